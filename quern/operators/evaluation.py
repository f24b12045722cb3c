"""Accuracy, reports, running and batched means, contrastive loss."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, log_sum_exp


def answer_metrics(df: DataFrame, answer: str, truth: str, options: str) -> DataFrame:
    """One row: accuracy over all, precision over the answered (null if none), and the accuracy of guessing."""
    right = (F.lower(answer) == F.lower(truth)).cast("int")
    return df.agg(
        F.avg(right).alias("accuracy"), F.try_divide(F.sum(right), F.count_if(F.col(answer) != "?")).alias("precision"), F.avg(1 / F.col(options)).alias("baseline")
    )


def classification_report(df: DataFrame, truth: str, predicted: str, labels: list[int]) -> DataFrame:
    """label, precision, recall, f1, support for each of the fixed labels; 0 where a ratio isn't defined."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.createDataFrame([(x,) for x in labels], "label int")
    hit = F.sum(F.when((F.col("t") == F.col("label")) & (F.col("p") == F.col("label")), F.col("n")).otherwise(0))
    said, real = F.sum(F.when(F.col("p") == F.col("label"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("t") == F.col("label"), F.col("n")).otherwise(0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    counted = F.broadcast(spine).join(cells, (F.col("t") == F.col("label")) | (F.col("p") == F.col("label")), "left").groupBy("label").agg(hit.alias("hit"), said.alias("said"), real.alias("support"))
    scored = counted.select("label", zero(F.try_divide("hit", "said")).alias("precision"), zero(F.try_divide("hit", "support")).alias("recall"), F.coalesce("support", F.lit(0)).cast("long").alias("support"))
    return scored.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def report_averages(report: DataFrame) -> DataFrame:
    """Macro and support-weighted means of a report."""
    by = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0))
    names = ("precision", "recall", "f1")
    return report.agg(*(F.avg(c).alias(f"macro_{c}") for c in names), *(by(c).alias(f"weighted_{c}") for c in names), F.sum("support").alias("support"))


def running_mean(df: DataFrame, value: str, group: str, order: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running_mean", F.avg(value).over(w))


def mean_of_batch_means(df: DataFrame, value: str, batch: str) -> DataFrame:
    return df.groupBy(batch).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean"))


def batch_similarity(a: DataFrame, batch: str, index: str, left: str, right: str, scale: float = 1.0) -> DataFrame:
    """Scaled dot products of all left and right vectors within a batch; a batch is of a fixed, small size."""
    l = a.select(batch, F.col(index).alias("i"), F.col(left).alias("lv"))  # noqa: E741
    r = a.select(batch, F.col(index).alias("j"), F.col(right).alias("rv"))
    return l.join(r, batch).select(batch, "i", "j", (dot(F.col("lv"), F.col("rv")) * scale).alias("logit"))


def contrastive_loss(similarity: DataFrame, batch: str, both_sides: bool = True) -> DataFrame:
    """Mean cross-entropy of each row against its diagonal, by batch; with both sides the mean of rows and columns."""
    def side(own: str, other: str) -> DataFrame:
        rows = similarity.groupBy(batch, own).agg(F.array_sort(F.collect_list(F.struct(other, "logit"))).alias("l"), F.max(F.when(F.col(own) == F.col(other), F.col("logit"))).alias("hit"))
        return rows.select(batch, (log_sum_exp(F.transform("l", lambda x: x["logit"])) - F.col("hit")).alias("loss"))

    rows = side("i", "j").unionByName(side("j", "i")) if both_sides else side("i", "j")
    return rows.groupBy(batch).agg(F.avg("loss").alias("loss"))


def label_counts(df: DataFrame, label: str, labels: dict[str, int]) -> DataFrame:
    """One row: rows of each named label, and all."""
    return df.agg(*(F.count_if(F.col(label) == v).alias(k) for k, v in labels.items()), F.count(F.lit(1)).alias("total"))


def all_finished(df: DataFrame, group: str, finished: str) -> DataFrame:
    return df.groupBy(group).agg(F.bool_and(finished).alias("finished"))


def counted_filter(df: DataFrame, keep) -> DataFrame:
    """One row: rows before a filter, after it, and dropped by it (a null condition drops)."""
    return df.agg(F.count(F.lit(1)).alias("before"), F.count_if(keep).alias("after")).withColumn("dropped", F.col("before") - F.col("after"))


def observed_filter(df: DataFrame, keep) -> tuple[DataFrame, Observation, Observation]:
    """The kept rows, and the observations ``before`` and ``after`` that the first job over them fills: a filter's counts
    without a pass of their own (a null condition drops)."""
    seen, left = Observation(), Observation()
    kept = df.observe(seen, F.count(F.lit(1)).alias("before")).where(keep).observe(left, F.count(F.lit(1)).alias("after"))
    return kept, seen, left


def expert_accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Mean of equality."""
    return df.agg(F.avg((F.col(truth) == F.col(predicted)).cast("int")).alias("accuracy"))
