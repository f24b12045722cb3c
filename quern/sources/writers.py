"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import fresh
from .files import write_files
from .scratch import hadoop


def write_parquet(df: DataFrame, path: str, files: int | None = None) -> None:
    (df.repartition(files) if files else df).write.mode("overwrite").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are written."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def append_generations(df: DataFrame, path: str, index: str, text: str) -> None:
    """Lines of the form ``index. text``."""
    df.select(F.concat(F.col(index).cast("string"), F.lit(". "), F.col(text)).alias("value")).write.mode("append").text(path)


def write_answers(df: DataFrame, path: str, answer: str, order: str, *ties: str, line: int = 1 << 16) -> None:
    """One character a row in the order given, ``line`` of them to a line of text; the files of the folder in the order of
    their names have them all. A line is what a task gathers; an answer that isn't one character is an error."""
    from ..operators.indexing import with_index

    (i,) = fresh(df, "i")
    numbered = with_index(df, F.col(order), *ties, name=i)
    one = F.when(F.length(answer) == 1, F.col(answer)).otherwise(F.raise_error(F.lit("an answer is one character")).cast("string"))
    listed = F.array_sort(F.collect_list(F.struct(F.col(i), one.alias("a"))))
    lines = numbered.groupBy(F.floor(F.col(i) / line).alias("line")).agg(F.array_join(F.transform(listed, lambda x: x["a"]), "").alias("value"))
    lines.repartitionByRange("line").sortWithinPartitions("line").select("value").write.mode("overwrite").text(path)


def append_metrics(spark: SparkSession, path: str, step: int, metrics: dict[str, float]) -> None:
    """A row for each metric of a step."""
    rows = [(step, k, float(v)) for k, v in metrics.items()]
    spark.createDataFrame(rows, "step long, metric string, value double").coalesce(1).write.mode("append").parquet(path)


def write_images(rows: DataFrame, folder: str) -> DataFrame:
    """Write encoded images (path, bytes) below ``folder``; returns the failures (see write_files)."""
    return write_files(rows, folder)


def resume_point(spark: SparkSession, folder: str, overwrite: bool = False) -> str | None:
    """Name of the last ``checkpoint-N`` in an output folder, None where a run starts anew; a folder with other content
    only is an error unless it may be overwritten."""
    files, at = hadoop(spark, folder)
    if overwrite or not files.exists(at):
        return None
    names = [f.getPath().getName() for f in files.listStatus(at)]
    found = [n for n in names if n.startswith("checkpoint-") and n[11:].isdigit()]
    if names and not found:
        raise ValueError(f"{folder} exists and is not empty")
    return max(found, key=lambda n: int(n[11:]), default=None)
