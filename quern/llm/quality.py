"""Host-level quality rules: failure rates per host, shrunk by an empirical beta prior, joined back to documents.

Everything is built-in column functions, so the whole path stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Stored, let, words_of

#: Fixed values of the base rule.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: A host is rejected when the shrunk failure rate of any one rule is above this.
MAX_HOST_RATE = 0.5
#: Rules that are judged by host: name and failing condition over the base columns.
HOST_RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
}
#: Columns that judge adds.
MADE = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected", "kept")
#: Rejected hosts are broadcast up to this many; beyond it a salted shuffle join is used.
BROADCAST_HOSTS = 200_000
#: Hosts with more than 1/HOT_PARTS of the rows are salted in that join; there are fewer than HOT_PARTS of them.
HOT_PARTS = 200
SALTS = 512
_POS = 28  # bits of a packed (hash, position) long that hold the position


def _covered(starts: Column) -> Column:
    """Words covered by 3-word windows that start at the sorted positions."""
    n = F.size(starts)
    gaps = F.zip_with(F.slice(starts, 2, F.greatest(n - 1, F.lit(0))), F.slice(starts, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
    return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda s, g: s + g))


def _repeated(sorted_keys: Column, key, take) -> Column:
    """``take`` of the elements of a sorted array whose ``key`` equals a neighbour's."""
    n = F.size(sorted_keys)
    kept = F.filter(
        F.transform(
            sorted_keys,
            lambda x, i: F.when(
                ((i > 0) & (key(F.get(sorted_keys, i - 1)) == key(x))) | ((i < n - 1) & (key(F.get(sorted_keys, i + 1)) == key(x))),
                take(x),
            ),
        ),
        lambda p: p.isNotNull(),
    )
    return F.sort_array(kept)


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows found twice or more. Windows are first sorted by packed 36-bit hashes as plain longs;
    only the few whose hash repeats are compared by their words, so the count is exact."""

    def of(ws: Column) -> Column:
        packed = F.transform(
            F.slice(ws, 1, F.size(ws) - 2),
            lambda w, i: F.shiftleft(F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)), _POS).bitwiseOR(i.cast("long")),
        )
        mask = F.lit((1 << _POS) - 1)
        candidates = let(
            F.sort_array(packed),
            lambda keys: _repeated(keys, lambda k: F.shiftright(k, _POS), lambda k: k.bitwiseAND(mask).cast("int")),
        )
        exact = lambda at: let(
            F.sort_array(
                F.transform(at, lambda p: F.struct(F.concat_ws(" ", F.get(ws, p), F.get(ws, p + 1), F.get(ws, p + 2)).alias("w"), p.alias("p")))
            ),
            lambda ks: _repeated(ks, lambda k: k["w"], lambda k: k["p"]),
        )
        counted = let(candidates, lambda at: F.when(F.size(at) == 0, F.lit(0)).otherwise(let(exact(at), _covered)))
        return F.when(F.size(ws) < 4, F.lit(0)).otherwise(counted)

    return let(words, of)


def base_stats(text: Column) -> Column:
    """Struct of the base counts of one text. Null and empty texts have zero of everything."""
    text = F.coalesce(text, F.lit(""))

    def lines_struct(lines: Column) -> Column:
        full = F.filter(lines, lambda x: F.translate(x, SPACES, "") != "")
        return let(full, lambda ls: F.struct(F.size(ls).cast("long").alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup")))

    def of(t: Column) -> Column:
        return F.struct(
            F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            lines_struct(F.split(t, "\n")).alias("lines"),
            let(words_of(t), lambda ws: F.struct(F.size(ws).cast("long").alias("n"), repeat_words(ws).cast("long").alias("rep"))).alias("words"),
        )

    return let(text, of)


def with_base(rows: DataFrame, text: str = "text") -> DataFrame:
    """host and row of ``rows`` plus the base columns of row.``text``."""
    df = rows.select("host", "row", base_stats(F.col(f"row.{text}")).alias("stats")).select(
        "host", "row",
        F.col("stats.words.n").alias("n_words"),
        F.col("stats.word_chars").alias("word_chars"),
        F.col("stats.n_symbols").alias("n_symbols"),
        F.col("stats.lines.n").alias("n_lines"),
        F.col("stats.lines.dup").alias("n_dup_lines"),
        F.col("stats.words.rep").alias("n_repeat_words"),
    )
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_rates(stats: DataFrame, rules: dict[str, str] = HOST_RULES, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: documents, and for each rule its failures and its rate shrunk towards the hosts' common rate.

    The beta prior's mean m and strength k come from the hosts by the method of moments: with p_h = f_h / n_h,
    m = sum f / sum n and v = the document-weighted variance of p_h less what sampling adds to it, H m (1 - m) / sum n for
    H hosts, k = m (1 - m) / v - 1, held to 1 .. 10,000 documents (10,000 where sampling explains all of the variance).
    The shrunk rate is (f_h + k m) / (n_h + k). Partial aggregation runs before the shuffle, so a hot host is one row a task.
    """
    fails = stats.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.expr(c)).alias(f"f_{r}") for r, c in rules.items()))
    fails = fails.where(F.col("host").isNotNull())
    mean = fails.agg(*(F.expr(f"try_divide(sum(f_{r}), sum(n))").alias(f"m_{r}") for r in rules))
    spread = fails.crossJoin(F.broadcast(mean)).agg(
        *(F.first(f"m_{r}").alias(f"m_{r}") for r in rules),
        *(F.expr(f"greatest(try_divide(sum(n * pow(f_{r} / n - m_{r}, 2)) - count(*) * first(m_{r}) * (1 - first(m_{r})), sum(n)), 0D)").alias(f"v_{r}") for r in rules),
    )
    strength = spread.select(
        *(F.col(f"m_{r}") for r in rules),
        *(F.expr(f"least(10000D, greatest(1D, coalesce(try_divide(m_{r} * (1 - m_{r}), v_{r}) - 1, 10000D)))").alias(f"k_{r}") for r in rules),
    )  # one row
    rates = fails.crossJoin(F.broadcast(strength)).select(
        "host", "n", *(f"f_{r}" for r in rules), *(F.expr(f"(f_{r} + k_{r} * m_{r}) / (n + k_{r})").alias(f"rate_{r}") for r in rules)
    )
    return rates.withColumn("host_rejected", F.greatest(*(F.col(f"rate_{r}") for r in rules), F.lit(0.0)) > max_rate)


def _judged(docs: DataFrame, text: str, host: str, keep: list[str], rules: dict[str, str], max_rate: float, broadcast_hosts: int) -> DataFrame:
    """row (a struct of the ``keep`` columns and the text) and the columns MADE: apart, so that no name of ``docs`` clashes."""
    rows = docs.select(docs[host].cast("string").alias("host"), F.struct(*(docs[c] for c in dict.fromkeys([*keep, text]))).alias("row"))
    based = with_base(rows, text)
    if text not in keep:
        based = based.withColumn("row", F.struct(*(F.col(f"row.{c}").alias(c) for c in keep)))
    stats = Stored(based, "quality").df
    rejected = Stored(host_rates(stats, rules, max_rate).where("host_rejected").select("host", "host_rejected"), "hosts").df
    if rejected.count() <= broadcast_hosts:
        out = stats.join(F.broadcast(rejected), "host", "left")
    else:
        out = _salted(stats, rejected)
    out = out.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None, rules: dict[str, str] = HOST_RULES, max_rate: float = MAX_HOST_RATE, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """The ``keep`` columns of ``docs`` (all of them by default) and the columns MADE.

    Null texts count as empty and so fail the base rule; a document without a host has no host verdict. Repeated rows
    stay, each judged alike. A kept column that is called like one of MADE is an error: leave it out, or take ``accepted``.
    An empty table gives an empty result.
    """
    keep = docs.columns if keep is None else keep
    clash = sorted({c for c in keep if c.lower() in MADE})
    if clash:
        raise ValueError(f"columns have names of the result: {', '.join(clash)}")
    return _judged(docs, text, host, keep, rules, max_rate, broadcast_hosts).select(*(F.col(f"row.{c}").alias(c) for c in keep), *MADE)


def accepted(docs: DataFrame, text: str = "text", host: str = "source", rules: dict[str, str] = HOST_RULES, max_rate: float = MAX_HOST_RATE, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """The rows of ``docs`` that judge keeps, with their own columns whatever they are called."""
    return _judged(docs, text, host, docs.columns, rules, max_rate, broadcast_hosts).where("kept").select("row.*")


def _salted(stats: DataFrame, rejected: DataFrame) -> DataFrame:
    """Left join on host that spreads hosts with over 1 / HOT_PARTS of the rows; by pigeonhole they are fewer than HOT_PARTS."""
    total = stats.count()
    hot = stats.groupBy("host").count().where(F.col("count") * HOT_PARTS > total).select("host", F.lit(True).alias("hot"))
    spread = F.when(F.col("host").isNull() | F.coalesce("hot", F.lit(False)), F.floor(F.rand(7) * SALTS).cast("int")).otherwise(F.lit(0))
    left = stats.join(F.broadcast(hot), "host", "left").withColumn("salt", spread).drop("hot")
    right = rejected.join(F.broadcast(hot), "host", "left").select(
        "host", "host_rejected", F.explode(F.when(F.coalesce("hot", F.lit(False)), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    )
    return left.join(right, ["host", "salt"], "left").drop("salt")
