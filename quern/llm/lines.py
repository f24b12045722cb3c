"""Removal of repeated runs of lines: prefix doubling over sequences of line ids.

The suffix starting at a line is ranked by its first 1, 2, 4, ... lines. One round joins the rank at a line with the rank
h lines on, groups equal pairs (an interval of the suffix array whose common prefix is 2h lines or more) and names the
group by its first position. Groups of one suffix end there: no longer run through them repeats. The last round overlaps
two ranks to reach the wanted length exactly. In each interval all suffixes but the first are later copies; their runs
together are the maximal repeated runs, and go. Where content decides as well, repeats shorter than the wanted length are
taken from the rounds before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, Stored, fresh, let

#: Lines of a run that counts as repeated whatever its content.
RUN = 3
#: Bytes from which a shorter run counts as well where content decides: as long as the strings of operator 7.
LEAST_BYTES = 100
_LOWEST = -(1 << 63)
_HAS_WORD = lambda x: F.translate(x, SPACES, "") != ""


def _ranked(keyed: DataFrame, tag: str) -> DataFrame:
    """(doc, tag, k, rank) of the rows whose key stands at two positions or more; rank is the key's first position. Other columns stay."""
    groups = Stored(keyed.groupBy("key").agg(F.min(F.struct("doc", "tag", "k")).alias("rank"), F.max(F.struct("doc", "tag", "k")).alias("last")).where("rank <> last").select("key", "rank"), f"{tag}-groups").df
    return Stored(keyed.join(groups.hint("shuffle_merge"), "key").drop("key"), tag).df


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, least_bytes: int | None = None) -> DataFrame:
    """(doc, tag, gone): sorted positions, among the lines with a word, of the lines to remove in each text.

    Repeated runs of ``run`` lines or more go. With ``least_bytes``, repeated runs of fewer lines go as well, from one line
    up, if their lines have so many bytes together; the length then grows by one line a round, so that none is passed over.
    Null and empty texts have no lines. Null ids come first, texts under one id are ordered by a hash, rows that agree in
    both are one document; texts and lines may be of any length. An empty table gives no rows.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    sizes = [] if least_bytes is None else ["line_size", "size"]
    lines = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(_LOWEST)).alias("doc"), F.xxhash64(raw).alias("tag"), F.posexplode(F.filter(F.split(raw, "\n"), _HAS_WORD)).alias("k", "line")
    ).select("doc", "tag", "k", *(F.octet_length("line").cast("long").alias(c) for c in sizes), F.unhex(F.sha2(F.col("line").cast("binary"), 256)).alias("key"))
    is_later = F.struct("doc", "tag", "k") != F.col("rank")
    cover = lambda rows, n: rows.where(is_later).select("doc", "tag", F.explode(F.sequence(F.col("k"), F.col("k") + (n - 1))).alias("k"))
    ranks, have, short = _ranked(lines, "lines"), 1, []
    while have < run:
        if sizes:
            short.append(cover(ranks.where(F.col("size") >= least_bytes), have))
        ahead = 1 if sizes else min(have, run - have)
        there = Window.partitionBy("doc", "tag").orderBy("k").rangeBetween(ahead, ahead)
        pairs = ranks.withColumn("next", F.max("rank").over(there))
        if sizes:  # the run's first line and what follows it
            pairs = pairs.withColumn("size", F.col("line_size") + F.max("size").over(there))
        pairs = pairs.where("next is not null").select("doc", "tag", "k", *sizes, F.struct("rank", "next").alias("key"))
        ranks, have = _ranked(pairs, "runs"), have + ahead
    later = cover(ranks, run)
    for rows in short:
        later = later.unionByName(rows)
    return Stored(later.groupBy("doc", "tag").agg(F.sort_array(F.collect_set("k")).alias("gone")), "gone").df


def _kept_text(raw, gone):
    """Lines that stay: a line without a word always does. Places of lines are set off against each other as sets of
    integers, so the work is linear in the lines and in the removed ones."""

    def of(lines):
        worded = F.filter(F.transform(lines, lambda x, i: F.when(_HAS_WORD(x), i)), lambda i: i.isNotNull())
        removed = let(worded, lambda at: F.transform(gone, lambda k: F.get(at, k)))
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    return let(F.split(raw, "\n"), of)


def _with_gone(docs: DataFrame, doc_id: str, text: str, run: int, least_bytes: int | None) -> tuple[DataFrame, str]:
    names = doc, tag, gone = fresh(docs, "doc", "tag", "gone")
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn(doc, F.coalesce(F.col(doc_id).cast("long"), F.lit(_LOWEST))).withColumn(tag, F.xxhash64(raw))
    cuts = removed_lines(docs, doc_id, text, run, least_bytes).toDF(*names)
    return rows.join(cuts.hint("shuffle_merge"), [doc, tag], "left").drop(doc, tag), gone


def digest_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, least_bytes: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed_lines, n_runs, kept_sha256 of every row.

    n_lines counts lines with a word; runs are taken over those, so blank lines neither count nor go. Null and empty texts
    have none. Null ids come first, texts that share an id are ordered by a hash, and equal rows count as one document.
    """
    rows, gone = _with_gone(docs, doc_id, text, run, least_bytes)
    raw = F.coalesce(F.col(text), F.lit(""))
    n = F.coalesce(F.size(gone), F.lit(0))
    heads = F.size(F.filter(F.transform(gone, lambda k, i: (i == 0) | (F.get(gone, i - 1) != k - 1)), lambda x: x))
    return rows.select(
        F.col(doc_id).alias("doc_id"),
        F.size(F.filter(F.split(raw, "\n"), _HAS_WORD)).cast("long").alias("n_lines"),
        F.when(F.col(gone).isNull(), 0).otherwise(n).cast("long").alias("n_removed_lines"),
        F.when(F.col(gone).isNull(), 0).otherwise(heads).cast("long").alias("n_runs"),
        F.sha2(F.when(F.col(gone).isNull(), raw).otherwise(_kept_text(raw, F.col(gone))).cast("binary"), 256).alias("kept_sha256"),
    )


def remove_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, least_bytes: int | None = None) -> DataFrame:
    """``docs`` without later copies of repeated line runs (see removed_lines); rows of which no word is left go.
    Rows that lose no line stay as they are, null and empty texts among them; all columns stay, whatever they are called."""
    rows, gone = _with_gone(docs, doc_id, text, run, least_bytes)
    raw = F.coalesce(F.col(text), F.lit(""))
    changed = rows.withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(_kept_text(raw, F.col(gone))))
    return changed.where(F.col(gone).isNull() | _HAS_WORD(F.coalesce(F.col(text), F.lit("")))).select(*docs.columns)
