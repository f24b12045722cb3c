"""Importance resampling towards a target: documents whose hashed word runs look like the target's are drawn more often.

External sort-count. One pass hashes the word runs of every text to buckets and writes them as packed uint16 streams with
the documents' offsets. A second pass reads the streams alone, sorts each and adds up the lengths of its runs: the buckets'
counts. Their gains, one number a bucket, go back to the executors; a third pass gathers them along the streams and sums
each document's stretch with ``np.add.reduceat``. The draw is a top share of a global order by score, where the noise of a
score follows from the id, so the draw is a Gumbel top-k sample that can be repeated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.indexing import with_index
from .common import Stored, fresh
from .words import word_blocks

#: Buckets of features; a stream's entries have 16 bits.
BUCKETS = 10_000
#: Words in a feature at most.
LONGEST = 2
#: Features in a stream, unless one document has more.
STREAM = 1 << 20
#: Words from which a document can be drawn, and the share of those that is.
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
_STREAMS = "doc_id array<long>, tie array<long>, n_words array<long>, offsets array<long>, stream binary"


def feature_buckets(data: bytes, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[int, np.ndarray]:
    """Number of words, and the buckets of all runs of 1 to ``longest`` words, in no order of meaning. A run's hash goes on
    from the hash of the run that is a word shorter."""
    n_words, tail, found = 0, [], [np.zeros(0, "<u2")]
    for block in word_blocks(data):
        ws = tail + block
        sums = list(map(crc32, ws))
        for n in range(1, longest + 1):
            if n > 1:
                sums = list(map(crc32, ws[n - 1 :], map(crc32, repeat(b" "), sums)))
            new = sums[max(0, len(tail) - n + 1) :]  # runs that end in this block
            found.append((np.fromiter(new, np.uint32, len(new)) % buckets).astype("<u2"))
        n_words += len(block)
        tail = ws[1 - longest :] if longest > 1 else []
    return n_words, np.concatenate(found)


def bucket_streams(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """One row for about STREAM features: ids, text hashes and word counts of its documents, their offsets, the stream."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit in 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ties, words, offsets, parts = [], [], [], [0], []

        def flush() -> pa.RecordBatch:
            row = [[ids[:]], [ties[:]], [words[:]], [offsets[:]], [np.concatenate(parts).tobytes()]]
            for x in (ids, ties, words, parts):
                x.clear()
            offsets[:] = [0]
            kinds = [pa.list_(pa.int64())] * 4 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["doc_id", "tie", "n_words", "offsets", "stream"])

        for batch in batches:
            for i, tie, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                n, found = feature_buckets(data.as_py() or b"", buckets, longest)
                ids.append(i)
                ties.append(tie)
                words.append(n)
                parts.append(found)
                offsets.append(offsets[-1] + len(found))
                if offsets[-1] >= STREAM:
                    yield flush()
        if ids:
            yield flush()

    raw = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(raw).alias("tie"), raw.cast("binary").alias("text")).mapInArrow(run, _STREAMS)


def bucket_counts(streams: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the buckets that occur: each stream is sorted, the lengths of its runs are added up within the task,
    and a task hands on a row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0):
                ordered = np.sort(np.frombuffer(data.as_buffer(), "<u2"), kind="stable")
                heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)])
                totals[ordered[heads]] += np.diff(np.append(heads, len(ordered)))
        there = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(totals[there])], names=["bucket", "n"])

    return streams.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame, buckets: int) -> list[int]:
    out = [0] * buckets
    for r in counts.collect():  # a row a bucket
        out[r.bucket] = r.n
    return out


def bucket_gains(source: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 ln(ratio)) of each bucket's smoothed share in the target to that in the source."""
    k = len(source)
    s_all, t_all = float(sum(source) + k), float(sum(target) + k)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source, target, strict=True)], np.int64)


def document_weights(streams: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, tie, n_words, n_features, weight): the floored mean of the gains along each document's stretch, 0 if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, ties, words, offsets, data in zip(*batch.columns, strict=True):
                at = offsets.values.to_numpy()
                n = np.diff(at)
                sums = np.zeros(len(n), np.int64)
                if at[-1]:
                    sums[n > 0] = np.add.reduceat(gains[np.frombuffer(data.as_buffer(), "<u2")], at[:-1][n > 0])
                weight = sums // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([ids.values, ties.values, words.values, pa.array(n), pa.array(weight)], names=["doc_id", "tie", "n_words", "n_features", "weight"])

    return streams.mapInArrow(run, "doc_id long, tie long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) for a u that the id's digest gives; a null id counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.left(F.sha2(name.cast("binary"), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def importance(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, tie (a hash of the text), n_features, weight, score and rank of every row of ``docs``; rank 1, 2, ... for the
    drawn ``percent`` of the rows with ``least_words`` or more, by falling score, then id, then tie; null for the others.

    Null and empty texts have no feature and weight 0. A null id draws like an empty one and comes first among ties.
    Repeated rows each count. An empty target or an empty table gives no error: gains are then those of empty counts.
    """
    own = Stored(bucket_streams(docs, doc_id, text, buckets, longest), "bucket-streams")
    theirs = Stored(bucket_streams(target.select(F.lit(0).alias("id"), F.col(target_text).alias("words")), "id", "words", buckets, longest), "target-streams")
    gains = bucket_gains(_dense(bucket_counts(own.df, buckets), buckets), _dense(bucket_counts(theirs.df, buckets), buckets))
    theirs.drop()
    scored = document_weights(own.df, gains).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    rows = Stored(scored, "scores")
    own.drop()
    able = rows.df.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    out = ["doc_id", "tie", "n_features", "weight", "score"]
    ranked = with_index(able.select(*out), -F.col("score"), "doc_id", "tie", name="rank")
    ranked = ranked.select(*out, F.when(F.col("rank") < drawn, F.col("rank") + 1).alias("rank"))
    return ranked.unionByName(rows.df.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``importance`` draws, with all their columns. Rows that agree in id and text go together:
    they stay if one of them is drawn. Null ids can be drawn as well."""
    key, tie = fresh(docs, "key", "tie")
    same = lambda id_, t: (F.coalesce(id_.cast("long"), F.lit(-(1 << 63))), t)
    drawn = importance(docs, target, doc_id=doc_id, text=text, **options).where("rank is not null")
    k, t = same(F.col("doc_id"), F.col("tie"))
    drawn = drawn.select(k.alias(key), t.alias(tie)).distinct()
    k, t = same(F.col(doc_id), F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    return docs.withColumns({key: k, tie: t}).join(drawn, [key, tie], "left_semi").select(*docs.columns)
