"""Removal of repeated byte strings by induced sorting of sampled suffixes, spread over shards.

A byte goes when a 100-byte string that covers it also starts earlier. Sorting every suffix of a corpus would carry far
more than the corpus, so, as induced sorting does, a sample of suffixes is sorted and the rest is induced from it:

1. Sample: the anchor of a 100-byte window is its leftmost 32-byte gram of least hash. Equal windows have equal anchors at
   equal offsets, and neighbouring windows mostly share theirs. Grams found once end there: their windows are unique.
2. Equal contexts of one gram are one suffix tuple; only the first is sorted on, later ones are repeats already.
3. Tuples go to shards by gram. Spark's external sort (spilled runs merged by a priority queue) delivers each shard in the
   order of the suffixes at its anchors, and common-prefix values of neighbours are taken from the bytes.
4. Induction: from the order of suffixes that start d bytes before their anchors, the order for d + 1 follows by a stable
   sort on the byte put in front; the common prefix of two is one more than the least value between them. Runs with a
   common prefix of 100 are equal windows: all but the earliest start are repeats.

A gram with more contexts than a shard should hold at once is split by the windows themselves, which group by content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, fresh, restrict

LENGTH = 100
GRAM = 32
#: Repeated grams that are broadcast as a map-side filter; beyond it the join shuffles.
BROADCAST_GRAMS = 2_000_000
#: Contexts of one gram that are sorted together; grams with more are split by their windows.
GROUP = 20_000
#: Rows that a task induces at once, in whole grams.
BLOCK = 30_000
_SEGMENT = 1 << 22
_LOWEST = -(1 << 63)
ANCHORS = "gram long, context long, doc long, tag long, spot long"


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(gram hash, position, first window, last window) of every anchor of the bytes; ``gram`` is a power of two."""
    parts = []
    for at in range(0, max(1, len(data) - length + 1), _SEGMENT):
        x = data[at : at + _SEGMENT + length - 1]
        if len(x) < length:
            break
        h, step, mult = _table(7)[x], 1, 0x9E3779B97F4A7C15
        while step < gram:
            h = h[:-step] * np.uint64(mult) + h[step:]
            step, mult = 2 * step, mult * mult % (1 << 64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        low = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        width, span = length - gram + 1, 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        pos = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
        ends = np.concatenate([starts[1:], [len(pos)]]) - 1
        parts.append((h[pos[starts]].view(np.int64), pos[starts] + at, starts + at, ends + at))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 4


def _anchor_rows(work: DataFrame, only_grams: bool) -> DataFrame:
    """Rows of ANCHORS; ``spot`` packs position, and the distances to the first and last window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(5)]
            for doc, tag, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = t.as_buffer().to_pybytes()
                g, p, first, last = anchors(np.frombuffer(raw, np.uint8))
                cols[0].append(g)
                if not only_grams:
                    spot = p << 16 | (p - first) << 8 | (p - last)
                    cols[1].append(np.fromiter((xxhash.xxh3_64_intdigest(raw[a : b + LENGTH], q) for a, b, q in zip(first.tolist(), last.tolist(), (spot & 0xFFFF).tolist(), strict=True)), np.uint64, len(p)).view(np.int64))
                    cols[2].append(np.full(len(p), doc, np.int64))
                    cols[3].append(np.full(len(p), tag, np.int64))
                    cols[4].append(spot)
            if cols[0]:
                for at in range(0, 1 if only_grams else 5):
                    cols[at] = np.concatenate(cols[at])
                if only_grams:
                    g, n = np.unique(cols[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], names=["gram", "n"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["gram", "context", "doc", "tag", "spot"])

    return work.select("doc", "tag", "bytes").mapInArrow(run, "gram long, n long" if only_grams else ANCHORS)


def induce(gram: np.ndarray, order: np.ndarray, left: np.ndarray, right: np.ndarray, near: np.ndarray, far: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """repeat[i, d]: the window that starts d bytes before anchor i has an equal one that starts earlier.

    Rows are sorted by (gram, right): bytes from the anchor on. ``left[i, j]`` is the byte j + 1 places before the anchor,
    ``near`` and ``far`` bound the d of the windows whose anchor this is, ``order`` ranks the rows' starts.
    """
    m, most = len(gram), left.shape[1]
    repeat = np.zeros((m, most + 1), dtype=bool)
    if m < 2:
        return repeat
    common = np.zeros(m, dtype=np.uint8)  # common prefix of row i and the row before it
    equal = (right[1:] == right[:-1]) & (gram[1:] == gram[:-1])[:, None]
    common[1:] = np.where(equal.all(axis=1), right.shape[1], equal.argmin(axis=1))
    least = [common]  # least[k][i]: over 2^k values from i on
    while 2 << len(least) - 1 <= m:
        half = 1 << len(least) - 1
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))
    rows = np.arange(m)
    kind = np.concatenate([[0], np.cumsum(gram[1:] != gram[:-1])])
    for d in range(most + 1):
        # rows are in the order of suffixes that start d bytes before their anchors, kind numbers equal (gram, d bytes)
        keep = far[rows] >= d
        rows, kind = rows[keep], kind[keep]
        if len(rows) < 2:
            break
        same = kind[1:] == kind[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        rows, kind = rows[keep], kind[keep]
        if len(rows) < 2:
            break
        a, b = rows[:-1], rows[1:]
        tied = kind[1:] == kind[:-1]
        span = np.where(tied, b - a, 1)
        level = np.frexp(span)[1] - 1
        value = np.zeros(len(a), dtype=np.int64)
        for k in np.unique(level[tied]):
            at = np.flatnonzero(tied & (level == k))
            value[at] = np.minimum(least[k][a[at] + 1], least[k][b[at] + 1 - (1 << k)])
        inside = near[rows] <= d
        equal = tied & (value + d >= length)
        heads = np.flatnonzero(np.concatenate([[True], ~equal]))
        first = np.minimum.reduceat(np.where(inside, order[rows], np.iinfo(np.int64).max), heads)
        first = np.repeat(first, np.diff(np.concatenate([heads, [len(rows)]])))
        repeat[rows, d] = inside & (order[rows] > first)
        if d < most:
            key = kind * 256 + left[rows, d]
            turn = np.argsort(key, kind="stable")
            rows, key = rows[turn], key[turn]
            kind = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    return repeat


def _induced(edges: DataFrame) -> DataFrame:
    """(doc, tag, start, end) of repeated bytes among contexts (gram, doc, tag, spot, bytes) sorted by (gram, right)."""

    def block(t: pa.Table) -> pa.RecordBatch:
        spot, gram = t["spot"].to_numpy(), t["gram"].to_numpy()
        pos, far, near = spot >> 16, spot >> 8 & 255, spot & 255
        m, most = len(gram), int(far.max())
        left, right = np.zeros((m, most), np.uint8), np.zeros((m, LENGTH), np.uint8)
        for i, (b, f) in enumerate(zip(t["bytes"].to_pylist(), far.tolist(), strict=True)):
            x = np.frombuffer(b, np.uint8)
            left[i, :f] = x[:f][::-1]
            right[i, : len(x) - f] = x[f:]
        doc, tag = t["doc"].to_numpy(), t["tag"].to_numpy()
        order = np.empty(m, np.int64)
        order[np.lexsort((pos, tag, doc))] = np.arange(m)
        repeat = induce(gram, order, left, right, near, far)
        row, d = np.nonzero(repeat)
        if not len(row):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, names=["doc", "tag", "start", "end"])
        cut = np.concatenate([[True], (row[1:] != row[:-1]) | (d[1:] != d[:-1] + 1)])
        heads = np.flatnonzero(cut)
        tails = np.concatenate([heads[1:], [len(row)]]) - 1
        r = row[heads]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (doc[r], tag[r], pos[r] - d[tails], pos[r] - d[heads] + LENGTH)], names=["doc", "tag", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows >= BLOCK:
                gram = held["gram"].to_numpy()
                whole = int(np.searchsorted(gram, gram[-1]))
                if whole:
                    yield block(held.slice(0, whole).combine_chunks())
                    held = held.slice(whole).combine_chunks()
        if held is not None and held.num_rows:
            yield block(held.combine_chunks())

    return edges.select("gram", "doc", "tag", "spot", "bytes").mapInArrow(run, "doc long, tag long, start long, end long")


def _windows(hot: DataFrame) -> DataFrame:
    """The same for grams with very many contexts: every window is a row, grouped by content with partial aggregation."""
    each = hot.select("doc", "tag", "bytes", F.expr("shiftright(spot, 16) - (shiftright(spot, 8) & 255)").alias("at"), F.expr("explode(sequence(0, cast((shiftright(spot, 8) & 255) - (spot & 255) as int)))").alias("i")).select(
        F.unhex(F.sha2(F.substring("bytes", F.col("i") + 1, F.lit(LENGTH)), 256)).alias("window"), F.struct("doc", "tag", (F.col("at") + F.col("i")).alias("start")).alias("spot")
    )
    each = Stored(each, "windows").df
    first = Stored(each.groupBy("window").agg(F.min("spot").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("window", "first"), "first-windows").df
    return each.join(first, "window").where("spot <> first").select("spot.doc", "spot.tag", "spot.start", (F.col("spot.start") + LENGTH).alias("end"))


def _contexts(edges: DataFrame, work: DataFrame) -> DataFrame:
    """Bytes of the contexts of stored edges (gram, doc, tag, spot): one join of their documents' texts."""
    lists = Stored(edges.groupBy("doc", "tag").agg(F.collect_list(F.struct("gram", "spot")).alias("l")), "edges-by-doc").df
    texts = restrict(work, Stored(lists.select("doc").distinct(), "edge-docs").df, "doc")
    cut = texts.join(lists.hint("shuffle_merge"), ["doc", "tag"]).select("doc", "tag", "bytes", F.explode("l").alias("x")).select("doc", "tag", "bytes", "x.gram", "x.spot")
    first = F.expr("cast(shiftright(spot, 16) - (shiftright(spot, 8) & 255) as int)")
    return cut.select("gram", "doc", "tag", "spot", F.substring("bytes", first + 1, F.expr(f"cast((shiftright(spot, 8) & 255) - (spot & 255) + {LENGTH} as int)")).alias("bytes"))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group: int = GROUP, broadcast_grams: int = BROADCAST_GRAMS) -> tuple[DataFrame, DataFrame]:
    """(heads, spans). heads: doc, tag, n_bytes, sha, copy for every row (copy: its whole text stands earlier).
    spans: doc, tag, starts, ends of repeated bytes, not merged, of rows that aren't copies."""
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LOWEST)).alias("doc"), F.xxhash64(raw).alias("tag"), raw.cast("binary").alias("bytes"))
    seen = Stored(rows.select("doc", "tag", F.octet_length("bytes").cast("long").alias("n_bytes"), F.sha2("bytes", 256).alias("sha")).groupBy("doc", "tag", "n_bytes", "sha").agg(F.count(F.lit(1)).alias("n")), "heads").df
    leads = Stored(seen.groupBy("sha").agg(F.min("doc").alias("lead"), F.sum("n").alias("rows")).where("rows > 1").select("sha", "lead"), "leads").df
    heads = seen.join(leads.hint("shuffle_merge"), "sha", "left").withColumn("copy", F.coalesce(F.col("doc") != F.col("lead"), F.lit(False))).drop("lead")
    heads = Stored(heads, "copies").df
    work = rows.where(F.octet_length("bytes") >= LENGTH)
    copies = Stored(heads.where("copy").select("doc", "tag"), "copied").df
    few = copies.count() <= 1_000_000
    work = work.join(F.broadcast(copies) if few else copies.hint("shuffle_merge"), ["doc", "tag"], "left_anti")
    if heads.agg(F.max("n")).first()[0] not in (None, 1):  # repeated rows of one document
        work = Stored(work.dropDuplicates(["doc", "tag"]), "work").df
    grams = Stored(_anchor_rows(work, True).groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram"), "grams").df
    found = Stored(restrict(_anchor_rows(work, False), grams, "gram", broadcast_grams), "found").df
    firsts = Stored(found.groupBy("gram", "context").agg(F.min(F.struct("doc", "tag", "spot")).alias("first")), "contexts").df
    first_start = lambda c: F.expr(f"shiftright({c}, 16) - (shiftright({c}, 8) & 255)")
    last_end = lambda c: F.expr(f"shiftright({c}, 16) - ({c} & 255) + {LENGTH}")
    later = found.join(firsts.hint("shuffle_merge"), ["gram", "context"]).where(F.struct("doc", "tag", "spot") != F.col("first")).select("doc", "tag", first_start("spot").alias("start"), last_end("spot").alias("end"))
    many = Stored(firsts.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "many").df
    edges = firsts.join(many.hint("shuffle_merge"), "gram").select("gram", "first.doc", "first.tag", "first.spot", (F.col("n") > group).alias("hot"))
    edges = Stored(edges, "edges").df
    any_hot = not edges.where("hot").isEmpty()
    calm = _contexts(edges.where("not hot"), work)
    n = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    suffix = F.expr("substring(bytes, cast((shiftright(spot, 8) & 255) as int) + 1)")
    parts = [later, _induced(calm.withColumn("suffix", suffix).repartition(n, "gram").sortWithinPartitions("gram", "suffix"))]
    if any_hot:
        parts.append(_windows(_contexts(edges.where("hot"), work)))
    spans = parts[0]
    for p in parts[1:]:
        spans = spans.unionByName(p)
    spans = spans.groupBy("doc", "tag").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    return heads, Stored(spans, "spans").df


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the half-open spans."""
    turn = np.argsort(starts, kind="stable")
    s, e = np.asarray(starts)[turn], np.maximum.accumulate(np.asarray(ends)[turn])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    heads = np.flatnonzero(new)
    return s[heads], e[np.concatenate([heads[1:], [len(s)]]) - 1]


def _left(raw: bytes, starts, ends) -> tuple[bytes, int, int]:
    s, e = merge_spans(np.asarray(starts), np.asarray(ends))
    cut = np.concatenate([[0], np.column_stack([s, e]).ravel(), [len(raw)]])
    return b"".join(raw[a:b] for a, b in cut.reshape(-1, 2).tolist()), int((e - s).sum()), len(s)


def digest_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Null texts are empty; texts under 100 bytes lose nothing. Null ids come before all others; rows that share an id are
    ordered by a hash of their text, and of equal rows one is the first. An empty table gives no rows.
    """
    heads, spans = repeated_spans(docs, doc_id, text, **options)
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LOWEST)).alias("doc"), F.xxhash64(raw).alias("tag"), raw.cast("binary").alias("bytes"))
    cut = restrict(rows, Stored(spans.select("doc").distinct(), "span-docs").df, "doc").join(spans.hint("shuffle_merge"), ["doc", "tag"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_left(b, s, e) for b, s, e in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            cols = [pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([hashlib.sha256(x[0]).hexdigest() for x in out], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["doc", "tag", "removed", "spans", "kept"])

    done = Stored(cut.select("doc", "tag", "bytes", "starts", "ends").mapInArrow(run, "doc long, tag long, removed long, spans long, kept string").dropDuplicates(["doc", "tag"]), "removed").df
    every = heads.withColumn("nth", F.explode(F.expr("sequence(1, cast(n as int))"))).join(done.hint("shuffle_merge"), ["doc", "tag"], "left")
    gone = (F.col("copy") | (F.col("nth") > 1)) & (F.col("n_bytes") >= LENGTH)
    pick = lambda full, own, none: F.when(gone, full).when(F.col("removed").isNotNull(), own).otherwise(none)
    return every.select(
        F.when(F.col("doc") != _LOWEST, F.col("doc")).alias("doc_id"),
        "n_bytes",
        pick(F.col("n_bytes"), F.col("removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.sha2(F.lit(b""), 256), F.col("kept"), F.col("sha")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without their repeated bytes; what is left of a cut character goes too. Rows left without text go.
    Texts under 100 bytes, null and empty ones stay. Null ids come first, texts under one id are ordered by a hash, and of
    equal rows of 100 bytes or more one stays. All columns stay, whatever they are called; an empty table gives no rows."""
    heads, spans = repeated_spans(docs, doc_id, text, **options)
    names = fresh(docs, "doc", "tag", "copy", "starts", "ends", "nth")
    doc, tag, copy, starts, ends, nth = names
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn(doc, F.coalesce(F.col(doc_id).cast("long"), F.lit(_LOWEST))).withColumn(tag, F.xxhash64(raw))
    known = heads.select("doc", "tag", "copy", "n").join(spans.hint("shuffle_merge"), ["doc", "tag"], "left")
    known = Stored(known.where("copy or starts is not null or n > 1"), "cuts").df
    several = not known.where("n > 1").isEmpty()
    known = known.select(F.col("doc").alias(doc), F.col("tag").alias(tag), F.col("copy").alias(copy), F.col("starts").alias(starts), F.col("ends").alias(ends))

    @F.pandas_udf("string")
    def cut(t: pd.Series, s: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([_left(x.encode(), a, b)[0].decode(errors="ignore") if a is not None else x for x, a, b in zip(t, s, e, strict=True)], dtype=object)

    out = rows.join(known.hint("shuffle_merge"), [doc, tag], "left")
    if several:
        from pyspark.sql import Window

        out = out.withColumn(nth, F.row_number().over(Window.partitionBy(doc, tag).orderBy(doc)))
        out = out.withColumn(copy, F.coalesce(copy, F.lit(False)) | (F.col(nth) > 1))
    out = out.where(~(F.coalesce(copy, F.lit(False)) & (F.octet_length(raw) >= LENGTH)))
    untouched = out.where(F.col(starts).isNull()).select(*docs.columns)
    changed = out.where(F.col(starts).isNotNull()).withColumn(text, cut(raw, F.col(starts), F.col(ends))).where(F.col(text) != "").select(*docs.columns)
    return untouched.unionByName(changed)
