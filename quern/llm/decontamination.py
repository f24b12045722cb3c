"""Benchmark decontamination by suffix arrays over the words of the training documents.

The documents' regions, maximal stretches in which every pair of neighbouring words occurs in the benchmark as well, are
found in one pass with a bitmap of pair hashes. No match of a window crosses a region's end, so the filter is exact; what
its hashes let through besides is only searched in vain. A task gathers regions to a shard, sorts the shard's suffixes
(prefix doubling over word ids, as deep as the longest item) and binary-searches every suffix of the benchmark in that
array, one word deeper a step: the range after a window's words has all its locations, the deepest range that isn't empty
is the longest verbatim match. The benchmark goes to the tasks in blocks of bounded size; regions are few, so that further
blocks read little. Documents with a match are removed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, fresh
from .words import word_blocks

WINDOW = 10
#: Words of the benchmark in a block, which is sent to every task (an item with more is a block of its own).
BLOCK_WORDS = 250_000
#: Words of regions in a shard (a document with more is a shard of its own).
SHARD_WORDS = 1 << 20
#: Bits of the bitmap of pairs: 16 a pair, within these bounds (8 KB to 4 MB are sent to every task).
LEAST_BITS, MOST_BITS = 16, 25
_HITS = "uid long, spans array<struct<start:long,stop:long>>, items array<string>"
_LONGEST = "item_id string, at long, length long, uid long, start long, n long"


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * np.uint32(0x9E3779B1) + b


def _sums(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, ws), np.uint32, len(ws))


def item_words(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id, words, n, pairs, starts) of the items that have a word: hashes of neighbouring words, and of the first
    word if the item is shorter than a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ws = [w for block in word_blocks(data.as_py() or b"") for w in block]
                if ws:
                    sums = _sums(ws)
                    rows.append((name, b" ".join(ws), len(ws), _pairs(sums[:-1], sums[1:]).astype(np.int64), sums[:1].astype(np.int64) if len(ws) < window else []))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["item_id", "words", "n", "pairs", "starts"])

    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), F.col(text).cast("binary").alias("text"))
    return named.mapInArrow(run, "item_id string, words binary, n long, pairs array<long>, starts array<long>")


def _bitmap(hashes: DataFrame, bits: int) -> bytes:
    """Bits set at the hashes' low ``bits`` bits; 64 of them are a row, so what comes back is bounded by the bitmap."""
    out = np.zeros(1 << (bits - 6), np.uint64)
    slot = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    words = hashes.select(F.shiftright(slot, 6).alias("i"), F.expr(f"shiftleft(1L, cast(h & 63 as int))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))
    for r in words.toLocalIterator():
        out[r.i] = np.uint64(r.b & (1 << 64) - 1)
    return out.astype("<u8").tobytes()


def regions_of(data: bytes, known: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> tuple[int, list[tuple[int, bytes]]]:
    """Number of words, and (place of the first word, words) of each maximal stretch of known pairs that has a window's
    words or a word with which a shorter item starts."""
    mask = np.uint32(len(known) - 1)
    out: list[tuple[int, bytes]] = []
    n, run, at, last = 0, [], 0, None

    def close() -> None:
        if len(run) >= window or run and starts[_sums(run) & mask].any():
            out.append((at, b" ".join(run)))

    for ws in word_blocks(data):
        if not ws:
            continue
        sums = _sums(ws)
        linked = known[_pairs(np.r_[np.uint32(last or 0), sums[:-1]], sums) & mask]
        if last is None:
            linked[0] = False
        last = sums[-1]
        heads = np.flatnonzero(~linked)
        run += ws[: heads[0] if len(heads) else len(ws)]
        if len(heads):
            close()
            ends = np.append(heads[1:], len(ws))
            worth = (ends - heads >= window) | (np.add.reduceat(starts[sums & mask].astype(np.int64), heads) > 0)
            out += [(n + b, b" ".join(ws[b:e])) for b, e in zip(heads[:-1][worth[:-1]].tolist(), ends[:-1][worth[:-1]].tolist(), strict=True)]
            run, at = ws[heads[-1] :], n + int(heads[-1])
        n += len(ws)
    close()
    return n, out


def _unpacked(bitmap: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").view(bool)


def candidate_regions(docs: DataFrame, pairs: bytes, starts: bytes, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, tie, n_words, at, words) of every row, the regions in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first = _unpacked(pairs), _unpacked(starts)
        for batch in batches:
            n, at, words = [], [], []
            for data in batch.column(2):
                count, found = regions_of(data.as_py() or b"", known, first, window)
                n.append(count)
                at.append([a for a, _ in found])
                words.append([w for _, w in found])
            cols = [*batch.columns[:2], pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "tie", "n_words", "at", "words"])

    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(raw).alias("tie"), raw.cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, tie long, n_words long, at array<long>, words array<binary>")


def suffix_order(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``tokens`` in the order of their first ``depth`` tokens or more, ties in the order of place."""
    rank, h = np.unique(tokens, return_inverse=True)[1], 1
    while h < depth and len(rank) and rank.max() + 1 < len(rank):
        ahead = np.zeros_like(rank)
        ahead[:-h] = rank[h:] + 1
        rank, h = np.unique(rank * (len(rank) + 1) + ahead, return_inverse=True)[1], 2 * h
    return np.argsort(rank, kind="stable")


def _bound(tokens: np.ndarray, order: np.ndarray, depth: int, low: np.ndarray, high: np.ndarray, want: np.ndarray, past: bool) -> np.ndarray:
    """First place in [low, high) whose suffix has at ``depth`` a token of at least ``want``, or beyond it if ``past``."""
    low, high, last = low.copy(), high.copy(), len(tokens) - 1
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        token = tokens[np.minimum(order[np.minimum(mid, last)] + depth, last)]
        below = open_ & (token <= want if past else token < want)
        low, high = np.where(below, mid + 1, low), np.where(open_ & ~below, mid, high)
    return low


class ItemBlock:
    """Some items of the benchmark as token numbers; 0 stands for all other words and for ends."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        vocabulary: dict[bytes, int] = {}
        split = [words.split() for _, words in items]
        self.tokens = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for ws in split for w in ws], np.int64)
        n = np.array([len(ws) for ws in split], np.int64)
        self.vocabulary, self.longest = vocabulary, int(n.max())
        self.item = np.repeat(np.arange(len(n)), n)
        self.at = np.arange(len(self.tokens)) - np.repeat(np.cumsum(n) - n, n)
        self.left = np.repeat(n, n) - self.at
        wide = np.minimum(np.repeat(n, n), window)
        self.window = np.where(self.left >= wide, wide, 0)  # 0: too near the end to start one

    def search(self, tokens: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each suffix of the block: bounds in ``order`` of its window, length of its longest match, a place of it."""
        m = len(self.tokens)
        low, high = np.zeros(m, np.int64), np.full(m, len(order), np.int64)
        from_, to, length, place = (np.zeros(m, np.int64) for _ in range(4))
        live = np.arange(m)
        for depth in range(self.longest):
            live = live[self.left[live] > depth]
            want = self.tokens[live + depth]
            low[live], high[live] = (_bound(tokens, order, depth, low[live], high[live], want, past) for past in (False, True))
            live = live[low[live] < high[live]]
            if not len(live):
                break
            length[live], place[live] = depth + 1, order[low[live]]
            full = live[self.window[live] == depth + 1]
            from_[full], to[full] = low[full], high[full]
        return from_, to, length, place


class _Shard:
    """Regions of documents side by side, a 0 behind each."""

    def __init__(self, rows: list[tuple[int, list[int], list[bytes]]], block: ItemBlock):
        get, tokens, self.uids = block.vocabulary.get, [], [uid for uid, _, _ in rows]
        row, base = [], []
        for i, (_, at, words) in enumerate(rows):
            for a, ws in zip(at, words, strict=True):
                base.append(a - len(tokens))
                tokens += [get(w, 0) for w in ws.split()]
                tokens.append(0)
                row.append((i, len(tokens)))
        self.tokens = np.array(tokens, np.int64)
        ends = np.array([e for _, e in row], np.int64)
        n = np.diff(ends, prepend=0)
        self.row, self.word = np.repeat([i for i, _ in row], n), np.arange(len(tokens)) + np.repeat(base, n)
        self.order = suffix_order(self.tokens, block.longest)


def _hits(shard: _Shard, block: ItemBlock) -> pa.RecordBatch:
    from_, to, _, _ = block.search(shard.tokens, shard.order)
    cover = np.zeros(len(shard.tokens) + 1, np.int64)
    items: dict[int, set[int]] = defaultdict(set)
    for wide in np.unique(block.window[to > from_]).tolist():  # the places of windows of one length don't overlap
        mine = np.flatnonzero((block.window == wide) & (to > from_))
        firsts, kind = np.unique(from_[mine], return_inverse=True)  # equal windows have equal bounds
        bearers = [set(x.tolist()) for x in np.split(block.item[mine][np.argsort(kind, kind="stable")], np.cumsum(np.bincount(kind))[:-1])]
        n = to[mine][np.unique(kind, return_index=True)[1]] - firsts
        place = shard.order[np.repeat(firsts - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        np.add.at(cover, place, 1)
        np.add.at(cover, place + wide, -1)
        for key in np.unique(shard.row[place] * len(n) + np.repeat(np.arange(len(n)), n)).tolist():
            items[key // len(n)] |= bearers[key % len(n)]
    hit = np.cumsum(cover[:-1]) > 0
    edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
    spans: dict[int, list] = defaultdict(list)
    for b, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        spans[int(shard.row[b])].append({"start": int(shard.word[b]), "stop": int(shard.word[e - 1]) + 1})
    rows = sorted(spans)
    kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.list_(pa.string())]
    cols = [[shard.uids[i] for i in rows], [spans[i] for i in rows], [[block.names[j] for j in sorted(items[i])] for i in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["uid", "spans", "items"])


def _longest(shard: _Shard, block: ItemBlock) -> pa.RecordBatch:
    from_, to, length, place = block.search(shard.tokens, shard.order)
    q = np.flatnonzero(to > from_)
    cols = [[block.names[i] for i in block.item[q]], block.at[q], length[q], [shard.uids[i] for i in shard.row[place[q]]], shard.word[place[q]], to[q] - from_[q]]
    kinds = [pa.string()] + [pa.int64()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["item_id", "at", "length", "uid", "start", "n"])


def _searched(regions: DataFrame, block: ItemBlock, report, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for uid, at, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((uid, at, words))
                size += sum(map(len, words)) // 4
                if size >= SHARD_WORDS:
                    yield report(_Shard(rows, block), block)
                    rows, size = [], 0
        if rows:
            yield report(_Shard(rows, block), block)

    return regions.where(F.size("at") > 0).select("uid", "at", "words").mapInArrow(run, schema)


def _blocks(items: DataFrame, window: int, words: int) -> Iterator[ItemBlock]:
    """The items in blocks; the driver holds one block and one partition of the stored items at a time."""
    rows, size = [], 0
    for r in items.select("item_id", "words", "n").toLocalIterator():
        if rows and size + r.n > words:
            yield ItemBlock(rows, window)
            rows, size = [], 0
        rows.append((r.item_id, bytes(r.words)))
        size += r.n
    if rows:
        yield ItemBlock(rows, window)


def _prepared(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, window: int) -> tuple[Stored, Stored]:
    known = Stored(item_words(items, item_id, item_text, window), "items")
    pairs, starts = known.df.select(F.explode("pairs").alias("h")), known.df.select(F.explode("starts").alias("h"))
    n = max(pairs.count(), starts.count())
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    found = candidate_regions(docs, _bitmap(pairs, bits), _bitmap(starts, bits), doc_id, text, window)
    return known, Stored(found.withColumn("uid", F.monotonically_increasing_id()), "regions")


def find_matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, tie (a hash of the text), n_words, n_hit, spans (start and stop of the stretches of words inside occurring
    windows) and items (ids as strings, in their order) of every row of ``docs``.

    A window is ``window`` consecutive words of an item, or all words of a shorter one. Null and empty texts have no words:
    such documents match nothing, such items occur nowhere. A null item id is an empty one; an id at several texts is one
    item with the windows of all. Null and repeated document ids are rows like others. Empty tables give no matches.
    """
    known, regions = _prepared(docs, items, doc_id, text, item_id, item_text, window)
    hits = [Stored(_searched(regions.df, block, _hits, _HITS), "hits") for block in _blocks(known.df, window, block_words)]
    known.drop()
    rows = regions.df.select("uid", "doc_id", "tie", "n_words")
    if not hits:
        rows = rows.select("*", F.array().cast("array<struct<start:long,stop:long>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    else:
        every = hits[0].df
        for more in hits[1:]:
            every = every.unionByName(more.df)
        merged = every.groupBy("uid").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        rows = rows.join(merged, "uid", "left").withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in (("spans", "array<struct<start:long,stop:long>>"), ("items", "array<string>"))})
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["stop"] - F.greatest(x["start"], s["upto"]))).alias("n"), F.greatest(s["upto"], x["stop"]).alias("upto"))
    return rows.select("doc_id", "tie", "n_words", F.aggregate("spans", none, step)["n"].alias("n_hit"), "spans", "items")


def longest_matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """item_id, at, length, doc_id, start, n of every benchmark suffix (by the place of its first word) whose window occurs:
    its longest verbatim match over all documents, one document and place of it (the smallest of those that the shards
    report), and the number of places of the window. Same rules as ``find_matches``; items that repeat an id and a text add up."""
    known, regions = _prepared(docs, items, doc_id, text, item_id, item_text, window)
    every = None
    for block in _blocks(known.df, window, block_words):
        part = Stored(_searched(regions.df, block, _longest, _LONGEST), "longest").df
        every = part if every is None else every.unionByName(part)
    known.drop()
    if every is None:
        return docs.sparkSession.createDataFrame([], "item_id string, at long, length long, doc_id long, start long, n long")
    named = every.join(regions.df.select("uid", "doc_id"), "uid")
    best = F.struct("length", (-F.col("doc_id")).alias("id"), (-F.col("start")).alias("start"))
    return named.groupBy("item_id", "at").agg(F.max(best).alias("b"), F.sum("n").alias("n")).select("item_id", "at", "b.length", (-F.col("b.id")).alias("doc_id"), (-F.col("b.start")).alias("start"), "n")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows in which a window of an item occurs, all columns kept."""
    key, tie = fresh(docs, "key", "tie")
    lowest = F.lit(-(1 << 63))
    hit = find_matches(docs, items, doc_id, text, **options).where("n_hit > 0").select(F.coalesce("doc_id", lowest).alias(key), F.col("tie").alias(tie)).distinct()
    keyed = docs.withColumns({key: F.coalesce(F.col(doc_id).cast("long"), lowest), tie: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    return keyed.join(hit, [key, tie], "left_anti").select(*docs.columns)
