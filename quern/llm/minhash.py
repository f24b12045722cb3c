"""Near-duplicate classes: many universal hash minima with banding, verification on full shingle sets, components.

1. One pass over the texts gives each document the digest of its shingle set, the set's size, and its minima (one band
   hash for each group of rows) with a parity sketch. Equal sets share all of it, so documents with one digest form a
   class; copies are never compared. A class is known by a number of its own: one id may stand at several texts.
2. Each bucket of each band links its members to its smallest member: a star, not all pairs. Stars are verified on full
   sets, and the verified links give first components.
3. Only buckets that still hold two or more components are compared across those components, and there only classes whose
   sizes allow a link and whose parity sketches do; these are verified on full sets too. No link that shares a bucket is
   lost: both filters are exact.

A parity sketch has PARITY bits with the parity of the shingles hashed to each. Two of them differ in no more bits than the
sets have elements apart, so pairs beyond a link's distance are surely none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, fresh, restrict
from .components import connected_components

PERMUTATIONS = 160
#: A pair at the threshold shares no bucket with at most this probability.
MAX_MISS = 1e-5
#: Bits of the parity sketch.
PARITY = 2048
WORDS = 300_000


def banding(threshold: float, permutations: int = PERMUTATIONS) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which a pair at the threshold is missed with at most MAX_MISS."""
    for rows in range(permutations, 0, -1):
        bands = permutations // rows
        if (1 - threshold**rows) ** bands <= MAX_MISS:
            return bands, rows
    return permutations, 1


class Shingler:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text (a shorter text: of the whole sequence)."""

    def __init__(self, n: int):
        import xxhash

        from .recent import Recent

        self.n, self.hash = n, Recent(xxhash.xxh3_64_intdigest, WORDS)
        self.empty = np.empty(0, dtype=np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
        if not words:
            return self.empty
        h = np.fromiter(map(self.hash.__getitem__, words), dtype=np.uint64, count=len(words))
        n = min(self.n, len(h))
        out = np.full(len(h) - n + 1, len(h) if len(h) < self.n else 0, dtype=np.uint64)
        for k in range(n):
            out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)


class Minima:
    """Universal hash minima: (a x + b) over 64 bits, the upper 32 kept, a odd. Fixed seed."""

    def __init__(self, bands: int, rows: int, permutations: int):
        rng = np.random.default_rng(20240501)
        self.a = rng.integers(0, 1 << 63, permutations, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, permutations, dtype=np.uint64)[:, None]
        self.bands, self.rows = bands, rows
        self.mix = rng.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band hashes (int64) and the parity sketch packed in int64s."""
        least = None
        for at in range(0, len(shingles), 4096):
            x = self.a * shingles[at : at + 4096]
            x += self.b
            low = x.min(axis=1)
            least = low if least is None else np.minimum(least, low)
        least >>= np.uint64(32)
        mixed = ((least[: self.bands * self.rows].reshape(self.bands, self.rows) + np.uint64(1)) * self.mix).sum(axis=1, dtype=np.uint64)
        mixed ^= mixed >> np.uint64(31)
        parity = np.packbits((np.bincount((shingles >> np.uint64(11)).astype(np.int64) % PARITY, minlength=PARITY) & 1).astype(np.uint8))
        return mixed.view(np.int64), np.frombuffer(parity.tobytes(), dtype="<i8")


def signatures(docs: DataFrame, doc_id: str, text: str, n: int, bands: int, rows: int, permutations: int) -> DataFrame:
    """doc_id, tag (a hash of the text), n_shingles, digest, bands, sketch of every row; without shingles digest, bands and
    sketch are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingle, minima, memo = Shingler(n), Minima(bands, rows, permutations), {}
        for batch in batches:
            memo.clear()  # sets that repeat within a batch
            size, digest, band, sketch = [], [], [], []
            for t in batch.column(2).to_pylist():
                s = shingle(t)
                size.append(len(s))
                if not len(s):
                    digest.append(None), band.append(None), sketch.append(None)
                    continue
                d = xxhash.xxh3_128_digest(s.tobytes())
                if d not in memo:
                    memo[d] = minima(s)
                digest.append(d), band.append(memo[d][0]), sketch.append(memo[d][1])
            longs = pa.list_(pa.int64())
            cols = [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(band, longs), pa.array(sketch, longs)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "tag", "n_shingles", "digest", "bands", "sketch"])

    tagged = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_tag(F.col(text)).alias("tag"), F.col(text).alias("text"))
    return tagged.mapInArrow(run, "doc_id long, tag long, n_shingles long, digest binary, bands array<long>, sketch array<long>")


def text_tag(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shingle_sets(docs: DataFrame, text: str, n: int) -> DataFrame:
    """(digest, set) with the sorted hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingle = Shingler(n)
        for batch in batches:
            sets = [shingle(t).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], names=["digest", "set"])

    return docs.select(text).mapInArrow(run, "digest binary, set binary")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str, n: int, percent: int) -> DataFrame:
    """Those of the stored pairs of classes (u, v) with 100 * intersection >= percent * union, on full sets.

    ``classes`` has cls, digest and rep, the id of a document with that set. Texts are filtered to these ids before any
    shuffle and sets to the digests after it (an id may have other texts too); the sets meet the pairs in two sort-merge joins, which adaptive execution splits
    where one class has very many pairs.
    """
    some = Stored(pairs.select(F.explode(F.array("u", "v")).alias("cls")).distinct().join(classes.select("cls", "digest", "rep"), "cls"), "pair-classes").df
    one = restrict(docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("text")), Stored(some.select("rep").distinct(), "pair-ids").df, "rep")
    sets = Stored(shingle_sets(one, "text", n).dropDuplicates(["digest"]).join(some.select("cls", "digest"), "digest").select("cls", "set"), "sets").df
    side = lambda c: sets.select(F.col("cls").alias(c), F.col("set").alias(f"set_{c}")).hint("shuffle_merge")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                if (raw := a.as_buffer()) is not last:
                    last, left = raw, np.frombuffer(raw, dtype=np.uint64)
                right = np.frombuffer(b.as_buffer(), dtype=np.uint64)
                both = len(left) + len(right)
                most = min(len(left), len(right))
                if 100 * most < percent * (both - most):
                    keep.append(False)
                    continue
                merged = np.concatenate([left, right])
                merged.sort(kind="stable")
                same = int((merged[1:] == merged[:-1]).sum())
                keep.append(100 * same >= percent * (both - same))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "set_u", "set_v")
    return joined.mapInArrow(run, "u long, v long")


def _differing(longs: range) -> Column:
    """Differing bits of columns s<k> and t<k>: plain longs, so that the join's generated code stays small."""
    out = F.lit(0)
    for k in longs:
        out = out + F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"t{k}")))
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, permutations: int = PERMUTATIONS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, tag of every row: classes of documents linked by n-word shingle sets with
    100 * intersection >= percent * union, taken transitively.

    component_id is the smallest doc_id of the class, kept marks that document. Texts that are null or without words have
    no shingles, are linked with nothing and stay. Rows are judged by their own text: an id that stands at two texts may be
    kept for one and not for the other. Repeated rows are alike. A null id is linked with nothing. ``tag`` is a hash of the
    text. An empty table gives no rows. Links below certainty: see MAX_MISS.
    """
    bands, rows = banding(percent / 100, permutations)
    signed = Stored(signatures(docs, doc_id, text, n, bands, rows, permutations), "signatures").df
    known = signed.where("digest is not null and doc_id is not null")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n"))
    classes = Stored(classes.withColumn("cls", F.monotonically_increasing_id()), "classes").df
    flat = classes.select("cls", F.posexplode("bands").alias("band", "bucket"))
    hubs = flat.groupBy("band", "bucket").agg(F.min("cls").alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1")
    hubs = Stored(hubs, "hubs").df
    shared = Stored(flat.join(hubs, ["band", "bucket"]).select("band", "bucket", "cls", "hub"), "shared").df
    stars = Stored(shared.where("cls <> hub").select(F.col("hub").alias("u"), F.col("cls").alias("v")).distinct(), "stars").df
    links = Stored(verified(stars, classes, docs, doc_id, text, n, percent), "links").df
    first = Stored(connected_components(links), "components").df
    # buckets that still hold several components, across these only
    placed = shared.join(first.withColumnRenamed("node", "cls"), "cls", "left").select("band", "bucket", "cls", F.coalesce("component", "cls").alias("component"))
    placed = Stored(placed, "placed").df
    split = placed.groupBy("band", "bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band", "bucket")
    mixed = placed.join(Stored(split, "split").df, ["band", "bucket"]).join(classes.select("cls", "sketch", "n"), "cls")
    # two sets that link are at most one step of log(100 / percent) apart in size (a little more, for rounding)
    mixed = Stored(mixed.withColumn("step", F.floor(F.log("n") / (math.log(100 / percent) * (1 + 1e-9)))), "mixed").df
    every = range(PARITY // 64)
    mixed = mixed.select("band", "bucket", "cls", "component", "n", "step", *(F.col("sketch")[k].alias(f"s{k}") for k in every))
    a = mixed.withColumnsRenamed({"cls": "u", "component": "cu", "n": "nu"})
    b = mixed.withColumnsRenamed({"cls": "v", "component": "cv", "n": "nv"} | {f"s{k}": f"t{k}" for k in every})
    b = b.withColumn("step", F.explode(F.array("step", F.col("step") - 1)))
    larger = F.struct("nu", "u") < F.struct("nv", "v")
    near = (_differing(every) * (100 + percent) <= (F.col("nu") + F.col("nv")) * (100 - percent)) & (F.col("nu") * 100 >= F.col("nv") * percent)
    across = a.hint("shuffle_merge").join(b, ["band", "bucket", "step"]).where((F.col("cu") != F.col("cv")) & larger & near)
    tested = stars.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    across = Stored(across.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().join(tested, ["u", "v"], "left_anti"), "across").df
    more = verified(across, classes, docs, doc_id, text, n, percent)
    whole = first.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    final = Stored(connected_components(whole.unionByName(more)).withColumnRenamed("node", "cls"), "final").df
    members = classes.select("cls", "digest", "rep").join(final, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = members.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_digest = Stored(members.join(least, "component").select("digest", "component_id"), "by-digest").df
    out = signed.select("doc_id", "tag", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(by_digest.hint("shuffle_merge"), "digest", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "tag")
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "tag")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each class of near_duplicates: the one of the smallest id, and of its rows with the same id,
    those with one text count once. Rows with a null id stay."""
    id_, tag, count, nth = fresh(docs, "id", "tag", "count", "nth")
    judged = near_duplicates(docs, doc_id, text, n, percent).where("kept and doc_id is not null")
    # of several texts under one id that belong to one class, the one of the smallest hash stays
    kept = judged.groupBy("doc_id", "component_id", F.when(F.col("n_shingles") == 0, F.col("tag")).alias("wordless")).agg(F.min("tag").alias("tag"), F.count(F.lit(1)).alias("count"))
    kept = Stored(kept.select(F.col("doc_id").alias(id_), F.col("tag").alias(tag), F.col("count").alias(count)), "kept").df
    rows = docs.withColumn(id_, F.col(doc_id).cast("long")).withColumn(tag, text_tag(F.col(text)))
    stay = rows.join(kept.hint("shuffle_merge"), [id_, tag])
    if not kept.where(F.col(count) > 1).isEmpty():
        stay = stay.withColumn(nth, F.row_number().over(Window.partitionBy(id_, tag).orderBy(id_))).where(F.col(nth) == 1)
    return stay.select(*docs.columns).unionByName(docs.where(F.col(doc_id).isNull()))
