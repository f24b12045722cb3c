"""Dense row numbers, batches, splits and shards in a global order, without a single-partition window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import fresh
from ..sources.scratch import Stored

_LOW = (1 << 33) - 1  # bits of a row id below the number of its partition


def with_index(df: DataFrame, key: Column, *ties: str, name: str = "index", parts: int | None = None) -> DataFrame:
    """``df`` with a gapless 0-based number in the order of ``key``, then of the ``ties`` columns, then of the scan.

    Rows are range-partitioned and sorted once and written to the shared folder with their place; the rows of the
    partitions before (one total for each partition) are added to it. The scan's row number is a range column as well, so
    one key with very many rows spreads over partitions. Null keys come first. ``name`` replaces a column of that name.
    """
    key_, uid, at, part, before = fresh(df, "key", "uid", "at", "part", "before")
    n = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [key_, *ties, uid]
    ranged = df.withColumn(key_, key).withColumn(uid, F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = Stored(ranged.withColumn(at, F.monotonically_increasing_id()).drop(key_, uid), "indexed").df.withColumn(part, F.shiftright(at, 33))
    totals = placed.groupBy(part).agg(F.count(F.lit(1)).alias("rows"))
    below = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range partition
    totals = totals.select(part, F.coalesce(F.sum("rows").over(below), F.lit(0)).alias(before))
    numbered = placed.join(F.broadcast(totals), part).withColumn(name, (F.col(before) + F.col(at).bitwiseAND(F.lit(_LOW))).cast("long"))
    return numbered.select(*(c for c in df.columns if c.lower() != name.lower()), name)


def seeded_key(seed: int, key: str) -> Column:
    """A long that orders rows like md5 of seed and key: its first 15 hexadecimal digits."""
    return F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")).cast("binary")), F.lit(15)), 16, 10).cast("long")


def shuffled(df: DataFrame, key: str, seed: int = 42, name: str = "index") -> DataFrame:
    """Rows numbered in a seeded random order that depends on the key only."""
    return with_index(df, seeded_key(seed, key), key, name=name)


def _cut(df: DataFrame, key: str, sizes: list[tuple[str, int]], seed: int) -> DataFrame:
    (i,) = fresh(df, "i")
    out, at = None, 0
    for name, size in sizes:
        at += size
        out = F.when(F.col(i) < at, name) if out is None else out.when(F.col(i) < at, name)
    return shuffled(df, key, seed, i).withColumn("split", out).drop(i)


def split(df: DataFrame, key: str, shares: list[tuple[str, float]], seed: int = 42) -> DataFrame:
    """``df`` with ``split``: the shares of a seeded order, floors first, what is left to the first ones in turn."""
    n = df.count()
    sizes = [int(n * s) for _, s in shares]
    for i in range(n - sum(sizes)):
        sizes[i % len(sizes)] += 1
    return _cut(df, key, [(name, size) for (name, _), size in zip(shares, sizes, strict=True)], seed)


def train_test(df: DataFrame, key: str, test: float | None = None, train: float | None = None, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: a test share, rounded up, or else a train share, rounded down, of a seeded order."""
    n = df.count()
    tested = math.ceil(n * test) if test is not None else n - int(n * train)
    return _cut(df, key, [("test", tested), ("train", n - tested)], seed)


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in the order, or all if there are fewer: a top-k, not a global sort."""
    return df.orderBy(*order).limit(n)


def rows_from(df: DataFrame, start: int, key: Column, *ties: str) -> DataFrame:
    """Rows from place ``start`` of the order on, as a resumed run needs them."""
    (i,) = fresh(df, "i")
    return with_index(df, key, *ties, name=i).where(F.col(i) >= start).drop(i)


def zip_rows(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, name: str = "index") -> DataFrame:
    """The i-th row of one table beside the i-th of the other, each in its order, as far as the shorter one goes."""
    return with_index(left, left_key, name=name).join(with_index(right, right_key, name=name), name)


def shard(df: DataFrame, key: Column, n: int, shard_id: int, *ties: str, contiguous: bool = True) -> DataFrame:
    """Rows of one of n shards of the ordered table; contiguous shards differ by one row at most, the first are larger."""
    (i,) = fresh(df, "i")
    numbered = with_index(df, key, *ties, name=i)
    if not contiguous:
        return numbered.where(F.col(i) % n == shard_id).drop(i)
    div, mod = divmod(df.count(), n)
    start = div * shard_id + min(shard_id, mod)
    return numbered.where(F.col(i).between(start, start + div + (shard_id < mod) - 1)).drop(i)


def batches(df: DataFrame, key: Column, size: int, *ties: str) -> DataFrame:
    """``df`` with batch_id and batch_idx of fixed-size batches in order."""
    (i,) = fresh(df, "i")
    return with_index(df, key, *ties, name=i).withColumn("batch_id", F.floor(F.col(i) / size).cast("long")).withColumn("batch_idx", F.col(i) % size).drop(i)
