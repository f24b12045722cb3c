"""Concatenation, weighted interleaving, class caps and balancing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import fresh
from .indexing import seeded_key, with_index


def concat(frames: list[DataFrame]) -> DataFrame:
    """All rows of all tables; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def weight_shares(weights: DataFrame, weight: str = "weight") -> DataFrame:
    """``weights`` (a short mixture table) with share: weight over the sum of weights."""
    (all_,) = fresh(weights, "all")
    return weights.crossJoin(F.broadcast(weights.agg(F.sum(weight).alias(all_)))).withColumn("share", F.col(weight) / F.col(all_)).drop(all_)


def interleave(sources: list[tuple[str, DataFrame, float]], key: str, seed: int = 42, stretch: int = 1 << 16) -> DataFrame:
    """Rows of the sources drawn by weight, each in its own order, up to and with the draw that takes a source's last row.

    Draw i picks the source in whose share of the weights a seeded number of i falls. Adds source_name and draw. Sources
    that differ in columns have nulls. A source without rows has run out before the first draw, so nothing is drawn. Rows
    are numbered once for all sources; draws are counted by ``stretch`` first, so that the stop is known before any is joined.
    """
    k, nth, s, n, before, first = fresh(concat([df for _, df, _ in sources]), "k", "nth", "s", "n", "before", "first")
    tagged = [df.withColumns({k: F.lit(i), "source_name": F.lit(name)}) for i, (name, df, _) in enumerate(sources)]
    rows = with_index(concat(tagged), F.struct(F.col(k), F.col(key).cast("long")), name=nth)
    held = {r[0]: (r[1], r[2]) for r in rows.groupBy(k).agg(F.count(F.lit(1)), F.min(nth)).collect()}  # a row a source
    spark, total, at, pick = sources[0][1].sparkSession, sum(w for *_, w in sources), 0.0, F.when(F.lit(False), 0)
    u = F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}-"), F.col("draw").cast("string")).cast("binary")), F.lit(8)), 16, 10).cast("double") / F.lit(float(1 << 32))
    for i, (_, _, w) in enumerate(sources[:-1]):
        at += w / total
        pick = pick.when(u < at, i)
    drawn = lambda upto: spark.range(upto).select(F.col("id").alias("draw"), F.floor(F.col("id") / stretch).alias(s)).withColumn(k, pick.otherwise(len(sources) - 1))
    every = drawn(sum(c for c, _ in held.values()) if len(held) == len(sources) else 0)
    upto = Window.partitionBy(k).orderBy(s).rowsBetween(Window.unboundedPreceding, -1)
    counts = every.groupBy(s, k).agg(F.count(F.lit(1)).alias(n)).withColumn(before, F.coalesce(F.sum(n).over(upto), F.lit(0)))
    size = F.create_map(*(F.lit(x) for i, (c, _) in held.items() for x in (i, c))) if held else F.create_map(F.lit(-1), F.lit(0))
    last = counts.where((F.col(before) < size[F.col(k)]) & (size[F.col(k)] <= F.col(before) + F.col(n)))  # a row a source at most
    nth_draw = F.col(before) + F.row_number().over(Window.partitionBy(s, k).orderBy("draw")) - 1
    stop = every.join(F.broadcast(last), [s, k]).withColumn(nth, nth_draw).where(F.col(nth) == size[F.col(k)] - 1).agg(F.min("draw")).first()[0]
    served = drawn(0 if stop is None else stop + 1).join(counts, [s, k]).withColumn(nth, nth_draw)
    start = F.create_map(*(F.lit(x) for i, (_, f) in held.items() for x in (i, f))) if held else size
    served = served.select(k, (F.col(nth) + start[F.col(k)]).alias(nth), "draw")
    return rows.join(served, [k, nth]).drop(k, nth)


def cap_per_class(df: DataFrame, label: str, order: str, n: int) -> DataFrame:
    """The first n rows of each class in order; the planner prunes them before the shuffle (WindowGroupLimit)."""
    (i,) = fresh(df, "n")
    w = Window.partitionBy(label).orderBy(order)
    return df.withColumn(i, F.row_number().over(w)).where(F.col(i) <= n).drop(i)


def balance(df: DataFrame, label: str, key: str, to, seed: int = 42) -> DataFrame:
    """Every class sampled down, without replacement, to the number of rows of class ``to`` (smaller ones stay whole).
    Without a row of that class there is nothing to balance to, which is an error."""
    n = df.where(F.col(label) == to).count()
    if not n:
        raise ValueError(f"no row has the label {to}")
    (i,) = fresh(df, "n")
    w = Window.partitionBy(label).orderBy(seeded_key(seed, key), key)
    return df.withColumn(i, F.row_number().over(w)).where(F.col(i) <= n).drop(i)


def last_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key: the last in the order."""
    (r,) = fresh(df, "r")
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias(r))
    return picked.select(key, *(F.col(f"{r}.{c}").alias(c) for c in rest))
