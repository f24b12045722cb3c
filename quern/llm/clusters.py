"""Centroid clustering of integer vectors: plain Lloyd rounds.

The centroids (at most a few thousand numbers) go to every task; ``mapInPandas`` takes integer squared differences to each
and the lowest centroid among the nearest. A task adds up its own vectors and hands on a row a cluster, which ``groupBy``
merges, so nothing but those rows is shuffled. Everything is an integer, so results don't depend on partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
#: Up to this size components, their squared differences and sums fit in 64 bits; beyond it Python's integers are used.
_SMALL = 1 << 26
_MOST = (1 << 63) - 1
_EXACT = "decimal(38,0)"


def integer_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, for vectors of ``dimensions`` components of which none is null or not finite."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    return df.where((F.size(x) == dimensions) & finite).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda y: F.floor(y * scale).cast("long")).alias("v"))


def _matrix(rows: list, dimensions: int) -> np.ndarray:
    m = np.stack(rows) if len(rows) else np.zeros((0, dimensions), np.int64)
    return m if not m.size or (m.min() >= -_SMALL and m.max() <= _SMALL) else m.astype(object)


def nearest(m: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each row, the lowest number among equals."""
    apart = np.stack([((m - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    near = apart.argmin(axis=1)
    return near, apart[np.arange(len(m)), near]


def _centroids(found: list[list[int]]) -> np.ndarray:
    small = all(abs(x) <= _SMALL for c in found for x in c)
    return np.array(found, np.int64 if small else object)


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, sums) of the clusters that aren't empty."""
    k, dims = centroids.shape

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums = [0] * k, [[0] * dims for _ in range(k)]
        for frame in frames:
            m = _matrix(list(frame["v"]), dims)
            near, _ = nearest(m, centroids)
            for c in np.unique(near):
                own = m[near == c]
                n[c] += len(own)
                sums[c] = [a + int(b) for a, b in zip(sums[c], own.sum(axis=0), strict=True)]
        there = [c for c in range(k) if n[c]]
        yield pd.DataFrame({"cluster": pd.Series(there, dtype="int32"), "n": pd.Series([n[c] for c in there], dtype="int64"), "sums": pd.Series([[Decimal(x) for x in sums[c]] for c in there], dtype=object)})

    parts = vectors.select("v").mapInPandas(run, f"cluster int, n long, sums array<{_EXACT}>")
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]).cast(_EXACT) for i in range(dims))).alias("sums"))


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance); a distance beyond 64 bits is the largest long."""
    dims = centroids.shape[1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            near, apart = nearest(_matrix(list(frame["v"]), dims), centroids)
            apart = apart if apart.dtype == np.int64 else [min(int(x), _MOST) for x in apart]
            yield pd.DataFrame({"vec_id": frame["vec_id"], "unnamed": frame["unnamed"], "cluster": near.astype("int32"), "distance": pd.Series(apart, dtype="int64")})

    # pandas would turn ids beside null ones into floats
    whole = vectors.select(F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("unnamed"), "v")
    found = whole.mapInPandas(run, "vec_id long, unnamed boolean, cluster int, distance long")
    return found.select(F.when(~F.col("unnamed"), F.col("vec_id")).alias("vec_id"), "cluster", "distance")


def _seeded(vec_id: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(vec_id.cast("string"), F.lit(""))).cast("binary"), 256)


def cluster(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, vec_id: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector (see integer_vectors).

    Centroids start as the k vectors whose ids have the smallest digests (ties of repeated ids: the smaller vector); with
    fewer vectors there are fewer centroids, and an empty table gives no rows. A null id counts as an empty text there.
    Components beyond 64 bits are held at the ends of that range; sums are exact, totals beyond it are the largest long.
    """
    vectors = Stored(integer_vectors(df, vec_id, vector, dimensions, scale), "vectors")
    first = vectors.df.select("v", _seeded(F.col("vec_id"), seed).alias("h")).orderBy("h", "v").limit(k).collect()  # k vectors
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return df.sparkSession.createDataFrame([], out)
    centroids = _centroids([list(r.v) for r in first])
    for _ in range(rounds):
        rows = centroids.tolist()
        for r in cluster_sums(vectors.df, centroids).collect():  # k rows
            rows[r.cluster] = [int(x) // r.n for x in r.sums]
        centroids = _centroids(rows)
    found = Stored(assigned(vectors.df, centroids), "assigned").df
    vectors.drop()
    totals = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast(_EXACT)).alias("d")).collect()}  # k rows
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per = [(c, min(d, _MOST), min(sum(totals.values()), _MOST), sha[c]) for c, d in totals.items()]
    per = df.sparkSession.createDataFrame(per, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
