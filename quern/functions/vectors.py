"""Vector functions over ARRAY<DOUBLE> columns. Totals and maxima are bound once a row, so each is linear in the length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

#: Fixed value: embeddings of a three-dimensional volume.
VOLUME_PATCHES = 2048


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def l2_normalize(v: Column) -> Column:
    return let(_double(v), lambda x: let(F.sqrt(total(F.transform(x, lambda e: e * e))), lambda n: F.transform(x, lambda e: e / n)))


def softmax(v: Column, temperature: float = 1.0) -> Column:
    """Shifted by the maximum; temperatures below 1e-6 count as that."""
    t = max(temperature, 1e-6)
    shifted = lambda x: let(F.array_max(x), lambda top: F.transform(x, lambda e: F.exp((e - top) / t)))
    return let(let(_double(v), shifted), lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def log_sum_exp(v: Column) -> Column:
    return let(_double(v), lambda x: let(F.array_max(x), lambda top: top + F.ln(total(F.transform(x, lambda e: F.exp(e - top))))))


def cross_entropy(logits: Column, target: Column) -> Column:
    """Of logits against the index of the right one."""
    return let(_double(logits), lambda x: log_sum_exp(x) - F.get(x, target))


def draw(probabilities: Column, u: Column) -> Column:
    """Index that a uniform number ``u`` in [0, 1) picks from probabilities: the first whose running sum exceeds it. One
    pass; the last index where rounding keeps the sum below ``u``."""
    step = lambda s, p: F.struct((s["sum"] + p).alias("sum"), (s["index"] + (s["sum"] + p <= u).cast("int")).alias("index"))
    return let(_double(probabilities), lambda x: F.least(F.aggregate(x, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("index")), step, lambda s: s["index"]), F.size(x) - 1))


def top_k(v: Column, k: int = 1) -> Column:
    """Array of (value, index), largest first, the lower index first among equals."""
    ranked = F.sort_array(F.transform(_double(v), lambda x, i: F.struct((-x).alias("neg"), i.alias("index"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: F.struct((-s["neg"]).alias("value"), s["index"].alias("index")))


def argmax(v: Column) -> Column:
    return let(v, lambda x: (F.array_position(x, F.array_max(x)) - 1).cast("int"))


def divide_by_max(v: Column) -> Column:
    return let(_double(v), lambda x: let(F.array_max(x), lambda top: F.transform(x, lambda e: e / top)))


def cyclic_resize(v: Column, n: int) -> Column:
    """The first n of the values repeated over and over."""
    return let(v, lambda x: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(x, i % F.size(x))))


def weighted_sum(vectors: Column, weights: Column) -> Column:
    """Sum of vectors, each times its weight."""
    scaled = F.zip_with(vectors, weights, lambda v, w: F.transform(_double(v), lambda x: x * w))
    zero = F.transform(_double(F.get(vectors, F.lit(0))), lambda x: x * 0)
    return F.aggregate(scaled, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))


def patches(image: Column | int, patch: Column | int):
    """Patches of a square image: the square of whole patches on a side."""
    if isinstance(image, int) and isinstance(patch, int):
        return (image // patch) ** 2
    image, patch = (x if isinstance(x, Column) else F.lit(x) for x in (image, patch))
    return let(F.floor(image / patch), lambda n: n * n).cast("long")


def tile_patches(tiles: Column, image: Column | int, patch: Column | int) -> Column:
    return tiles * patches(image, patch)


def join_tiles(tiles: Column) -> Column:
    """Embeddings of all tiles of a sample in one list: the first two dimensions become one."""
    return F.flatten(tiles)
