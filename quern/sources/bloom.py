"""A Bloom filter built by a partial aggregation and applied where rows are scanned, before they are shuffled or opened."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, hashes of a key, and bounds of the filter's bits (8 KB to 32 MB are sent to the executors).
BITS_A_KEY, HASHES = 12, 4
LEAST_BITS, MOST_BITS = 16, 28


def _places(key: Column, bits: int) -> list[Column]:
    """Bit numbers of a key: stretches of steps between two halves of a hash."""
    h = F.xxhash64(key)
    low, step = h.bitwiseAND(F.lit((1 << 31) - 1)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    return [(low + step * i).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(HASHES)]


class Bloom:
    """Filter of a column's keys. A key that it lets through may be absent, one that it drops is; null keys are dropped."""

    def __init__(self, keys: DataFrame, key: str):
        n = keys.count()
        self.bits = min(MOST_BITS, max(LEAST_BITS, (BITS_A_KEY * n - 1).bit_length() if n else 0))
        place = F.explode(F.array(*_places(F.col(key), self.bits))).alias("p")
        words = keys.where(F.col(key).isNotNull()).select(place).groupBy(F.shiftright("p", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("w"))
        self.words = np.zeros(1 << (self.bits - 6), np.uint64)
        for r in words.toLocalIterator():  # at most one row for each word of the filter
            self.words[r.i] = np.uint64(r.w & (1 << 64) - 1)

    def may_have(self, key: Column) -> Column:
        spark_words = self.words

        @F.pandas_udf("boolean")
        def there(*places: pd.Series) -> pd.Series:
            hit = np.ones(len(places[0]), bool)
            for p in places:
                p = p.to_numpy()
                hit &= (spark_words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) > 0
            return pd.Series(hit)

        return key.isNotNull() & there(*_places(key, self.bits))
