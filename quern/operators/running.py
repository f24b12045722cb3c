"""Running totals over groups of any size, and row numbers in scan order, by segmented prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import fresh
from ..sources.scratch import Stored
from .indexing import with_index

#: Rows of a stretch that one task sums up.
STRETCH = 1 << 20
#: Blocks of files whose offsets are broadcast; more are joined by a shuffle.
BROADCAST_BLOCKS = 500_000


def running(df: DataFrame, value: str, group: str | None, order: Column, *ties: str, stretch: int = STRETCH, exact: str | None = None) -> DataFrame:
    """``df`` with running_sum, running_count and running_mean of ``value`` in each group, up to and with each row.

    Rows are in the order of ``order``, then ``ties``, then the scan; without ``group`` all rows are one group. They are
    numbered over all groups and cut into stretches of ``stretch`` rows whatever their groups, so a group that holds all
    rows spreads over as many tasks as any. Sums run inside a stretch; what its first group has in earlier stretches is
    added from a table of one row a stretch. Null values count neither in sums nor in counts; a sum and mean of none are
    null. ``exact`` is a decimal type to sum in, so that sums don't depend on the order of additions. Null groups are one.
    """
    i, part, g, v, s, n, before, before_n, last = fresh(df, "i", "part", "g", "v", "s", "n", "before", "before_n", "last")
    kind = exact or dict(df.dtypes)[value]
    named = df.withColumns({g: F.struct(F.col(group)) if group else F.struct(F.lit(0)), v: F.col(value).cast(kind)})
    numbered = with_index(named, F.struct(g, order), *ties, name=i).withColumn(part, F.floor(F.col(i) / stretch))
    rows = Stored(numbered, "stretches").df
    inside = Window.partitionBy(part, g).orderBy(i).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row a stretch: what its last group holds in it, and the sum of that over the stretches in which it is the last
    ends = rows.groupBy(part, g).agg(F.sum(v).alias(s), F.count(v).alias(n), F.max(i).alias(last)).groupBy(part).agg(F.max_by(F.struct(g, s, n), last).alias(last))
    upto = Window.partitionBy(f"{last}.{g}").orderBy(part)
    summed = ends.select((F.col(part) + 1).alias(part), F.col(f"{last}.{g}").alias(g), F.sum(f"{last}.{s}").over(upto).alias(before), F.sum(f"{last}.{n}").over(upto).alias(before_n))
    own = rows.withColumns({s: F.sum(v).over(inside), n: F.count(v).over(inside)})
    joined = own.join(summed.select(F.col(part).alias(last), F.col(g).alias(f"{g}2"), before, before_n), (F.col(part) == F.col(last)) & F.col(g).eqNullSafe(F.col(f"{g}2")), "left")
    total = F.when(F.col(s).isNull() & F.col(before).isNull(), None).otherwise(F.coalesce(s, F.lit(0)) + F.coalesce(before, F.lit(0)))
    count = F.col(n) + F.coalesce(before_n, F.lit(0))
    return joined.select(*(F.col(c) for c in df.columns), total.alias("running_sum"), count.alias("running_count"), F.when(count > 0, total.cast("double") / count).alias("running_mean"))
