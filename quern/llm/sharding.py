"""Contiguous shards of near-equal bytes from global prefix sums over per-partition totals. JVM only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored

N_SHARDS = 16
#: Rows of a range partition, where that makes more of them than the shuffle partitions.
PART_ROWS = 4_000_000


def shard_by_bytes(docs: DataFrame, n_shards: int = N_SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row, in the order of doc_id.

    Rows are range-partitioned once; each partition's totals (one row a partition) give the bytes and rows before it, a
    running sum inside the partition gives the rest, and a row goes to the shard in which its middle byte falls.
    Null texts have size 1, null ids come first, repeated ids and rows are ordered by a row number taken at the scan, and
    that number is also a range column, so one id with very many rows still spreads. An empty table gives no rows.
    """
    text_col = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(text_col) + 1).cast("long").alias("size"), F.crc32(text_col.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("uid"))
    rows = Stored(rows, "sizes").df  # the range sampler reads it again; the texts are read once
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // PART_ROWS)
    placed = Stored(rows.repartitionByRange(n, "doc_id", "uid").withColumn("part", F.spark_partition_id()), "ranges").df
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range partition
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("part")
    offsets = totals.select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(everything).alias("all_bytes")
    )
    running = Window.partitionBy("part").orderBy("doc_id", "uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        placed.withColumn("upto", F.sum("size").over(running))
        .withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "uid")))
        .join(F.broadcast(offsets), "part")
        .select(
            "doc_id", "size", "text_crc32",
            F.expr(f"cast(least({n_shards - 1}, ((bytes_before + upto) * 2 - size) * {n_shards} div (2 * all_bytes)) as int)").alias("shard"),
            (F.col("rows_before") + F.col("nth") - 1).alias("row"),
        )
    )
    cut = Stored(cut, "cut").df
    firsts = cut.groupBy("shard").agg(F.min("row").alias("first_row"))  # n_shards rows at most
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
