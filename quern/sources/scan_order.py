"""Rows numbered in the order in which they stand in their files, whatever the splits and their packing into tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import fresh
from ..operators.running import BROADCAST_BLOCKS, running
from .scratch import Stored


def numbered_scan(spark: SparkSession, paths: str | list[str], format: str = "text", schema: str | None = None, name: str = "row", broadcast_blocks: int = BROADCAST_BLOCKS, **options: str) -> DataFrame:
    """The rows of files with ``file`` and a gapless 0-based number: paths as given, below each the files by their URI, in
    a file its rows as they stand there.

    Parquet rows have their place from the format and need no shuffle. Of other formats the place in a block (a stretch of
    a file that a task reads) is counted in a task of its own; what a block has before it is a prefix sum over a row for
    each block, counted in a first pass. Blocks must be the same in both passes: if settings or the number of executors
    change them in between, that is an error and never a wrong number. Empty files and folders have no rows.
    """
    reader = spark.read.options(**options)
    reader = reader.schema(schema) if schema else reader
    frames = []
    for place, path in enumerate([paths] if isinstance(paths, str) else paths):
        df = reader.format(format).load(path)
        if not frames:
            place_, at, block, nth, before, n, file2 = fresh(df.withColumns({"file": F.lit(""), name: F.lit(0)}), "place", "at", "block", "nth", "before", "n", "file")
            out = df.columns
        own = F.col("_metadata.row_index") if format == "parquet" else F.monotonically_increasing_id()
        start = F.lit(0).cast("long") if format == "parquet" else F.col("_metadata.file_block_start")
        frames.append(df.select(*out, F.lit(place).alias(place_), F.col("_metadata.file_path").alias("file"), start.alias(block), own.alias(at)))
    rows = frames[0]
    for more in frames[1:]:
        rows = rows.unionByName(more)
    unit = [place_, "file", block]
    counted = Stored(rows.groupBy(*unit).agg(F.count(F.lit(1)).cast("long").alias(n)), "blocks").df
    few = counted.count() <= broadcast_blocks
    if few:
        upto = Window.orderBy(*unit).rowsBetween(Window.unboundedPreceding, -1)  # a row a block, within the bound
        blocks = counted.withColumn(before, F.coalesce(F.sum(n).over(upto), F.lit(0)))
    else:
        blocks = running(counted, n, None, F.struct(*unit)).withColumn(before, F.col("running_sum") - F.col(n)).drop("running_sum", "running_count", "running_mean")
    if format != "parquet":
        rows = rows.withColumn(at, F.row_number().over(Window.partitionBy(*unit).orderBy(at)) - 1)
    blocks = blocks.select(*(F.col(c).alias(f"{c}_") for c in unit), n, before)
    blocks = F.broadcast(blocks) if few else blocks.hint("shuffle_merge")
    same = [F.col(c) == F.col(f"{c}_") for c in unit]
    found = rows.join(blocks, same, "left")
    sure = F.when(F.col(n) > F.col(at), F.col(before) + F.col(at)).otherwise(F.raise_error(F.lit("blocks of files changed between two passes; set spark.sql.files.minPartitionNum")).cast("long"))
    return found.select(*out, "file", sure.alias(name))
