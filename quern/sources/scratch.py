"""Tables in the cluster's shared folder.

Intermediate results that are read twice, or that end a long lineage, are written as Parquet into the folder that the
cluster names in ``spark.checkpoint.dir``. A lost executor then costs a re-read, never a re-computation of the chain.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_left: dict[str, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, a local session gets a folder of its own; a
    cluster has none that all its machines see, so that is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quern-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return _own[0]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def hadoop(spark: SparkSession, path: str):
    """(file system, path object) of a path in any store that Spark reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class Stored:
    """A DataFrame written to the shared folder; ``df`` reads it back, ``drop`` frees the disk early. Tables that are left
    when the application ends go then."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark = df.sparkSession
        self.path = fresh_path(self.spark, tag)
        if not _left:
            atexit.register(_drop_left)
        _left[self.path] = hadoop(self.spark, self.path)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        files, at = hadoop(self.spark, self.path)
        files.delete(at, True)
        _left.pop(self.path, None)


def _drop_left() -> None:
    """Best effort: a stopped session's files can still be reached while its JVM runs."""
    for files, at in list(_left.values()):
        try:
            files.delete(at, True)
        except Exception:  # no JVM any more
            return
