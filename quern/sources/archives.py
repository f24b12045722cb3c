"""Archives read by member.

The members of tar and zip archives are listed once, from headers only, and stored as an index: number, archive, name and
place. Numbers run over all archives in the order of their names. Whoever asks for numbers then reads those byte ranges and
nothing else: by constants through a data source that takes filters on the number and plans its partitions from the index,
or by data through a join on the index. An archive is never held in memory, so its size doesn't matter.
"""

from __future__ import annotations

import struct
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import ArrayType, BinaryType

from .ranges import Ranges, list_files, open_file
from .scratch import fresh_path

MEMBERS = "archive string, index long, name string, offset long, packed long, size long, method string"
LOCATOR = ["archive", "offset", "packed", "size", "method"]
#: Bytes of members in a partition of the source, and in a batch that it hands on, unless one member has more.
PART_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


def _tar_members(path: str) -> Iterator[tuple[str, int, int, int, str]]:
    with open_file(path) as f, tarfile.open(fileobj=f, mode="r:") as t:  # contents are sought over
        for m in t:
            if m.isfile():
                yield m.name, m.offset_data, m.size, m.size, "stored"


def _zip_members(path: str) -> Iterator[tuple[str, int, int, int, str]]:
    kinds = {zipfile.ZIP_STORED: "stored", zipfile.ZIP_DEFLATED: "deflate"}
    with open_file(path) as f, zipfile.ZipFile(f) as z:
        for m in z.infolist():
            if m.is_dir():
                continue
            if m.compress_type not in kinds or m.flag_bits & 1:
                raise ValueError(f"{path}: {m.filename} is packed in a way that isn't read")
            name, extra = struct.unpack("<26xHH", f.read_at(30, m.header_offset))  # of the local header, which may differ
            yield m.filename, m.header_offset + 30 + name + extra, m.compress_size, m.file_size, kinds[m.compress_type]


def list_members(files: DataFrame) -> DataFrame:
    """A row for each file inside the archives at ``path``, read from headers; names that leave the archive's folder are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for i, member in enumerate(_zip_members(path) if path.endswith(".zip") else _tar_members(path)):
                    if member[0].startswith("/") or ".." in member[0].split("/"):
                        raise ValueError(f"{path}: {member[0]} leaves the archive's folder")
                    rows.append((path, i, *member))
                cols = list(zip(*rows, strict=True)) or [()] * 7
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["archive", "index", "name", "offset", "packed", "size", "method"])

    return files.select("path").repartition(F.col("path")).mapInArrow(run, MEMBERS)


class ArchiveIndex:
    """The stored index at ``path``: ``members`` sorted by number, and ``archives`` with a row for each archive."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, spark: SparkSession, folder: str, glob: str = "*.tar", path: str | None = None) -> ArchiveIndex:
        """Lists the archives of a folder; empty ones and an empty folder are fine."""
        out = cls(spark, path or fresh_path(spark, "archive-index"))
        files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path")
        # listed once, so that the numbers follow from what is stored
        list_members(files).write.parquet(f"{out.path}/listed")
        listed = spark.read.schema(MEMBERS).parquet(f"{out.path}/listed")
        before = Window.orderBy("archive").rowsBetween(Window.unboundedPreceding, -1)  # one row for each archive
        totals = listed.groupBy("archive").agg(F.count(F.lit(1)).alias("n")).select("archive", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
        numbered = listed.join(totals, "archive").select((F.col("first") + F.col("index")).alias("number"), *listed.columns)
        numbered.repartitionByRange("number").sortWithinPartitions("number").write.option("parquet.block.size", str(4 << 20)).parquet(f"{out.path}/members")
        placed = out.members().withColumn("file", F.col("_metadata.file_path"))
        places = placed.groupBy("archive").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("packed").alias("bytes"), F.sort_array(F.collect_set("file")).alias("files"))
        places.sort("first").write.parquet(f"{out.path}/archives")
        return out

    def members(self) -> DataFrame:
        """number, archive, index, name, offset, packed, size, method."""
        return self.spark.read.schema(f"number long, {MEMBERS}").parquet(f"{self.path}/members")

    def read(self) -> DataFrame:
        """number, archive, name, bytes; filters on the number (=, in, <, <=, >, >=) reach the source, which then plans
        partitions for those members only. Switches the session's filter pushdown for Python sources on."""
        self.spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        self.spark.dataSource.register(ArchiveSource)
        return self.spark.read.format(ArchiveSource.name()).option("index", self.path).load()


class ArchiveSource(DataSource):
    """Options: index (path of a stored index), part_bytes."""

    @classmethod
    def name(cls) -> str:
        return "quern_archive"

    def schema(self) -> str:
        return "number long, archive string, name string, bytes binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["index"], int(self.options.get("part_bytes", PART_BYTES)))


class Members(InputPartition):
    """Stretches of archives' members: (archive, files of the index, first and last number, numbers if only some are wanted)."""

    def __init__(self, stretches: list[tuple[str, list[str], int, int, list[int] | None]]):
        self.stretches = stretches


class ArchiveReader(DataSourceReader):
    def __init__(self, index: str, part_bytes: int):
        self.index, self.part_bytes = index, part_bytes
        self.low, self.high, self.wanted = 0, (1 << 63) - 1, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("number",):
                yield f
            elif isinstance(f, (EqualTo, In)):
                asked = {f.value} if isinstance(f, EqualTo) else {x for x in f.value if x is not None}
                self.wanted = asked if self.wanted is None else self.wanted & asked
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f

    def _stretches(self) -> Iterator[tuple[int, tuple]]:
        """(bytes, stretch) of the archives' wanted members, from a row for each archive; none is over ``part_bytes`` by the
        archive's mean."""
        for file in list_files(f"{self.index}/archives", ".parquet"):
            with open_file(file) as f:
                for a in pq.read_table(f).to_pylist():
                    first, last = max(self.low, a["first"]), min(self.high, a["first"] + a["n"] - 1)
                    each = max(1, a["bytes"] // a["n"])
                    step = max(1, self.part_bytes // each)
                    if self.wanted is None:
                        for s in range(first, last + 1, step):
                            stop = min(last, s + step - 1)
                            yield each * (stop - s + 1), (a["archive"], a["files"], s, stop, None)
                    else:
                        mine = sorted(x for x in self.wanted if first <= x <= last)
                        for s in range(0, len(mine), step):
                            some = mine[s : s + step]
                            yield each * len(some), (a["archive"], a["files"], some[0], some[-1], some)

    def partitions(self) -> list[Members]:
        """Stretches side by side up to ``part_bytes``, so that small archives share a task and large ones are split."""
        out, now, size = [], [], 0
        for n, stretch in self._stretches():
            if now and size + n > self.part_bytes:
                out.append(Members(now))
                now, size = [], 0
            now.append(stretch)
            size += n
        return [*out, Members(now)]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        ranges, rows, size = Ranges(), [], 0
        for _, files, first, last, wanted in partition.stretches:
            where = [("number", ">=", first), ("number", "<=", last)] + ([("number", "in", wanted)] if wanted else [])
            for file in files:
                with open_file(file) as f:
                    found = pq.read_table(f, filters=where).to_pylist()
                for m in found:
                    rows.append((m["number"], m["archive"], m["name"], ranges.member(*(m[c] for c in LOCATOR))))
                    size += m["size"]
                    if size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)
        ranges.close()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["number", "archive", "name", "bytes"])


def fetch_members(rows: DataFrame, locators: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the bytes behind each struct of LOCATOR fields in the array ``locators``, null for a null one.
    It runs where the rows are; no shuffle carries the bytes."""
    names, at = rows.columns, rows.columns.index(locators)
    schema = rows.drop(locators).schema.add(out, ArrayType(BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges()
        for batch in batches:
            for i, listed in enumerate(batch.column(at)):  # one row at a time: its bytes are what a task holds
                found = listed.as_py()
                data = None if found is None else [None if x is None else ranges.member(*(x[c] for c in LOCATOR)) for x in found]
                kept = [c.slice(i, 1) for j, c in enumerate(batch.columns) if j != at]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([data], pa.list_(pa.binary()))], names=[*(n for j, n in enumerate(names) if j != at), out])
        ranges.close()

    return rows.mapInArrow(run, schema)
