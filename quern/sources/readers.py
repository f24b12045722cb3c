"""Scans: every one is lazy, with an explicit schema."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import store_of
from .scratch import hadoop


def parse_jsonl(lines: DataFrame, schema: str, keep_line: bool = False) -> DataFrame:
    """The rows in ``value`` with ``malformed``: lines that are blank, broken or no object are rows of nulls with it set.
    With ``keep_line`` such a line stays in ``line``."""
    object_only = F.when(F.startswith(F.trim("value"), F.lit("{")), F.col("value"))
    parsed = F.from_json(object_only, f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"})
    rows = lines.select("value", parsed.alias("r")).withColumn("malformed", F.col("r").isNull() | F.col("r.__bad").isNotNull())
    fields = [f.name for f in rows.schema["r"].dataType.fields if f.name != "__bad"]
    kept = [F.when(F.col("malformed"), F.col("value")).alias("line")] if keep_line else []
    return rows.select(*(F.when(~F.col("malformed"), F.col(f"r.{n}")).alias(n) for n in fields), *kept, "malformed")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each line, malformed and blank ones as nulls with ``malformed`` set."""
    return parse_jsonl(spark.read.text(path), schema)


def read_jsonl_matching(spark: SparkSession, path: str, schema: str, needles: list[str]) -> DataFrame:
    """Lines that contain any of the strings, filtered before they are parsed."""
    hit = F.lit(False)
    for n in needles:
        hit = hit | F.contains("value", F.lit(n))
    return spark.read.text(path).where(hit).select(F.from_json("value", schema).alias("r")).select("r.*")


SUFFIXES = {"parquet": "parquet", "pq": "parquet", "orc": "orc", "json": "json", "jsonl": "json", "csv": "csv", "tsv": "tsv", "arrow": "arrow"}


def read_table(spark: SparkSession, path: str | list[str], format: str | None = None, schema: str | None = None, config: str | None = None, data_dir: str | None = None) -> DataFrame:
    """One table of a path or several: by format, by the path's suffix, or for a folder by the suffix of its files.

    parquet, orc, json(l), csv, tsv, and folders of a saved dataset. ``data_dir`` is a folder below the path, and ``config``
    one below that.
    """
    paths = ["/".join(x for x in (p.rstrip("/"), data_dir, config) if x) for p in ([path] if isinstance(path, str) else path)]
    kind = format or SUFFIXES.get(paths[0].rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()) or _kind_of_folder(spark, paths[0])
    if kind == "arrow":
        return read_saved_dataset(spark, paths[0])
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in ("csv", "tsv"):
        return reader.option("header", True).option("nanValue", "NaN").option("sep", "\t" if kind == "tsv" else ",").csv(paths)
    return reader.format({"jsonl": "json", "pq": "parquet"}.get(kind, kind)).load(paths)


def _names(spark: SparkSession, folder: str) -> list[str]:
    files, at = hadoop(spark, folder)
    return sorted(f.getPath().getName() for f in files.listStatus(at))


def _kind_of_folder(spark: SparkSession, folder: str) -> str:
    names = _names(spark, folder)
    if {"dataset_info.json", "state.json"} <= set(names):
        return "arrow"
    kinds = {SUFFIXES[n.rsplit(".", 1)[-1].lower()] for n in names if n[0] not in "._" and n.rsplit(".", 1)[-1].lower() in SUFFIXES}
    if len(kinds) != 1:
        raise ValueError(f"files of one format are expected in {folder}, found: {', '.join(sorted(kinds)) or 'none'}")
    return kinds.pop()


def read_saved_dataset(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """A saved dataset: a folder with dataset_info.json, state.json and Arrow stream files, read by record batch."""
    from .saved import read_saved

    return read_saved(spark, folder, columns)


def spread(scan: DataFrame, each: int = 1) -> DataFrame:
    """A scan of fewer splits than the session has cores (or ``each`` times as many, so that none waits long for the last),
    dealt to all of them by rows: for work that costs much a row. Scans with more splits stay as they are, so large tables
    aren't shuffled."""
    cores = each * scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def packed(scan: DataFrame) -> DataFrame:
    """A scan of single files in fewer tasks: Spark puts 32 small files to one, which then takes longer to start than to run.
    Up to 16 of its tasks become one, without a shuffle, but four a core stay."""
    n = scan.rdd.getNumPartitions()
    return scan.coalesce(max(4 * scan.sparkSession.sparkContext.defaultParallelism, n // 16, 1))


def read_parquet_registry(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes, format of the Parquet files in a folder (not below it); the last row of a path in the last file wins."""
    from ..operators.mixing import last_wins

    rows = spark.read.option("pathGlobFilter", "*.parquet").schema("path string, bytes binary, format string").parquet(folder)
    placed = rows.select("path", "bytes", "format", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    return last_wins(placed, "path", "file", "at").drop("file", "at")


def _scanned(below: str, recursive: bool) -> bool:
    """Whether a scan of files takes one at this path below its folder: no name is hidden, and folders are partitions' if
    others aren't looked into."""
    parts = below.split("/")
    hidden = any(p[0] == "." or p[0] == "_" and "=" not in p or p.endswith("._COPYING_") for p in parts)
    return not hidden and (recursive or all("=" in p for p in parts[:-1]))


def empty_files(spark: SparkSession, folder: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """path of the files without a byte, which Spark's scans of files leave out, chosen as by those scans. A task lists the
    folder and those below it, one at a time; a store that only Spark opens is listed by the driver."""
    files, at = hadoop(spark, folder)
    roots, found = [], []
    for root in (s.getPath() for s in files.globStatus(at) or ()):
        try:
            store_of(root.toString())
            roots.append((root.toString(),))
        except (OSError, ValueError, NotImplementedError):  # Arrow has no such store
            found += [(root.toString(), p) for p in _empty_by_hadoop(files, root) if _scanned(p or root.getName(), recursive)]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root in batch.column(0).to_pylist():
                store, top = store_of(root)
                info = store.get_file_info(top)
                if info.is_file and not info.size and _scanned(info.base_name, recursive):
                    yield pa.RecordBatch.from_pydict({"path": [root]})
                folders = [top] if info.type == pa.fs.FileType.Directory else []
                while folders:
                    names = []
                    for f in store.get_file_info(pa.fs.FileSelector(folders.pop())):
                        if f.size:
                            continue
                        name = f.path[len(top.rstrip("/")) + 1 :]
                        if f.type == pa.fs.FileType.Directory and _scanned(f"{name}/-", recursive):
                            folders.append(f.path)
                        elif f.is_file and _scanned(name, recursive):
                            names.append(f"{root.rstrip('/')}/{name}")
                    yield pa.RecordBatch.from_pydict({"path": pa.array(names, pa.string())})

    paths = spark.createDataFrame(roots, "path string").coalesce(1).mapInArrow(listed, "path string")
    if found:
        paths = paths.unionByName(spark.createDataFrame([("/".join(x for x in f if x),) for f in found], "path string"))
    if glob is None:
        return paths
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
    return paths.where(F.element_at(F.split("path", "/"), -1).rlike(rf"(?s)\A(?:{pattern})\z"))


def _empty_by_hadoop(files, root) -> Iterator[str]:
    """Paths below the root, "" for itself."""
    listed = files.listFiles(root, True)
    while listed.hasNext():
        f = listed.next()
        if not f.getLen():
            yield f.getPath().toString()[len(root.toString().rstrip("/")) + 1 :]


def read_files(spark: SparkSession, folder: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """path and bytes of files, empty ones as well."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    empty = empty_files(spark, folder, glob, recursive).select("path", F.lit("").cast("binary").alias("bytes"))
    return packed(empty.unionByName(reader.load(folder).select("path", F.col("content").alias("bytes"))))  # listed beside the reading


def read_image_folders(spark: SparkSession, folder: str) -> DataFrame:
    """path, label and class of files in class sub-directories; labels number the class names in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.element_at(F.split("path", "/"), -2).alias("class"))
    names = [r[0] for r in files.select("class").distinct().orderBy("class").collect()]  # one for each class
    table = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i))) if names else F.create_map(F.lit(""), F.lit(0))
    return files.select("path", table[F.col("class")].alias("label"), "class")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """One row a character of a file or of a folder's files: index and answer. Line breaks are no answers. Lines are
    numbered as they stand in the files and their lengths summed up in stretches, so no task has more than its lines."""
    from ..operators.running import running
    from .scan_order import numbered_scan

    lines = numbered_scan(spark, path).withColumn("n", F.length("value")).where("n > 0")
    placed = running(lines, "n", None, F.col("row")).select("value", (F.col("running_sum") - F.col("n")).cast("long").alias("start"))
    each = placed.select("start", F.posexplode(F.filter(F.split("value", ""), lambda c: c != "")).alias("at", "answer"))
    return each.select((F.col("start") + F.col("at")).alias("index"), "answer")


def read_volumes(spark: SparkSession, folder: str) -> DataFrame:
    """path, shape and values (flat, as doubles) of .npy files; pickled arrays are refused."""

    def volumes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [np.load(io.BytesIO(b), allow_pickle=False) for b in frame["bytes"]]
            yield pd.DataFrame({"path": frame["path"], "shape": [list(map(int, x.shape)) for x in found], "values": [x.astype(float).ravel() for x in found]})

    return read_files(spark, folder, "*.npy").mapInPandas(volumes, "path string, shape array<int>, values array<double>")


def read_images(spark: SparkSession, folder: str | list[str], glob: str | None = None) -> DataFrame:
    """path, height, width, channels and pixels of the image files of a folder or of a list, decoded in the JVM; -1 and no
    pixels where that fails. The source's pixels are in the order blue, green, red, as rgb_pixels turns round."""
    reader = spark.read.format("image").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return packed(reader.load(folder).select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels")))


def rgb_pixels(pixels: Column, channels: Column) -> Column:
    """Three bytes a pixel, red, green, blue, of the image source's pixels of 1, 3 or 4 channels; null where there are none.
    Only bytes of a few rows at a time are held."""

    @F.pandas_udf("binary")
    def rgb(data: pd.Series, n: pd.Series) -> pd.Series:
        order = {1: [0, 0, 0], 3: [2, 1, 0], 4: [2, 1, 0]}
        return pd.Series([np.frombuffer(d, np.uint8).reshape(-1, k)[:, order[k]].tobytes() if d else None for d, k in zip(data, n, strict=True)], dtype=object)

    return rgb(pixels, channels)


def read_archives(spark: SparkSession, folder: str, glob: str = "*.tar") -> DataFrame:
    """archive, index, name and bytes of the files inside tar or zip archives.

    For stores that only Spark opens: one task holds an archive at a time and hands its files on one by one. Elsewhere
    ArchiveIndex reads members by range. Names that leave the archive's folder are an error; ``index`` counts inside an archive.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for i, (name, content) in enumerate(_members(path, data.as_buffer())):
                    if name.startswith("/") or ".." in name.split("/"):
                        raise ValueError(f"{path}: {name} leaves the archive's folder")
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([i], pa.int64()), pa.array([name]), pa.array([content], pa.binary())], names=["archive", "index", "name", "bytes"])

    return read_files(spark, folder, glob).mapInArrow(members, "archive string, index long, name string, bytes binary")


def _members(path: str, data) -> Iterator[tuple[str, bytes]]:
    if path.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for n in z.namelist():
                if not n.endswith("/"):
                    yield n, z.read(n)
    else:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                if m.isfile():
                    yield m.name, t.extractfile(m).read()
