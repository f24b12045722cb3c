"""Registries of attachments: where the bytes behind a sample's references are."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import fresh
from ..functions.images import header, verified_png
from ..operators.modalities import exploded, merge_registry, valid_samples
from .archives import LOCATOR, ArchiveIndex, fetch_members
from .bloom import Bloom
from .payloads import fetch_payloads, places_of
from .ranges import Ranges
from .readers import read_files, read_images
from .scratch import Stored

#: Bytes that are read for a header at first; a header that isn't found there is looked for in as many as FULL_HEADER.
HEADER, FULL_HEADER = 4096, 1 << 20
#: Files that are decoded by a scan of their paths, which pass the driver; more are decoded by a scan of the whole folder.
DECODE_PATHS = 20_000


class Registry(Protocol):
    """A lookup table (path, payload), the rule for samples whose attachments it can serve, and the merge."""

    def lookup(self) -> DataFrame: ...

    def check(self, samples: DataFrame) -> DataFrame: ...

    def merge(self, samples: DataFrame, strict: bool = True) -> DataFrame: ...


def _fetched_last(samples: DataFrame, places: DataFrame, strict: bool, fetch) -> DataFrame:
    """Samples with payloads for values: joined by (path, place), each path once; the payloads are fetched after the last shuffle."""
    located = merge_registry(samples, places, "place", strict=strict, unique=True)
    at, got = fresh(located, "at", "got")
    whole = fetch(located.withColumn(at, F.transform("modalities", lambda m: m["value"])), at, got)
    return whole.withColumn("modalities", F.transform("modalities", lambda m, i: m.withField("value", F.get(got, i)))).select(*samples.columns)


class FileRegistry:
    """Files below a folder, by their path relative to it; samples are kept if their images decode with height over 1."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _below(self, df: DataFrame, path: str = "path") -> DataFrame:
        base = re.escape(self.base.split(":", 1)[-1].lstrip("/"))
        return df.withColumn(path, F.regexp_replace(path, f"^([a-z]+:)?/*{base}/", ""))

    def lookup(self) -> DataFrame:
        return self._below(read_files(self.spark, self.base, recursive=True)).select("path", F.col("bytes").alias("payload"))

    def merge(self, samples: DataFrame, strict: bool = True) -> DataFrame:
        return merge_registry(samples, self.lookup(), strict=strict)

    def referenced(self, samples: DataFrame) -> DataFrame:
        """path and at (where the file is) of the files that samples refer to. Of the folder only names are listed: a
        filter of the references drops most of them in the scan, a join the rest. Nothing is opened."""
        asked = Stored(exploded(samples).select(F.col("m.value").cast("string").alias("path")).where("path is not null").distinct(), "references").df
        names = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.base).select(F.col("path").alias("at"))
        listed = self._below(names.withColumn("path", F.col("at"))).where(Bloom(asked, "path").may_have(F.col("path")))
        return listed.join(asked, "path", "left_semi")

    def headers(self, samples: DataFrame) -> DataFrame:
        """path, at, format, width, height, opened of the files that samples refer to, by range reads of their headers;
        nulls where no header is understood. ``opened`` counts the files that a row's reading opened."""
        return _headers(self.referenced(samples))

    def check(self, samples: DataFrame) -> DataFrame:
        """Samples without attachments stay. Only referenced files are opened; what fails by its header isn't read further,
        PNG files of a right height are unpacked and verified where they are, others are decoded by the image source: only
        these while they are few, else with the folder's others, which costs more reading but no list on the driver."""
        found = Stored(_headers(self.referenced(samples)).where("height > 1"), "headers").df
        png = found.where("format = 'png'").mapInArrow(_verify, "path string, height int")
        rest = found.where("format <> 'png'").select("path", "at")
        n = rest.count()
        if not n:
            return valid_samples(samples, png)
        decoded = read_images(self.spark, [r["at"] for r in rest.collect()] if n <= DECODE_PATHS else self.base)
        good = png.unionByName(self._below(decoded).select("path", "height").join(rest.select("path"), "path", "left_semi"))
        return valid_samples(samples, good)

    def with_headers(self, samples: DataFrame) -> DataFrame:
        """Samples whose files all have a header that is understood, of any height: the cheaper rule for training rows."""
        return valid_samples(samples, self.headers(samples).where("format is not null").select("path"), min_height=None)


def _headers(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ranges = Ranges()
                data = ranges.get(at, 0, HEADER)
                found = header(data) or (header(ranges.get(at, 0, FULL_HEADER)) if data[:2] == b"\xff\xd8" else None)
                rows.append((path, at, *(found or (None, None, None)), ranges.opened, ranges.read))
                ranges.close()
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            names = ["path", "at", "format", "width", "height", "opened", "bytes_read"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return files.select("path", "at").mapInArrow(run, "path string, at string, format string, width int, height int, opened long, bytes_read long")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ranges, names, heights = Ranges(), [], []
        for path, at in zip(batch.column("path").to_pylist(), batch.column("at").to_pylist(), strict=True):
            height = verified_png(lambda offset, size, at=at: ranges.get(at, offset, size))
            if height is not None:
                names.append(path)
                heights.append(height)
        ranges.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(heights, pa.int32())], names=["path", "height"])


class ArchiveRegistry:
    """Files in archives, by their number over all archives; samples are kept if all numbers are there. Only the bytes of
    members that samples refer to are read, after the last shuffle."""

    def __init__(self, spark: SparkSession, folder: str, glob: str = "*.tar"):
        self.index = ArchiveIndex.build(spark, folder, glob)

    def _places(self) -> DataFrame:
        return self.index.members().select(F.col("number").cast("string").alias("path"), F.struct(*LOCATOR).alias("place"))

    def lookup(self) -> DataFrame:
        return self.index.read().select(F.col("number").cast("string").alias("path"), F.col("bytes").alias("payload"))

    def check(self, samples: DataFrame) -> DataFrame:
        return valid_samples(samples, self._places().select("path"), min_height=None)

    def merge(self, samples: DataFrame, strict: bool = True) -> DataFrame:
        return _fetched_last(samples, self._places(), strict, fetch_members)


class TableRegistry:
    """A registry table that ``write_registry`` made; samples are kept if all paths are there."""

    def __init__(self, spark: SparkSession, table: str, column: str = "bytes"):
        self.spark, self.table, self.column = spark, table, column

    def lookup(self) -> DataFrame:
        return self.spark.table(self.table).select("path", F.col(self.column).alias("payload"))

    def check(self, samples: DataFrame) -> DataFrame:
        return valid_samples(samples, self.spark.table(self.table).select("path"), min_height=None, unique=True)

    def merge(self, samples: DataFrame, strict: bool = False) -> DataFrame:
        return _fetched_last(samples, places_of(self.spark, self.table), strict, lambda rows, at, out: fetch_payloads(rows, at, out, self.column))


def registry_of(kind: str, spark: SparkSession, folder: str) -> Registry:
    """``wids`` reads archives, ``table`` a registry table, any other kind files; ``hdf5`` has no reader."""
    if kind == "hdf5":
        raise NotImplementedError("no reader for hdf5")
    return {"wids": ArchiveRegistry, "table": TableRegistry}.get(kind, FileRegistry)(spark, folder)


def merged(samples: DataFrame, registry: Registry, check_input: bool = False, strict: bool = True) -> DataFrame:
    """Samples with the registry's bytes as values; with ``check_input`` those that it can't serve go first."""
    return registry.merge(registry.check(samples) if check_input else samples, strict=strict)
