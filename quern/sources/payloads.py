"""Large registries of payloads: a table bucketed and sorted by path, joined by place, its bytes fetched last.

Joins and groupings carry a payload's place (file, row) instead of its bytes. The table is bucketed by path and has each
path once, so the join shuffles the references only; the bytes are read from small row groups where the rows end up.
"""

from __future__ import annotations

import itertools
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType

from ..functions.common import fresh
from .ranges import OPEN_FILES, open_file

#: Bytes of a row group, the unit that a fetch reads, and how many of them a task remembers.
ROW_GROUP, KEPT_GROUPS = 4 << 20, 8
#: Bytes of rows and payloads that a task fetches together, by the averages of row groups, and that it hands on at a time.
FETCH_BYTES, OUT_BYTES = 64 << 20, 8 << 20


def write_registry(rows: DataFrame, table: str, buckets: int, *order: Column, path: str = "path", location: str | None = None) -> None:
    """``rows`` as a table of that many buckets, sorted by path; of a path's rows the last in ``order`` stays (any, without
    an order), null paths go. The rows are shuffled once: the choice runs on the buckets' partitioning. ``location`` is the
    table's folder, by default one in the warehouse."""
    (n,) = fresh(rows, "n")
    placed = rows.where(F.col(path).isNotNull()).repartition(buckets, path)
    last = Window.partitionBy(path).orderBy(*(c.desc_nulls_last() for c in order) or (F.lit(0),))
    chosen = placed.withColumn(n, F.row_number().over(last)).where(F.col(n) == 1).drop(n)
    out = chosen.write.mode("overwrite").format("parquet").option("parquet.block.size", str(ROW_GROUP)).bucketBy(buckets, path).sortBy(path)
    (out.option("path", location) if location else out).saveAsTable(table)


def places_of(spark: SparkSession, table: str, path: str = "path") -> DataFrame:
    """path and place (file, row) of every payload; no payload is read."""
    return spark.table(table).select(F.col(path).alias("path"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place"))


class _Groups:
    """Columns of row groups by file, the latest remembered; a file's footer is read once."""

    def __init__(self, column: str):
        self.column, self.read = column, 0
        self.kept, self.files, self.metas = OrderedDict(), OrderedDict(), {}

    def _meta(self, file: str) -> tuple[pq.FileMetaData, list[int], list[float]]:
        """Footer, first row of each group and one past the last, bytes of a payload of each group on average."""
        if file not in self.metas:
            with open_file(file) as f:
                meta = pq.read_metadata(f)
            groups = [meta.row_group(g) for g in range(meta.num_row_groups)]
            k = meta.schema.names.index(self.column)
            self.metas[file] = meta, list(itertools.accumulate((g.num_rows for g in groups), initial=0)), [g.column(k).total_uncompressed_size / max(1, g.num_rows) for g in groups]
        return self.metas[file]

    def _group(self, file: str, row: int) -> int:
        return bisect_right(self._meta(file)[1], row) - 1

    def size(self, file: str, row: int) -> float:
        return self._meta(file)[2][self._group(file, row)]

    def _opened(self, file: str) -> pq.ParquetFile:
        if file not in self.files:
            if len(self.files) >= OPEN_FILES:
                self.files.popitem(last=False)[1].close(force=True)
            self.files[file] = pq.ParquetFile(open_file(file), metadata=self._meta(file)[0])
        self.files.move_to_end(file)
        return self.files[file]

    def get(self, file: str, row: int) -> bytes | None:
        g = self._group(file, row)
        if (file, g) not in self.kept:
            if len(self.kept) >= KEPT_GROUPS:
                self.kept.popitem(last=False)
            self.kept[file, g] = self._opened(file).read_row_group(g, columns=[self.column]).column(0)
            self.read += 1
        self.kept.move_to_end((file, g))
        return self.kept[file, g][row - self._meta(file)[1][g]].as_py()

    def close(self) -> None:
        for f in self.files.values():
            f.close(force=True)
        self.files.clear()


def _windows(batches: Iterator[pa.RecordBatch], at: int, groups: _Groups) -> Iterator[list[tuple[pa.RecordBatch, list]]]:
    """Rows in order, with their places, as many at a time as take FETCH_BYTES with their payloads."""
    held, room = [], 0.0
    for whole in batches:
        listed, start, each = whole.column(at).to_pylist(), 0, whole.nbytes / max(1, whole.num_rows)
        for i, row in enumerate(listed):
            cost = each + sum(groups.size(x["file"], x["row"]) for x in row or [] if x is not None)
            if room and room + cost > FETCH_BYTES:
                yield [*held, (whole.slice(start, i - start), listed[start:i])]
                held, room, start = [], 0.0, i
            room += cost
        held.append((whole.slice(start), listed[start:]))
    yield held


def fetch_payloads(rows: DataFrame, places: str, out: str, column: str = "bytes") -> DataFrame:
    """``rows`` with ``out``: the payload behind each place of the array ``places``, null for a null one. The places of as many
    rows as FETCH_BYTES allow are read in the order of files, so a row group is read once for all of them. Nothing is shuffled."""
    names, at = rows.columns, rows.columns.index(places)
    schema = rows.drop(places).schema.add(out, ArrayType(BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _Groups(column)
        for window in _windows(batches, at, groups):
            found = {p: groups.get(*p) for p in sorted({(x["file"], x["row"]) for _, listed in window for row in listed for x in row or [] if x is not None})}
            for batch, listed in window:
                kept, data, start, size = [c for j, c in enumerate(batch.columns) if j != at], [], 0, 0
                for i, row in enumerate(listed):
                    data.append(None if row is None else [None if x is None else found[x["file"], x["row"]] for x in row])
                    size += sum(len(x) for x in data[-1] or [] if x is not None)
                    if size > OUT_BYTES or i + 1 == len(listed):
                        yield pa.RecordBatch.from_arrays([*(c.slice(start, i + 1 - start) for c in kept), pa.array(data, pa.list_(pa.binary()))], names=[*(n for j, n in enumerate(names) if j != at), out])
                        data, start, size = [], i + 1, 0
        groups.close()

    return rows.mapInArrow(run, schema)
