"""Saved datasets: folders of Arrow stream files with two state files, written with a commit and read by record batch."""

from __future__ import annotations

import io
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .ranges import Ranges, list_files, open_file, store_of

#: Bytes of record batches that a task reads, unless one batch has more.
STRETCH = 64 << 20
#: Bytes of a shard in memory beyond which more shards are written than were asked for.
SHARD_BYTES = 256 << 20
_STRETCHES = "file string, place long, head array<struct<at:long,size:long>>, start long, size long"
_SCHEMA, _DICTIONARY, _BATCH = 1, 2, 3


def _message(meta: bytes) -> tuple[int, int]:
    """Kind and body size of an Arrow message by its metadata, a flatbuffer: fields 1 and 3 of the root table."""
    root = struct.unpack_from("<I", meta)[0]
    table = root - struct.unpack_from("<i", meta, root)[0]
    size = struct.unpack_from("<H", meta, table)[0]
    place = lambda k: struct.unpack_from("<H", meta, table + 4 + 2 * k)[0] if 4 + 2 * k < size else 0
    kind, body = place(1), place(3)
    return (meta[root + kind] if kind else 0), (struct.unpack_from("<q", meta, root + body)[0] if body else 0)


def messages(path: str, ranges: Ranges | None = None) -> Iterator[tuple[int, int, int]]:
    """(kind, start, size) of the messages of an Arrow stream file; only their metadata is read."""
    ranges, at = ranges or Ranges(), 0
    while True:
        head = ranges.get(path, at, 8)
        if len(head) < 8:
            return
        mark, size = struct.unpack("<Ii", head)
        if mark != 0xFFFFFFFF:
            raise ValueError(f"{path}: no Arrow message at {at}")
        if not size:
            return
        kind, body = _message(ranges.get(path, at + 8, size))
        yield kind, at, 8 + size + body
        at += 8 + size + body


def data_files(folder: str) -> list[str]:
    """The files that a saved dataset's state names, in that order; without names there, its *.arrow files by name. A folder
    without both state files is no saved dataset."""
    names = {f.rsplit("/", 1)[1] for f in list_files(folder)}
    missing = {"dataset_info.json", "state.json"} - names
    if missing:
        raise ValueError(f"not a saved dataset, without {', '.join(sorted(missing))}: {folder}")
    with open_file(f"{folder.rstrip('/')}/state.json") as f:
        named = [x["filename"] for x in json.loads(f.read() or b"{}").get("_data_files") or []]
    lost = [n for n in named if n not in names]
    if lost:
        raise ValueError(f"{folder} lacks {', '.join(lost)}, which its state names")
    return [f"{folder.rstrip('/')}/{n}" for n in named or sorted(n for n in names if n.endswith(".arrow"))]


def read_saved(spark: SparkSession, folder: str, columns: list[str] | None = None, stretch: int = STRETCH) -> DataFrame:
    """Rows of a saved dataset, of ``columns`` if given. Files are cut between record batches by their messages' metadata,
    so that many tasks read a large file; a task reads the schema, dictionaries and its batches, and decodes its columns."""
    from pyspark.sql.pandas.types import from_arrow_schema

    files = data_files(folder)
    if not files:
        raise ValueError(f"no Arrow file in {folder}")
    with open_file(files[0]) as f:
        schema = pa.ipc.open_stream(f).schema
    unknown = set(columns or []) - set(schema.names)
    if unknown:
        raise ValueError(f"not in the dataset: {', '.join(sorted(unknown))}")
    fields = [schema.get_field_index(c) for c in columns] if columns else None

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head, rows, first, upto = [], [], None, 0
                for kind, at, size in messages(file):
                    if kind != _BATCH:
                        head.append({"at": at, "size": size})
                        if first is not None:  # a dictionary between batches holds for what follows
                            rows.append((file, place, head[:-1], first, upto - first))
                            first = None
                        continue
                    if first is not None and at + size - first > stretch:
                        rows.append((file, place, list(head), first, upto - first))
                        first = None
                    first, upto = at if first is None else first, at + size
                if first is not None:
                    rows.append((file, place, list(head), first, upto - first))
                kinds = [pa.string(), pa.int64(), pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int64())])), pa.int64(), pa.int64()]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["file", "place", "head", "start", "size"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges()
        for batch in batches:
            for r in batch.to_pylist():
                data = b"".join(ranges.get(r["file"], x["at"], x["size"]) for x in [*r["head"], {"at": r["start"], "size": r["size"]}])
                for part in pa.ipc.open_stream(io.BytesIO(data), options=pa.ipc.IpcReadOptions(included_fields=fields)):
                    yield pa.RecordBatch.from_arrays([_plain(part.column(c)) for c in columns], names=columns) if columns else pa.RecordBatch.from_arrays([_plain(c) for c in part.columns], names=part.schema.names)
        ranges.close()

    listed = spark.createDataFrame(list(enumerate(files)), "place long, file string").repartition(max(1, min(len(files), 1000)))
    cuts = listed.mapInArrow(plan, _STRETCHES)
    plain = pa.schema([pa.field(f.name, _plain(pa.array([], f.type)).type) for f in ([schema.field(c) for c in columns] if columns else schema)])
    return cuts.repartition(max(1, _tasks(spark, files, stretch)), "file", "start").mapInArrow(read, from_arrow_schema(plain))


def _tasks(spark: SparkSession, files: list[str], stretch: int) -> int:
    """As many tasks as there are stretches by the files' sizes, within reason."""
    total = 0
    for f in files:
        store, at = store_of(f)
        total += store.get_file_info(at).size
    return min(100_000, max(-(-total // stretch), min(len(files), spark.sparkContext.defaultParallelism)))


def _plain(column: pa.Array) -> pa.Array:
    return column.dictionary_decode() if pa.types.is_dictionary(column.type) else column


def write_saved(df: DataFrame, folder: str, shards: int | None = None, max_rows: int = 10_000) -> None:
    """``df`` as a saved dataset at ``folder``: numbered shards, one for each partition (or ``shards`` of them, more where
    they would hold over SHARD_BYTES each, since a shard is one task's; rows are weighed first), and both state files. Shards are written aside by tasks and moved on commit, the state last: a job that fails leaves no dataset
    and, after its abort, no file; a repeated task leaves one shard. A folder that holds a dataset already is an error."""
    df.sparkSession.dataSource.register(SavedDataset)
    rows = df.repartition(max(shards, -(-_weight(df) // SHARD_BYTES))) if shards else df
    rows.write.format(SavedDataset.name()).option("path", folder).option("rows", str(max_rows)).mode("append").save()


def _weight(df: DataFrame) -> int:
    """Bytes of all rows in Arrow."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["n"])

    return df.mapInArrow(sizes, "n long").agg(F.sum("n")).first()[0] or 0


class SavedDataset(DataSource):
    """Sink. Options: path, rows (in a record batch)."""

    @classmethod
    def name(cls) -> str:
        return "quern_saved"

    def writer(self, schema: StructType, overwrite: bool) -> SavedWriter:
        return SavedWriter(self.options["path"].rstrip("/"), schema, int(self.options.get("rows", 10_000)))


@dataclass
class Shard(WriterCommitMessage):
    partition: int
    name: str
    rows: int
    size: int


class SavedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, rows: int):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.rows, self.schema, self.aside = path, rows, to_arrow_schema(schema), f"{path}/.aside-{uuid.uuid4().hex}"
        store, at = store_of(path)
        if store.get_file_info(f"{at}/state.json").type == pa.fs.FileType.File:
            raise ValueError(f"{path} holds a dataset")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        """One shard aside, under a name that no other attempt has; empty partitions write none."""
        from pyspark import TaskContext

        store, at = store_of(self.aside)
        store.create_dir(at, recursive=True)
        name, n, out, writer = f"{uuid.uuid4().hex}.arrow", 0, None, None
        for batch in iterator:
            if batch.num_rows:
                if writer is None:
                    out = store.open_output_stream(f"{at}/{name}")
                    writer = pa.ipc.new_stream(out, batch.schema)
                for s in range(0, batch.num_rows, self.rows):
                    writer.write_batch(batch.slice(s, self.rows))
                n += batch.num_rows
        if writer is None:
            return Shard(TaskContext.get().partitionId(), "", 0, 0)
        writer.close()
        out.close()
        return Shard(TaskContext.get().partitionId(), name, n, store.get_file_info(f"{at}/{name}").size)

    def commit(self, messages: list[Shard | None]) -> None:
        store, at = store_of(self.path)
        shards = sorted((m for m in messages if m and m.rows), key=lambda m: m.partition)
        store.create_dir(at, recursive=True)
        if not shards:  # the schema is kept
            with store.open_output_stream(f"{at}/data-00000-of-00001.arrow") as out, pa.ipc.new_stream(out, self.schema):
                pass
        names = [f"data-{i:05d}-of-{len(shards):05d}.arrow" for i in range(len(shards))] or ["data-00000-of-00001.arrow"]
        for m, name in zip(shards, names, strict=False):
            store.move(f"{store_of(self.aside)[1]}/{m.name}", f"{at}/{name}")
        info = {"features": {f.name: str(f.type) for f in self.schema}, "num_rows": sum(m.rows for m in shards), "dataset_size": sum(m.size for m in shards)}
        self._put("dataset_info.json", info)
        self._put("state.json", {"_data_files": [{"filename": n} for n in names], "_fingerprint": uuid.uuid4().hex, "_format_type": None})
        self._clear()

    def abort(self, messages: list[Shard | None]) -> None:
        self._clear()

    def _put(self, name: str, content: dict) -> None:
        store, at = store_of(self.path)
        with store.open_output_stream(f"{at}/.{name}") as f:
            f.write(json.dumps(content).encode())
        store.move(f"{at}/.{name}", f"{at}/{name}")

    def _clear(self) -> None:
        store, at = store_of(self.aside)
        if store.get_file_info(at).type == pa.fs.FileType.Directory:
            store.delete_dir(at)
