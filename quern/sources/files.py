"""A sink of single files: a row is a path and its bytes; what can't be written becomes a row of a failures table."""

from __future__ import annotations

import errno
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .ranges import store_of

#: Folder of the failures table below the files'.
FAILURES = "_failures"
#: Errors that a path brings about itself; any other is the store's.
OF_PATH = {errno.EACCES, errno.EEXIST, errno.EILSEQ, errno.EINVAL, errno.EISDIR, errno.ELOOP, errno.ENAMETOOLONG, errno.ENOTDIR, errno.ENOTEMPTY, errno.EPERM}
_FAILED = pa.schema([("path", pa.string()), ("error", pa.string())])


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``bytes`` to ``path`` below ``folder`` now; returns the table of the paths that failed and why.

    A task writes its files aside and moves them to their places when it has all of them, so a task that fails or is
    repeated leaves no part of a file, and of a path's several rows one stays whole. Failures are a table below the folder,
    renewed by each write. Paths that leave the folder, that the store can't have (a file is in the way, a name is too long),
    null paths and null bytes fail; a store that fails (it is full, a file too many is open) fails the task, as its rows
    aren't at fault. Folders are made as needed. Any store that Arrow opens will do.
    """
    spark = rows.sparkSession
    spark.dataSource.register(FileSink)
    rows.select(rows["path"].cast("string").alias("path"), rows["bytes"].cast("binary").alias("bytes")).write.format(FileSink.name()).option("path", folder).mode("append").save()
    return spark.read.schema("path string, error string").parquet(f"{folder.rstrip('/')}/{FAILURES}")


class FileSink(DataSource):
    """Option: path, the folder."""

    @classmethod
    def name(cls) -> str:
        return "quern_files"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"].rstrip("/"))


@dataclass
class Written(WriterCommitMessage):
    files: int
    failures: str  # the task's failures, aside


class FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.aside = path, f"{path}/.aside-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = store_of(self.path)
        own = f"{store_of(self.aside)[1]}/{uuid.uuid4().hex}"
        store.create_dir(own, recursive=True)
        moves, failed, made = [], [], set()
        for batch in iterator:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at = None if name is None else posixpath.normpath(posixpath.join(root, name))
                if at is None or not at.startswith(root + "/") or not data.is_valid:
                    failed.append((name, "no path" if at is None else "leaves the folder" if data.is_valid else "no bytes"))
                    continue
                with store.open_output_stream(f"{own}/{len(moves)}") as f:
                    f.write(data.as_buffer())
                moves.append((name, at))
        done = 0
        for i, (name, at) in enumerate(moves):
            try:
                if (parent := posixpath.dirname(at)) not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                store.move(f"{own}/{i}", at)
                done += 1
            except (OSError, ValueError) as e:
                if isinstance(e, OSError) and e.errno not in OF_PATH:
                    raise
                failed.append((name, str(e)))  # what can't be written is listed, not fatal
        table = pa.Table.from_arrays([pa.array([x[k] for x in failed], pa.string()) for k in (0, 1)], schema=_FAILED)
        with store.open_output_stream(f"{own}/failures") as f:
            pq.write_table(table, f)
        return Written(done, f"{own}/failures")

    def commit(self, messages: list[Written | None]) -> None:
        """The failures table appears: one file for each task that had any, and one at least."""
        store, root = store_of(self.path)
        folder = f"{root}/{FAILURES}"
        if store.get_file_info(folder).type == pa.fs.FileType.Directory:
            store.delete_dir(folder)
        store.create_dir(folder, recursive=True)
        for i, m in enumerate(m for m in messages if m):
            store.move(m.failures, f"{folder}/part-{i:05d}.parquet")
        if not messages:
            with store.open_output_stream(f"{folder}/part-00000.parquet") as f:
                pq.write_table(_FAILED.empty_table(), f)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, at = store_of(self.aside)
        if store.get_file_info(at).type == pa.fs.FileType.Directory:
            store.delete_dir(at)
