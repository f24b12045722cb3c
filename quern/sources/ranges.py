"""Byte ranges of files in any store that Arrow opens, read inside tasks."""

from __future__ import annotations

import re
import zlib
from collections import OrderedDict

import pyarrow as pa
import pyarrow.fs

#: Files that a task keeps open at a time.
OPEN_FILES = 64


def store_of(path: str) -> tuple[pa.fs.FileSystem, str]:
    """(file system, path in it) of an absolute path or URI."""
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def open_file(path: str) -> pa.NativeFile:
    files, at = store_of(path)
    return files.open_input_file(at)


def list_files(folder: str, suffix: str = "") -> list[str]:
    """Files directly in a folder, in the order of their names."""
    files, at = store_of(folder)
    found = [f.base_name for f in files.get_file_info(pa.fs.FileSelector(at)) if f.is_file]
    return [f"{folder.rstrip('/')}/{n}" for n in sorted(found) if n.endswith(suffix) and n[0] not in "._"]


class Ranges:
    """Reads ranges; ``opened`` counts the files it had to open, ``read`` the bytes."""

    def __init__(self):
        self.files: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.opened = self.read = 0

    def _file(self, path: str) -> pa.NativeFile:
        if path not in self.files:
            if len(self.files) >= OPEN_FILES:
                self.files.popitem(last=False)[1].close()
            self.files[path] = open_file(path)
            self.opened += 1
        self.files.move_to_end(path)
        return self.files[path]

    def get(self, path: str, offset: int, size: int) -> bytes:
        """The bytes there, fewer at the end of the file."""
        data = self._file(path).read_at(size, offset)
        self.read += len(data)
        return data

    def member(self, path: str, offset: int, packed: int, size: int, method: str) -> bytes:
        """An archive's member at its place; a short or damaged one is an error."""
        data = self.get(path, offset, packed)
        if method == "deflate":
            data = zlib.decompress(data, -15)
        if len(data) != size:
            raise ValueError(f"{path}: {len(data)} of {size} bytes at {offset}")
        return data

    def close(self) -> None:
        for f in self.files.values():
            f.close()
        self.files.clear()
