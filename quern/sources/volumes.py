"""Arrays in .npy files read by slab: a task reads the byte range of some rows of an array, never the whole file."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import Ranges

#: Bytes of a slab, unless one row of the outermost axis has more; bytes in which a header must end.
SLAB, HEADER = 16 << 20, 1 << 16
_PLAN = "path string, shape array<long>, dtype string, fortran boolean, start long, stop long, at long, size long"


def header_of(data: bytes) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """Shape, whether columns come first, type and size of the header of a .npy file, from its first bytes."""
    f = io.BytesIO(data)
    version = npy.read_magic(f)
    shape, fortran, dtype = (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(f)
    if dtype.hasobject:
        raise ValueError("pickled arrays are refused")
    return shape, fortran, dtype, f.tell()


def read_volume_slabs(spark: SparkSession, folder: str, glob: str = "*.npy", slab: int = SLAB) -> DataFrame:
    """path, shape, start, stop and values (flat, as doubles, in the file's order) of the slabs of all arrays of a folder.

    A slab is rows start to stop of the axis that lies outermost in the file: the first, or the last of an array with
    columns first (``fortran``). Headers are read first, by range; slabs are then dealt out as rows of a table, so that
    one large array is read by many tasks. Arrays without elements have no slab, single numbers have one. Broken, cut and
    pickled files are an error, as are types that aren't real numbers.
    """

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges()
        for batch in batches:
            rows = []
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    shape, fortran, dtype, at = header_of(ranges.get(path, 0, HEADER))
                except Exception as e:
                    raise ValueError(f"{path}: {e}") from e
                if dtype.kind not in "biuf":
                    raise ValueError(f"{path}: not real numbers but {dtype}")
                if length != at + dtype.itemsize * int(np.prod(shape, dtype=object)):
                    raise ValueError(f"{path} has {length} bytes, which its header doesn't promise")
                outer = (shape[::-1] if fortran else shape) or (1,)
                row = dtype.itemsize * int(np.prod(outer[1:], dtype=object))
                step = max(1, slab // max(1, row))
                for s in range(0, outer[0] if row else 0, step):
                    stop = min(outer[0], s + step)
                    rows.append((path, list(shape), dtype.str, fortran, s, stop, at + s * row, (stop - s) * row))
            kinds = [pa.string(), pa.list_(pa.int64()), pa.string(), pa.bool_(), *[pa.int64()] * 4]
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "shape", "dtype", "fortran", "start", "stop", "at", "size"])
        ranges.close()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges()
        for batch in batches:
            for i, r in enumerate(batch.to_pylist()):
                values = np.frombuffer(ranges.get(r["path"], r["at"], r["size"]), np.dtype(r["dtype"])).astype(float)
                listed = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))
                kept = batch.slice(i, 1).select(["path", "shape", "fortran", "start", "stop"])
                yield pa.RecordBatch.from_arrays([*kept.columns, listed], names=[*kept.schema.names, "values"])
        ranges.close()

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "length")
    slabs = files.mapInArrow(plan, _PLAN)
    dealt = slabs.repartition(F.col("path"), F.col("start"))
    return dealt.mapInArrow(read, "path string, shape array<long>, fortran boolean, start long, stop long, values array<double>")
