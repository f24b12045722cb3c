"""Batched maps: a callable over columns of a fixed number of rows, as arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string

Columns = dict[str, "np.ndarray | Lists | list"]


class Lists:
    """A column of arrays of numbers: ``values[offsets[i]:offsets[i + 1]]`` is row i's."""

    def __init__(self, offsets: np.ndarray, values: np.ndarray):
        self.offsets, self.values = offsets, values

    def __len__(self) -> int:
        return len(self.offsets) - 1


def _handed(column: pa.Array) -> np.ndarray | Lists | list:
    """Numbers without nulls as NumPy arrays, arrays of them as Lists, both without a copy; all else as Python values."""
    kind = column.type
    if pa.types.is_primitive(kind) and not pa.types.is_temporal(kind) and not column.null_count:
        return column.to_numpy(zero_copy_only=False)
    if (pa.types.is_list(kind) or pa.types.is_large_list(kind)) and not column.null_count:
        flat = column.flatten()
        if pa.types.is_primitive(flat.type) and not pa.types.is_temporal(flat.type) and not flat.null_count:
            offsets = column.offsets.to_numpy()
            return Lists(offsets - offsets[0], flat.to_numpy(zero_copy_only=False))
    return column.to_pylist()


def _taken(value, kind: pa.DataType) -> pa.Array:
    if isinstance(value, pa.Array):
        return value.cast(kind)
    if isinstance(value, Lists):
        whole = pa.large_list(kind.value_type) if pa.types.is_large_list(kind) else pa.list_(kind.value_type)
        make = pa.LargeListArray if pa.types.is_large_list(kind) else pa.ListArray
        return make.from_arrays(pa.array(value.offsets, pa.int64() if pa.types.is_large_list(kind) else pa.int32()), pa.array(value.values, kind.value_type)).cast(whole)
    return pa.array(value, kind)


def _sized(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``size``, the last one shorter."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - n)
            held.append(part)
            n, batch = n + part.num_rows, batch.slice(part.num_rows)
            if n == size:
                yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def map_batches(df: DataFrame, f: Callable[[Columns], Columns], schema: str, size: int = 1000, errors: str = "raise") -> DataFrame:
    """``f`` over the columns of ``size`` rows at a time (the last batch of a task is shorter), giving columns of ``schema``.

    ``f`` may return more or fewer rows than it got, but as many in each column. Errors of ``f``: ``raise`` fails the job,
    ``drop`` leaves the batch out, ``rows`` tries its rows one by one and leaves out those that fail. Columns that ``schema``
    lacks are left out, ones that ``f`` doesn't return are an error. An empty table gives none; f isn't called for it.
    """
    if errors not in ("raise", "drop", "rows"):
        raise ValueError(f"errors is raise, drop or rows, not {errors}")
    if size < 1:
        raise ValueError("a batch has one row at least")
    from pyspark.sql.pandas.types import to_arrow_schema

    declared: StructType = _parse_datatype_string(schema)
    kinds = to_arrow_schema(declared)

    def call(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = f({n: _handed(c) for n, c in zip(batch.schema.names, batch.columns, strict=True)})
        return pa.RecordBatch.from_arrays([_taken(got[k.name], k.type) for k in kinds], names=kinds.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sized(batches, size):
            try:
                yield call(batch)
            except Exception:
                if errors == "raise":
                    raise
                for i in range(batch.num_rows if errors == "rows" else 0):
                    try:
                        one = call(batch.slice(i, 1))
                    except Exception:  # the policy: this row goes
                        continue
                    yield one

    return df.mapInArrow(run, declared)


def filter_batches(df: DataFrame, f: Callable[[Columns], np.ndarray], size: int = 1000) -> DataFrame:
    """The rows for which ``f``, given the columns of ``size`` rows, returns true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sized(batches, size):
            kept = np.asarray(f({n: _handed(c) for n, c in zip(batch.schema.names, batch.columns, strict=True)}), bool)
            yield batch.filter(pa.array(kept))

    return df.mapInArrow(run, df.schema)
