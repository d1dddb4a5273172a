"""Small helpers between Arrow batches and numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def binary16(high: np.ndarray, low: np.ndarray) -> pa.Array:
    """A binary column of 16 bytes a row from two 64-bit columns."""
    raw = np.empty((len(high), 2), ">u8")
    raw[:, 0], raw[:, 1] = high, low
    return fixed_binary(raw.view(np.uint8).reshape(len(high), 16))


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """A binary column from a uint8 matrix, one row each."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def with_nulls(column: pa.Array, null: np.ndarray) -> pa.Array:
    """The column with nulls where the mask is true."""
    import pyarrow.compute as pc

    return pc.if_else(pa.array(~null), column, pa.scalar(None, column.type))


def lists(values: np.ndarray, limits: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and n + 1 offsets."""
    return pa.ListArray.from_arrays(pa.array(limits.astype(np.int32)), pa.array(values, kind))


def texts_of(column: pa.Array) -> list[str | None]:
    """A string column as Python strings; bytes that are no UTF-8 become U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
        return [None if b is None else b.decode("utf-8", "replace") for b in raw]
