"""Texts of an Arrow column as one byte array with offsets, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 4 << 20


def whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, null as empty, without copying."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of whole texts of about ``size`` bytes; a longer text is a run of its own."""
    data, offsets = whole(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        last = min(last, n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def slices(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) for runs of whole texts of about ``size`` bytes; null becomes empty."""
    column = pc.fill_null(column, "")
    _, offsets = whole(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = min(max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1), n)
        yield first, column[first:last]
        first = last
