"""Text columns as flat byte buffers: word bounds and dictionaries without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The white space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
#: Texts are worked on in slices of about this many bytes (a longer text is a slice of its own).
SLICE_BYTES = 4 << 20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the bounds of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``size`` bytes each."""
    first, rows = 0, len(bounds) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1)
        yield first, min(last, rows)
        first = min(last, rows)


def pieces(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``text_bytes`` of a column, slice by slice in row order."""
    data, bounds = text_bytes(column)
    for first, last in slices(bounds, size):
        yield data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]


def runs(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of set bytes; no run crosses the bounds of a row."""
    start = mask.copy()
    end = mask.copy()
    start[1:] &= ~mask[:-1]
    end[:-1] &= ~mask[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(mask))]
    start[inner] |= mask[inner]
    end[inner - 1] |= mask[inner - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word (bytes between white space)."""
    starts, ends = runs(~IS_SPACE[data], bounds)
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The given byte ranges (in order, not overlapping) as one binary array."""
    mark = np.zeros(len(data) + 1, np.int8)  # ranges are not empty, so starts differ, and so do ends
    mark[starts] += 1
    mark[ends] -= 1
    kept = data[np.cumsum(mark[:-1], dtype=np.int8).view(bool)]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))]
    )


def coded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """For every byte range the place of its content in the dictionary of distinct contents, and the dictionary."""
    found = gathered(data, starts, ends).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``start, start + 1, ...`` of all ranges, one after the other."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)


def per_row(values: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Sum of values by row, as whole numbers."""
    return np.bincount(rows, weights=values, minlength=n_rows).astype(np.int64)
