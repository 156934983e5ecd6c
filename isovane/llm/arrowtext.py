"""Text columns as flat numpy buffers, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
PIECE_ROWS = 512


def pieces(column: pa.Array, limit: int = PIECE_BYTES, most: int = PIECE_ROWS) -> Iterator[tuple[int, int]]:
    """Row ranges (start, stop) of a string column with about ``limit`` bytes and ``most`` rows each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, n = 0, len(sizes)
    ends = np.cumsum(sizes)
    while start < n:
        base = ends[start] - sizes[start]
        stop = max(start + 1, min(start + most, int(np.searchsorted(ends, base + limit, side="right"))))
        yield start, stop
        start = stop


def in_pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """``batches`` cut into the pieces of their text column, so that what is made of a batch is never whole in memory."""
    for batch in batches:
        for start, stop in pieces(batch.column(column)):
            yield batch.slice(start, stop - start)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows one after another, offsets); null rows are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def flat_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all rows one after another, offsets); null rows are empty."""
    raw, at = flat_bytes(column)
    first = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), first[at]


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each row; empty rows give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
