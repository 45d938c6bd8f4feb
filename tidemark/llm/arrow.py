"""Text columns of Arrow batches as flat bytes, cut into slices of bounded size."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20


def give_back(collect: bool = True) -> None:
    """Return freed memory to the system. Python workers live on for the tasks of later stages, beside the JVM."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which keeps its own counsel
        pass


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column and the row offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of about `limit` bytes of text each; one longer text is a slice of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        data, offsets = flat(batch.column(batch.schema.get_field_index(column)))
        a = 0
        while a < batch.num_rows:
            b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
            b = min(max(b, a + 1), batch.num_rows)
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            a = b


def ragged(table: pa.Table, column: str) -> list[np.ndarray]:
    """The rows of a list column as views of one array."""
    cells = table.column(column).combine_chunks()
    if isinstance(cells, pa.ChunkedArray):
        cells = pa.concat_arrays(cells.chunks) if cells.num_chunks else pa.array([], cells.type)
    ends = np.concatenate([[0], np.cumsum(np.nan_to_num(np.array(cells.value_lengths()), nan=0.0)).astype(np.int64)])
    flat_values = cells.flatten().to_numpy(zero_copy_only=False)
    return [flat_values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
