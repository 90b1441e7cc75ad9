"""Helpers shared by the operators that work on whole texts inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that a task holds at once; a single longer text is a slice of its own.
SLICE_BYTES = 8 << 20


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds at most ``limit`` bytes in each, or a single row."""
    for batch in batches:
        values = batch.column(column)
        lengths = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_pylist()
        start, held = 0, 0
        for row, length in enumerate(lengths):
            if held and held + length > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += length
        if start < batch.num_rows:
            yield batch.slice(start)


def as_bytes(values: pa.Array) -> list[bytes]:
    """UTF-8 bytes per row; null is empty."""
    return [v or b"" for v in pa.compute.cast(values, pa.binary()).to_pylist()]


def joined(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column one after another, and the offset of each row and of the end; null is empty."""
    values = pa.compute.fill_null(pa.compute.cast(values, pa.large_binary()), b"")
    _, offsets, data = values.buffers()
    bounds = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    if data is None:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]
