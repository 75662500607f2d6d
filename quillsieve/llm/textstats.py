"""Byte-level statistics of whole texts as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a (large) binary array as one array, and its offsets; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null(b"")
    wide = pa.types.is_large_binary(texts.type) or pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    bytes_ = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return bytes_, offsets - offsets[0]


def blocks(texts: pa.Array, limit: int = 1 << 20):
    """(first row, rows) so that each block has about `limit` bytes, and always one row at least."""
    if not len(texts):
        return
    _, offsets = buffer_of(texts)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield start, end - start
        start = end


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def per_text(counts_at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a per-byte array over each text."""
    total = np.concatenate([[0], np.cumsum(counts_at, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks the first byte of each word of each text."""
    space = SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[at] = ~space[at]
    return start
