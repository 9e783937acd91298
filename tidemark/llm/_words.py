"""Columnar word handling for the Arrow operators: a text batch as word codes over its own dictionary."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def trim() -> None:
    """Hands free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidied(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An iterator function whose worker hands memory back to the system when a task ends (workers outlive their tasks)."""

    @wraps(function)
    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        trim()

    return run


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about ``most`` bytes in ``column`` (a longer row makes a run of its own)."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, offsets, dictionary): word i of text t is dictionary[codes[offsets[t] + i]].

    Words are the runs of bytes other than 0x20 and 0x09-0x0D; null and blank texts have none.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, ends = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    coded = flat.filter(full).dictionary_encode()
    return coded.indices.to_numpy(), kept[ends], coded.dictionary


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ... for lengths[i] entries each, all in a row."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)
