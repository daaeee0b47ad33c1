"""Arrow batches in slices of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_LIBC = ctypes.CDLL(None)
_MMAP_THRESHOLD = -3  # glibc's number of this option
if hasattr(_LIBC, "mallopt"):  # arrays of a megabyte and more go back as soon as they are freed
    _LIBC.mallopt(_MMAP_THRESHOLD, 1 << 20)


def give_back() -> None:
    """Return freed memory to the machine: a worker is used again by other tasks, and by other stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):  # of glibc
        _LIBC.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds about ``most`` bytes of ``column``.

    A longer value is a slice of its own; nothing is dropped.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes) - sizes) // most
        for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(group)) + 1):
            yield batch.slice(int(part[0]), len(part))
    give_back()
