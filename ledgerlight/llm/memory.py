"""Memory of Python workers: they live on between tasks, and what they keep is missing to the tasks that follow."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def give_back() -> None:
    """Return what Arrow and the C allocator hold unused to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that gives its memory back at the end of the task."""

    @wraps(scan)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from scan(batches)
        finally:
            give_back()

    return run


def lean_group(of: Callable[[tuple, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table], pa.Table]:
    """A function of a group for ``applyInArrow`` that gives its memory back after each."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        try:
            return of(key, table)
        finally:
            give_back()

    return run


def lean_cogroup(of: Callable[[tuple, pa.Table, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The same for a function of two groups of one key."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return of(key, left, right)
        finally:
            give_back()

    return run
