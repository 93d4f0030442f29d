"""Memory of Python workers, which live on between tasks and stages beside an executor's JVM."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Hand memory that is free, but still held by the allocators, back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` that gives memory back after each of its batches, and at the end."""

    def run(batches: Iterator) -> Iterator:
        def each() -> Iterator:
            for batch in batches:
                yield batch
                give_back()

        yield from work(each())
        give_back()

    return run
