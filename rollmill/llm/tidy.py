"""Memory of Python workers, which outlive their tasks: what a task leaves behind is given back.

numpy's freed arrays stay with the C library and Arrow's with its pool, so an idle worker holds
the peak of its last task, beside the workers that run now. And their threads: a task has one core, and
the threads that numpy's matrix library keeps beside it wait for work by turning over, which takes
the processor time of other tasks.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa

from rollmill.llm import textkernel

_trim: Callable[[int], int] | None
try:
    _trim = ctypes.CDLL(None).malloc_trim  # of glibc
except AttributeError:
    _trim = None


@functools.cache
def _thread_setters() -> list[Callable[[int], None]]:
    """The functions by which the copy of OpenBLAS that came with numpy takes its number of threads."""
    found = []
    for path in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        library = ctypes.CDLL(str(path))
        names = ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads")
        found += [getattr(library, name) for name in names if hasattr(library, name)][:1]
    return found


def one_thread() -> None:
    """From now on, matrix products of this process run on the thread that asks for them."""
    for put in _thread_setters():
        put(1)


def release() -> None:
    textkernel.forget()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(f: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A function of batches that runs on one thread and gives its memory back at its end, however it ends."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch], *args, **named) -> Iterator[pa.RecordBatch]:
        one_thread()
        try:
            yield from f(batches, *args, **named)
        finally:
            release()

    return run
