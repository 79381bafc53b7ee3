"""What a worker process keeps between tasks: one model, the one asked for last, and no freed memory."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa

_held: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """The model of that key. Another one is let go first, so a worker never holds two of them."""
    if key not in _held:
        _held.clear()
        pa.default_memory_pool().release_unused()
        _held[key] = make()
    return _held[key]


def _give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(work: Callable[[Iterator], Iterator], model: bool = False) -> Callable[[Iterator], Iterator]:
    """``work`` for mapInArrow, which does not leave its freed memory in a worker that is idle then.

    Work without a ``model`` lets go of the one that earlier work of this worker has left.
    """

    def run(batches: Iterator) -> Iterator:
        if not model:
            _held.clear()
        try:
            yield from work(batches)
        finally:
            _give_back()

    return run
