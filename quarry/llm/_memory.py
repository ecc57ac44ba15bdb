"""Memory of Python workers, which Spark reuses from task to task."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

#: What clears the caches that live as long as a worker, by name.
_caches: dict[str, Callable[[], None]] = {}


def cached(name: str, clear: Callable[[], None]) -> None:
    """Make a worker-wide cache known, so that tasks without use for it free it."""
    _caches[name] = clear


def _free(uses: str | None) -> None:
    for name, clear in _caches.items():
        if name != uses:
            clear()

def _trim() -> None:
    """Hand freed memory back to the system (where the C library can)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def trimmed(run, uses: str | None = None):
    """A task function that starts and ends without caches but the one it uses, and leaves no freed memory behind.

    A worker stays beside the JVM in the executor's memory.
    """

    def wrapped(batches):
        _free(uses)
        yield from run(batches)
        _free(uses)
        _trim()

    return wrapped
