"""What a Python worker keeps between tasks, and giving it back.

Spark reuses workers for one operator after another.  An operator that keeps tables for its next task registers how to drop
them; when a worker turns to another operator, those of all others go, and freed memory is returned to the system.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

_drops: dict[str, Callable[[], None]] = {}
_now: list[str] = [""]


def keeps(name: str, drop: Callable[[], None]) -> None:
    """Operator `name` keeps tables in this process; drop() lets them go."""
    _drops[name] = drop


def trim() -> None:
    """Return free memory to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def task(name: str):
    """Decorator of a task's batch function: drops what other operators keep, and trims when the task ends."""

    def wrap(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
        @wraps(run)
        def bounded(batches: Iterator) -> Iterator:
            if _now[0] != name:
                for other, drop in _drops.items():
                    if other != name:
                        drop()
                _now[0] = name
                trim()
            yield from run(batches)
            trim()

        return bounded

    return wrap
