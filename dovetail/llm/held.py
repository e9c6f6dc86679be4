"""What a Python worker keeps between tasks: the state of one operator at a time, so that stages do not add up."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

_STATE: dict[str, object] = {}


def only(name: str, make: Callable[[], object] = lambda: None) -> object:
    """The state called ``name``, made where there is none; the states of all others go."""
    others = [k for k in _STATE if k != name]
    for other in others:
        del _STATE[other]
    if others:
        gc.collect()
        trim()
    if name not in _STATE:
        _STATE[name] = make()
    return _STATE[name]


def trim() -> None:
    """Give free memory back to the system: a worker is reused and would keep it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library
