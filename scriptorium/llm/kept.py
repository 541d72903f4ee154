"""What a Python worker keeps from one task to the next: one thing at a time.

Workers live on through the stages of a job.  If every operator left its tables of known words behind, an
executor would hold those of all stages at once.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_kept: dict[Hashable, Any] = {}


def kept(key: Hashable, build: Callable[[], Any]) -> Any:
    """The thing of that key, built if this worker holds another one or none."""
    if key not in _kept:
        release()
        _kept[key] = build()
    return _kept[key]


def release() -> None:
    """Drop what an earlier stage left, and hand free memory back: an idle worker stays beside the next stage."""
    _kept.clear()
    trim()


def trim() -> None:
    """Hand free memory back and keep what is kept."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
