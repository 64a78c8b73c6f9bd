"""Memory of Python workers, which Spark keeps for the tasks and stages that follow."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def hand_back() -> None:
    """Gives memory that was freed back to the system; the allocators keep it for the worker's life else."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass
