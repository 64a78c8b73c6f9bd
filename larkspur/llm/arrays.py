"""Array columns that reached the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of a list column as views of its buffers, without a copy of the values."""
    out = []
    for c in column.chunks:
        values, ends = c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return out
