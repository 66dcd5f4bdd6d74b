"""Arrow list columns as dense matrices and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def as_matrix(column) -> np.ndarray:
    """Equal-length list column as a rows x length matrix; missing or undefined entries are refused."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if np.isnan(flat).any():
        raise ValueError("a vector holds a missing or undefined value")
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def as_lists(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))
