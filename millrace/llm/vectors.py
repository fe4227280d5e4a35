"""Vectors as fixed-width binary, and blocks of them that meet in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """Not null, no null and no non-finite component. An empty vector is usable."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & F.coalesce(~bad, F.lit(False))


def rows_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists without nulls as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def matrix_of(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """A column of equally long binaries as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def binary_of(matrix: np.ndarray) -> pa.Array:
    width = matrix.shape[1] * matrix.itemsize if matrix.size else 0
    raw = np.ascontiguousarray(matrix).tobytes()
    return pa.array([raw[i * width : (i + 1) * width] for i in range(matrix.shape[0])], pa.binary())
