"""Vectors as lists of integers: which count, how they are scaled, and how a batch of them becomes a matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scaled components stay below this, so that squared distances and products of vectors of 64 components fit a long.
LARGEST = 1 << 27


def is_finite(vector: Column) -> Column:
    """The vector is not null, and no component is null or non-finite; never null."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def scaled(vector: Column, factor: int) -> Column:
    """floor(factor * x) of every component x, as longs; components too large for a long become the largest or smallest long."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(F.lit(float(factor)) * x))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a column of integer lists; shorter lists end in zeros. Raises for components of `LARGEST` or more."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) and not -LARGEST < flat.min() <= flat.max() < LARGEST:
        raise ValueError(f"a scaled component is {LARGEST} or more in size: results would not fit a long")
    if len(flat) == dims * len(sizes):
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out
