"""Vector tables: which rows count, and their components as whole numbers.

A row counts if its vector is not null and all its components are finite.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components of larger size cannot be counted exactly in 64 bits and are refused.
LARGEST = 1 << 31


def finite(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector, bad)


def whole(vectors: DataFrame, scale: int, shift: int, *columns: str) -> DataFrame:
    """``columns`` and ``x``: floor(scale * component) + shift of the rows that count."""
    rows = vectors.select(*columns, F.col("embedding").cast("array<double>").alias("_v")).where(finite(F.col("_v")))
    return rows.select(*columns, F.transform("_v", lambda c: F.floor(c * scale).cast("bigint") + shift).alias("x"))


def measure(rows: DataFrame) -> tuple[int, int, int, int]:
    """(rows, width, smallest, largest component); vectors of different widths, or with too large components, are refused."""
    n, narrow, wide, low, high = rows.agg(
        F.count("*"), F.min(F.size("x")), F.max(F.size("x")), F.min(F.array_min("x")), F.max(F.array_max("x"))
    ).first()
    if not n:
        return 0, 0, 0, 0
    if narrow != wide:
        raise ValueError(f"vectors of {narrow} and of {wide} components in one table")
    low, high = low or 0, high or 0
    if max(-low, high) > LARGEST:
        raise ValueError(f"components from {low} to {high} are beyond {LARGEST}")
    return n, wide, low, high


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column without nulls as rows of int64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), width)
