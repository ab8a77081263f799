"""What the operators on embeddings share: which rows take part, and their numbers as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components become whole numbers of this fraction.
SCALE = 256


def is_finite(x: Column) -> Column:
    """Whether an array is there and holds finite numbers only."""
    return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def most_common_width(rows: DataFrame, column: str) -> int | None:
    """The length that most arrays have, the smaller of two that are as common; None without rows. One row reaches the driver."""
    first = rows.groupBy(F.size(column).alias("width")).count().orderBy(F.desc("count"), "width").first()
    return first["width"] if first else None


def whole_rows(vectors: DataFrame, *others: Column) -> tuple[DataFrame, int]:
    """vec_id, x (array<long>: floor(256 * c) of each component c as double) and `others`, and the length of x.

    Rows without a vector, with null or non-finite components, with components
    that no long holds, or of another length than most are left out.
    """
    c = F.col("embedding").cast("array<double>")
    fits = is_finite(c) & (F.size(c) > 0) & F.forall(c, lambda v: F.abs(v * SCALE) < float(2**63))
    rows = vectors.where(fits).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(c, lambda v: F.floor(v * SCALE)).alias("x"), *others)
    width = most_common_width(rows, "x")
    return (rows, 0) if width is None else (rows.where(F.size("x") == width), width)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def exact(x: np.ndarray, most: int) -> np.ndarray:
    """`x` as 64-bit integers where no result is beyond `most` and that fits, otherwise as integers of any size."""
    return x.astype(np.int64) if most < 2**62 else x.astype(object)


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; they are scaled first, so that squares neither vanish nor overflow."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
