"""Vectors of whole numbers, as centroid clustering and hard-negative mining take them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Squared distances and inner products of 64 such components, and their transforms, fit 64-bit numbers.
LARGEST = 1 << 24


def scaled(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as array<int>; larger numbers than LARGEST stop the job."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fits = F.forall(whole, lambda v: F.abs(v) <= LARGEST)
    return F.when(fits, whole.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a vector component exceeds {LARGEST} after scaling")))


def is_whole(vector: Column, size: int | None = None) -> Column:
    """Whether a vector is there, has this many components, and none is null, NaN or infinite; never null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if size is not None:
        finite = finite & (F.size(vector) == size)
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """A list column of an Arrow batch as rows of 64-bit integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(len(column), size)


def prepared(df: DataFrame, vec_id: str, vector: str, size: int, *more: Column) -> DataFrame:
    """(vec_id, v, more...) of rows whose vector is whole."""
    return df.where(is_whole(F.col(vector), size)).select(F.col(vec_id).cast("long").alias("vec_id"), scaled(F.col(vector)).alias("v"), *more)
