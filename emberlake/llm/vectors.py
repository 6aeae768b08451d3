"""What the vector operators share: whole rows, integer components, Arrow batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``rows`` whose vector is there and holds no null and no component that isn't finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col(vector).isNotNull() & ~bad)


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x, taken as a double."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column as rows of a matrix of long; all lists have one length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    values = flat.flatten().to_numpy(zero_copy_only=False)
    if n and len(values) % n:
        raise ValueError("the vectors have different lengths")
    return values.reshape(n, -1 if n else 0) if n else values.reshape(0, 0)


def lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.ravel()))
