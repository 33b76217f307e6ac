"""What the operators on embeddings share: valid vectors, classes of equal ones, Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_valid(v: Column) -> Column:
    """Not null nor empty, every component finite, not all zero."""
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def keyed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, h1, h2 (128-bit hash of the vector), vector of the valid vectors that have an id."""
    rows = vectors.where(F.col(id_col).isNotNull() & is_valid(F.col(vector_col)))
    return rows.select(F.col(id_col).alias("id"), F.xxhash64(vector_col).alias("h1"), F.xxhash64(F.lit(3), vector_col).alias("h2"), F.col(vector_col).alias("vector"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)
