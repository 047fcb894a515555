"""Vectors as numpy matrices for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector can be compared: finite components, not all zero, and the commonest length."""
    value = F.col(column)
    whole = rows.where(value.isNotNull() & (F.size(value) > 0)).where(
        F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(value, lambda x: x != 0)
    )
    lengths = whole.groupBy(F.size(value).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return whole.where(F.size(value) == (lengths.d if lengths else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of one length in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            return np.concatenate([matrix(c) for c in column.chunks])
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def sample(rows: DataFrame, most: int, column: str = "embedding", seed: int = 7) -> np.ndarray:
    """At most ``most`` vectors by a hash of the vector, so that reruns agree."""
    some = rows.select(column).distinct().orderBy(F.xxhash64(F.lit(seed), column), column).limit(most)
    return matrix(some.toArrow().column(0)) if most else np.zeros((0, 0))
