"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def precision(embeddings: DataFrame) -> str:
    """float where the components are such, double otherwise: nothing is rounded."""
    kind = embeddings.schema["embedding"].dataType
    return "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"


def parted(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, embedding) of the rows that take part and of all others.

    Those take part that have an id, are neither null nor zero, have finite components alone, and are of the most common
    length (of equally common ones, the larger).
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{precision(embeddings)}>").alias("embedding"))
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    right = F.coalesce(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    common = rows.where(right).groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    right = right & (F.size("embedding") == (common["n"] if common else 0))
    return rows.where(right), rows.where(~F.coalesce(right, F.lit(False)))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of the column's own precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def listed(x: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(x).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), flat)
