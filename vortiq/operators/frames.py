"""Frames as rows: all points of a frame in packed arrays, for work on whole fields."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(samples: DataFrame, values: list[str], keys: tuple[str, ...] = ("repeat_id", "frame_id")) -> DataFrame:
    """One row a frame: every value as an array over the points in order of row j, then column i; NULL where missing.

    A frame's points are a grid's worth, so a row is bounded by the grid.
    """
    points = F.array_sort(F.collect_list(F.struct("j", "i", *values)))
    got = samples.groupBy(*keys).agg(points.alias("_p"))
    return got.select(*keys, *[F.col(f"_p.{v}").alias(v) for v in values])


def field(row, shape: tuple[int, int]) -> np.ndarray:
    """A packed array as a field, NaN where missing."""
    return np.asarray(row, dtype=float).reshape(shape)
