"""Statistics of samples that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.phase import assign_phase
from ..operators.statistics import POINT, paired


def stream_moments(samples: DataFrame, time: str, late: str, window: str) -> DataFrame:
    """Means and moments by point and tumbling window of event time; samples later than `late` are dropped.

    State is a few numbers for each open window and point.
    """
    own = paired(samples.withWatermark(time, late))
    return own.groupBy(F.window(time, window).alias("window"), *POINT).agg(F.count("u").alias("count"), F.avg("u").alias("u_mean"), F.avg("v").alias("v_mean"), F.var_pop("u").alias("uu"), F.var_pop("v").alias("vv"), (-F.covar_pop("u", "v")).alias("uv"))


def stream_phase_means(samples: DataFrame, time: str, late: str, window: str, fs: float, f0: float, n_bins: int) -> DataFrame:
    """Phase means by window, bin and point, by the frame clock."""
    own = paired(assign_phase(samples, fs, f0, n_bins).withWatermark(time, late))
    return own.groupBy(F.window(time, window).alias("window"), "bin", *POINT).agg(F.count("u").alias("count"), F.avg("u").alias("u_phase"), F.avg("v").alias("v_phase"))
