"""Correlations in time and space on jointly valid samples, as joins and aggregations.

A reference series is one point's samples; it is joined on the frame, so the field is read once and never regrouped
whole. All coefficients are centred on the samples they use and bounded by 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import pearson, slope
from .statistics import POINT, paired


def reference(samples: DataFrame, j: int, i: int) -> DataFrame:
    return paired(samples).where((F.col("j") == j) & (F.col("i") == i)).select("repeat_id", "frame_id", F.col("u").alias("ur"), F.col("v").alias("vr"))


def two_point(samples: DataFrame, j: int, i: int) -> DataFrame:
    """Ruu, Rvv and Ruv (v with the reference u) of every point with the reference, and its mean motion during the
    reference's ejections (Q2) and sweeps (Q4)."""
    own = paired(samples).join(reference(samples, j, i), ["repeat_id", "frame_id"])
    q2, q4 = (F.col("ur") < 0) & (F.col("vr") > 0), (F.col("ur") > 0) & (F.col("vr") < 0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return own.groupBy(*POINT).agg(
        pearson(F.col("u"), F.col("ur")).alias("ruu"), pearson(F.col("v"), F.col("vr")).alias("rvv"), pearson(F.col("v"), F.col("ur")).alias("ruv"), F.count(F.when(F.col("u").isNotNull() & F.col("ur").isNotNull(), 1)).alias("n"),
        zero(F.avg(F.when(q2, F.col("u")))).alias("q2_u"), zero(F.avg(F.when(q2, F.col("v")))).alias("q2_v"), F.count(F.when(q2, F.col("u"))).alias("q2_n"),
        zero(F.avg(F.when(q4, F.col("u")))).alias("q4_u"), zero(F.avg(F.when(q4, F.col("v")))).alias("q4_v"), F.count(F.when(q4, F.col("u"))).alias("q4_n"),
    )


def streamwise(samples: DataFrame, j: int, i: int, x_mm: Column, max_lag_mm: float) -> DataFrame:
    """Ruu along the row of the reference, NULL beyond the lag. x_mm: place of column i."""
    own = paired(samples).where(F.col("j") == j).join(reference(samples, j, i), ["repeat_id", "frame_id"])
    got = own.groupBy("i").agg(pearson(F.col("u"), F.col("ur")).alias("ruu"), F.count(F.when(F.col("u").isNotNull() & F.col("ur").isNotNull(), 1)).alias("n"))
    here = F.max(F.when(F.col("i") == i, x_mm)).over(Window.partitionBy())
    return got.withColumn("delta_x", x_mm - here).withColumn("ruu", F.when(F.abs("delta_x") <= max_lag_mm, F.col("ruu")))


def autocorrelation(series: DataFrame, keys: list[str], a: str, b: str, max_lag: int) -> DataFrame:
    """R(lag) = sum a(t) b(t + lag) / sqrt(sum a^2 sum b^2) of complete series (keys, frame_id, a, b), lags from 0.

    Each sample is sent to max_lag + 1 partners, an equi-join on the frame; lags never cross keys.
    """
    lags = F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag")
    early = series.select(*keys, "frame_id", F.col(a).alias("_a"), lags).withColumn("frame_id", F.col("frame_id") + F.col("lag"))
    sums = early.join(series.select(*keys, "frame_id", F.col(b).alias("_b")), [*keys, "frame_id"]).groupBy(*keys, "lag").agg(F.sum(F.col("_a") * F.col("_b")).alias("_ab"))
    power = series.groupBy(*keys).agg(F.sum(F.col(a) * F.col(a)).alias("_aa"), F.sum(F.col(b) * F.col(b)).alias("_bb"))
    return sums.join(power, keys).select(*keys, "lag", F.try_divide("_ab", F.sqrt(F.col("_aa") * F.col("_bb"))).alias("r"))


def integral_time(correlation: DataFrame, keys: list[str], fs: float) -> DataFrame:
    """Trapezoidal integral of r(lag) up to its first value of at most zero (or its last)."""
    order = Window.partitionBy(*keys).orderBy("lag")
    rows = correlation.withColumn("_piece", (F.col("r") + F.lag("r").over(order)) / 2 / fs).withColumn("_before", F.when(F.lag("r").over(order) <= 0, 1).otherwise(0))
    rows = rows.withColumn("_past", F.max("_before").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.where("_past = 0").groupBy(*keys).agg(F.coalesce(F.sum("_piece"), F.lit(0.0)).alias("time"), F.max("lag").alias("last_lag"))


def space_time(samples: DataFrame, j: int, i: int, max_lag: int) -> DataFrame:
    """R(lag, column): Pearson coefficient of the reference with each column of its row lag frames later."""
    lags = F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag")
    early = reference(samples, j, i).select("frame_id", "ur", lags).withColumn("frame_id", F.col("frame_id") + F.col("lag"))
    own = paired(samples).where(F.col("j") == j).select("frame_id", "i", "u").join(early, "frame_id")
    return own.groupBy("lag", "i").agg(pearson(F.col("u"), F.col("ur")).alias("r"), F.count(F.when(F.col("u").isNotNull() & F.col("ur").isNotNull(), 1)).alias("n"))


def convection(lagged: DataFrame, i: int, dx_mm: float, fs: float, least: float = 0.3) -> DataFrame:
    """Ridge of a space-time map downstream of column i and the velocity of a line through it; NULL if the line doesn't
    move downstream or fewer than two lags reach the least correlation."""
    best = lagged.where((F.col("i") > i) & (F.col("lag") > 0) & F.col("r").isNotNull()).groupBy("lag").agg(F.max_by("i", F.struct("r", -F.col("i"))).alias("i"), F.max("r").alias("r"))
    strong = best.where(F.col("r") >= least).select((F.col("lag") / fs).alias("t"), ((F.col("i") - i) * (dx_mm * 1e-3)).alias("x"))
    line = slope(F.col("x"), F.col("t"))
    return strong.agg(F.count(F.lit(1)).alias("points"), F.when((F.count(F.lit(1)) >= 2) & (line > 0), line).alias("velocity"))
