"""Moments of velocity samples.

A table of samples has one row a frame and grid point: repeat_id, frame_id, j, i, u, v, valid. It is dense: every frame
holds every point. Lookup tables (means by point, repeat or bin) have at most a grid's worth of rows for each repeat
and bin; they are joined without a hint, so Spark broadcasts them where their measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite, ratio

POINT = ["j", "i"]


def paired(samples: DataFrame) -> DataFrame:
    """u and v as doubles, both NULL unless the sample is valid and both are finite."""
    ok = F.col("valid") & finite("u").isNotNull() & finite("v").isNotNull()
    return samples.withColumns({"u": F.when(ok, F.col("u").cast("double")), "v": F.when(ok, F.col("v").cast("double"))})


def repeat_means(samples: DataFrame) -> DataFrame:
    """Plain mean of each repeat and point over all its samples, valid or not; one NaN makes the mean NaN."""
    return samples.groupBy("repeat_id", *POINT).agg(F.avg(F.col("u").cast("double")).alias("mean_u"), F.avg(F.col("v").cast("double")).alias("mean_v"))


def moments(centred: DataFrame, keys: list[str], count: Column | None = None) -> DataFrame:
    """count, uu, vv and uv (minus the mean product) by keys of fluctuations du, dv; NULLs take no part."""
    n = F.count("du") if count is None else count
    return centred.groupBy(*keys).agg(
        F.count("du").alias("count"),
        ratio(F.sum(F.col("du") * F.col("du")), n).alias("uu"), ratio(F.sum(F.col("dv") * F.col("dv")), n).alias("vv"), ratio(-F.sum(F.col("du") * F.col("dv")), n).alias("uv"),
    )


def mean_stats(samples: DataFrame, means: DataFrame | None = None, min_valid_fraction: float = 0.7, u_inf: float = 25.0) -> DataFrame:
    """Mean flow, Reynolds stresses and their root mean squares by point.

    Without means the moments are population moments about the point's own mean. With the means of repeats they are
    mean squares about those, without recentring. Points with fewer than two valid samples or less than the given
    share (equality passes) have NULL statistics.
    """
    own = paired(samples)
    sums = [F.count(F.lit(1)).alias("n_frames"), F.count("u").alias("valid_count"), F.avg("u").alias("u_mean"), F.avg("v").alias("v_mean")]
    if means is None:
        stress = [F.var_pop("u").alias("uu"), F.var_pop("v").alias("vv"), (-F.covar_pop("u", "v")).alias("uv")]
    else:
        own = own.join(means, ["repeat_id", *POINT]).withColumns({"du": F.col("u") - F.col("mean_u"), "dv": F.col("v") - F.col("mean_v")})
        stress = [F.avg(F.col("du") * F.col("du")).alias("uu"), F.avg(F.col("dv") * F.col("dv")).alias("vv"), (-F.avg(F.col("du") * F.col("dv"))).alias("uv")]
    got = own.groupBy(*POINT).agg(*sums, *stress).withColumn("valid_fraction", ratio("valid_count", "n_frames"))
    ok = (F.col("valid_count") >= 2) & (F.col("valid_fraction") >= min_valid_fraction)
    got = got.withColumns({c: F.when(ok, F.col(c)) for c in ("u_mean", "v_mean", "uu", "vv", "uv")}).withColumn("accepted", ok)
    return got.withColumns({"u_rms": F.sqrt("uu"), "v_rms": F.sqrt("vv"), "tke": (F.col("uu") + F.col("vv")) * (0.5 / u_inf**2)}).drop("n_frames")


def total_branch(samples: DataFrame, means: DataFrame) -> DataFrame:
    """du, dv: samples less the mean of their repeat (means with repeat_id) or of their point."""
    keys = [c for c in ("repeat_id", *POINT) if c in means.columns]
    return paired(samples).join(means, keys).withColumns({"du": F.col("u") - F.col("mean_u"), "dv": F.col("v") - F.col("mean_v")})


def pooled_rms(samples: DataFrame) -> DataFrame:
    """u_rms of each row j, pooled over x and time about the mean of each point, with its number of samples."""
    own = paired(samples)
    mean = own.groupBy(*POINT).agg(F.avg("u").alias("mean_u"))
    return own.join(mean, POINT).groupBy("j").agg(F.count("u").alias("count"), F.sqrt(F.avg(F.pow(F.col("u") - F.col("mean_u"), 2))).alias("u_rms"))


def retained_energy(whole: DataFrame, active: DataFrame) -> DataFrame:
    """Of each row j: root mean square of du in both branches (repeat_id, frame_id, j, i, du) where both have a value,
    their ratio, and the share of the energy that the active one keeps."""
    key = ["repeat_id", "frame_id", *POINT]
    both = whole.select(*key, F.col("du").alias("a")).join(active.select(*key, F.col("du").alias("b")), key).where("a is not null and b is not null")
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    return both.groupBy("j").agg(F.count(F.lit(1)).alias("count"), rms("a").alias("rms_whole"), rms("b").alias("rms_active"), ratio(rms("b"), rms("a")).alias("rms_ratio"), ratio(F.sum(F.col("b") * F.col("b")), F.sum(F.col("a") * F.col("a"))).alias("energy_share"))


def closure(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How far two tables agree: points with both values, the largest difference, and the relative root mean square."""
    both = left.select(*keys, finite(value).alias("a")).join(right.select(*keys, finite(value).alias("b")), keys).where("a is not null and b is not null")
    gap = F.col("a") - F.col("b")
    return both.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(gap)).alias("max_abs"), ratio(F.sqrt(F.avg(gap * gap)), F.sqrt(F.avg(F.col("a") * F.col("a")))).alias("rel_rms"))


def range_average(stats: DataFrame, values: list[str], first: int, last: int) -> DataFrame:
    """Equal-weight mean over columns first..last of each row, and how many points had a value."""
    own = stats.where(F.col("i").between(first, last))
    return own.groupBy("j").agg(*[F.avg(c).alias(c) for c in values], *[F.count(c).alias(f"n_{c}") for c in values])


def column_metrics(stats: DataFrame, value: str) -> DataFrame:
    """Peak, wall-normal mean and number of values of each column."""
    return stats.groupBy("i").agg(F.max(value).alias("peak"), F.avg(value).alias("mean"), F.count(value).alias("n"))
