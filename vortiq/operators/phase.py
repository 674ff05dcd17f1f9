"""Phase averages and the triple decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .statistics import POINT, paired


def phase_means(samples: DataFrame, keys: list[str], min_samples: int) -> DataFrame:
    """Count and mean of each keys and point; means of too few samples are NULL."""
    got = paired(samples).groupBy(*keys, *POINT).agg(F.count("u").alias("count"), F.avg("u").alias("u_phase"), F.avg("v").alias("v_phase"))
    ok = F.col("count") >= min_samples
    return got.withColumns({"u_phase": F.when(ok, F.col("u_phase")), "v_phase": F.when(ok, F.col("v_phase"))})


def coherent(phases: DataFrame, stats: DataFrame) -> DataFrame:
    """Coherent part of each bin and point: its phase mean less the mean in time."""
    return phases.join(stats.select(*POINT, "u_mean", "v_mean"), POINT).withColumns({"u_coherent": F.col("u_phase") - F.col("u_mean"), "v_coherent": F.col("v_phase") - F.col("v_mean")})


def random_branch(samples: DataFrame, by_repeat: DataFrame) -> DataFrame:
    """du, dv: samples (with bin) less the phase mean of their repeat; NULL where that is missing."""
    means = by_repeat.select("repeat_id", "bin", *POINT, "u_phase", "v_phase")
    return paired(samples).join(means, ["repeat_id", "bin", *POINT]).withColumns({"du": F.col("u") - F.col("u_phase"), "dv": F.col("v") - F.col("v_phase")})


def random_moments(samples: DataFrame, min_samples: int) -> tuple[DataFrame, DataFrame]:
    """Moments of the random branch by bin and point, and by point.

    A bin's sums are divided by its pooled count of the first pass, the overall ones by the number of random samples.
    """
    pooled = phase_means(samples, ["bin"], min_samples)
    random = random_branch(samples, phase_means(samples, ["repeat_id", "bin"], min_samples))
    sums = [F.count("du").alias("n"), F.sum(F.col("du") * F.col("du")).alias("suu"), F.sum(F.col("dv") * F.col("dv")).alias("svv"), F.sum(F.col("du") * F.col("dv")).alias("suv")]
    bins = pooled.select("bin", *POINT, "count").join(random.groupBy("bin", *POINT).agg(*sums), ["bin", *POINT], "left")
    part = lambda c, n: F.when(F.col("count") >= min_samples, ratio(F.coalesce(c, F.lit(0.0)), n))
    bins = bins.select("bin", *POINT, "count", part(F.col("suu"), F.col("count")).alias("uu"), part(F.col("svv"), F.col("count")).alias("vv"), part(-F.col("suv"), F.col("count")).alias("uv"))
    whole = random.groupBy(*POINT).agg(*sums)
    whole = whole.select(*POINT, F.col("n").alias("count"), ratio("suu", "n").alias("uu"), ratio("svv", "n").alias("vv"), ratio(-F.col("suv"), F.col("n")).alias("uv"))
    return bins, whole


def triple_residual(samples: DataFrame, stats: DataFrame, min_samples: int) -> DataFrame:
    """Largest difference between total and coherent plus random fluctuations, over all samples."""
    random = random_branch(samples, phase_means(samples, ["repeat_id", "bin"], min_samples)).join(stats.select(*POINT, "u_mean", "v_mean"), POINT)
    gap = lambda a: F.abs((F.col(a) - F.col(f"{a}_mean")) - ((F.col(f"{a}_phase") - F.col(f"{a}_mean")) + F.col(f"d{a}")))
    return random.agg(F.count("du").alias("n"), F.greatest(F.max(gap("u")), F.max(gap("v"))).alias("max_residual"))


def coverage(samples: DataFrame, min_samples: int) -> DataFrame:
    """Of each bin: all valid samples, fewest and most at a point, whether every point has enough, and the cycles."""
    points = samples.groupBy("bin", *POINT).agg(F.count(F.when(F.col("valid") & F.col("u").isNotNull() & F.col("v").isNotNull(), 1)).alias("n"), F.max("cycle").alias("cycle"))
    return points.groupBy("bin").agg(F.sum("n").alias("total"), F.min("n").alias("fewest"), F.max("n").alias("most"), F.every(F.col("n") >= min_samples).alias("accepted_everywhere"), F.max("cycle").alias("cycles"))


def decomposition_profiles(stats: DataFrame, pooled: DataFrame, random: DataFrame, first: int, last: int) -> DataFrame:
    """Profiles of total, coherent and random stresses over columns first..last.

    The coherent stress is the equal-weight mean over bins of the pooled coherent parts' products.
    """
    wave = coherent(pooled, stats).groupBy(*POINT).agg(F.avg(F.col("u_coherent") * F.col("u_coherent")).alias("coherent_uu"), F.avg(F.col("v_coherent") * F.col("v_coherent")).alias("coherent_vv"), (-F.avg(F.col("u_coherent") * F.col("v_coherent"))).alias("coherent_uv"))
    total = stats.select(*POINT, *[F.col(c).alias(f"total_{c}") for c in ("uu", "vv", "uv")])
    rest = random.select(*POINT, *[F.col(c).alias(f"random_{c}") for c in ("uu", "vv", "uv")])
    names = [f"{a}_{b}" for a in ("total", "coherent", "random") for b in ("uu", "vv", "uv")]
    return total.join(wave, POINT, "left").join(rest, POINT, "left").where(F.col("i").between(first, last)).groupBy("j").agg(*[F.avg(c).alias(c) for c in names])


def harmonics(phases: DataFrame, value: str, n_bins: int, orders: int = 3, offset_deg: float = 0.0) -> DataFrame:
    """Amplitude and phase of the first harmonics of phase means, by point; NULL unless every bin has a value."""
    angle = lambda k: (F.col("bin") - 1) * (6.283185307179586 * k / n_bins)
    parts = []
    for k in range(1, orders + 1):
        parts += [F.sum(F.col(value) * F.cos(angle(k))).alias(f"c{k}"), F.sum(F.col(value) * F.sin(angle(k))).alias(f"s{k}")]
    got = phases.groupBy(*POINT).agg(F.count(value).alias("n"), *parts).where(F.col("n") == n_bins)
    listed = F.explode(F.array(*[F.struct(F.lit(k).alias("harmonic"), (F.col(f"c{k}") / n_bins).alias("re"), (-F.col(f"s{k}") / n_bins).alias("im")) for k in range(1, orders + 1)])).alias("h")
    got = got.select(*POINT, listed).select(*POINT, "h.*")
    degrees = F.degrees(F.atan2("im", "re"))
    return got.select(*POINT, "harmonic", (2 * F.hypot("re", "im")).alias("amplitude"), degrees.alias("phase_deg"), (F.pmod(degrees - F.col("harmonic") * offset_deg + 180.0, F.lit(360.0)) - 180.0).alias("mechanical_deg"))
