"""Transport statistics: repeat-centred moments on admitted support, and what they add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .statistics import POINT, paired

CELL = ["repeat_id", "bin", *POINT]


def support(samples: DataFrame, min_samples: int) -> DataFrame:
    """Admitted cells (repeat, bin, point) with their count, phase means pu, pv and the repeat's means tu, tv."""
    cells = paired(samples).groupBy(*CELL).agg(F.count("u").alias("n"), F.sum("u").alias("su"), F.sum("v").alias("sv")).where((F.col("n") >= min_samples) & (F.col("n") > 0))
    means = cells.groupBy("repeat_id", *POINT).agg((F.sum("su") / F.sum("n")).alias("tu"), (F.sum("sv") / F.sum("n")).alias("tv"))
    return cells.withColumns({"pu": F.col("su") / F.col("n"), "pv": F.col("sv") / F.col("n")}).join(means, ["repeat_id", *POINT])


def transport_cells(samples: DataFrame, min_samples: int) -> DataFrame:
    """Of each bin and point: count, sums of values, and of total, random and coherent products (centred before they
    are multiplied). Every other statistic of transport is a sum of these."""
    admitted = support(samples, min_samples)
    own = paired(samples).join(admitted.select(*CELL, "tu", "tv", "pu", "pv"), CELL).where("u is not null")
    a, b, c, d = (F.col(x) - F.col(y) for x, y in (("u", "tu"), ("v", "tv"), ("u", "pu"), ("v", "pv")))
    sums = own.groupBy("bin", *POINT).agg(
        F.count(F.lit(1)).alias("n"), F.sum("u").alias("su"), F.sum("v").alias("sv"),
        F.sum(a * a).alias("total_uu"), F.sum(b * b).alias("total_vv"), F.sum(a * b).alias("total_uv"),
        F.sum(c * c).alias("random_uu"), F.sum(d * d).alias("random_vv"), F.sum(c * d).alias("random_uv"),
    )
    e, f = F.col("pu") - F.col("tu"), F.col("pv") - F.col("tv")
    wave = admitted.groupBy("bin", *POINT).agg(F.sum(F.col("n") * e * e).alias("coherent_uu"), F.sum(F.col("n") * f * f).alias("coherent_vv"), F.sum(F.col("n") * e * f).alias("coherent_uv"))
    return sums.join(wave, ["bin", *POINT])


def transport_stats(cells: DataFrame, n_frames: int, min_valid_fraction: float) -> DataFrame:
    """By point: means and total, coherent and random stresses (uv with its sign turned), NULL where not accepted."""
    names = [f"{a}_{b}" for a in ("total", "coherent", "random") for b in ("uu", "vv", "uv")]
    got = cells.groupBy(*POINT).agg(F.sum("n").alias("count"), ratio(F.sum("su"), F.sum("n")).alias("u_mean"), ratio(F.sum("sv"), F.sum("n")).alias("v_mean"), *[ratio(F.sum(c) * (-1.0 if c.endswith("uv") else 1.0), F.sum("n")).alias(c) for c in names])
    ok = (F.col("count") >= 2) & (F.col("count") / F.lit(float(n_frames)) >= min_valid_fraction)
    return got.withColumns({c: F.when(ok, F.col(c)) for c in ("u_mean", "v_mean", *names)}).withColumn("accepted", ok)


def transport_phases(cells: DataFrame, stats: DataFrame) -> DataFrame:
    """By bin and accepted point: phase means and stresses."""
    names = [f"{a}_{b}" for a in ("total", "coherent", "random") for b in ("uu", "vv", "uv")]
    got = cells.select("bin", *POINT, "n", (F.col("su") / F.col("n")).alias("u_phase"), (F.col("sv") / F.col("n")).alias("v_phase"), *[(F.col(c) * (-1.0 if c.endswith("uv") else 1.0) / F.col("n")).alias(c) for c in names])
    return got.join(stats.where("accepted").select(*POINT), POINT, "left_semi")


def identity(stats: DataFrame) -> DataFrame:
    """Closure of total = coherent + random for each stress."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("stress"), F.col(f"total_{c}").alias("total"), (F.col(f"coherent_{c}") + F.col(f"random_{c}")).alias("parts")) for c in ("uu", "vv", "uv")])).alias("s")
    flat = stats.where("accepted").select(rows).select("s.*")
    gap = F.col("total") - F.col("parts")
    return flat.groupBy("stress").agg(F.count("total").alias("n"), F.max(F.abs(gap)).alias("max_abs"), ratio(F.sqrt(F.avg(gap * gap)), F.sqrt(F.avg(F.col("total") * F.col("total")))).alias("rel_rms"))


def production(stats: DataFrame, gradient: DataFrame, stress: str = "total_uv") -> DataFrame:
    """Main-shear production: the (sign-turned) stress times dU/dy of each point (column gradient)."""
    return stats.join(gradient.select(*POINT, "gradient"), POINT).select(*POINT, (F.col(stress) * F.col("gradient")).alias("production"))
