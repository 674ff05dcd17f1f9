"""Quadrant and hole analysis of products of fluctuations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .statistics import POINT

EPS = 2.220446049250313e-16


def quadrant(u: Column, v: Column) -> Column:
    """1 to 4 by the signs; NULL on an axis."""
    return F.when((u > 0) & (v > 0), 1).when((u < 0) & (v > 0), 2).when((u < 0) & (v < 0), 3).when((u > 0) & (v < 0), 4)


def events(u: Column, v: Column, hole: Column, scale: Column) -> Column:
    """The quadrant of a product that is strictly larger than hole times scale, else NULL."""
    return F.when(F.abs(u * v) > hole * scale, quadrant(u, v))


def quadrant_cells(fluctuations: DataFrame, scale: DataFrame, holes: list[float], keys: list[str] | None = None) -> DataFrame:
    """Additive sums by keys, point, hole and quadrant of fluctuations (du, dv).

    scale has u_rms and v_rms by keys and point; where it is NULL nothing counts as observed. One pass over the samples makes all holes and quadrants: they are
    conditional sums of one aggregation and are listed as rows afterwards, so nothing is multiplied before it shrinks.
    """
    keys = [*(keys or []), *POINT]
    own = fluctuations.where("du is not null and dv is not null").join(scale.select(*keys, (F.col("u_rms") * F.col("v_rms")).alias("scale")).where("scale is not null"), keys)
    stress = -F.col("du") * F.col("dv")
    sums = [F.count(F.lit(1)).alias("n"), F.sum(stress).alias("stress"), F.sum(F.col("du") * F.col("du")).alias("u2"), F.sum(F.col("dv") * F.col("dv")).alias("v2")]
    for h, hole in enumerate(holes):
        which = events(F.col("du"), F.col("dv"), F.lit(float(hole)), F.col("scale"))
        for q in range(1, 5):
            sums += [F.count(F.when(which == q, 1)).alias(f"n_{h}_{q}"), F.sum(F.when(which == q, stress).otherwise(0.0)).alias(f"s_{h}_{q}")]
    got = own.groupBy(*keys).agg(*sums)
    listed = F.explode(F.array(*[F.struct(F.lit(float(hole)).alias("hole"), F.lit(q).alias("quadrant"), F.col(f"n_{h}_{q}").alias("events"), F.col(f"s_{h}_{q}").alias("event_stress")) for h, hole in enumerate(holes) for q in range(1, 5)])).alias("e")
    return got.select(*keys, "n", "stress", "u2", "v2", listed).select(*keys, "e.*", "n", "stress", "u2", "v2")


def quadrant_stats(cells: DataFrame, keys: list[str] | None = None, floor: float = 1e-6) -> DataFrame:
    """Probability, conditional mean, contribution and signed share of each quadrant and hole.

    Sums over a coarser set of keys (all bins of a cycle, say) pool the samples. A quadrant without an event has
    probability and contribution 0 and no conditional mean; the share is NULL where the stress is within the floor.
    """
    keys = [*(keys or []), *POINT, "hole", "quadrant"]
    got = cells.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "events", "event_stress", "stress", "u2", "v2")])
    mean = F.col("stress") / F.col("n")
    least = F.greatest(F.lit(EPS), floor * F.sqrt(F.col("u2") / F.col("n")) * F.sqrt(F.col("v2") / F.col("n")))
    part = F.col("event_stress") / F.col("n")
    return got.select(*keys, "n", "events", ratio("events", "n").alias("probability"), ratio("event_stress", "events").alias("conditional_mean"), part.alias("contribution"), F.when(F.abs(mean) > least, part / mean).alias("stress_share"))


def quadrant_closure(cells: DataFrame) -> DataFrame:
    """How far the four quadrants at hole 0 add up to the whole stress."""
    sums = cells.where("hole = 0").groupBy(*[c for c in ("bin", *POINT) if c in cells.columns]).agg(F.sum("event_stress").alias("parts"), F.first("stress").alias("stress"), F.first("n").alias("n"))
    return sums.agg(F.count(F.lit(1)).alias("points"), F.max(F.abs((F.col("parts") - F.col("stress")) / F.col("n"))).alias("max_abs"))
