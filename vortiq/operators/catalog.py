"""Operators on catalogs of structures: selection, comparison and distributions.

A catalog row is one connected region: frame_id, sign, connectivity, component_id, pixel_count, col_min, col_max,
row_min, row_max, lx_over_delta, height_mm, area_mm2, is_ss (passes the criteria), is_censored, and what a caller adds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hazen, pearson, ratio
from ..sources.shared import written
from .asof import numbered, placed
from .domain import frame_runs, numbered_by_frame


def representative(catalog: DataFrame, keys: list[str]) -> DataFrame:
    """The longest row of each group; then most pixels, then smallest component_id. With count, the group's size."""
    own = Window.partitionBy(*keys)
    order = own.orderBy(F.desc("lx_over_delta"), F.desc("pixel_count"), F.asc("component_id"))
    ranked = catalog.withColumn("_place", F.row_number().over(order)).withColumn("count", F.count(F.lit(1)).over(own))
    return ranked.where("_place = 1").drop("_place")


def box_iou(a: str, b: str) -> Column:
    """Intersection over union of the pixel boxes of two structs of columns."""
    c = lambda s, n: F.col(f"{s}.{n}").cast("double")
    wide = F.greatest(F.lit(0.0), F.least(c(a, "col_max"), c(b, "col_max")) - F.greatest(c(a, "col_min"), c(b, "col_min")) + 1)
    high = F.greatest(F.lit(0.0), F.least(c(a, "row_max"), c(b, "row_max")) - F.greatest(c(a, "row_min"), c(b, "row_min")) + 1)
    area = lambda s: (c(s, "col_max") - c(s, "col_min") + 1) * (c(s, "row_max") - c(s, "row_min") + 1)
    return ratio(wide * high, area(a) + area(b) - wide * high)


def connectivity_comparison(catalog: DataFrame, frames: DataFrame, threshold: float) -> DataFrame:
    """One row a frame and sign: how many complete structures longer than the threshold either connectivity finds, and
    how their longest ones compare. Frames without any are there."""
    own = catalog.where(F.col("is_ss") & ~F.col("is_censored") & (F.col("lx_over_delta") > threshold))
    best = representative(own, ["frame_id", "sign", "connectivity"]).select("frame_id", "sign", "connectivity", F.struct("count", "component_id", "lx_over_delta", "col_min", "col_max", "row_min", "row_max").alias("r"))
    best = best.groupBy("frame_id", "sign").agg(F.first(F.when(F.col("connectivity") == 8, F.col("r")), True).alias("a"), F.first(F.when(F.col("connectivity") == 4, F.col("r")), True).alias("b"))
    spine = frames.select("frame_id", F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign"))
    got = spine.join(best, ["frame_id", "sign"], "left")
    has8, has4 = F.col("a").isNotNull(), F.col("b").isNotNull()
    return got.select(
        "frame_id", "sign", F.coalesce("a.count", F.lit(0)).alias("count8"), F.coalesce("b.count", F.lit(0)).alias("count4"),
        F.when(has8 & has4, "both").when(has8, "only_8").when(has4, "only_4").otherwise("neither").alias("category"),
        F.col("a.component_id").alias("component8"), F.col("b.component_id").alias("component4"),
        (F.col("a.lx_over_delta") - F.col("b.lx_over_delta")).alias("delta_lx"), F.when(has8 & has4, box_iou("a", "b")).alias("bbox_iou"),
    )


def comparison_summary(compared: DataFrame) -> DataFrame:
    """Counts, overlap shares and mean differences of a comparison."""
    is_ = lambda *names: F.count(F.when(F.col("category").isin(*names), 1))
    return compared.agg(
        F.count(F.lit(1)).alias("units"), F.sum("count8").alias("objects8"), F.sum("count4").alias("objects4"), is_("both").alias("in_both"), is_("only_8").alias("only8"), is_("only_4").alias("only4"), is_("neither").alias("neither"),
        ratio(is_("both"), is_("both", "only_8", "only_4")).alias("jaccard"), ratio(is_("both"), is_("both", "only_8")).alias("share8_also4"), ratio(is_("both"), is_("both", "only_4")).alias("share4_also8"),
        F.avg("bbox_iou").alias("mean_iou"), F.median("bbox_iou").alias("median_iou"), F.avg("delta_lx").alias("mean_delta"), F.median(F.abs(F.col("delta_lx"))).alias("median_abs_delta"),
    )


def threshold_counts(catalog: DataFrame, thresholds: list[float]) -> DataFrame:
    """Structures of each connectivity and length threshold: all, complete, censored, by sign, frames, touching."""
    rows = catalog.where("is_ss").withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where("lx_over_delta > threshold")
    complete = ~F.col("is_censored")
    n = lambda c: F.count(F.when(c, 1))
    return rows.groupBy("connectivity", "threshold").agg(
        F.count(F.lit(1)).alias("all_ss"), n(complete).alias("complete"), n(~complete).alias("censored"), n(complete & (F.col("sign") == 1)).alias("positive"), n(complete & (F.col("sign") == -1)).alias("negative"),
        F.countDistinct(F.when(complete, F.col("frame_id"))).alias("frames"), ratio(n(complete & F.col("touches_exclusion")), n(complete)).alias("touching_share"),
    )


def frame_overlap(catalog: DataFrame, thresholds: list[float]) -> DataFrame:
    """Frames in which either connectivity finds a complete structure: both, any, Jaccard, share of 8 also in 4."""
    rows = catalog.where(F.col("is_ss") & ~F.col("is_censored")).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where("lx_over_delta > threshold")
    frames = rows.groupBy("threshold", "frame_id").agg(F.max(F.when(F.col("connectivity") == 8, 1).otherwise(0)).alias("a"), F.max(F.when(F.col("connectivity") == 4, 1).otherwise(0)).alias("b"))
    both = F.sum(F.col("a") * F.col("b"))
    return frames.groupBy("threshold").agg(F.sum("a").alias("frames8"), F.sum("b").alias("frames4"), both.alias("in_both"), F.count(F.lit(1)).alias("in_any"), ratio(both, F.count(F.lit(1))).alias("jaccard"), ratio(both, F.sum("a")).alias("share8_also4"))


def length_distribution(catalog: DataFrame, start: float = 3.0, step: float = 0.25) -> DataFrame:
    """Counts and shares of complete structures by length bins common to both connectivities, empty bins included.

    The last edge is one step beyond the longest length rounded up to a step; the last bin holds its right edge.
    """
    own = catalog.where(F.col("is_ss") & ~F.col("is_censored") & F.col("connectivity").isin(4, 8))
    top = own.agg(F.max(F.greatest(F.lit(start + step), F.ceil(F.col("lx_over_delta") / step) * step)).alias("top"))
    edges = top.select(F.explode(F.sequence(F.lit(0), F.coalesce(F.round((F.col("top") + step - start) / step).cast("int") - 1, F.lit(0)))).alias("bin"))
    spine = edges.select("bin", F.explode(F.array(F.lit(8), F.lit(4))).alias("connectivity"))
    counts = own.where(F.col("lx_over_delta") >= start).groupBy("connectivity", F.floor((F.col("lx_over_delta") - start) / step).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    totals = own.groupBy("connectivity").agg(F.count(F.lit(1)).alias("total"))
    got = spine.join(counts, ["connectivity", "bin"], "left").join(totals, "connectivity", "left")
    return got.select("connectivity", (start + F.col("bin") * step).alias("bin_left"), (start + F.col("bin") * step + step).alias("bin_right"), F.coalesce("n", F.lit(0)).alias("count"), (F.coalesce("n", F.lit(0)) / F.greatest(F.coalesce("total", F.lit(1)), F.lit(1))).alias("probability"))


def length_percentiles(catalog: DataFrame) -> DataFrame:
    """Median, 90th and 95th (midpoint) percentile of complete lengths by connectivity."""
    return hazen(catalog.where(F.col("is_ss") & ~F.col("is_censored")), ["connectivity"], "lx_over_delta", {"p50": 0.5, "p90": 0.9, "p95": 0.95})


def branch_metrics(catalog: DataFrame, frames: DataFrame, pixels: int, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """By frame (or other keys), those of frames without structures included: counts, occupied share, median and 90th
    percentile (linear) length."""
    got = catalog.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_lsm"), 1)).alias("lsm"), F.count(F.when(F.col("is_vlsm"), 1)).alias("vlsm"), F.sum("pixel_count").alias("px"), F.percentile("lx_over_delta", F.lit(0.5)).alias("median_length"), F.percentile("lx_over_delta", F.lit(0.9)).alias("p90_length"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return frames.select(*keys).join(got, list(keys), "left").select(*keys, zero("n").alias("n"), zero("lsm").alias("lsm"), zero("vlsm").alias("vlsm"), (zero("px") / F.lit(float(pixels))).alias("occupied_share"), "median_length", "p90_length")


def length_cdf(catalog: DataFrame) -> DataFrame:
    """Distinct lengths with the share of structures up to each, from counts by length."""
    counts = catalog.where("lx_over_delta is not null").groupBy("lx_over_delta").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("lx_over_delta").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("cumulative", F.sum("n").over(upto)).select("lx_over_delta", "n", (F.col("cumulative") / F.max("cumulative").over(Window.partitionBy())).alias("cdf"))


def frame_summary(catalog: DataFrame, frames: DataFrame, thresholds: list[float]) -> DataFrame:
    """By frame, sign and connectivity, zero rows included: structures, and all and complete ones beyond each length."""
    spine = frames.select("frame_id", F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign"), F.lit(1).alias("_")).select("frame_id", "sign", F.explode(F.array(F.lit(8), F.lit(4))).alias("connectivity"))
    over = lambda t: F.col("is_ss") & (F.col("lx_over_delta") > t)
    counts = [F.count(F.lit(1)).alias("components")]
    for k, t in enumerate(thresholds):
        counts += [F.count(F.when(over(t), 1)).alias(f"ss_{k}"), F.count(F.when(over(t) & ~F.col("is_censored"), 1)).alias(f"complete_{k}")]
    got = spine.join(catalog.groupBy("frame_id", "sign", "connectivity").agg(*counts), ["frame_id", "sign", "connectivity"], "left")
    return got.fillna(0, [c for c in got.columns if c not in ("frame_id", "sign", "connectivity")])


def by_column(catalog: DataFrame, columns: DataFrame) -> DataFrame:
    """Structures by the column of x (i, x_mm) nearest their centroid (edges half-way; the last closed), columns without
    any included: numbers, large ones, mean length and area."""
    order = written(numbered(columns.select("i", "x_mm"), "x_mm", "_k"), "columns")
    middle = order.join(order.select((F.col("_k") - 1).alias("_k"), F.col("x_mm").alias("_next")), "_k").select(((F.col("x_mm") + F.col("_next")) / 2).alias("edge"))
    at = placed(catalog, "centroid_x_mm", middle, "edge", "_k").withColumn("_k", F.col("_k") + 1)
    got = at.where("_k is not null").groupBy("_k").agg(F.count("component_id").alias("n"), F.count(F.when(F.col("is_lsm"), 1)).alias("lsm"), F.count(F.when(F.col("is_vlsm"), 1)).alias("vlsm"), F.avg("lx_over_delta").alias("mean_length"), F.avg("area_mm2").alias("mean_area"))
    return order.join(got, "_k", "left").select("i", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "lsm", "vlsm")], "mean_length", "mean_area")


def spacing(catalog: DataFrame) -> DataFrame:
    """Streamwise distance to the same-sign structure before it, by centroid; NULL for a frame's first."""
    order = Window.partitionBy("frame_id", "sign").orderBy("centroid_x_mm", "component_id")
    return catalog.withColumn("spacing_mm", F.col("centroid_x_mm") - F.lag("centroid_x_mm").over(order))


def wall_attached(catalog: DataFrame, limit: float = 0.05) -> DataFrame:
    """Adds wall_attached: the lower end lies strictly below limit (in delta)."""
    return catalog.withColumn("wall_attached", F.col("y_min_over_delta") < limit)


def attached_stats(catalog: DataFrame) -> DataFrame:
    """Wall-attached structures by number and area."""
    own = F.col("wall_attached")
    return catalog.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(own, 1)).alias("attached"), ratio(F.count(F.when(own, 1)), F.count(F.lit(1))).alias("share"), ratio(F.sum(F.when(own, F.col("area_mm2")).otherwise(0.0)), F.sum("area_mm2")).alias("area_share"))


def population_density(catalog: DataFrame, n_bins: int = 12) -> DataFrame:
    """Wall-attached structures by logarithmic bins of height: edges, count and count over width, empty bins included.

    No rows for fewer than two attached structures.
    """
    own = catalog.where("wall_attached").select("height_mm")
    span = own.where("height_mm > 0").agg(F.min(F.log10("height_mm")).alias("lo"), F.max(F.log10("height_mm")).alias("hi")).join(own.agg(F.count(F.lit(1)).alias("m")), F.lit(True)).where("m >= 2 and lo is not null")
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.log10("height_mm") - F.col("lo")) / (F.col("hi") - F.col("lo")) * n_bins), F.lit(n_bins - 1))).otherwise(n_bins - 1)
    counts = own.where("height_mm > 0").join(span, F.lit(True)).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edge = lambda k: F.pow(F.lit(10.0), F.col("lo") + (F.col("hi") - F.col("lo")) * k / n_bins)
    bins = span.select(F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"), "lo", "hi")
    got = bins.join(counts, "bin", "left").select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("count"))
    return got.withColumn("density", ratio("count", F.col("high") - F.col("low")))


def superstructure_stats(catalog: DataFrame) -> DataFrame:
    """Very large structures with counted parts: mean and median number, median part length, and the correlation of
    whole and part length (from three on)."""
    own = catalog.where("is_vlsm and n_sub is not null")
    both = F.col("lx_over_delta").isNotNull() & F.col("sub_length").isNotNull()
    return own.agg(F.count(F.lit(1)).alias("n"), F.avg("n_sub").alias("mean_sub"), F.median("n_sub").alias("median_sub"), F.median("sub_length").alias("median_length"), F.when(F.count(F.when(both, 1)) >= 3, pearson(F.col("lx_over_delta"), F.col("sub_length"))).alias("correlation"))


def sub_histogram(catalog: DataFrame) -> DataFrame:
    return catalog.where("is_vlsm and n_sub is not null").groupBy("n_sub").agg(F.count(F.lit(1)).alias("count"))


def percolation(components: DataFrame, keys: list[str], valid_pixels: int) -> DataFrame:
    """By keys of a table of components (pixel_count): occupancy, largest share, susceptibility without the largest,
    and the share of those below three pixels."""
    biggest = F.max("pixel_count").over(Window.partitionBy(*keys))
    rows = components.withColumn("_big", biggest)
    rest = F.when(F.col("pixel_count") < F.col("_big"), F.col("pixel_count"))
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(n.alias("components"), ratio(F.sum("pixel_count"), F.lit(float(valid_pixels))).alias("occupancy"), F.max("pixel_count").alias("largest"), ratio(F.max("pixel_count"), F.sum("pixel_count")).alias("largest_share"), F.avg("pixel_count").alias("mean_size"), F.median("pixel_count").alias("median_size"), F.coalesce(ratio(F.sum(rest * rest), F.sum(rest)), F.lit(0.0)).alias("susceptibility"), ratio(F.count(F.when(F.col("pixel_count") < 3, 1)), n).alias("small_share"))


def geometry_metrics(catalog: DataFrame, keys: list[str], valid_pixels: int) -> DataFrame:
    """By keys: mean, median and 90th percentile area, 95th percentile aspect, share of the largest tenth in the area,
    small ones, large ones and density."""
    # equal areas are counted first, so that the window over a group holds distinct areas, not structures
    order = Window.partitionBy(*keys).orderBy(F.desc("area_mm2")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = catalog.where("area_mm2 is not null").groupBy(*keys, "area_mm2").agg(F.count(F.lit(1)).alias("_c"))
    sizes = sizes.withColumn("_upto", F.sum("_c").over(order)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    most = F.greatest(F.lit(1), F.round(F.col("_n") * 0.1))
    within = F.greatest(F.lit(0), F.least(F.col("_c"), most - F.col("_upto") + F.col("_c")))
    tails = sizes.groupBy(*keys).agg(F.sum(within * F.col("area_mm2")).alias("_tail"))
    n = F.count(F.lit(1))
    got = catalog.groupBy(*keys).agg(n.alias("n"), F.avg("area_mm2").alias("mean_area"), F.sum("area_mm2").alias("total_area"), F.avg("aspect").alias("mean_aspect"), ratio(F.count(F.when(F.col("pixel_count") <= 4, 1)), n).alias("small_share"), F.count(F.when(F.col("is_lsm"), 1)).alias("lsm"), F.count(F.when(F.col("is_vlsm"), 1)).alias("vlsm"), F.max("lx_over_delta").alias("max_length"), (n / F.lit(float(valid_pixels))).alias("density"))
    got = got.join(tails, keys, "left").select(*keys, "n", "mean_area", "total_area", "mean_aspect", "small_share", ratio("_tail", "total_area").alias("tail_share"), "lsm", "vlsm", "max_length", "density")
    areas = hazen(catalog, keys, "area_mm2", {"median_area": 0.5, "p90_area": 0.9})
    return got.join(areas, keys, "left").join(hazen(catalog, keys, "aspect", {"median_aspect": 0.5, "p95_aspect": 0.95}), keys, "left")


def preview_frames(catalog: DataFrame) -> DataFrame:
    """One frame of each kind: with the longest very large structure, with the longest large one but no very large, and
    with the fewest structures and neither; the smaller frame_id at ties."""
    frames = catalog.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("is_lsm")).alias("lsm"), F.max(F.col("is_vlsm")).alias("vlsm"), F.max(F.when(F.col("is_lsm"), F.col("lx_over_delta"))).alias("lsm_length"), F.max(F.when(F.col("is_vlsm"), F.col("lx_over_delta"))).alias("vlsm_length"))
    kind = F.when(F.col("vlsm"), "vlsm").when(F.col("lsm"), "lsm").otherwise("none")
    score = F.when(F.col("vlsm"), F.col("vlsm_length")).when(F.col("lsm"), F.col("lsm_length")).otherwise(-F.col("n"))
    best = frames.select("frame_id", kind.alias("kind"), score.cast("double").alias("score")).groupBy("kind").agg(F.max_by("frame_id", F.struct("score", -F.col("frame_id"))).alias("frame_id"), F.max("score").alias("score"))
    return best


def figure_rows(catalog: DataFrame, limit: int | None = None) -> DataFrame:
    """Complete very large structures in the order of figures: frame up, sign down, length down; place from 1."""
    own, order = catalog.where(F.col("is_vlsm") & ~F.col("is_censored")), [F.desc("sign"), F.desc("lx_over_delta"), F.col("component_id")]
    return numbered_by_frame(own if limit is None else own.orderBy("frame_id", *order).limit(limit), order, "place")


def bootstrap_median(values: DataFrame, keys: list[str], value: str, resamples: int = 500, level: float = 0.95, seed: int = 7) -> DataFrame:
    """Median of each group and a bootstrap interval of it.

    The n draws of a resample are the rows at ceil(n U) of n uniform numbers, so its median needs only the middle order
    statistics of these: the lower is a beta variate, and the next lies above it by the smallest of the others. Medians so
    drawn have the distribution of whole resamples of n rows. Rows are counted by value first; the window that finds the
    values at the drawn ranks holds distinct values and two ranks a resample.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = counts.select(*keys, F.sum("_n").over(upto).alias("_at"), F.col(value).cast("double").alias("_value"), F.lit(None).cast("int").alias("_b"))
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_size"), F.expr(f"percentile(`{value}`, 0.5, _n)").alias("median"))
    wanted = sizes.select(*keys, "_size", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("_b"))
    wanted = wanted.withColumn("_seed", F.xxhash64(F.lit(seed), *keys, "_b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = []
            for n, own in zip(batch["_size"], batch["_seed"]):
                rng, k = np.random.default_rng(int(own) % 2**64), (n + 1) // 2
                low = rng.beta(k, n + 1 - k)
                high = low if n % 2 else 1 - (1 - low) * rng.random() ** (1 / (n - k))
                at.append([min(max(int(np.ceil(n * x)), 1), int(n)) for x in (low, high)])
            yield batch.drop(columns=["_size", "_seed"]).assign(_ranks=at)

    types = {f.name: f.dataType.simpleString() for f in sizes.schema}
    drawn = wanted.mapInPandas(run, ", ".join([f"`{k}` {types[k]}" for k in keys] + ["_b int", "_ranks array<long>"]))
    ranks = drawn.select(*keys, F.explode("_ranks").alias("_at"), F.lit(None).cast("double").alias("_value"), "_b")
    # the value at a rank is the first whose rows end there or later: from above, the last one met
    down = Window.partitionBy(*keys).orderBy(F.desc("_at"), F.col("_b").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = steps.unionByName(ranks).withColumn("m", F.last("_value", ignorenulls=True).over(down)).where("_b is not null")
    medians = met.groupBy(*keys, "_b").agg(F.avg("m").alias("m"))
    part = (1 - level) / 2
    return sizes.select(*keys, "median").join(hazen(medians, keys, "m", {"low": part, "high": 1 - part}), keys)


def plateaus(series: DataFrame, max_change: float = 0.15, min_run: int = 3) -> DataFrame:
    """Runs of neighbouring points (k, median, low, high) whose intervals overlap and whose medians differ little."""
    order = Window.orderBy("k")
    larger = F.greatest(F.abs(F.col("median")), F.abs(F.lead("median").over(order)))
    linked = (F.col("low") <= F.lead("high").over(order)) & (F.lead("low").over(order) <= F.col("high")) & (F.coalesce(ratio(F.abs(F.lead("median").over(order) - F.col("median")), larger), F.lit(0.0)) <= max_change)
    rows = series.withColumn("_next", F.coalesce(linked, F.lit(False)))
    rows = rows.withColumn("_run", F.sum(F.when(F.coalesce(F.lag("_next").over(order), F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("_run").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count(F.lit(1)).alias("length")).where(F.col("length") >= min_run).drop("_run")


def performance(frames: DataFrame, planned: int) -> tuple[DataFrame, DataFrame]:
    """Summary of a run's frames (frame_id, seconds, components), and one of each unbroken run of frame numbers.

    Only the runs themselves are put in order.
    """
    whole = hazen(frames.withColumn("_k", F.lit(1)), ["_k"], "seconds", {"p95_seconds": 0.95}).select("p95_seconds")
    own = frames.agg(F.count(F.lit(1)).alias("n_frames"), F.avg("seconds").alias("mean_seconds"), F.median("seconds").alias("median_seconds"), F.sum("seconds").alias("total_seconds"), (F.avg("seconds") * planned).alias("planned_seconds"))
    runs = frames.join(frame_runs(frames), "frame_id").groupBy("first_frame").agg(F.max("frame_id").alias("last_frame"), F.count(F.lit(1)).alias("n_frames"), F.avg("seconds").alias("mean_seconds"), F.sum("components").alias("components"))
    runs = runs.withColumn("segment", F.row_number().over(Window.orderBy("first_frame")))
    return own.join(whole, F.lit(True)), runs


def false_positives(found: DataFrame, frames: DataFrame, seen: DataFrame) -> DataFrame:
    """Found boxes a frame on the frames without an annotated one."""
    empty = frames.select("frame_id").join(seen.select("frame_id").distinct(), "frame_id", "left_anti")
    counts = empty.join(found.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n")), "frame_id", "left")
    return counts.agg(F.count(F.lit(1)).alias("negative_frames"), F.coalesce(F.sum("n"), F.lit(0)).alias("false_positives"), F.avg(F.coalesce("n", F.lit(0))).alias("per_frame"))


def annotation_boxes(windows: DataFrame, samples: DataFrame, scale: DataFrame, floor: float) -> DataFrame:
    """Annotated windows (frame_id, box_id, sign, i0, i1) with the rows that their field spans: those pixels of the sign
    beyond floor times the row's u_rms (scale: j, u_rms), and the share of the window's valid pixels that they are."""
    pixels = samples.where("u is not null").join(scale.select("j", "u_rms"), "j").select("frame_id", "j", "i", "u", "u_rms")
    met = windows.join(pixels, "frame_id").where(F.col("i").between(F.col("i0"), F.col("i1")))
    strong = F.col("sign") * F.col("u") > floor * F.col("u_rms")
    return met.groupBy("frame_id", "box_id", "sign", "i0", "i1").agg(F.min(F.when(strong, F.col("j"))).alias("j0"), F.max(F.when(strong, F.col("j"))).alias("j1"), F.count(F.when(strong, 1)).alias("pixels"), ratio(F.count(F.when(strong, 1)), F.count(F.lit(1))).alias("share"), F.max(F.col("sign") * F.col("u") / F.col("u_rms")).alias("strength"))
