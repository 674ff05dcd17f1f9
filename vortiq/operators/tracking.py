"""Structures followed from frame to frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .matching import overlap_links


def convection_shift(structures: DataFrame, rows: DataFrame, dt_s: float, dx_mm: float) -> DataFrame:
    """structures (y_mm) with shift: whole cells that the mean velocity of the nearest row (j, y_mm, u_mean) moves them
    by in a frame. rows has a profile's size."""
    profile = rows.where("u_mean is not null").select(F.struct("y_mm", "j", "u_mean").alias("r")).agg(F.collect_list("r").alias("profile"))
    near = F.array_min(F.transform("profile", lambda p: F.struct(F.abs(p["y_mm"] - F.col("y_mm")).alias("far"), p["j"].alias("j"), p["u_mean"].alias("u"))))
    return structures.join(profile, F.lit(True)).withColumn("shift", F.coalesce(F.round(near["u"] * (dt_s * 1e3 / dx_mm)), F.lit(0)).cast("int")).drop("profile")


def classify(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Events: continuation, split and merge for links; death and birth for nodes without one.

    nodes: repeat_id, frame_id, node (unique). Deaths in a repeat's last frame and births in its first are none.
    """
    out = F.count(F.lit(1)).over(Window.partitionBy("node_from"))
    into = F.count(F.lit(1)).over(Window.partitionBy("node_to"))
    kinds = links.withColumns({"_o": out, "_i": into}).select("repeat_id", (F.col("frame_to") - 1).alias("frame_from"), "frame_to", "node_from", "node_to", F.when((F.col("_o") == 1) & (F.col("_i") == 1), "continuation").when(F.col("_o") > 1, "split").otherwise("merge").alias("event"), "overlap")
    ends = nodes.groupBy("repeat_id").agg(F.min("frame_id").alias("_first"), F.max("frame_id").alias("_last"))
    own = nodes.join(ends, "repeat_id")
    none = F.lit(None).cast("double")
    death = own.where("frame_id < _last").join(links.select(F.col("node_from").alias("node")), "node", "left_anti").select("repeat_id", F.col("frame_id").alias("frame_from"), (F.col("frame_id") + 1).alias("frame_to"), F.col("node").alias("node_from"), F.lit(None).cast("long").alias("node_to"), F.lit("death").alias("event"), none.alias("overlap"))
    birth = own.where("frame_id > _first").join(links.select(F.col("node_to").alias("node")), "node", "left_anti").select("repeat_id", (F.col("frame_id") - 1).alias("frame_from"), F.col("frame_id").alias("frame_to"), F.lit(None).cast("long").alias("node_from"), F.col("node").alias("node_to"), F.lit("birth").alias("event"), none.alias("overlap"))
    return kinds.unionByName(death).unionByName(birth)


def track_ids(events: DataFrame, nodes: DataFrame, checkpoint, max_rounds: int = 64) -> DataFrame:
    """(node, track): nodes along continuations share the smallest node as track.

    Continuations make chains, so doubling the reach of pointers ends after log2 of the longest; checkpoint(df) cuts the
    lineage of each round (a written table, or DataFrame.checkpoint).
    """
    step = events.where("event = 'continuation'").select(F.col("node_to").alias("node"), F.col("node_from").alias("to"))
    now = checkpoint(nodes.select("node").join(step, "node", "left").select("node", F.coalesce("to", "node").alias("to")))
    for _ in range(max_rounds):
        further = now.join(now.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to"), (F.col("to") != F.col("next")).alias("moved"))
        further = checkpoint(further)
        now = further.drop("moved")
        if further.where("moved").isEmpty():
            return now.withColumnRenamed("to", "track")
    raise RuntimeError("chains are longer than the rounds allow")


def tracks(named: DataFrame, nodes: DataFrame, events: DataFrame, n_columns: int) -> DataFrame:
    """Each track: frames, sizes, splits and merges, and what may have cut it short (view edge, first or last frame).

    nodes also has pixel_count, lx_over_delta, is_vlsm, col_min, col_max.
    """
    ends = nodes.groupBy("repeat_id").agg(F.min("frame_id").alias("_first"), F.max("frame_id").alias("_last"))
    marks = events.where("event = 'split'").select(F.col("node_from").alias("node")).distinct().withColumn("splits", F.lit(1)).join(events.where("event = 'merge'").select(F.col("node_to").alias("node")).distinct().withColumn("merges", F.lit(1)), "node", "full")
    rows = named.join(nodes, "node").join(ends, "repeat_id").join(marks, "node", "left")
    got = rows.groupBy("track", "repeat_id", "_first", "_last").agg(F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"), F.countDistinct("frame_id").alias("lifetime"), F.max("pixel_count").alias("max_pixels"), F.avg("pixel_count").alias("mean_pixels"), F.max("lx_over_delta").alias("max_length"), F.coalesce(F.sum("splits"), F.lit(0)).alias("splits"), F.coalesce(F.sum("merges"), F.lit(0)).alias("merges"), F.max((F.col("col_min") <= 1) | (F.col("col_max") >= n_columns)).alias("touches_view"), F.max("is_vlsm").alias("any_vlsm"))
    return got.withColumn("touches_window", (F.col("first_frame") == F.col("_first")) | (F.col("last_frame") == F.col("_last"))).drop("_first", "_last")


def track_summary(got: DataFrame) -> DataFrame:
    """Lifetimes of all tracks and of those that nothing cut short."""
    whole = ~F.col("touches_view") & ~F.col("touches_window")
    return got.agg(F.count(F.lit(1)).alias("tracks"), F.count(F.when(whole, 1)).alias("uncensored"), F.avg("lifetime").alias("mean_lifetime"), F.avg(F.when(whole, F.col("lifetime"))).alias("mean_uncensored"), F.median("lifetime").alias("median_lifetime"), F.max("lifetime").alias("max_lifetime"), F.sum("splits").alias("splits"), F.sum("merges").alias("merges"))


def link_frames(rows: DataFrame, nodes: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Events of structures from the runs of their rows (see matching.overlap_links)."""
    return classify(overlap_links(rows, threshold), nodes)
