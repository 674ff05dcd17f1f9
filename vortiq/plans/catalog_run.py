"""One run over a sequence: catalog, counts, wall-attached and superstructure figures, and tracks together."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog, compare, structures, tracking
from ..sources.shared import written


@dataclass(frozen=True)
class Place:
    """Where frames lie: shape, columns' and rows' places (mm), the layer's thickness by column (mm), the analysed part."""

    shape: tuple[int, int]
    x_mm: np.ndarray
    y_mm: np.ndarray
    delta_mm: np.ndarray
    domain: np.ndarray


def run_catalog(frames: DataFrame, samples: DataFrame, place: Place, scale: np.ndarray, how: structures.Hysteresis, profile: DataFrame, dt_s: float, attached_below: float = 0.05, v_rms: float = 1.0, link: float = 0.2) -> dict[str, DataFrame]:
    """All tables of a run; frames are searched once and the catalog written once.

    frames: packed u by repeat and frame; samples: frame_id, j, i, v, for the parts of superstructures; profile: j, y_mm,
    u_mean, whose rows move structures from frame to frame. catalog: every structure with its number `node` over the
    sequence, wall_attached, and n_sub and sub_length where it has parts. frames: counts by frame. attached,
    superstructure: their figures. events, tracks, lifetimes: structures followed through the frames.
    """
    cells = place.shape[0] * place.shape[1] + 1
    found = structures.hysteresis_structures(frames, place.shape, scale, place.domain, place.x_mm, place.y_mm, place.delta_mm, how)
    found = found.withColumns({"node": F.col("frame_id") * cells + F.col("structure_id"), "y_min_over_delta": F.col("y_min_mm") * F.col("lx_over_delta") / F.col("length_mm")})
    own = written(catalog.wall_attached(found, attached_below), "catalog")
    at = own.select("repeat_id", "frame_id", "structure_id", F.explode("pixels").alias("_p")).select("repeat_id", "frame_id", "structure_id", "_p.j", "_p.i")
    x, delta = (F.get(F.array(*map(F.lit, map(float, v))), F.col("i") - 1) for v in (place.x_mm, place.delta_mm))
    parts = structures.decompose(at.join(samples.select("frame_id", "j", "i", "v"), ["frame_id", "j", "i"]).select("repeat_id", "frame_id", "structure_id", "i", x.alias("x_mm"), "v", F.lit(v_rms).alias("v_rms"), delta.alias("delta_mm")))
    whole = written(own.join(parts.drop("interfaces"), ["repeat_id", "frame_id", "structure_id"], "left"), "catalog")
    counts = whole.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_lsm"), 1)).alias("lsm"), F.count(F.when(F.col("is_vlsm"), 1)).alias("vlsm"), F.count(F.when(F.col("wall_attached"), 1)).alias("attached"))
    every = frames.select("frame_id").join(counts, "frame_id", "left").fillna(0)

    y = F.coalesce("weighted_y_mm", "centroid_y_mm").alias("y_mm")
    moving = tracking.convection_shift(whole.select("repeat_id", "frame_id", "node", y), profile, dt_s, float(np.median(np.diff(place.x_mm))))
    rows = compare.row_runs(whole, ("repeat_id", "frame_id"), "node").join(moving.select("node", "shift"), "node")
    span = F.transform("pixels", lambda p: p["i"])
    nodes = whole.select("repeat_id", "frame_id", "node", "pixel_count", "lx_over_delta", "is_vlsm", F.array_min(span).alias("col_min"), F.array_max(span).alias("col_max"))
    events = written(tracking.link_frames(rows, nodes, link), "events")
    tracks = tracking.tracks(tracking.track_ids(events, nodes, lambda df: written(df, "tracks")), nodes, events, place.shape[1])
    return {"catalog": whole, "frames": every, "attached": catalog.attached_stats(whole), "superstructure": catalog.superstructure_stats(whole), "events": events, "tracks": tracks, "lifetimes": tracking.track_summary(tracks)}
