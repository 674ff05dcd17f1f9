"""Queries that run whole sections, sweeps and summaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import domain, modal, phase, spectra, statistics, structures
from ..plans import sections
from ..plans.views import BOXES, GRID, PIV, SMP, boxes, final, grid, piv, rounded
from ..sources.shared import written
from .fields import DELTA, DOMAIN, HOW, SHAPE, WEAK, X, Y, packed
from .flow import FEW, NINE, RANDOM, STATS, TRANSPORT, frames_of, phased

ALPHAS = [0.5, 1.0, 1.5]


def cfg(s, d):
    return sections.Flow(frames_of(s, d), 16.0, 2.0, 8, FEW, 0.709, edge_rows=1, edge_columns=2)


def transported(s, d):
    return sections.transport_section(piv(s, d), grid(s), cfg(s, d))


def transport_profiles(s, d):
    return sections.profiles(transported(s, d)["statistics"], grid(s), NINE, 2, 7)


def inside(s, d):
    return transported(s, d)["production_inside"]


def detected(s, d, name):
    return sections.detection_section(piv(s, d), SHAPE, X, Y, HOW)[name]


def energy(s, d):
    means = statistics.repeat_means(piv(s, d))
    return statistics.retained_energy(statistics.total_branch(piv(s, d), means), phase.random_branch(phased(s, d), phase.phase_means(phased(s, d), ["repeat_id", "bin"], FEW)))


def sweep(s, d):
    parts = structures.threshold_sweep(packed(s, d), SHAPE, np.full(SHAPE, 0.12), ALPHAS)
    return C.percolation(parts, ["frame_id", "alpha", "connectivity"], 32).groupBy("alpha", "connectivity").agg(F.avg("occupancy").alias("occupancy"), F.avg("largest_share").alias("largest_share"), F.avg("susceptibility").alias("susceptibility"), F.sum("components").alias("components"))


def sweep_pixels(s, d):
    parts = structures.threshold_sweep(packed(s, d), SHAPE, np.full(SHAPE, 0.12), ALPHAS)
    return parts.groupBy("alpha", "connectivity", "sign").agg(F.sum("pixel_count").alias("pixels"), F.countDistinct("frame_id").alias("frames"))


def sensitivity(s, d):
    """A full grid of growth and core thresholds with the core at least the growth, and both connectivities."""
    from dataclasses import replace

    sets = [replace(WEAK, alpha=a, seed_alpha=b, connectivity=c) for a in (0.6, 0.9) for b in (0.8, 1.4) if b >= a for c in (4, 8)]
    got = structures.hysteresis_sweep(packed(s, d), SHAPE, np.full(SHAPE, 0.12), DOMAIN, X, Y, DELTA, sets)
    # the metrics read the structures several times
    own = written(got.select("set", "area_mm2", "aspect", "pixel_count", "is_lsm", "is_vlsm", "lx_over_delta"), "sweep")
    return C.geometry_metrics(own, ["set"], 32).drop("density")


def gap_scan(s, d):
    """Groups left by streamwise merging within each of several gaps."""
    own = boxes(s, d).select(F.lit(1).alias("repeat_id"), "frame_id", "sign", F.col("component_id").alias("structure_id"), "x_min_mm", "x_max_mm")
    out = None
    for gap in (0.0, 4.0, 16.0):
        one = structures.merge_islands(own, gap).agg(F.countDistinct("frame_id", "sign", "group").alias("groups")).withColumn("gap", F.lit(gap))
        out = one if out is None else out.unionByName(one)
    return out


def attempts(s, d):
    """Attempts (classes of structures) with their very large structures, detection rate, and the frames they share with
    all others."""
    own = boxes(s, d).withColumn("attempt", F.col("component_id") % 3)
    every = own.select("frame_id").distinct().agg(F.count(F.lit(1)).alias("all_frames"))
    got = own.where("is_vlsm").groupBy("attempt").agg(F.count(F.lit(1)).alias("vlsm"), F.countDistinct("frame_id").alias("frames"))
    return got.join(every, F.lit(True)).select("attempt", "vlsm", "frames", (F.col("frames") / F.col("all_frames")).alias("rate"), F.when(F.col("frames") == F.col("all_frames"), "OK").otherwise("FAIL").alias("status"))


def pod_branch(s, d):
    """Metrics by frame of structures in fields rebuilt from the modes that hold half of the energy, less the mean."""
    snaps = modal.snapshots(piv(s, d))
    model = modal.pod(snaps)
    rank = model.energy_rank(0.5)
    rebuilt = modal.as_frames(modal.reconstruct(snaps, model, rank))
    found = structures.hysteresis_structures(rebuilt, SHAPE, np.full(SHAPE, 0.08), DOMAIN, X, Y, DELTA, WEAK)
    return C.branch_metrics(found, snaps.select("frame_id"), 32)


def peaks(s, d):
    return spectra.spectral_peak(spectra.spatial_spectra(statistics.paired(piv(s, d)), "u", 2e-3, 0.5, 6).withColumnRenamed("wavenumber", "frequency"), ["j"])


QUERIES = {
    "section_mean_flow": (lambda s, d: rounded(sections.mean_flow(piv(s, d), cfg(s, d))["statistics"].select("j", "i", "u_mean", "uu")), final(STATS, "SELECT j, i, CASE WHEN valid_fraction >= 0.709 THEN um END AS u_mean, CASE WHEN valid_fraction >= 0.709 THEN uu0 END AS uu FROM st", "j i u_mean~ uu~")),
    "section_transport_profiles": (lambda s, d: rounded(transport_profiles(s, d)), final(f"{TRANSPORT}, {GRID}", " UNION ALL ".join(f"SELECT '{c}' AS quantity, y_mm, avg(CASE WHEN ok THEN {c} END) AS mean_value, count(CASE WHEN ok THEN {c} END) AS finite_spatial_count, min(x_mm) AS x_min_mm, max(x_mm) AS x_max_mm FROM tr JOIN grid g ON tr.j = g.j AND tr.i = g.i WHERE tr.i BETWEEN 2 AND 7 GROUP BY y_mm" for c in NINE), "quantity y_mm~ mean_value~ finite_spatial_count x_min_mm~ x_max_mm~")),
    "section_production_inside": (lambda s, d: rounded(inside(s, d)), None),
    "section_transport_closure": (lambda s, d: rounded(transported(s, d)["closure"]), None),
    "section_detection_catalog": (lambda s, d: rounded(detected(s, d, "catalog").drop("passes")), None),
    "section_detection_frames": (lambda s, d: detected(s, d, "frames"), None),
    "section_detection_windows": (lambda s, d: detected(s, d, "windows"), None),
    "retained_energy": (lambda s, d: rounded(energy(s, d)), final(f"{STATS}, {RANDOM}", "SELECT r.j, count(*) AS count, sqrt(avg((u-mu)*(u-mu))) AS rms_whole, sqrt(avg(du*du)) AS rms_active, sqrt(avg(du*du))/sqrt(avg((u-mu)*(u-mu))) AS rms_ratio, sum(du*du)/sum((u-mu)*(u-mu)) AS energy_share FROM rnd r JOIN rm ON r.repeat_id = rm.repeat_id AND r.j = rm.j AND r.i = rm.i WHERE du IS NOT NULL GROUP BY r.j", "j count rms_whole~ rms_active~ rms_ratio~ energy_share~")),
    "strided_frames": (lambda s, d: rounded(domain.strided(piv(s, d), 3, 7, 20, 2).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("u"))), final(PIV, "SELECT frame_id, count(*) AS n, sum(u) AS u FROM piv WHERE frame_id >= 3 AND (frame_id-3) % 7 = 0 AND frame_id-3 < 140 AND j % 2 = 1 AND i % 2 = 1 GROUP BY frame_id", "frame_id n u~")),
    "percolation_sweep": (lambda s, d: rounded(sweep(s, d)), None),
    "sweep_pixels": (sweep_pixels, final(SMP, "SELECT a AS alpha, CAST(c AS INTEGER) AS connectivity, CAST(sg AS INTEGER) AS sign, count(*) AS pixels, count(DISTINCT frame_id) AS frames FROM smp, (VALUES (0.5),(1.0),(1.5)) x(a), (VALUES (8),(4)) y(c), (VALUES (1),(-1)) z(sg) WHERE sg*(u/0.12) >= a GROUP BY a, c, sg", "alpha~ connectivity sign pixels frames")),
    "sensitivity_sweep": (lambda s, d: rounded(sensitivity(s, d)), None),
    "merge_gap_scan": (gap_scan, final(f"{BOXES}, r AS (SELECT *, max(x_max_mm) OVER (PARTITION BY frame_id, sign ORDER BY x_min_mm, component_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM boxes)", "SELECT CAST(g AS DOUBLE) AS gap, count(*) FILTER (reach IS NULL OR x_min_mm-reach > g) AS groups FROM r, (VALUES (0.0),(4.0),(16.0)) v(g) GROUP BY g", "gap~ groups")),
    "attempt_summary": (lambda s, d: rounded(attempts(s, d)), final(f"{BOXES}, n AS (SELECT count(DISTINCT frame_id) AS n FROM boxes)", "SELECT component_id % 3 AS attempt, count(*) AS vlsm, count(DISTINCT frame_id) AS frames, count(DISTINCT frame_id)/CAST(max(n) AS DOUBLE) AS rate, CASE WHEN count(DISTINCT frame_id) = max(n) THEN 'OK' ELSE 'FAIL' END AS status FROM boxes, n WHERE is_vlsm GROUP BY component_id % 3", "attempt vlsm frames rate~ status")),
    "pod_branch_metrics": (lambda s, d: rounded(pod_branch(s, d)), None),
    "spatial_peak": (lambda s, d: rounded(peaks(s, d)), None),
}
