"""Queries on whole fields: structures, quadrant objects, blurs, flow maps, and files of frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import frames as P
from ..operators import statistics, structures
from ..plans.views import GRID, PIV, SMP, final, grid, piv, rounded
from ..sources import cache, tecplot
from .flow import frames_of

SHAPE = (4, 8)
X, Y, DELTA = 2.0 * np.arange(8), np.array([0.5, 2.0, 4.5, 8.0]), np.full(8, 4.0)
U_RMS = np.array([0.10, 0.11, 0.12, 0.13])
DOMAIN = np.ones(SHAPE, bool)
HOW = structures.Detection(thresholds=(0.4, 0.8, 1.6), dx_mm=2.0, dy_mm=1.5, delta99_mm=4.0, plus_per_mm=10.0, lower_plus=60.0, upper_plus=10.0)
WEAK = structures.Hysteresis(alpha=0.8, seed_alpha=1.4, connectivity=4, min_pixels=2, closing_radius=1, max_hole=2, min_lsm=0.8, min_vlsm=1.6)


def packed(s, d):
    return P.pack(statistics.paired(piv(s, d)), ["u", "v"])


def found(s, d):
    return structures.find_structures(packed(s, d), SHAPE, U_RMS, X, Y, HOW)


def held(s, d):
    return structures.hysteresis_structures(packed(s, d), SHAPE, np.full(SHAPE, 0.12), DOMAIN, X, Y, DELTA, WEAK)


def parts(s, d):
    pixels = held(s, d).select("repeat_id", "frame_id", "structure_id", F.explode("pixels").alias("p")).select("repeat_id", "frame_id", "structure_id", "p.j", "p.i")
    rows = statistics.paired(piv(s, d)).select("frame_id", "j", "i", "v").join(pixels, ["frame_id", "j", "i"])
    return structures.decompose(rows.select("repeat_id", "frame_id", "structure_id", "i", (2.0 * F.col("i")).alias("x_mm"), "v", F.lit(0.12).alias("v_rms"), F.lit(4.0).alias("delta_mm")), 0.2, 0.2)


def files(s, d, last=None):
    """The files of all frames, or of those up to the last one."""
    own = piv(s, d) if last is None else piv(s, d).where(F.col("frame_id") <= last)
    return tecplot.render(own.join(grid(s), ["j", "i"]).select("frame_id", "j", "i", "x_mm", "y_mm", F.col("u").cast("float").alias("u"), F.col("v").cast("float").alias("v"), "valid"))


def read_back(s, d, last=None):
    return tecplot.parse(files(s, d, last), 8)


def sequence(s, d, last=None):
    """The frames read back in two repeats of half their number."""
    one = read_back(s, d, last)
    half = (frames_of(s, d) if last is None else last) // 2
    return cache.sequence([one.where(F.col("frame_no") <= half), one.where(F.col("frame_no") > half).withColumn("frame_no", F.col("frame_no") - half)], half)


def faulty(s, d):
    own = sequence(s, d)
    return cache.problems(own.where("frame_id <> 4 or j < 3").unionByName(own.where("frame_id = 5 and j = 1")), frames_of(s, d), 4, 8)


QUERIES = {
    "pack_frames": (lambda s, d: rounded(packed(s, d).select("repeat_id", "frame_id", F.size("u").alias("n"), F.aggregate("u", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))).alias("total"), F.get("v", F.lit(9)).alias("tenth"))), final(SMP, "SELECT repeat_id, frame_id, CAST(count(*) AS INTEGER) AS n, coalesce(sum(u), 0) AS total, max(CASE WHEN j = 2 AND i = 2 THEN v END) AS tenth FROM smp GROUP BY repeat_id, frame_id", "repeat_id frame_id n total~ tenth~")),
    "structure_pixels": (lambda s, d: found(s, d).where("connectivity = 8").groupBy("frame_id", "sign").agg(F.sum("pixel_count").alias("pixels"), F.min("col_min").alias("first"), F.max("row_max").alias("top")), final(SMP, "SELECT frame_id, CAST(sg AS INTEGER) AS sign, count(*) AS pixels, min(i) AS first, max(j) AS top FROM smp, (VALUES (1),(-1)) v(sg) WHERE sg*u > CASE j WHEN 1 THEN 0.10 WHEN 2 THEN 0.11 WHEN 3 THEN 0.12 ELSE 0.13 END GROUP BY frame_id, sg", "frame_id sign pixels first top")),
    "find_structures": (lambda s, d: rounded(found(s, d).drop("passes")), None),
    "hysteresis_structures": (lambda s, d: rounded(held(s, d).drop("pixels")), None),
    "quadrant_objects": (lambda s, d: rounded(structures.quadrant_objects(packed(s, d), SHAPE, np.full(SHAPE, 0.0144), DOMAIN, X, Y, DELTA, 1.0).drop("pixels")), None),
    "quadrant_object_pixels": (lambda s, d: structures.quadrant_objects(packed(s, d), SHAPE, np.full(SHAPE, 0.0144), DOMAIN, X, Y, DELTA, 1.0).groupBy("frame_id", "sign").agg(F.sum("pixel_count").alias("pixels")), final(SMP, "SELECT frame_id, CAST(CASE WHEN u > 0 THEN 1 ELSE -1 END AS INTEGER) AS sign, count(*) AS pixels FROM smp WHERE u <> 0 AND abs(u*v)/0.0144 >= 1 GROUP BY 1, 2", "frame_id sign pixels")),
    "gaussian_blur": (lambda s, d: rounded(structures.blurred(packed(s, d), SHAPE, (1.0, 1.5), (3, 3), "zero").select("repeat_id", "frame_id", F.posexplode("u").alias("k", "u")).select("repeat_id", "frame_id", "k", "u")), final(SMP, "SELECT a.repeat_id, a.frame_id, CAST((a.j-1)*8+a.i-1 AS INTEGER) AS k, CASE WHEN max(CASE WHEN a.j = b.j AND a.i = b.i THEN b.u END) IS NOT NULL THEN sum(b.u*exp(-pow(a.j-b.j, 2)/2)*exp(-pow(a.i-b.i, 2)/4.5))/sum(CASE WHEN b.u IS NOT NULL THEN exp(-pow(a.j-b.j, 2)/2)*exp(-pow(a.i-b.i, 2)/4.5) END) END AS u FROM smp a JOIN smp b ON a.frame_id = b.frame_id AND abs(a.j-b.j) <= 1 AND abs(a.i-b.i) <= 1 GROUP BY a.repeat_id, a.frame_id, a.j, a.i", "repeat_id frame_id k u~")),
    "decompose_structures": (lambda s, d: rounded(parts(s, d).drop("interfaces")), None),
    "ftle": (lambda s, d: rounded(structures.ftle(packed(s, d).select("repeat_id", "frame_id", F.transform("u", lambda x: F.coalesce(x, F.lit(0.0))).alias("u"), F.transform("v", lambda x: F.coalesce(x, F.lit(0.0))).alias("v")), SHAPE, X, Y, 0.2, 5)), None),
    "tecplot_scan": (lambda s, d: rounded(read_back(s, d).select("frame_no", "j", "i", "x_mm", "y_mm", F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"), "valid")), final(f"{PIV}, {GRID}", "SELECT frame_id AS frame_no, p.j, p.i, x_mm, y_mm, u, v, valid FROM piv p JOIN grid g ON p.j = g.j AND p.i = g.i", "frame_no j i x_mm~ y_mm~ u~ v~ valid")),
    "mean_spacing": (lambda s, d: rounded(tecplot.mean_spacing(read_back(s, d))), final(f"{PIV}, {GRID}", "SELECT avg(d) AS h_mm FROM (SELECT x_mm-lag(x_mm) OVER (PARTITION BY frame_id, p.j ORDER BY p.i) AS d FROM piv p JOIN grid g ON p.j = g.j AND p.i = g.i) t WHERE d > 0", "h_mm~")),
    "sequence_build": (lambda s, d: rounded(sequence(s, d).groupBy("repeat_id").agg(F.min("frame_id").alias("first"), F.max("frame_id").alias("last"), F.count(F.lit(1)).alias("n"), F.sum(F.col("u").cast("double")).alias("u"))), final(PIV, "SELECT CAST(CASE WHEN 2*frame_id <= n THEN 1 ELSE 2 END AS INTEGER) AS repeat_id, min(frame_id) AS first, max(frame_id) AS last, count(*) AS n, sum(u) AS u FROM piv, (SELECT count(DISTINCT frame_id) AS n FROM piv) c GROUP BY 1", "repeat_id first last n u~")),
    "sequence_problems": (faulty, final(PIV, "SELECT 'missing_points' AS problem, count(*) AS n FROM piv WHERE frame_id = 4 AND j >= 3 UNION ALL SELECT 'repeated_points', count(*) FROM piv WHERE frame_id = 5 AND j = 1", "problem n")),
}
