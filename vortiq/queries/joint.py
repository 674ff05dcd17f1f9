"""Queries on whole runs: one run with all its tables, two catalogs side by side, and audits of gates."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from ..operators import boundary, catalog, compare, statistics, structures, wall
from ..plans.catalog_run import Place, run_catalog
from ..plans.views import BOXES, SMP, boxes, final, flow, piv, rounded
from ..sources.shared import written
from .fields import DELTA, DOMAIN, SHAPE, WEAK, X, Y, packed
from .oracles import HELD, held, recursive, regions
from .studies import windows

PLACE = Place(SHAPE, X, Y, DELTA, DOMAIN)


def profile(s, d):
    """Speeds that move structures by some cells a frame: the pooled mean of each row, made as large as a mean flow's."""
    return statistics.pooled_rms(piv(s, d)).select("j", (F.col("j") * F.col("j") * 0.5).alias("y_mm"), (F.col("u_rms") * 20).alias("u_mean"))


def run(s, d, name):
    samples = statistics.paired(piv(s, d))
    return run_catalog(packed(s, d), samples, PLACE, np.full(SHAPE, 0.12), WEAK, profile(s, d), 1e-3, 0.3, 0.12)[name]


def loose(s, d):
    own = replace(WEAK, alpha=0.6, seed_alpha=1.2, connectivity=8)
    return structures.hysteresis_structures(packed(s, d), SHAPE, np.full(SHAPE, 0.12), DOMAIN, X, Y, DELTA, own)


def both(s, d):
    strict = structures.hysteresis_structures(packed(s, d), SHAPE, np.full(SHAPE, 0.12), DOMAIN, X, Y, DELTA, WEAK)
    return compare.paired(written(strict, "strict"), written(loose(s, d), "loose"), 0.2)


def audit(s, d, what):
    u = F.col("sign") * F.col("u")
    gates = {"alpha": u >= 0.8 * F.col("u_rms"), "floor": F.abs("u") >= 0.1, "sign": u > 0}
    return what(windows(s, d), statistics.paired(piv(s, d)), statistics.pooled_rms(piv(s, d)), gates)


#: Regions of the strict (0) and the loose (1) set, and the links between them.
TWO = f"""{held('(0, 0.8, 1.4, 4), (1, 0.6, 1.2, 8)')}, {regions(2, 0.8, 1.6, 's, frame_id')},
sz AS (SELECT gs.s, gs.frame_id, gs.sign, gs.id, structure_id, n FROM gs),
px2 AS (SELECT l.s, l.frame_id, l.sign, l.j, l.i, structure_id, n FROM lab l JOIN sz ON l.s = sz.s AND l.frame_id = sz.frame_id AND l.sign = sz.sign AND l.id = sz.id),
lk AS (SELECT a.frame_id, a.sign, a.structure_id AS before, b.structure_id AS after, count(*) AS shared, count(*)/CAST(least(max(a.n), max(b.n)) AS DOUBLE) AS overlap FROM px2 a JOIN px2 b ON a.s = 0 AND b.s = 1 AND a.frame_id = b.frame_id AND a.sign = b.sign AND a.j = b.j AND a.i = b.i GROUP BY 1, 2, 3, 4 HAVING count(*)/CAST(least(max(a.n), max(b.n)) AS DOUBLE) > 0.2),
kd AS (SELECT *, count(*) OVER (PARTITION BY frame_id, sign, before) AS o, count(*) OVER (PARTITION BY frame_id, sign, after) AS c FROM lk),
pr AS (SELECT frame_id, sign, before, after, CASE WHEN o > 1 AND c > 1 THEN 'regrouped' WHEN o > 1 THEN 'split' WHEN c > 1 THEN 'joined' ELSE 'kept' END AS kind, shared, overlap FROM kd
 UNION ALL SELECT frame_id, sign, structure_id, NULL, 'lost', 0, NULL FROM sz WHERE s = 0 AND NOT EXISTS (SELECT 1 FROM lk WHERE lk.frame_id = sz.frame_id AND lk.sign = sz.sign AND lk.before = sz.structure_id)
 UNION ALL SELECT frame_id, sign, NULL, structure_id, 'new', 0, NULL FROM sz WHERE s = 1 AND NOT EXISTS (SELECT 1 FROM lk WHERE lk.frame_id = sz.frame_id AND lk.sign = sz.sign AND lk.after = sz.structure_id))"""

WINDOWED = f"""{SMP}, {BOXES}, rms AS (SELECT s.j, sqrt(avg((u-m)*(u-m))) AS r FROM smp s JOIN (SELECT j, i, avg(u) AS m FROM smp GROUP BY j, i) a ON s.j = a.j AND s.i = a.i GROUP BY s.j),
wn AS (SELECT frame_id, component_id AS box_id, sign, col_min % 8 + 1 AS i0, least(col_min % 8 + 3, 8) AS i1 FROM boxes),
gp AS (SELECT w.frame_id, box_id, sign, s.j, sign*u >= 0.8*r AS a, abs(u) >= 0.1 AS f, sign*u > 0 AS g FROM wn w JOIN smp s ON s.frame_id = w.frame_id AND s.i BETWEEN i0 AND i1 AND u IS NOT NULL JOIN rms ON rms.j = s.j),
ga AS (SELECT frame_id, box_id, sign, count(*) AS pixels, count(*) FILTER (a)/CAST(count(*) AS DOUBLE) AS share_alpha, count(*) FILTER (f)/CAST(count(*) AS DOUBLE) AS share_floor, count(*) FILTER (g)/CAST(count(*) AS DOUBLE) AS share_sign, count(*) FILTER (f AND g)/CAST(count(*) AS DOUBLE) AS without_alpha, count(*) FILTER (a AND g)/CAST(count(*) AS DOUBLE) AS without_floor, count(*) FILTER (a AND f)/CAST(count(*) AS DOUBLE) AS without_sign, count(*) FILTER (a AND f AND g)/CAST(count(*) AS DOUBLE) AS share_all FROM gp GROUP BY 1, 2, 3),
gr AS (SELECT j, count(*) AS pixels, count(*) FILTER (a AND f AND g) AS passed, count(*) FILTER (NOT a AND f AND g) AS only_alpha, count(*) FILTER (a AND NOT f AND g) AS only_floor, count(*) FILTER (a AND f AND NOT g) AS only_sign FROM gp GROUP BY j)"""

#: The strict set alone, its frames and figures, and links between frames by shifted pixels.
FOLLOWED = f"""{HELD}, pf AS (SELECT s.j, 20*sqrt(avg((s.u-m)*(s.u-m))) AS um FROM smp s JOIN (SELECT j, i, avg(u) AS m FROM smp GROUP BY j, i) a ON s.j = a.j AND s.i = a.i GROUP BY s.j),
nr AS (SELECT frame_id, structure_id, um, row_number() OVER (PARTITION BY frame_id, structure_id ORDER BY abs(0.5*pf.j*pf.j-coalesce(weighted_y_mm, centroid_y_mm)), pf.j) AS p FROM gt, pf),
nd AS (SELECT g.frame_id, g.frame_id*33+g.structure_id AS node, g.structure_id, CAST(round(um*0.5) AS INTEGER) AS shift, r.repeat_id FROM gt g JOIN nr ON nr.frame_id = g.frame_id AND nr.structure_id = g.structure_id AND p = 1 JOIN reps r ON r.frame_id = g.frame_id),
np AS (SELECT nd.repeat_id, l.frame_id, nd.node, nd.shift, l.j, l.i FROM lab l JOIN gs ON gs.frame_id = l.frame_id AND gs.sign = l.sign AND gs.id = l.id JOIN nd ON nd.frame_id = l.frame_id AND nd.structure_id = gs.structure_id),
lc AS (SELECT max(i) AS m FROM np), mv AS (SELECT repeat_id, frame_id, node, j, i+shift AS i FROM np, lc WHERE i+shift BETWEEN 1 AND m),
zs AS (SELECT node, count(*) AS n FROM mv GROUP BY node), zt AS (SELECT node, count(*) AS n FROM np GROUP BY node),
ol AS (SELECT a.repeat_id, a.frame_id AS frame_from, b.frame_id AS frame_to, a.node AS node_from, b.node AS node_to, count(*) AS shared FROM mv a JOIN np b ON a.repeat_id = b.repeat_id AND b.frame_id = a.frame_id+1 AND a.j = b.j AND a.i = b.i GROUP BY 1, 2, 3, 4, 5),
lk AS (SELECT ol.*, shared/CAST(least(zs.n, zt.n) AS DOUBLE) AS overlap FROM ol JOIN zs ON zs.node = node_from JOIN zt ON zt.node = node_to WHERE shared/CAST(least(zs.n, zt.n) AS DOUBLE) >= 0.2),
kd AS (SELECT *, count(*) OVER (PARTITION BY node_from) AS o, count(*) OVER (PARTITION BY node_to) AS c FROM lk),
en AS (SELECT repeat_id, min(frame_id) AS f0, max(frame_id) AS f1 FROM nd GROUP BY repeat_id),
ev AS (SELECT repeat_id, frame_from, frame_to, node_from, node_to, CASE WHEN o = 1 AND c = 1 THEN 'continuation' WHEN o > 1 THEN 'split' ELSE 'merge' END AS event, overlap FROM kd
 UNION ALL SELECT n.repeat_id, frame_id, frame_id+1, node, NULL, 'death', NULL FROM nd n JOIN en ON n.repeat_id = en.repeat_id WHERE frame_id < f1 AND node NOT IN (SELECT node_from FROM lk)
 UNION ALL SELECT n.repeat_id, frame_id-1, frame_id, NULL, node, 'birth', NULL FROM nd n JOIN en ON n.repeat_id = en.repeat_id WHERE frame_id > f0 AND node NOT IN (SELECT node_to FROM lk)),
wa AS (SELECT *, y_min_mm/4 < 0.3 AS att FROM gt)"""

def edges(s, d):
    """Edge velocities of all columns, one in five of them missing, through a smoothing spline."""
    own = boundary.edge_velocity(flow(s, d).select("i", "j", F.col("u_mean").alias("u")), ["i"])
    return wall.edge_velocity_spline(own.select(F.lit(1).alias("k"), (2.0 * F.col("i")).alias("x"), F.when(F.col("i") % 5 != 0, F.col("u_edge")).alias("u_edge")), "k", 0.9)


def settled(s, d):
    """Rows of structures along which the median length hardly changes, by quartiles."""
    own = boxes(s, d).groupBy(F.col("row_min").alias("k")).agg(F.percentile("lx_over_delta", F.lit(0.5)).alias("median"), F.percentile("lx_over_delta", F.lit(0.25)).alias("low"), F.percentile("lx_over_delta", F.lit(0.75)).alias("high"))
    return catalog.plateaus(own, 0.05, 2)


def smeared(s, d):
    """Blur with missing values as zeros."""
    return structures.blurred(packed(s, d), SHAPE, (1.0, 1.5), (3, 5), "zero", by_mask=False).select("repeat_id", "frame_id", F.posexplode("u").alias("k", "u"))


#: Weights of a window of 3 rows and 5 columns, all of them.
WHOLE = "((1+2*exp(-0.5))*(1+2*exp(-1/4.5)+2*exp(-4/4.5)))"
LEVELS = f"{BOXES}, ks AS (SELECT row_min AS k, quantile_cont(lx_over_delta, 0.5) AS m, quantile_cont(lx_over_delta, 0.25) AS lo, quantile_cont(lx_over_delta, 0.75) AS hi FROM boxes GROUP BY row_min), nx AS (SELECT *, coalesce(lo <= lead(hi) OVER w AND lead(lo) OVER w <= hi AND coalesce(abs(lead(m) OVER w-m)/nullif(greatest(abs(m), abs(lead(m) OVER w)), 0), 0) <= 0.05, false) AS linked FROM ks WINDOW w AS (ORDER BY k)), rn AS (SELECT *, sum(CASE WHEN was THEN 0 ELSE 1 END) OVER (ORDER BY k) AS run FROM (SELECT *, coalesce(lag(linked) OVER (ORDER BY k), false) AS was FROM nx) q)"

#: Tracks along continuations, and what may have cut them short.
LIVED = f"""{FOLLOWED}, chain AS (SELECT node, node AS track FROM nd WHERE node NOT IN (SELECT node_to FROM ev WHERE event = 'continuation') UNION ALL SELECT e.node_to, c.track FROM chain c JOIN ev e ON e.event = 'continuation' AND e.node_from = c.node),
nb AS (SELECT node, min(i) <= 1 OR max(i) >= 8 AS rim FROM np GROUP BY node),
tk AS (SELECT c.track, nd.repeat_id, min(nd.frame_id) AS f, max(nd.frame_id) AS l, count(DISTINCT nd.frame_id) AS n, bool_or(rim) AS rim, count(*) FILTER (c.node IN (SELECT node_from FROM ev WHERE event = 'split')) AS sp, count(*) FILTER (c.node IN (SELECT node_to FROM ev WHERE event = 'merge')) AS mg FROM chain c JOIN nd ON nd.node = c.node JOIN nb ON nb.node = c.node GROUP BY 1, 2),
tw AS (SELECT tk.*, NOT rim AND f <> f0 AND l <> f1 AS free FROM tk JOIN en ON en.repeat_id = tk.repeat_id)"""

AUDIT = "frame_id box_id sign pixels share_alpha~ share_floor~ share_sign~ without_alpha~ without_floor~ without_sign~ share_all~ binding"
QUERIES = {
    "run_frames": (lambda s, d: run(s, d, "frames"), recursive(FOLLOWED, "SELECT r.frame_id, count(structure_id) AS n, count(*) FILTER (is_lsm) AS lsm, count(*) FILTER (is_vlsm) AS vlsm, count(*) FILTER (att) AS attached FROM reps r LEFT JOIN wa ON wa.frame_id = r.frame_id GROUP BY r.frame_id", "frame_id n lsm vlsm attached")),
    "run_attached": (lambda s, d: rounded(run(s, d, "attached")), recursive(FOLLOWED, "SELECT count(*) AS n, count(*) FILTER (att) AS attached, count(*) FILTER (att)/CAST(count(*) AS DOUBLE) AS share, sum(CASE WHEN att THEN area_mm2 ELSE 0 END)/sum(area_mm2) AS area_share FROM wa", "n attached share~ area_share~")),
    "run_superstructure": (lambda s, d: rounded(run(s, d, "superstructure")), None),
    "run_events": (lambda s, d: rounded(run(s, d, "events")), recursive(FOLLOWED, "SELECT * FROM ev", "repeat_id frame_from frame_to node_from node_to event overlap~")),
    "run_lifetimes": (lambda s, d: rounded(run(s, d, "lifetimes")), recursive(LIVED, "SELECT count(*) AS tracks, count(*) FILTER (free) AS uncensored, avg(n) AS mean_lifetime, avg(n) FILTER (free) AS mean_uncensored, median(n) AS median_lifetime, max(n) AS max_lifetime, CAST(sum(sp) AS BIGINT) AS splits, CAST(sum(mg) AS BIGINT) AS merges FROM tw", "tracks uncensored mean_lifetime~ mean_uncensored~ median_lifetime~ max_lifetime splits merges")),
    "paired_catalogs": (lambda s, d: rounded(both(s, d)), recursive(TWO, "SELECT repeat_id, pr.* FROM pr JOIN reps ON reps.frame_id = pr.frame_id", "repeat_id frame_id sign before after kind shared overlap~")),
    "paired_summary": (lambda s, d: rounded(compare.pair_summary(both(s, d))), recursive(TWO, "SELECT sign, kind, count(*) AS n, count(DISTINCT frame_id) AS frames, CAST(sum(shared) AS BIGINT) AS shared, avg(overlap) AS overlap FROM pr GROUP BY sign, kind", "sign kind n frames shared overlap~")),
    "edge_velocity_spline": (lambda s, d: rounded(edges(s, d)), None),
    "plateau_runs": (lambda s, d: settled(s, d), final(LEVELS, 'SELECT min(k) AS "first", max(k) AS "last", count(*) AS length FROM rn GROUP BY run HAVING count(*) >= 2', '"first" "last" length')),
    "gaussian_zero_filled": (lambda s, d: rounded(smeared(s, d)), final(SMP, f"SELECT a.repeat_id, a.frame_id, CAST((a.j-1)*8+a.i-1 AS INTEGER) AS k, CASE WHEN max(CASE WHEN a.j = b.j AND a.i = b.i THEN b.u END) IS NOT NULL THEN sum(coalesce(b.u, 0)*exp(-pow(a.j-b.j, 2)/2)*exp(-pow(a.i-b.i, 2)/4.5))/{WHOLE} END AS u FROM smp a JOIN smp b ON a.frame_id = b.frame_id AND abs(a.j-b.j) <= 1 AND abs(a.i-b.i) <= 2 GROUP BY a.repeat_id, a.frame_id, a.j, a.i", "repeat_id frame_id k u~")),
    "gate_audit": (lambda s, d: rounded(audit(s, d, compare.gate_audit)), final(WINDOWED, "SELECT *, CASE WHEN greatest(without_alpha, without_floor, without_sign) <= share_all THEN NULL WHEN without_alpha >= greatest(without_floor, without_sign) THEN 'alpha' WHEN without_floor >= without_sign THEN 'floor' ELSE 'sign' END AS binding FROM ga", AUDIT)),
    "gate_rows": (lambda s, d: audit(s, d, compare.gate_rows), final(WINDOWED, "SELECT *, CASE WHEN greatest(only_alpha, only_floor, only_sign) = 0 THEN NULL WHEN only_alpha >= greatest(only_floor, only_sign) THEN 'alpha' WHEN only_floor >= only_sign THEN 'floor' ELSE 'sign' END AS binding FROM gr", "j pixels passed only_alpha only_floor only_sign binding")),
}
