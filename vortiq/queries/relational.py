"""Queries on catalogs: selection, comparison, matching and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import matching as M
from ..operators import domain, modal, structures, tracking
from ..plans.views import BOX_COLUMNS, BOXES, FLOW, GRID, boxes, final, flow, grid, rounded, table
from ..sources.shared import written

TIERS = [3.0, 3.8, 4.5]


def frames(s, d):
    return boxes(s, d).select("frame_id").distinct()


FRAMES = "frames AS (SELECT DISTINCT frame_id FROM boxes)"
COMPLETE = "is_ss AND NOT is_censored"
RANKED = "rep AS (SELECT *, row_number() OVER (PARTITION BY frame_id, sign, connectivity ORDER BY lx_over_delta DESC, pixel_count DESC, component_id) AS p, count(*) OVER (PARTITION BY frame_id, sign, connectivity) AS cnt FROM boxes WHERE is_ss AND NOT is_censored AND lx_over_delta > 3.8)"
COMPARED = f"""{BOXES}, {FRAMES}, {RANKED},
spine AS (SELECT frame_id, s AS sign FROM frames, (VALUES (1),(-1)) t(s)),
cmp AS (SELECT p.frame_id, p.sign, coalesce(a.cnt, 0) AS count8, coalesce(b.cnt, 0) AS count4, CASE WHEN a.cnt > 0 AND b.cnt > 0 THEN 'both' WHEN a.cnt > 0 THEN 'only_8' WHEN b.cnt > 0 THEN 'only_4' ELSE 'neither' END AS category, a.component_id AS component8, b.component_id AS component4, a.lx_over_delta-b.lx_over_delta AS delta_lx,
 CASE WHEN a.cnt > 0 AND b.cnt > 0 THEN greatest(0, least(a.col_max,b.col_max)-greatest(a.col_min,b.col_min)+1)*greatest(0, least(a.row_max,b.row_max)-greatest(a.row_min,b.row_min)+1) END AS inter, (a.col_max-a.col_min+1)*(a.row_max-a.row_min+1)+(b.col_max-b.col_min+1)*(b.row_max-b.row_min+1) AS areas
 FROM spine p LEFT JOIN rep a ON a.p = 1 AND a.connectivity = 8 AND a.frame_id = p.frame_id AND a.sign = p.sign LEFT JOIN rep b ON b.p = 1 AND b.connectivity = 4 AND b.frame_id = p.frame_id AND b.sign = p.sign),
compared AS (SELECT *, inter/CAST(areas-inter AS DOUBLE) AS bbox_iou FROM cmp)"""


def hazen_sql(rows: str, keys: str, value: str, levels: dict) -> str:
    parts = ", ".join(f"sum(CASE WHEN rn = floor(least(greatest(n*{p}+0.5, 1), n)) THEN x*(1-(least(greatest(n*{p}+0.5, 1), n)-floor(least(greatest(n*{p}+0.5, 1), n)))) WHEN rn = floor(least(greatest(n*{p}+0.5, 1), n))+1 THEN x*(least(greatest(n*{p}+0.5, 1), n)-floor(least(greatest(n*{p}+0.5, 1), n))) ELSE 0 END) AS {name}" for name, p in levels.items())
    return f"SELECT {keys}, {parts} FROM (SELECT {keys}, {value} AS x, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) AS rn, CAST(count(*) OVER (PARTITION BY {keys}) AS DOUBLE) AS n FROM ({rows}) r0) r GROUP BY {keys}"


def found_seen(s, d):
    own = boxes(s, d).select("frame_id", "connectivity", "sign", F.col("component_id").alias("box_id"), F.col("x_min_mm").alias("x0"), F.col("x_max_mm").alias("x1"), F.col("y_min_mm").alias("y0"), F.col("y_max_mm").alias("y1"))
    return own.where("connectivity = 8").drop("connectivity"), own.where("connectivity = 4").drop("connectivity")


PAIRS = f"""{BOXES}, bx AS (SELECT frame_id, connectivity, sign, component_id AS box_id, x_min_mm AS x0, x_max_mm AS x1, y_min_mm AS y0, y_max_mm AS y1 FROM boxes),
pr AS (SELECT a.frame_id, a.box_id AS found_id, b.box_id AS seen_id, a.sign = b.sign AS sign_match, greatest(0, least(a.x1,b.x1)-greatest(a.x0,b.x0))/(greatest(a.x1,b.x1)-least(a.x0,b.x0)) AS x_iou, greatest(0, least(a.x1,b.x1)-greatest(a.x0,b.x0))*greatest(0, least(a.y1,b.y1)-greatest(a.y0,b.y0)) AS inter, (a.x1-a.x0)*(a.y1-a.y0)+(b.x1-b.x0)*(b.y1-b.y0) AS areas, abs((a.x1-a.x0)-(b.x1-b.x0))/greatest(a.x1-a.x0, b.x1-b.x0) AS length_error, abs(a.x0+a.x1-b.x0-b.x1)/2/128 AS x_error, abs(a.y0+a.y1-b.y0-b.y1)/2/24 AS y_error FROM bx a JOIN bx b ON a.frame_id = b.frame_id AND a.connectivity = 8 AND b.connectivity = 4),
pm AS (SELECT frame_id, found_id, seen_id, sign_match, x_iou, inter/(areas-inter) AS box_iou, length_error, x_error, y_error, x_iou >= 0.3 AND x_error <= 0.2 AND y_error <= 0.25 AS eligible, x_iou >= 0.5 AND x_error <= 0.1 AND y_error <= 0.15 AS position_match FROM pr)"""
PAIR_SCORE = "0.45*x_iou+0.25*box_iou+0.15*greatest(0, 1-length_error)+0.075*greatest(0, 1-x_error/0.2)+0.075*greatest(0, 1-y_error/0.25)"


def pair_table(s, d):
    a, b = found_seen(s, d)
    return M.pair_metrics(a, b, 128.0, 24.0)


def chosen_pairs(s, d):
    # only what the choice and its scores need goes through the tasks that choose
    return M.assign_pairs(pair_table(s, d).select("frame_id", "found_id", "seen_id", "sign_match", "eligible", "score"))


def scored(s, d):
    a, b = found_seen(s, d)
    return M.score_frames(chosen_pairs(s, d), a, b, frames(s, d))


def params(s, d):
    """Parameter sets with their recall and false positives: brands of parts."""
    rows = table(s, d, "part")
    return rows.groupBy("p_brand", "p_size").agg(F.round(F.avg("p_retailprice"), 2).alias("recall"), F.count(F.lit(1)).cast("double").alias("fp"))


#: Height in mm of the flow's rows next to structures.
CELL = 1.0


def moving(s, d):
    """Structures of connectivity 8 with the cells that the mean flow at their height moves them by in a millisecond."""
    rows = flow(s, d).groupBy("j").agg(F.avg("u_mean").alias("u_mean")).withColumn("y_mm", F.col("j") * CELL)
    own = boxes(s, d).where("connectivity = 8").withColumn("y_mm", (F.col("y_min_mm") + F.col("y_max_mm")) / 2)
    return tracking.convection_shift(own, rows, 1e-3, 10.0)


def nodes(s, d):
    """They as nodes of a repeat of 50 frames each."""
    return moving(s, d).select((F.floor((F.col("frame_id") - 1) / 50) + 1).cast("int").alias("repeat_id"), "frame_id", F.col("component_id").alias("node"), "pixel_count", "lx_over_delta", "is_vlsm", "col_min", "col_max", "row_min", "row_max", "shift")


def row_runs(s, d):
    return nodes(s, d).select("repeat_id", "frame_id", "node", "shift", F.explode(F.sequence("row_min", "row_max")).alias("j"), F.col("col_min").alias("first"), F.col("col_max").alias("last"))


NODES = f"""{BOXES}, {FLOW}, pf AS (SELECT j, avg(u_mean) AS u FROM flow GROUP BY j), nr AS (SELECT component_id, u, row_number() OVER (PARTITION BY component_id ORDER BY abs(j*{CELL}-(y_min_mm+y_max_mm)/2), j) AS p FROM boxes, pf WHERE connectivity = 8),
nodes AS (SELECT CAST((frame_id-1)//50+1 AS INTEGER) AS repeat_id, frame_id, component_id AS node, pixel_count, lx_over_delta, is_vlsm, col_min, col_max, row_min, row_max, CAST(round(u*1e-3*1e3/10.0) AS INTEGER) AS shift FROM boxes JOIN nr USING (component_id) WHERE connectivity = 8 AND p = 1),
lastcol AS (SELECT max(col_max) AS m FROM nodes),
olap AS (SELECT a.repeat_id, a.frame_id AS frame_from, b.frame_id AS frame_to, a.node AS node_from, b.node AS node_to, greatest(0, least(least(a.col_max+a.shift, m), b.col_max)-greatest(a.col_min+a.shift, b.col_min)+1)*greatest(0, least(a.row_max,b.row_max)-greatest(a.row_min,b.row_min)+1) AS shared, least((least(a.col_max+a.shift, m)-(a.col_min+a.shift)+1)*(a.row_max-a.row_min+1), (b.col_max-b.col_min+1)*(b.row_max-b.row_min+1)) AS smaller FROM nodes a JOIN nodes b ON a.repeat_id = b.repeat_id AND b.frame_id = a.frame_id+1, lastcol),
links AS (SELECT *, shared/CAST(smaller AS DOUBLE) AS overlap FROM olap WHERE shared > 0 AND shared/CAST(smaller AS DOUBLE) >= 0.2),
kinds AS (SELECT *, count(*) OVER (PARTITION BY node_from) AS o, count(*) OVER (PARTITION BY node_to) AS i_ FROM links),
ends AS (SELECT repeat_id, min(frame_id) AS f0, max(frame_id) AS f1 FROM nodes GROUP BY repeat_id),
events_ AS (SELECT repeat_id, frame_from, frame_to, node_from, node_to, CASE WHEN o = 1 AND i_ = 1 THEN 'continuation' WHEN o > 1 THEN 'split' ELSE 'merge' END AS event, overlap FROM kinds
 UNION ALL SELECT n.repeat_id, frame_id, frame_id+1, node, NULL, 'death', NULL FROM nodes n JOIN ends e ON n.repeat_id = e.repeat_id WHERE frame_id < f1 AND node NOT IN (SELECT node_from FROM links)
 UNION ALL SELECT n.repeat_id, frame_id-1, frame_id, NULL, node, 'birth', NULL FROM nodes n JOIN ends e ON n.repeat_id = e.repeat_id WHERE frame_id > f0 AND node NOT IN (SELECT node_to FROM links))"""
CHAIN = f"{NODES}, chain AS (SELECT node, node AS track FROM nodes WHERE node NOT IN (SELECT node_to FROM events_ WHERE event = 'continuation') UNION ALL SELECT e.node_to, c.track FROM chain c JOIN events_ e ON e.event = 'continuation' AND e.node_from = c.node)"


def event_table(s, d):
    return tracking.link_frames(row_runs(s, d), nodes(s, d))


def track_table(s, d):
    happened = written(event_table(s, d), "events")
    named = tracking.track_ids(happened, nodes(s, d), lambda df: written(df, "tracks"))
    return tracking.tracks(named, nodes(s, d), happened, BOX_COLUMNS)


def rows_at(s, d):
    return M.nearest_rows(flow(s, d).groupBy("j").agg(F.avg("u_mean").alias("y_plus")), s.createDataFrame([(5.0,), (20.0,), (23.5,), (99.0,)], "target double"), "y_plus", "j")


def probes(s, d):
    return M.nearest_points(grid(s), s.createDataFrame([(1, 3.2, 2.1), (2, 9.0, 0.4), (3, 100.0, 9.0)], "probe int, px double, py double"))


def interpolated(s, d):
    knots = flow(s, d).groupBy("i").agg(F.avg("u_mean").alias("delta")).select((F.col("i") * 2.0).alias("x"), "delta")
    return M.interpolate(s.range(0, 70).select((F.col("id") * 0.5).alias("x")), knots, "x", "delta")


def runs(s, d):
    """Contiguous runs of frames with more than four complete structures."""
    own = boxes(s, d).where("is_ss and not is_censored").groupBy("frame_id").agg(F.count(F.lit(1)).alias("n")).where("n > 4")
    return domain.frame_runs(own).groupBy("first_frame").agg(F.max("frame_id").alias("last"), F.count(F.lit(1)).alias("length")).withColumnRenamed("first_frame", "first")


def set_operations(s, d):
    own = boxes(s, d)
    a, b = (own.where(f"connectivity = {c} and lx_over_delta > 4.5").select("frame_id") for c in (8, 4))
    parts = {"both": a.intersect(b), "either": a.union(b).distinct(), "only_8": a.subtract(b), "all_rows": a.unionByName(b)}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n"), F.sum("frame_id").alias("total")).withColumn("part", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


PIECES = {"both": "SELECT frame_id FROM a INTERSECT SELECT frame_id FROM b", "either": "SELECT frame_id FROM a UNION SELECT frame_id FROM b", "only_8": "SELECT frame_id FROM a EXCEPT SELECT frame_id FROM b", "all_rows": "SELECT frame_id FROM a UNION ALL SELECT frame_id FROM b"}


def eigenvalues(s, d):
    return table(s, d, "part").groupBy((F.col("p_size") % 30 + 1).alias("mode")).agg(F.sum("p_retailprice").alias("eigenvalue"))


def percentile_rows(s, d):
    return C.length_percentiles(boxes(s, d))


def parent_table(s, d):
    px = row_runs(s, d)
    own = nodes(s, d).select("node", "pixel_count")
    small = px.join(own.where("pixel_count <= 30").select("node"), "node", "left_semi")
    large = px.join(own.where("pixel_count > 30").select("node"), "node", "left_semi")
    return M.parents(small, large, ["repeat_id", "frame_id"]).select("node", "parent", "shared", "status")


def box_pixels():
    """Every pixel of a box, with values that its place makes."""
    pixel = lambda j, i: F.struct((i * 2.0).alias("x_mm"), (j * 1.5).alias("y_mm"), (10.0 + i).alias("delta_mm"), (i - j - 10.0).alias("u"))
    return F.flatten(F.transform(F.sequence("row_min", "row_max"), lambda j: F.transform(F.sequence("col_min", "col_max"), lambda i: pixel(j, i))))


def geometry_table(s, d):
    regions = nodes(s, d).select("node", F.when(F.col("node") % 2 == 0, 1).otherwise(-1).alias("sign"), box_pixels().alias("pixels"))
    return structures.structure_geometry(regions, ["node"], 2.0, 1.5)


def compare_tables(s, d):
    a = boxes(s, d).select("frame_id", "pixel_count")
    return M.same_rows(a.where("pixel_count > 20"), a.where("pixel_count < 40"))


def gallery_rows(s, d):
    """Slots over all frames of the catalog."""
    last = boxes(s, d).agg(F.max("frame_id")).first()[0]
    return M.gallery(boxes(s, d).where("connectivity = 8"), last or 1)


def bootstrap_rows(s, d):
    return C.bootstrap_median(boxes(s, d).withColumn("k", F.col("connectivity")), ["k"], "lx_over_delta")


def summary_stats(s, d):
    return tracking.track_summary(track_table(s, d))


CDF = "SELECT lx_over_delta, n, sum(n) OVER (ORDER BY lx_over_delta)/CAST(sum(n) OVER () AS DOUBLE) AS cdf FROM (SELECT lx_over_delta, count(*) AS n FROM boxes GROUP BY lx_over_delta) t"
GEO = "mean_area total_area mean_aspect small_share tail_share"
COLUMN_X = "cols AS (SELECT CAST(k AS INTEGER) AS i, CAST(k AS DOUBLE)*10 AS x_mm FROM range(1, 15) t(k)), ed AS (SELECT i, (x_mm+lag(x_mm) OVER (ORDER BY x_mm))/2 AS lo, (x_mm+lead(x_mm) OVER (ORDER BY x_mm))/2 AS hi FROM cols)"
SUMMARY_COLUMNS = ", ".join(f"count(CASE WHEN is_ss AND lx_over_delta > {t} THEN 1 END) AS ss_{k}, count(CASE WHEN is_ss AND lx_over_delta > {t} AND NOT is_censored THEN 1 END) AS complete_{k}" for k, t in enumerate(TIERS))
SUMMARY_NAMES = [f"{a}_{k}" for k in range(3) for a in ("ss", "complete")]

QUERIES = {
    "representative": (lambda s, d: C.representative(boxes(s, d), ["frame_id", "sign"]).select("frame_id", "sign", "component_id", "count"), final(BOXES, "SELECT frame_id, sign, component_id, count FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, sign ORDER BY lx_over_delta DESC, pixel_count DESC, component_id) AS p, count(*) OVER (PARTITION BY frame_id, sign) AS count FROM boxes) t WHERE p = 1", "frame_id sign component_id count")),
    "connectivity_comparison": (lambda s, d: rounded(C.connectivity_comparison(boxes(s, d), frames(s, d), 3.8)), final(COMPARED, "SELECT * FROM compared", "frame_id sign count8 count4 category component8 component4 delta_lx~ bbox_iou~")),
    "comparison_summary": (lambda s, d: rounded(C.comparison_summary(C.connectivity_comparison(boxes(s, d), frames(s, d), 3.8))), final(COMPARED, "SELECT count(*) AS units, CAST(sum(count8) AS BIGINT) AS objects8, CAST(sum(count4) AS BIGINT) AS objects4, count(*) FILTER (category = 'both') AS in_both, count(*) FILTER (category = 'only_8') AS only8, count(*) FILTER (category = 'only_4') AS only4, count(*) FILTER (category = 'neither') AS neither, count(*) FILTER (category = 'both')/CAST(nullif(count(*) FILTER (category <> 'neither'), 0) AS DOUBLE) AS jaccard, count(*) FILTER (category = 'both')/CAST(nullif(count(*) FILTER (category IN ('both', 'only_8')), 0) AS DOUBLE) AS share8_also4, count(*) FILTER (category = 'both')/CAST(nullif(count(*) FILTER (category IN ('both', 'only_4')), 0) AS DOUBLE) AS share4_also8, avg(bbox_iou) AS mean_iou, median(bbox_iou) AS median_iou, avg(delta_lx) AS mean_delta, median(abs(delta_lx)) AS median_abs_delta FROM compared", "units objects8 objects4 in_both only8 only4 neither jaccard~ share8_also4~ share4_also8~ mean_iou~ median_iou~ mean_delta~ median_abs_delta~")),
    "threshold_counts": (lambda s, d: rounded(C.threshold_counts(boxes(s, d), TIERS)), final(BOXES, "SELECT connectivity, CAST(t AS DOUBLE) AS threshold, count(*) AS all_ss, count(*) FILTER (NOT is_censored) AS complete, count(*) FILTER (is_censored) AS censored, count(*) FILTER (NOT is_censored AND sign = 1) AS positive, count(*) FILTER (NOT is_censored AND sign = -1) AS negative, count(DISTINCT CASE WHEN NOT is_censored THEN frame_id END) AS frames, count(*) FILTER (NOT is_censored AND touches_exclusion)/CAST(nullif(count(*) FILTER (NOT is_censored), 0) AS DOUBLE) AS touching_share FROM boxes, (VALUES (3.0),(3.8),(4.5)) v(t) WHERE is_ss AND lx_over_delta > t GROUP BY connectivity, t", "connectivity threshold~ all_ss complete censored positive negative frames touching_share~")),
    "frame_overlap": (lambda s, d: rounded(C.frame_overlap(boxes(s, d), TIERS)), final(BOXES, f"SELECT CAST(t AS DOUBLE) AS threshold, CAST(sum(a) AS BIGINT) AS frames8, CAST(sum(b) AS BIGINT) AS frames4, CAST(sum(a*b) AS BIGINT) AS in_both, count(*) AS in_any, sum(a*b)/CAST(count(*) AS DOUBLE) AS jaccard, sum(a*b)/CAST(nullif(sum(a), 0) AS DOUBLE) AS share8_also4 FROM (SELECT t, frame_id, max(CASE WHEN connectivity = 8 THEN 1 ELSE 0 END) AS a, max(CASE WHEN connectivity = 4 THEN 1 ELSE 0 END) AS b FROM boxes, (VALUES (3.0),(3.8),(4.5)) v(t) WHERE {COMPLETE} AND lx_over_delta > t GROUP BY t, frame_id) g GROUP BY t", "threshold~ frames8 frames4 in_both in_any jaccard~ share8_also4~")),
    "length_distribution": (lambda s, d: rounded(C.length_distribution(boxes(s, d))), final(BOXES, f"SELECT c AS connectivity, 3+k*0.25 AS bin_left, 3.25+k*0.25 AS bin_right, count(component_id) AS count, count(component_id)/CAST(greatest(max(tot), 1) AS DOUBLE) AS probability FROM (SELECT CAST(round((greatest(3.25, ceil(max(lx_over_delta)*4)/4)+0.25-3)/0.25) AS BIGINT) AS nb FROM boxes WHERE {COMPLETE}) e, (VALUES (8),(4)) cc(c), range(1000) r(k) LEFT JOIN boxes b ON {COMPLETE} AND b.connectivity = c AND b.lx_over_delta >= 3+k*0.25 AND b.lx_over_delta < 3.25+k*0.25 LEFT JOIN (SELECT connectivity AS tc, count(*) AS tot FROM boxes WHERE {COMPLETE} GROUP BY connectivity) t ON tc = c WHERE k < nb GROUP BY c, k", "connectivity bin_left~ bin_right~ count probability~")),
    "length_percentiles": (lambda s, d: rounded(percentile_rows(s, d)), final(BOXES, hazen_sql(f"SELECT * FROM boxes WHERE {COMPLETE}", "connectivity", "lx_over_delta", {"p50": 0.5, "p90": 0.9, "p95": 0.95}), "connectivity p50~ p90~ p95~")),
    "branch_metrics": (lambda s, d: rounded(C.branch_metrics(boxes(s, d), frames(s, d), 1000)), final(f"{BOXES}, {FRAMES}", "SELECT f.frame_id, count(component_id) AS n, count(*) FILTER (is_lsm) AS lsm, count(*) FILTER (is_vlsm) AS vlsm, coalesce(sum(pixel_count), 0)/1000.0 AS occupied_share, quantile_cont(lx_over_delta, 0.5) AS median_length, quantile_cont(lx_over_delta, 0.9) AS p90_length FROM frames f LEFT JOIN boxes b ON b.frame_id = f.frame_id GROUP BY f.frame_id", "frame_id n lsm vlsm occupied_share~ median_length~ p90_length~")),
    "length_cdf": (lambda s, d: rounded(C.length_cdf(boxes(s, d))), final(BOXES, CDF, "lx_over_delta~ n cdf~")),
    "frame_summary": (lambda s, d: C.frame_summary(boxes(s, d), frames(s, d), TIERS), final(f"{BOXES}, {FRAMES}", f"SELECT f.frame_id, CAST(sg AS INTEGER) AS sign, CAST(cn AS INTEGER) AS connectivity, count(component_id) AS components, {SUMMARY_COLUMNS} FROM frames f CROSS JOIN (VALUES (1),(-1)) a(sg) CROSS JOIN (VALUES (8),(4)) c(cn) LEFT JOIN boxes b ON b.frame_id = f.frame_id AND b.sign = sg AND b.connectivity = cn GROUP BY f.frame_id, sg, cn", "frame_id sign connectivity components " + " ".join(SUMMARY_NAMES))),
    "structures_by_column": (lambda s, d: rounded(C.by_column(boxes(s, d), s.range(1, 15).select(F.col("id").cast("int").alias("i"), (F.col("id") * 10.0).alias("x_mm")))), final(f"{BOXES}, {COLUMN_X}", "SELECT i, count(component_id) AS n, count(*) FILTER (is_lsm) AS lsm, count(*) FILTER (is_vlsm) AS vlsm, avg(lx_over_delta) AS mean_length, avg(area_mm2) AS mean_area FROM ed LEFT JOIN boxes ON (lo IS NULL OR centroid_x_mm >= lo) AND (hi IS NULL OR centroid_x_mm < hi) GROUP BY i", "i n lsm vlsm mean_length~ mean_area~")),
    "structure_spacing": (lambda s, d: rounded(C.spacing(boxes(s, d)).select("component_id", "spacing_mm")), final(BOXES, "SELECT component_id, centroid_x_mm - lag(centroid_x_mm) OVER (PARTITION BY frame_id, sign ORDER BY centroid_x_mm, component_id) AS spacing_mm FROM boxes", "component_id spacing_mm~")),
    "attached_stats": (lambda s, d: rounded(C.attached_stats(C.wall_attached(boxes(s, d)))), final(BOXES, "SELECT count(*) AS n, count(*) FILTER (y_min_over_delta < 0.05) AS attached, count(*) FILTER (y_min_over_delta < 0.05)/CAST(count(*) AS DOUBLE) AS share, sum(CASE WHEN y_min_over_delta < 0.05 THEN area_mm2 ELSE 0 END)/sum(area_mm2) AS area_share FROM boxes", "n attached share~ area_share~")),
    "population_density": (lambda s, d: rounded(C.population_density(C.wall_attached(boxes(s, d)))), final(f"{BOXES}, own AS (SELECT height_mm FROM boxes WHERE y_min_over_delta < 0.05), sp AS (SELECT log10(min(height_mm)) AS lo, log10(max(height_mm)) AS hi FROM own), bn AS (SELECT CAST(k AS INTEGER) AS bin, pow(10.0, lo+(hi-lo)*k/12) AS low, pow(10.0, lo+(hi-lo)*(k+1)/12) AS high FROM sp, range(12) t(k)), ct AS (SELECT CAST(least(floor((log10(height_mm)-lo)/(hi-lo)*12), 11) AS INTEGER) AS bin, count(*) AS n FROM own, sp GROUP BY 1)", "SELECT bn.bin, low, high, coalesce(n, 0) AS count, coalesce(n, 0)/(high-low) AS density FROM bn LEFT JOIN ct ON ct.bin = bn.bin", "bin low~ high~ count density~")),
    "superstructure_stats": (lambda s, d: rounded(C.superstructure_stats(boxes(s, d))), final(BOXES, "SELECT count(*) AS n, avg(n_sub) AS mean_sub, median(n_sub) AS median_sub, median(sub_length) AS median_length, corr(lx_over_delta, sub_length) AS correlation FROM boxes WHERE is_vlsm", "n mean_sub~ median_sub~ median_length~ correlation~")),
    "sub_histogram": (lambda s, d: C.sub_histogram(boxes(s, d)), final(BOXES, "SELECT CAST(n_sub AS INTEGER) AS n_sub, count(*) AS count FROM boxes WHERE is_vlsm GROUP BY n_sub", "n_sub count")),
    "percolation": (lambda s, d: rounded(C.percolation(boxes(s, d), ["frame_id", "sign"], 1000)), final(f"{BOXES}, m AS (SELECT *, max(pixel_count) OVER (PARTITION BY frame_id, sign) AS big FROM boxes)", "SELECT frame_id, sign, count(*) AS components, sum(pixel_count)/1000.0 AS occupancy, max(pixel_count) AS largest, max(pixel_count)/CAST(sum(pixel_count) AS DOUBLE) AS largest_share, avg(pixel_count) AS mean_size, median(pixel_count) AS median_size, coalesce(sum(CASE WHEN pixel_count < big THEN pixel_count*pixel_count END)/CAST(sum(CASE WHEN pixel_count < big THEN pixel_count END) AS DOUBLE), 0) AS susceptibility, count(*) FILTER (pixel_count < 3)/CAST(count(*) AS DOUBLE) AS small_share FROM m GROUP BY frame_id, sign", "frame_id sign components occupancy~ largest largest_share~ mean_size~ median_size~ susceptibility~ small_share~")),
    "geometry_metrics": (lambda s, d: rounded(C.geometry_metrics(boxes(s, d), ["connectivity", "sign"], 1000).select("connectivity", "sign", "n", *GEO.split(), "lsm", "vlsm", "median_area", "p90_area", "median_aspect", "p95_aspect")), final(f"{BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY connectivity, sign ORDER BY area_mm2 DESC, component_id) AS p, count(*) OVER (PARTITION BY connectivity, sign) AS m FROM boxes), ha AS ({hazen_sql('SELECT * FROM boxes', 'connectivity, sign', 'area_mm2', {'median_area': 0.5, 'p90_area': 0.9})}), hb AS ({hazen_sql('SELECT * FROM boxes', 'connectivity, sign', 'aspect', {'median_aspect': 0.5, 'p95_aspect': 0.95})})", "SELECT r.connectivity, r.sign, count(*) AS n, avg(area_mm2) AS mean_area, sum(area_mm2) AS total_area, avg(aspect) AS mean_aspect, count(*) FILTER (pixel_count <= 4)/CAST(count(*) AS DOUBLE) AS small_share, sum(CASE WHEN p <= greatest(1, round(m*CAST(0.1 AS DOUBLE))) THEN area_mm2 ELSE 0 END)/sum(area_mm2) AS tail_share, count(*) FILTER (is_lsm) AS lsm, count(*) FILTER (is_vlsm) AS vlsm, max(median_area) AS median_area, max(p90_area) AS p90_area, max(median_aspect) AS median_aspect, max(p95_aspect) AS p95_aspect FROM r JOIN ha ON ha.connectivity = r.connectivity AND ha.sign = r.sign JOIN hb ON hb.connectivity = r.connectivity AND hb.sign = r.sign GROUP BY r.connectivity, r.sign", "connectivity sign n " + " ".join(c + "~" for c in GEO.split()) + " lsm vlsm median_area~ p90_area~ median_aspect~ p95_aspect~")),
    "preview_frames": (lambda s, d: rounded(C.preview_frames(boxes(s, d))), final(f"{BOXES}, f AS (SELECT frame_id, count(*) AS n, max(CASE WHEN is_lsm THEN 1 ELSE 0 END) AS l, max(CASE WHEN is_vlsm THEN 1 ELSE 0 END) AS v, max(CASE WHEN is_lsm THEN lx_over_delta END) AS ll, max(CASE WHEN is_vlsm THEN lx_over_delta END) AS vl FROM boxes GROUP BY frame_id), k AS (SELECT frame_id, CASE WHEN v = 1 THEN 'vlsm' WHEN l = 1 THEN 'lsm' ELSE 'none' END AS kind, CASE WHEN v = 1 THEN vl WHEN l = 1 THEN ll ELSE -n END AS score FROM f)", "SELECT kind, frame_id, score FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, frame_id) AS p FROM k) t WHERE p = 1", "kind frame_id score~")),
    "figure_rows": (lambda s, d: C.figure_rows(boxes(s, d), 100).select("place", "component_id"), final(BOXES, "SELECT CAST(place AS INTEGER) AS place, component_id FROM (SELECT component_id, row_number() OVER (ORDER BY frame_id, sign DESC, lx_over_delta DESC, component_id) AS place FROM boxes WHERE is_vlsm AND NOT is_censored) t WHERE place <= 100", "place component_id")),
    "match_windows": (lambda s, d: M.match_windows(boxes(s, d), BOX_COLUMNS).select("component_id", "window_min", "window_max", "matched", "reason", "candidates"), final(f"{BOXES}, o AS (SELECT * FROM boxes WHERE connectivity = 8 AND is_ss), tg AS (SELECT *, col_max-col_min+1 AS w FROM o WHERE NOT is_censored), cand AS (SELECT t.component_id, t.col_min, w, k AS st FROM tg t, range(1, 65) r(k) WHERE k <= 64-w+1 AND NOT EXISTS (SELECT 1 FROM o WHERE o.frame_id = t.frame_id AND t.row_min <= o.row_max AND t.row_max >= o.row_min AND k <= o.col_max AND k+w-1 >= o.col_min)), rk AS (SELECT *, row_number() OVER (PARTITION BY component_id ORDER BY abs(st-col_min), st) AS p, count(*) OVER (PARTITION BY component_id) AS n FROM cand)", "SELECT tg.component_id, CAST(st AS INTEGER) AS window_min, CAST(st+tg.w-1 AS INTEGER) AS window_max, st IS NOT NULL AS matched, CAST(CASE WHEN st IS NULL THEN 1 ELSE 0 END AS INTEGER) AS reason, CAST(coalesce(n, 0) AS INTEGER) AS candidates FROM tg LEFT JOIN rk ON rk.component_id = tg.component_id AND rk.p = 1", "component_id window_min window_max matched reason candidates")),
    "retain_nonoverlapping": (lambda s, d: M.retain_nonoverlapping(boxes(s, d)).select("component_id", "kept", "suppressed"), None),
    "gallery": (gallery_rows, None),
    "merge_islands": (lambda s, d: structures.merge_islands(boxes(s, d).select(F.lit(1).alias("repeat_id"), "frame_id", "sign", F.col("component_id").alias("structure_id"), "x_min_mm", "x_max_mm"), 4.0).select("structure_id", "group"), final(f"{BOXES}, r AS (SELECT *, max(x_max_mm) OVER (PARTITION BY frame_id, sign ORDER BY x_min_mm, component_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM boxes), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR x_min_mm-reach > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY frame_id, sign ORDER BY x_min_mm, component_id ROWS UNBOUNDED PRECEDING) AS gr FROM r)", 'SELECT component_id AS structure_id, first_value(component_id) OVER (PARTITION BY frame_id, sign, gr ORDER BY x_min_mm, component_id) AS "group" FROM g', 'structure_id "group"')),
    "merge_streamwise": (lambda s, d: structures.merge_streamwise(boxes(s, d).select(F.lit(1).alias("repeat_id"), "frame_id", "sign", F.col("component_id").alias("structure_id"), "x_min_mm", "x_max_mm", "y_min_mm", "y_max_mm"), 4.0).select("structure_id", "group"), None),
    "nearest_rows": (lambda s, d: rounded(rows_at(s, d)), final(f"{FLOW}, pr AS (SELECT j, avg(u_mean) AS y_plus FROM flow GROUP BY j), t AS (SELECT * FROM (VALUES (5.0),(20.0),(23.5),(99.0)) v(target))", "SELECT CAST(target AS DOUBLE) AS target, j, y_plus, target BETWEEN (SELECT min(y_plus) FROM pr) AND (SELECT max(y_plus) FROM pr) AS in_range FROM (SELECT target, j, y_plus, row_number() OVER (PARTITION BY target ORDER BY abs(y_plus-target), j) AS p FROM t, pr) x WHERE p = 1", "target~ j y_plus~ in_range")),
    "nearest_points": (lambda s, d: rounded(probes(s, d)), final(f"{GRID}, pb AS (SELECT * FROM (VALUES (1, 3.2, 2.1), (2, 9.0, 0.4), (3, 100.0, 9.0)) v(probe, px, py))", "SELECT CAST(probe AS INTEGER) AS probe, j, i, dist AS distance FROM (SELECT probe, j, i, sqrt(pow(x_mm-px, 2)+pow(y_mm-py, 2)) AS dist, row_number() OVER (PARTITION BY probe ORDER BY sqrt(pow(x_mm-px, 2)+pow(y_mm-py, 2)), i, j) AS p FROM pb, grid) t WHERE p = 1", "probe j i distance~")),
    "interpolate": (lambda s, d: rounded(interpolated(s, d)), final(f"{FLOW}, kn AS (SELECT i*2.0 AS x0, avg(u_mean) AS y0 FROM flow GROUP BY i), sp AS (SELECT x0, y0, lead(x0) OVER (ORDER BY x0) AS x1, lead(y0) OVER (ORDER BY x0) AS y1, row_number() OVER (ORDER BY x0) AS n FROM kn), pt AS (SELECT k*CAST(0.5 AS DOUBLE) AS x FROM range(70) t(k))", "SELECT x, y0+(y1-y0)*(x-x0)/(x1-x0) AS delta FROM pt LEFT JOIN sp ON x1 IS NOT NULL AND x <= x1 AND (x > x0 OR (n = 1 AND x = x0))", "x~ delta~")),
    "track_links": (lambda s, d: rounded(M.overlap_links(row_runs(s, d))), final(NODES, "SELECT repeat_id, frame_to, node_from, node_to, shared, overlap FROM links", "repeat_id frame_to node_from node_to shared overlap~")),
    "track_events": (lambda s, d: rounded(event_table(s, d)), final(NODES, "SELECT * FROM events_", "repeat_id frame_from frame_to node_from node_to event overlap~")),
    "tracks": (lambda s, d: rounded(track_table(s, d).select("track", "first_frame", "last_frame", "lifetime", "max_pixels", "mean_pixels", "max_length", "splits", "merges", "touches_view", "any_vlsm", "touches_window")), "WITH RECURSIVE " + final(f"{CHAIN}, sp AS (SELECT DISTINCT node_from AS node FROM events_ WHERE event = 'split'), mg AS (SELECT DISTINCT node_to AS node FROM events_ WHERE event = 'merge')", "SELECT track, min(frame_id) AS first_frame, max(frame_id) AS last_frame, count(DISTINCT frame_id) AS lifetime, max(pixel_count) AS max_pixels, avg(pixel_count) AS mean_pixels, max(lx_over_delta) AS max_length, count(sp.node) AS splits, count(mg.node) AS merges, bool_or(col_min <= 1 OR col_max >= 64) AS touches_view, bool_or(is_vlsm) AS any_vlsm, min(frame_id) = max(f0) OR max(frame_id) = max(f1) AS touches_window FROM chain c JOIN nodes n ON n.node = c.node JOIN ends e ON e.repeat_id = n.repeat_id LEFT JOIN sp ON sp.node = n.node LEFT JOIN mg ON mg.node = n.node GROUP BY track", "track first_frame last_frame lifetime max_pixels mean_pixels~ max_length~ splits merges touches_view any_vlsm touches_window")[5:]),
    "track_summary": (lambda s, d: rounded(summary_stats(s, d).select("tracks", "mean_lifetime", "median_lifetime", "max_lifetime")), "WITH RECURSIVE " + final(CHAIN, "SELECT count(*) AS tracks, avg(n) AS mean_lifetime, median(n) AS median_lifetime, max(n) AS max_lifetime FROM (SELECT track, count(*) AS n FROM chain GROUP BY track) t", "tracks mean_lifetime~ median_lifetime~ max_lifetime")[5:]),
    "parents": (lambda s, d: parent_table(s, d), final(f"{NODES}, ov AS (SELECT a.node, b.node AS parent, greatest(0, least(a.col_max,b.col_max)-greatest(a.col_min,b.col_min)+1)*greatest(0, least(a.row_max,b.row_max)-greatest(a.row_min,b.row_min)+1) AS shared FROM nodes a JOIN nodes b ON a.frame_id = b.frame_id AND a.pixel_count <= 30 AND b.pixel_count > 30), bp AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY shared DESC, parent) AS p FROM ov WHERE shared > 0)", "SELECT n.node, parent, CAST(coalesce(shared, 0) AS BIGINT) AS shared, CASE WHEN parent IS NULL THEN 'unattached' ELSE 'attached' END AS status FROM nodes n LEFT JOIN bp ON bp.node = n.node AND p = 1 WHERE n.pixel_count <= 30", "node parent shared status")),
    "structure_geometry": (lambda s, d: rounded(geometry_table(s, d)), final(f"{NODES}, px AS (SELECT node, i*2.0 AS x, j*1.5 AS y, 10.0+i AS dl, i-j-10.0 AS u, CASE WHEN node % 2 = 0 THEN 1 ELSE -1 END AS sg FROM nodes, range(1, 65) a(i), range(1, 20) b(j) WHERE i BETWEEN col_min AND col_max AND j BETWEEN row_min AND row_max), g AS (SELECT node, count(*) AS pixel_count, avg(x) AS centroid_x_mm, avg(y) AS centroid_y_mm, max(x)-min(x)+2 AS length_mm, max(y)-min(y)+1.5 AS height_mm, median(dl) AS delta_mm, avg(u) AS u_mean, max(abs(u)) AS peak, sum(greatest(sg*u, 0)) AS w, sum(greatest(sg*u, 0)*x) AS wx, sum(greatest(sg*u, 0)*y) AS wy FROM px GROUP BY node)", "SELECT node, pixel_count, centroid_x_mm, centroid_y_mm, length_mm, height_mm, delta_mm, u_mean, peak, CASE WHEN w > 0 THEN wx/w END AS weighted_x_mm, CASE WHEN w > 0 THEN wy/w END AS weighted_y_mm, pixel_count*3.0 AS area_mm2, length_mm/delta_mm AS lx_over_delta, height_mm/delta_mm AS ly_over_delta FROM g", "node pixel_count centroid_x_mm~ centroid_y_mm~ length_mm~ height_mm~ delta_mm~ u_mean~ peak~ weighted_x_mm~ weighted_y_mm~ area_mm2~ lx_over_delta~ ly_over_delta~")),
    "pair_metrics": (lambda s, d: rounded(pair_table(s, d)), final(PAIRS, f"SELECT *, CASE WHEN eligible THEN {PAIR_SCORE} ELSE 0 END AS score FROM pm", "frame_id found_id seen_id sign_match x_iou~ box_iou~ length_error~ x_error~ y_error~ eligible position_match score~")),
    "assign_pairs": (lambda s, d: rounded(chosen_pairs(s, d).select("frame_id", "found_id", "seen_id", "score")), None),
    "score_frames": (lambda s, d: rounded(scored(s, d)), None),
    "greedy_iou": (lambda s, d: M.greedy_iou(found_seen(s, d)[1], found_seen(s, d)[0], 0.3), None),
    "f_scores": (lambda s, d: rounded(M.f_scores(M.greedy_iou(found_seen(s, d)[1], found_seen(s, d)[0], 0.3))), None),
    "annotation_recall": (lambda s, d: rounded(M.annotation_recall(found_seen(s, d)[0], found_seen(s, d)[1], 0.5)), final(f"{PAIRS}, ov AS (SELECT b.frame_id, b.sign, b.box_id, CASE WHEN least(a.x1,b.x1)-greatest(a.x0,b.x0) > 0 THEN (least(a.x1,b.x1)-greatest(a.x0,b.x0))/(b.x1-b.x0) END AS sh, (a.x1-a.x0)/(b.x1-b.x0) AS r, a.box_id AS fid FROM bx b LEFT JOIN bx a ON a.connectivity = 8 AND a.frame_id = b.frame_id AND a.sign = b.sign WHERE b.connectivity = 4 AND b.x1 > b.x0), bs AS (SELECT *, row_number() OVER (PARTITION BY box_id ORDER BY coalesce(sh, -1) DESC, fid) AS p FROM ov)", "SELECT frame_id, sign, box_id, coalesce(sh, 0) AS share, coalesce(sh, 0) >= 0.5 AS hit, CASE WHEN coalesce(sh, 0) >= 0.5 THEN r END AS length_ratio FROM bs WHERE p = 1", "frame_id sign box_id share~ hit length_ratio~")),
    "pareto_front": (lambda s, d: rounded(M.pareto(params(s, d), "recall", "fp")), final("pm AS (SELECT p_brand, p_size, round(avg(p_retailprice), 2) AS recall, CAST(count(*) AS DOUBLE) AS fp FROM part GROUP BY p_brand, p_size)", "SELECT * FROM pm a WHERE NOT EXISTS (SELECT 1 FROM pm b WHERE b.recall >= a.recall AND b.fp <= a.fp AND (b.recall > a.recall OR b.fp < a.fp))", "p_brand p_size recall~ fp~")),
    "same_rows": (compare_tables, final(f"{BOXES}, l AS (SELECT frame_id, pixel_count FROM boxes WHERE pixel_count > 20), r AS (SELECT frame_id, pixel_count FROM boxes WHERE pixel_count < 40)", "SELECT (SELECT count(*) FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) x) AS only_left, (SELECT count(*) FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l) y) AS only_right", "only_left only_right")),
    "contiguous_runs": (runs, final(f"{BOXES}, n AS (SELECT frame_id FROM boxes WHERE {COMPLETE} GROUP BY frame_id HAVING count(*) > 4), g AS (SELECT frame_id, frame_id-row_number() OVER (ORDER BY frame_id) AS g FROM n)", "SELECT min(frame_id) AS first, max(frame_id) AS last, count(*) AS length FROM g GROUP BY g", "first last length")),
    "set_operations": (set_operations, final(f"{BOXES}, a AS (SELECT frame_id FROM boxes WHERE connectivity = 8 AND lx_over_delta > 4.5), b AS (SELECT frame_id FROM boxes WHERE connectivity = 4 AND lx_over_delta > 4.5)", " UNION ALL ".join(f"SELECT count(*) AS n, CAST(sum(frame_id) AS BIGINT) AS total, '{k}' AS part FROM ({q}) t" for k, q in PIECES.items()), "n total part")),
    "energy_modes": (lambda s, d: rounded(modal.energy_modes(eigenvalues(s, d), s.createDataFrame([(0.5,), (0.8,), (0.99,)], "target double"))), final("ev AS (SELECT p_size % 30 + 1 AS mode, sum(p_retailprice) AS e FROM part GROUP BY p_size % 30), cm AS (SELECT mode, sum(e) OVER (ORDER BY mode)/sum(e) OVER () AS c FROM ev)", "SELECT CAST(t AS DOUBLE) AS target, CAST(min(mode) AS INTEGER) AS modes, min(c) AS achieved FROM cm, (VALUES (0.5),(0.8),(0.99)) v(t) WHERE c >= t GROUP BY t", "target~ modes achieved~")),
    "bootstrap_median": (lambda s, d: rounded(bootstrap_rows(s, d)), None),
}
