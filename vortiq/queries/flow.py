"""Queries on means, stresses, phases, transport, quadrants, domains and gradients."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.phase import assign_phase
from ..operators import correlation, domain, gradients, phase, quadrants, statistics, transport
from ..plans.views import BINNED, EVENTS, GRID, PIV, SMP, event_samples, final, grid, piv, rounded, table

FS, F0, BINS, FEW, SHARE = 16.0, 2.0, 8, 28, 0.909
HOLES = [0.0, 1.0, 2.0]

MEANS = "rm AS (SELECT repeat_id, j, i, avg(u) AS mu, avg(v) AS mv FROM piv GROUP BY repeat_id, j, i)"
STATS = f"""{BINNED}, {MEANS},
sums AS (SELECT s.j, s.i, count(*) AS n, count(u) AS valid_count, avg(u) AS um, avg(v) AS vm, avg((u-mu)*(u-mu)) AS uu0, avg((v-mv)*(v-mv)) AS vv0, -avg((u-mu)*(v-mv)) AS uv0 FROM smp s JOIN rm ON s.repeat_id = rm.repeat_id AND s.j = rm.j AND s.i = rm.i GROUP BY s.j, s.i),
st AS (SELECT j, i, valid_count, valid_count/CAST(n AS DOUBLE) AS valid_fraction, valid_count >= 2 AND valid_count/CAST(n AS DOUBLE) >= {SHARE} AS accepted, um, vm, uu0, vv0, uv0 FROM sums),
stats AS (SELECT j, i, valid_count, valid_fraction, accepted, CASE WHEN accepted THEN um END AS u_mean, CASE WHEN accepted THEN vm END AS v_mean, CASE WHEN accepted THEN uu0 END AS uu, CASE WHEN accepted THEN vv0 END AS vv, CASE WHEN accepted THEN uv0 END AS uv FROM st)"""
POOLED = f"pooled AS (SELECT bin, j, i, count(u) AS count, CASE WHEN count(u) >= {FEW} THEN avg(u) END AS u_phase, CASE WHEN count(u) >= {FEW} THEN avg(v) END AS v_phase FROM binned GROUP BY bin, j, i)"
BY_REPEAT = f"prep AS (SELECT repeat_id, bin, j, i, CASE WHEN count(u) >= {FEW} THEN avg(u) END AS pu, CASE WHEN count(u) >= {FEW} THEN avg(v) END AS pv FROM binned GROUP BY repeat_id, bin, j, i)"
RANDOM = f"{BY_REPEAT}, rnd AS (SELECT b.*, u-pu AS du, v-pv AS dv FROM binned b JOIN prep p ON b.repeat_id = p.repeat_id AND b.bin = p.bin AND b.j = p.j AND b.i = p.i)"
CELLS = f"""cell AS (SELECT repeat_id, bin, j, i, count(u) AS n, sum(u) AS su, sum(v) AS sv FROM binned GROUP BY repeat_id, bin, j, i HAVING count(u) >= {FEW}),
tm AS (SELECT repeat_id, j, i, sum(su)/sum(n) AS tu, sum(sv)/sum(n) AS tv FROM cell GROUP BY repeat_id, j, i),
adm AS (SELECT c.*, su/n AS pu, sv/n AS pv, tu, tv FROM cell c JOIN tm ON c.repeat_id = tm.repeat_id AND c.j = tm.j AND c.i = tm.i),
own AS (SELECT b.repeat_id, b.bin, b.j, b.i, u-tu AS a, v-tv AS b_, u-pu AS c, v-pv AS d, pu-tu AS e, pv-tv AS f, u, v FROM binned b JOIN adm ON b.repeat_id = adm.repeat_id AND b.bin = adm.bin AND b.j = adm.j AND b.i = adm.i WHERE u IS NOT NULL)"""
TRANSPORT = f"""{BINNED}, {CELLS},
nf AS (SELECT count(DISTINCT frame_id) AS nf FROM piv),
tr AS (SELECT j, i, count(*) AS count, count(*) >= 2 AND count(*)/CAST(max(nf) AS DOUBLE) >= {SHARE - 0.2} AS ok, avg(u) AS u_mean, avg(v) AS v_mean, avg(a*a) AS total_uu, avg(b_*b_) AS total_vv, -avg(a*b_) AS total_uv, avg(e*e) AS coherent_uu, avg(f*f) AS coherent_vv, -avg(e*f) AS coherent_uv, avg(c*c) AS random_uu, avg(d*d) AS random_vv, -avg(c*d) AS random_uv FROM own, nf GROUP BY j, i)"""
NINE = [f"{a}_{b}" for a in ("total", "coherent", "random") for b in ("uu", "vv", "uv")]


def phased(spark, d):
    return assign_phase(piv(spark, d), FS, F0, BINS)


def stats(spark, d):
    return statistics.mean_stats(piv(spark, d), statistics.repeat_means(piv(spark, d)), SHARE)


def frames_of(spark, d):
    return table(spark, d, "embeddings").where(F.size("embedding") == 64).count()


def cells(spark, d):
    return transport.transport_cells(phased(spark, d), FEW)


def transported(spark, d):
    return transport.transport_stats(cells(spark, d), frames_of(spark, d), SHARE - 0.2)


def gradient(spark, d):
    return gradients.d_dy(stats(spark, d).join(grid(spark), ["j", "i"]), "u_mean")


def random_quadrants(spark, d):
    both = phase.random_branch(phased(spark, d), phase.phase_means(phased(spark, d), ["repeat_id", "bin"], FEW))
    scale = both.groupBy("bin", "j", "i").agg(F.sqrt(F.avg(F.col("du") * F.col("du"))).alias("u_rms"), F.sqrt(F.avg(F.col("dv") * F.col("dv"))).alias("v_rms"))
    return quadrants.quadrant_cells(both, scale, HOLES, ["bin"])


def total_quadrants(spark, d):
    return quadrants.quadrant_cells(statistics.total_branch(piv(spark, d), statistics.repeat_means(piv(spark, d))), stats(spark, d), HOLES)


def quadrant_sql(rows: str, keys: str, scale: str, digits: str) -> str:
    listed = f"SELECT {keys}, h AS hole, q AS quadrant, count(*) AS n, count(CASE WHEN q = own AND abs(du*dv) > h*scale THEN 1 END) AS events, sum(CASE WHEN q = own AND abs(du*dv) > h*scale THEN -du*dv ELSE 0 END) AS es, sum(-du*dv) AS s, sum(du*du) AS u2, sum(dv*dv) AS v2 FROM (SELECT *, CASE WHEN du > 0 AND dv > 0 THEN 1 WHEN du < 0 AND dv > 0 THEN 2 WHEN du < 0 AND dv < 0 THEN 3 WHEN du > 0 AND dv < 0 THEN 4 END AS own FROM ({rows}) r0) r, (VALUES (0.0),(1.0),(2.0)) hh(h), (VALUES (1),(2),(3),(4)) qq(q) GROUP BY {keys}, h, q"
    return f"SELECT {digits}, CAST(hole AS DOUBLE) AS hole, CAST(quadrant AS INTEGER) AS quadrant, n, events, events/CAST(n AS DOUBLE) AS probability, es/nullif(events, 0) AS conditional_mean, es/n AS contribution, CASE WHEN abs(s/n) > greatest(2.220446049250313e-16, 1e-6*sqrt(u2/n)*sqrt(v2/n)) THEN (es/n)/(s/n) END AS stress_share FROM ({listed}) l"


TOTAL_ROWS = "SELECT s.j, s.i, u-mu AS du, v-mv AS dv, sqrt(uu)*sqrt(vv) AS scale FROM smp s JOIN rm ON s.repeat_id = rm.repeat_id AND s.j = rm.j AND s.i = rm.i JOIN stats t ON s.j = t.j AND s.i = t.i WHERE u IS NOT NULL AND t.uu IS NOT NULL"
RANDOM_ROWS = "SELECT r.bin, r.j, r.i, du, dv, scale FROM rnd r JOIN (SELECT bin, j, i, sqrt(avg(du*du))*sqrt(avg(dv*dv)) AS scale FROM rnd GROUP BY bin, j, i) z ON r.bin = z.bin AND r.j = z.j AND r.i = z.i WHERE du IS NOT NULL AND scale IS NOT NULL"
QUAD = "j i hole quadrant n events probability~ conditional_mean~ contribution~ stress_share~"


def pooled_cycle(spark, d):
    made = random_quadrants(spark, d)
    return quadrants.quadrant_stats(made)


def closure_of(spark, d):
    own = statistics.mean_stats(piv(spark, d))
    return statistics.closure(own, stats(spark, d), ["j", "i"], "uu")


def dual_grid(spark, d):
    """Places that the first repeat saw against those that the second saw often enough, one of which is off."""
    seen = lambda k, least: piv(spark, d).where(F.col("repeat_id") == k).groupBy("j", "i").agg(F.avg(F.col("valid").cast("int")).alias("f")).where(F.col("f") >= least).select("j", "i")
    other = grid(spark).join(seen(2, 0.909), ["j", "i"]).withColumn("x_mm", F.col("x_mm") + F.when((F.col("i") == 2) & (F.col("j") == 1), 1e-6).otherwise(0.0))
    return domain.grid_differences(grid(spark).join(seen(1, 0.0), ["j", "i"]), other)


def mask(spark, d):
    return piv(spark, d).select("frame_id", "j", "i", F.col("valid").alias("ok"))


REGION = (2.0, 6.0, 0.5, 2.0)


def outside_region(spark, d):
    """Samples and means by frame of what lies outside a rectangle, and of the cells that contaminate neither view."""
    left = domain.without(statistics.paired(piv(spark, d)).join(grid(spark), ["j", "i"]), REGION)
    bad = lambda every: domain.contaminated(F.col("x_mm"), F.col("y_mm"), (4.0, 10.0, 1.0, 4.5), every)
    return left.groupBy("frame_id").agg(F.count(F.lit(1)).alias("points"), F.count("u").alias("n"), F.avg("u").alias("u_mean"), F.avg(F.when(~bad(False), F.col("u"))).alias("u_shown"), F.avg(F.when(~bad(True), F.col("u"))).alias("u_drag"))


def by_wall_distance(spark, d):
    return stats(spark, d).groupBy(domain.wall_distance(F.col("j"), 0.5, 1.3).alias("y")).agg(F.avg("u_mean").alias("u_mean"), F.sum("valid_count").alias("n"))


def zero_rows(spark, d):
    """Samples whose first rows are zero for a part of the frames."""
    dead = F.col("j") <= 1 + F.col("frame_id") % 2
    return piv(spark, d).withColumns({c: F.when(dead, 0.0).otherwise(F.col(c)) for c in ("u", "v")})


def frame_list(spark, d):
    n = frames_of(spark, d)
    return spark.range(1).select(F.explode(domain.spread_frames(1, n, 7)).alias("frame_id"))


def events_phase(spark, d):
    own = assign_phase(event_samples(spark, d).drop("j").withColumn("j", F.lit(1)), 24.0, 5.0, 6, 30.0)
    return own.groupBy("event_type", "bin").agg(F.count(F.lit(1)).alias("n"), F.max("cycle").alias("cycles"), F.avg("u").alias("u_mean"), F.sum("mechanical_deg").alias("angles"))


def grouping(spark, d):
    """Counts and means by repeat and bin, by bin, and overall, in one pass."""
    own = statistics.paired(phased(spark, d))
    return own.groupingSets([["repeat_id", "bin"], ["bin"], []], "repeat_id", "bin").agg(F.count("u").alias("n"), F.avg("u").alias("u_mean")).select("repeat_id", "bin", "n", "u_mean")


EVENT_PHASE = "ph AS (SELECT *, ((frame_id-1)*75.0) % 360 AS phi FROM ev), nb AS (SELECT event_id, event_type, u, frame_id, phi, b, row_number() OVER (PARTITION BY event_id ORDER BY abs((phi - b*60.0 + 540) % 360 - 180), b) AS p FROM ph, range(6) t(b))"
CENTRAL = "(CASE WHEN lead(u_mean) OVER w IS NULL AND lead(y_mm) OVER w IS NULL THEN u_mean ELSE lead(u_mean) OVER w END - CASE WHEN lag(y_mm) OVER w IS NULL THEN u_mean ELSE lag(u_mean) OVER w END) * 1000.0 / (coalesce(lead(y_mm) OVER w, y_mm) - coalesce(lag(y_mm) OVER w, y_mm))"
GRADIENT = f"{STATS}, {GRID}, gr AS (SELECT s.j, s.i, {CENTRAL} AS gradient FROM stats s JOIN grid g ON s.j = g.j AND s.i = g.i WINDOW w AS (PARTITION BY s.i ORDER BY s.j))"


def planar(spark, d):
    own = statistics.paired(piv(spark, d)).join(grid(spark), ["j", "i"])
    return gradients.planar_criteria(own.select("frame_id", "j", "i", "x_mm", "y_mm", "u", "v"))


def difference(c, place, part, row):
    w = f"(PARTITION BY frame_id, {part} ORDER BY {row})"
    return f"(CASE WHEN lead({place}) OVER {w} IS NULL THEN {c} ELSE lead({c}) OVER {w} END - CASE WHEN lag({place}) OVER {w} IS NULL THEN {c} ELSE lag({c}) OVER {w} END)*1000.0/(coalesce(lead({place}) OVER {w}, {place}) - coalesce(lag({place}) OVER {w}, {place}))"


PLANAR = f"{SMP}, {GRID}, d1 AS (SELECT frame_id, s.j, s.i, u, v, x_mm, y_mm FROM smp s JOIN grid g ON s.j = g.j AND s.i = g.i), d2 AS (SELECT frame_id, j, i, {difference('u', 'x_mm', 'j', 'i')} AS ux, {difference('u', 'y_mm', 'i', 'j')} AS uy, {difference('v', 'x_mm', 'j', 'i')} AS vx, {difference('v', 'y_mm', 'i', 'j')} AS vy FROM d1)"
PLANAR_BODY = "SELECT frame_id, j, i, vx-uy AS vorticity, -0.5*(ux*ux+vy*vy+2*uy*vx) AS q, 0.5*(m1+m2)-sqrt(greatest(0.25*(m1-m2)*(m1-m2)+m3*m3, 0)) AS lambda2, CASE WHEN ux*vy-uy*vx-0.25*(ux+vy)*(ux+vy) > 0 THEN sqrt(ux*vy-uy*vx-0.25*(ux+vy)*(ux+vy)) WHEN ux*vy-uy*vx-0.25*(ux+vy)*(ux+vy) IS NOT NULL THEN 0 END AS lambda_ci FROM (SELECT *, ux*ux+uy*vx AS m1, vy*vy+uy*vx AS m2, 0.5*(uy+vx)*(ux+vy) AS m3 FROM d2) m"
COH = f"{STATS}, {POOLED}, coh AS (SELECT p.bin, p.j, p.i, u_phase-u_mean AS uc, v_phase-v_mean AS vc FROM pooled p JOIN stats s ON p.j = s.j AND p.i = s.i)"

QUERIES = {
    "mean_stats": (lambda s, d: rounded(stats(s, d)), final(STATS, "SELECT *, sqrt(uu) AS u_rms, sqrt(vv) AS v_rms, (uu+vv)*(0.5/625.0) AS tke FROM stats", "j i valid_count accepted u_mean~ v_mean~ uu~ vv~ uv~ valid_fraction~ u_rms~ v_rms~ tke~")),
    "mean_stats_pooled": (lambda s, d: rounded(statistics.mean_stats(piv(s, d)).select("j", "i", "valid_count", "u_mean", "v_mean", "uu", "vv", "uv")), final(SMP, "SELECT j, i, count(u) AS valid_count, avg(u) AS u_mean, avg(v) AS v_mean, var_pop(u) AS uu, var_pop(v) AS vv, -covar_pop(u, v) AS uv FROM smp GROUP BY j, i", "j i valid_count u_mean~ v_mean~ uu~ vv~ uv~")),
    "repeat_means": (lambda s, d: rounded(statistics.repeat_means(piv(s, d))), final(f"{PIV}, {MEANS}", "SELECT repeat_id, j, i, mu AS mean_u, mv AS mean_v FROM rm", "repeat_id j i mean_u~ mean_v~")),
    "branch_raw": (lambda s, d: rounded(statistics.paired(piv(s, d)).select("repeat_id", "frame_id", "j", "i", "u", "v")), final(SMP, "SELECT * FROM smp", "repeat_id frame_id j i u~ v~")),
    "branch_total": (lambda s, d: rounded(statistics.total_branch(piv(s, d), statistics.repeat_means(piv(s, d))).select("frame_id", "j", "i", "du", "dv")), final(f"{SMP}, {MEANS}", "SELECT frame_id, s.j, s.i, u-mu AS du, v-mv AS dv FROM smp s JOIN rm ON s.repeat_id = rm.repeat_id AND s.j = rm.j AND s.i = rm.i", "frame_id j i du~ dv~")),
    "branch_random": (lambda s, d: rounded(phase.random_branch(phased(s, d), phase.phase_means(phased(s, d), ["repeat_id", "bin"], FEW)).select("frame_id", "j", "i", "du", "dv")), final(f"{BINNED}, {RANDOM}", "SELECT frame_id, j, i, du, dv FROM rnd", "frame_id j i du~ dv~")),
    "assign_phase": (lambda s, d: rounded(assign_phase(piv(s, d).select("frame_id").distinct(), FS, F0, BINS).select("frame_id", "phase_deg", "bin", "cycle")), final(BINNED, "SELECT DISTINCT b.frame_id, phi AS phase_deg, bin, cycle FROM binned b JOIN frames f ON b.frame_id = f.frame_id", "frame_id phase_deg~ bin cycle")),
    "phase_of_events": (lambda s, d: rounded(events_phase(s, d), 4), final(f"{EVENTS}, {EVENT_PHASE}", "SELECT event_type, CAST(b+1 AS INTEGER) AS bin, count(*) AS n, CAST(max(floor((frame_id-1)/(24.0/5.0))+1) AS BIGINT) AS cycles, avg(u) AS u_mean, sum((phi+30) % 360) AS angles FROM nb WHERE p = 1 GROUP BY event_type, b", "event_type bin n cycles u_mean~ angles~", 4)),
    "phase_means": (lambda s, d: rounded(phase.phase_means(phased(s, d), ["bin"], FEW)), final(f"{BINNED}, {POOLED}", "SELECT * FROM pooled", "bin j i count u_phase~ v_phase~")),
    "phase_means_by_repeat": (lambda s, d: rounded(phase.phase_means(phased(s, d), ["repeat_id", "bin"], FEW).drop("count")), final(f"{BINNED}, {BY_REPEAT}", "SELECT repeat_id, bin, j, i, pu AS u_phase, pv AS v_phase FROM prep", "repeat_id bin j i u_phase~ v_phase~")),
    "phase_coherent": (lambda s, d: rounded(phase.coherent(phase.phase_means(phased(s, d), ["bin"], FEW), stats(s, d)).select("bin", "j", "i", "u_coherent", "v_coherent")), final(COH, "SELECT bin, j, i, uc AS u_coherent, vc AS v_coherent FROM coh", "bin j i u_coherent~ v_coherent~")),
    "phase_random_bins": (lambda s, d: rounded(phase.random_moments(phased(s, d), FEW)[0]), final(f"{BINNED}, {POOLED}, {RANDOM}", "SELECT p.bin, p.j, p.i, p.count, CASE WHEN p.count >= 28 THEN coalesce(x, 0)/nullif(p.count, 0) END AS uu, CASE WHEN p.count >= 28 THEN coalesce(y, 0)/nullif(p.count, 0) END AS vv, CASE WHEN p.count >= 28 THEN coalesce(z, 0)/nullif(p.count, 0) END AS uv FROM pooled p JOIN (SELECT bin, j, i, sum(du*du) AS x, sum(dv*dv) AS y, -sum(du*dv) AS z FROM rnd GROUP BY bin, j, i) r ON p.bin = r.bin AND p.j = r.j AND p.i = r.i", "bin j i count uu~ vv~ uv~")),
    "phase_random_global": (lambda s, d: rounded(phase.random_moments(phased(s, d), FEW)[1]), final(f"{BINNED}, {RANDOM}", "SELECT j, i, count(du) AS count, avg(du*du) AS uu, avg(dv*dv) AS vv, -avg(du*dv) AS uv FROM rnd GROUP BY j, i", "j i count uu~ vv~ uv~")),
    "phase_triple_residual": (lambda s, d: rounded(phase.triple_residual(phased(s, d), stats(s, d), FEW)), final(f"{STATS}, {RANDOM}", "SELECT count(du) AS n, greatest(max(abs((u-u_mean)-((pu-u_mean)+du))), max(abs((v-v_mean)-((pv-v_mean)+dv)))) AS max_residual FROM rnd r JOIN prep p ON r.repeat_id = p.repeat_id AND r.bin = p.bin AND r.j = p.j AND r.i = p.i JOIN stats s ON r.j = s.j AND r.i = s.i", "n max_residual~")),
    "phase_coverage": (lambda s, d: phase.coverage(phased(s, d), FEW * 2), final(BINNED, "SELECT bin, CAST(sum(n) AS BIGINT) AS total, min(n) AS fewest, max(n) AS most, bool_and(n >= 56) AS accepted_everywhere, max(c) AS cycles FROM (SELECT bin, j, i, count(u) AS n, max(cycle) AS c FROM binned GROUP BY bin, j, i) t GROUP BY bin", "bin total fewest most accepted_everywhere cycles")),
    "phase_harmonics": (lambda s, d: rounded(phase.harmonics(phase.phase_means(phased(s, d), ["bin"], 2), "u_phase", BINS, 3, 30.0)), final(f"{BINNED}, pm AS (SELECT bin, j, i, avg(u) AS x FROM binned GROUP BY bin, j, i), c AS (SELECT j, i, h AS harmonic, sum(x*cos(2*pi()*h*(bin-1)/8))/8 AS re, -sum(x*sin(2*pi()*h*(bin-1)/8))/8 AS im FROM pm, (VALUES (1),(2),(3)) t(h) GROUP BY j, i, h)", "SELECT j, i, CAST(harmonic AS INTEGER) AS harmonic, 2*sqrt(re*re+im*im) AS amplitude, degrees(atan2(im, re)) AS phase_deg, ((degrees(atan2(im, re)) - harmonic*30 + 180 + 720) % 360) - 180 AS mechanical_deg FROM c", "j i harmonic amplitude~ phase_deg~ mechanical_deg~")),
    "grouping_sets": (lambda s, d: rounded(grouping(s, d)), final(BINNED, "SELECT repeat_id, bin, count(u) AS n, avg(u) AS u_mean FROM binned GROUP BY GROUPING SETS ((repeat_id, bin), (bin), ())", "repeat_id bin n u_mean~")),
    "transport_stats": (lambda s, d: rounded(transported(s, d)), final(TRANSPORT, f"SELECT j, i, count, ok AS accepted, {', '.join(f'CASE WHEN ok THEN {c} END AS {c}' for c in ['u_mean', 'v_mean', *NINE])} FROM tr", f"j i count accepted u_mean~ v_mean~ {' '.join(c + '~' for c in NINE)}")),
    "transport_phases": (lambda s, d: rounded(transport.transport_phases(cells(s, d), transported(s, d))), final(TRANSPORT, f"SELECT o.bin, o.j, o.i, count(*) AS n, avg(o.u) AS u_phase, avg(o.v) AS v_phase, avg(a*a) AS total_uu, avg(b_*b_) AS total_vv, -avg(a*b_) AS total_uv, avg(e*e) AS coherent_uu, avg(f*f) AS coherent_vv, -avg(e*f) AS coherent_uv, avg(c*c) AS random_uu, avg(d*d) AS random_vv, -avg(c*d) AS random_uv FROM own o JOIN tr ON o.j = tr.j AND o.i = tr.i WHERE tr.ok GROUP BY o.bin, o.j, o.i", f"bin j i n u_phase~ v_phase~ {' '.join(c + '~' for c in NINE)}")),
    "transport_identity": (lambda s, d: rounded(transport.identity(transported(s, d))), final(TRANSPORT, " UNION ALL ".join(f"SELECT '{c}' AS stress, count(*) AS n, max(abs(total_{c}-coherent_{c}-random_{c})) AS max_abs, sqrt(avg(pow(total_{c}-coherent_{c}-random_{c}, 2)))/sqrt(avg(total_{c}*total_{c})) AS rel_rms FROM tr WHERE ok" for c in ("uu", "vv", "uv")), "stress n max_abs~ rel_rms~")),
    "transport_production": (lambda s, d: rounded(transport.production(transported(s, d), gradient(s, d))), final(f"{GRADIENT}, {TRANSPORT.split(BINNED + ', ')[1]}", "SELECT tr.j, tr.i, CASE WHEN ok THEN total_uv END * gradient AS production FROM tr JOIN gr ON tr.j = gr.j AND tr.i = gr.i", "j i production~")),
    "quadrants_total": (lambda s, d: rounded(quadrants.quadrant_stats(total_quadrants(s, d))), final(STATS, quadrant_sql(TOTAL_ROWS, "j, i", "", "j, i"), QUAD)),
    "quadrants_random": (lambda s, d: rounded(quadrants.quadrant_stats(random_quadrants(s, d), ["bin"])), final(f"{BINNED}, {RANDOM}", quadrant_sql(RANDOM_ROWS, "bin, j, i", "", "bin, j, i"), "bin " + QUAD)),
    "quadrants_cycle": (lambda s, d: rounded(pooled_cycle(s, d)), final(f"{BINNED}, {RANDOM}", quadrant_sql(RANDOM_ROWS, "j, i", "", "j, i"), QUAD)),
    "quadrant_closure": (lambda s, d: rounded(quadrants.quadrant_closure(total_quadrants(s, d))), final(f"{STATS}, q AS ({quadrant_sql(TOTAL_ROWS, 'j, i', '', 'j, i')})", "SELECT count(*) AS points, max(abs(c - s)) AS max_abs FROM (SELECT j, i, sum(contribution) AS c FROM q WHERE hole = 0 GROUP BY j, i) a JOIN (SELECT j, i, avg(-du*dv) AS s FROM (" + TOTAL_ROWS + ") r GROUP BY j, i) b ON a.j = b.j AND a.i = b.i", "points max_abs~")),
    "pooled_rms": (lambda s, d: rounded(statistics.pooled_rms(piv(s, d))), final(SMP, "SELECT s.j, count(u) AS count, sqrt(avg((u-m)*(u-m))) AS u_rms FROM smp s JOIN (SELECT j, i, avg(u) AS m FROM smp GROUP BY j, i) a ON s.j = a.j AND s.i = a.i GROUP BY s.j", "j count u_rms~")),
    "stress_closure": (lambda s, d: rounded(closure_of(s, d)), final(f"{STATS}, alone AS (SELECT j, i, var_pop(u) AS a FROM smp GROUP BY j, i)", "SELECT count(*) AS n, max(abs(a-uu)) AS max_abs, sqrt(avg((a-uu)*(a-uu)))/sqrt(avg(a*a)) AS rel_rms FROM alone JOIN stats s ON alone.j = s.j AND alone.i = s.i WHERE uu IS NOT NULL", "n max_abs~ rel_rms~")),
    "range_average": (lambda s, d: rounded(statistics.range_average(stats(s, d), ["u_mean", "uu"], 2, 6)), final(STATS, "SELECT j, avg(u_mean) AS u_mean, avg(uu) AS uu, count(u_mean) AS n_u_mean, count(uu) AS n_uu FROM stats WHERE i BETWEEN 2 AND 6 GROUP BY j", "j u_mean~ uu~ n_u_mean n_uu")),
    "column_metrics": (lambda s, d: rounded(statistics.column_metrics(stats(s, d), "uu")), final(STATS, "SELECT i, max(uu) AS peak, avg(uu) AS mean, count(uu) AS n FROM stats GROUP BY i", "i peak~ mean~ n")),
    "decomposition_profiles": (lambda s, d: rounded(phase.decomposition_profiles(stats(s, d), phase.phase_means(phased(s, d), ["bin"], FEW), phase.random_moments(phased(s, d), FEW)[1], 2, 7)), final(f"{COH}, {RANDOM}, w AS (SELECT j, i, avg(uc*uc) AS a, avg(vc*vc) AS b, -avg(uc*vc) AS c FROM coh GROUP BY j, i), g AS (SELECT j, i, avg(du*du) AS a, avg(dv*dv) AS b, -avg(du*dv) AS c FROM rnd GROUP BY j, i)", "SELECT s.j, avg(uu) AS total_uu, avg(vv) AS total_vv, avg(uv) AS total_uv, avg(w.a) AS coherent_uu, avg(w.b) AS coherent_vv, avg(w.c) AS coherent_uv, avg(g.a) AS random_uu, avg(g.b) AS random_vv, avg(g.c) AS random_uv FROM stats s JOIN w ON s.j = w.j AND s.i = w.i JOIN g ON s.j = g.j AND s.i = g.i WHERE s.i BETWEEN 2 AND 7 GROUP BY s.j", f"j {' '.join(c + '~' for c in NINE)}")),
    "frame_window": (lambda s, d: domain.frame_window(piv(s, d), "second_half", frames_of(s, d)).groupBy("repeat_id").agg(F.min("frame_id").alias("first"), F.max("frame_id").alias("last"), F.count(F.lit(1)).alias("n")), final(f"{PIV}, n AS (SELECT count(*) AS n FROM embeddings)", "SELECT repeat_id, min(frame_id) AS first, max(frame_id) AS last, count(*) AS n FROM (SELECT piv.* FROM piv, n WHERE frame_id > n.n//2) f GROUP BY repeat_id", "repeat_id first last n")),
    "frame_to_repeat": (lambda s, d: piv(s, d).select("frame_id").distinct().select("frame_id", domain.frame_to_repeat(F.col("frame_id"), [100, 250]).alias("part")), final(PIV, "SELECT DISTINCT frame_id, CAST(CASE WHEN frame_id > 250 THEN 3 WHEN frame_id > 100 THEN 2 ELSE 1 END AS INTEGER) AS part FROM piv", "frame_id part")),
    "spread_frames": (frame_list, "WITH n AS (SELECT count(*) AS n FROM embeddings WHERE len(embedding) = 64) SELECT DISTINCT CAST(floor(1 + k*((n-1)/6.0)) AS BIGINT) AS frame_id FROM n, range(7) t(k)"),
    "eroded_domain": (lambda s, d: domain.eroded(mask(s, d), 1, 1, ("frame_id",)), final(PIV, "SELECT a.frame_id, a.j, a.i, count(*) = 9 AND bool_and(b.valid) AS kept FROM piv a JOIN piv b ON b.frame_id = a.frame_id AND b.j BETWEEN a.j-1 AND a.j+1 AND b.i BETWEEN a.i-1 AND a.i+1 GROUP BY a.frame_id, a.j, a.i", "frame_id j i kept")),
    "trusted_domain": (lambda s, d: domain.trusted(mask(s, d).join(grid(s), ["j", "i"]), 2, 1, ("frame_id",)), final(f"{PIV}, {GRID}", "SELECT frame_id, p.j, p.i, valid AND p.i BETWEEN 3 AND 6 AND p.j < 4 AS trusted FROM piv p", "frame_id j i trusted")),
    "spatial_exclusion": (lambda s, d: rounded(outside_region(s, d)), final(f"{SMP}, {GRID}", "SELECT frame_id, count(*) AS points, count(u) AS n, avg(u) AS u_mean, avg(CASE WHEN NOT (x_mm >= 4 AND x_mm < 10 AND y_mm BETWEEN 1 AND 4.5) THEN u END) AS u_shown, avg(CASE WHEN NOT (x_mm >= 4 AND x_mm < 10) THEN u END) AS u_drag FROM smp s JOIN grid g ON s.j = g.j AND s.i = g.i WHERE NOT (x_mm BETWEEN 2 AND 6 AND y_mm BETWEEN 0.5 AND 2) GROUP BY frame_id", "frame_id points n u_mean~ u_shown~ u_drag~")),
    "wall_distance": (lambda s, d: rounded(by_wall_distance(s, d)), final(STATS, "SELECT (j-1+1.3)*0.5 AS y, avg(u_mean) AS u_mean, CAST(sum(count) AS BIGINT) AS n FROM (SELECT j, i, u_mean, (SELECT count(u) FROM smp WHERE smp.j = stats.j AND smp.i = stats.i) AS count FROM stats) t GROUP BY j", "y~ u_mean~ n")),
    "wall_rows": (lambda s, d: domain.wall_rows(zero_rows(s, d)), final(PIV, "SELECT CAST(max(n) AS INTEGER) AS crop FROM (SELECT frame_id, min(j)-1 AS n FROM piv WHERE j > 1 + frame_id % 2 AND (u <> 0 OR v <> 0) GROUP BY frame_id) t", "crop")),
    "oriented": (lambda s, d: rounded(domain.oriented(piv(s, d), 4, "bottom").unionByName(domain.oriented(piv(s, d), 4, "top")).groupBy("j").agg(F.sum("u").alias("u"), F.sum("v").alias("v"))), final(PIV, "SELECT j, sum(u) AS u, sum(v) AS v FROM (SELECT 5-j AS j, u, v FROM piv UNION ALL SELECT j, u, -v FROM piv) t GROUP BY j", "j u~ v~")),
    "remapped": (lambda s, d: rounded(domain.remapped(piv(s, d), grid(s), 1).select("frame_id", "j", "i", "y_mm", "u")), final(f"{PIV}, {GRID}", "SELECT frame_id, j-1 AS j, i, (j-1)*3.0 AS y_mm, u FROM piv WHERE j > 1", "frame_id j i y_mm~ u~")),
    "grid_differences": (dual_grid, final(f"{PIV}, {GRID}, sn AS (SELECT repeat_id, j, i, avg(CASE WHEN valid THEN 1.0 ELSE 0 END) AS f FROM piv GROUP BY repeat_id, j, i), one AS (SELECT g.* FROM grid g JOIN sn ON g.j = sn.j AND g.i = sn.i AND repeat_id = 1), other AS (SELECT g.j, g.i, x_mm+CASE WHEN g.i = 2 AND g.j = 1 THEN 1e-6 ELSE 0 END AS x_mm, y_mm FROM grid g JOIN sn ON g.j = sn.j AND g.i = sn.i AND repeat_id = 2 AND f >= 0.909)", "SELECT count(a.x_mm+b.x_mm) AS shared, count(*)-count(a.x_mm+b.x_mm) AS lacking, count(CASE WHEN greatest(abs(a.x_mm-b.x_mm), abs(a.y_mm-b.y_mm)) > 1e-9 THEN 1 END) AS apart FROM one a FULL JOIN other b ON a.j = b.j AND a.i = b.i", "shared lacking apart")),
    "drawable_span": (lambda s, d: domain.drawable_span(mask(s, d), ["frame_id", "j"]).select("frame_id", "j", "i", "inside"), final(PIV, "SELECT frame_id, j, i, coalesce(i BETWEEN min(CASE WHEN valid THEN i END) OVER (PARTITION BY frame_id, j) AND max(CASE WHEN valid THEN i END) OVER (PARTITION BY frame_id, j), false) AS inside FROM piv", "frame_id j i inside")),
    "gradient": (lambda s, d: rounded(gradient(s, d).select("j", "i", "gradient")), final(GRADIENT, "SELECT * FROM gr", "j i gradient~")),
    "gradient_rbf": (lambda s, d: rounded(gradients.d_dy_rbf(stats(s, d).join(grid(s), ["j", "i"]), grid(s), "u_mean").select("j", "i", "gradient")), None),
    "planar_criteria": (lambda s, d: rounded(planar(s, d), 4), final(PLANAR, PLANAR_BODY, "frame_id j i vorticity~ q~ lambda2~ lambda_ci~", 4)),
    "two_point_correlation": (lambda s, d: rounded(correlation.two_point(piv(s, d), 2, 4)), final(SMP, "SELECT s.j, s.i, corr(CASE WHEN r.u IS NOT NULL THEN s.u END, CASE WHEN s.u IS NOT NULL THEN r.u END) AS ruu, corr(CASE WHEN r.v IS NOT NULL THEN s.v END, CASE WHEN s.v IS NOT NULL THEN r.v END) AS rvv, corr(CASE WHEN r.u IS NOT NULL THEN s.v END, CASE WHEN s.v IS NOT NULL THEN r.u END) AS ruv, count(CASE WHEN r.u IS NOT NULL THEN s.u END) AS n, coalesce(avg(CASE WHEN r.u < 0 AND r.v > 0 THEN s.u END), 0) AS q2_u, coalesce(avg(CASE WHEN r.u < 0 AND r.v > 0 THEN s.v END), 0) AS q2_v, count(CASE WHEN r.u < 0 AND r.v > 0 THEN s.u END) AS q2_n, coalesce(avg(CASE WHEN r.u > 0 AND r.v < 0 THEN s.u END), 0) AS q4_u, coalesce(avg(CASE WHEN r.u > 0 AND r.v < 0 THEN s.v END), 0) AS q4_v, count(CASE WHEN r.u > 0 AND r.v < 0 THEN s.u END) AS q4_n FROM smp s JOIN smp r ON s.frame_id = r.frame_id AND r.j = 2 AND r.i = 4 GROUP BY s.j, s.i", "j i ruu~ rvv~ ruv~ n q2_u~ q2_v~ q2_n q4_u~ q4_v~ q4_n")),
}
