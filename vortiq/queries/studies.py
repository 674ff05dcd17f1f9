"""Queries on profiles by place, given log laws, case views, friction studies, rounds of scores and searched fields."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from ..operators import boundary as B
from ..operators import catalog as C
from ..operators import domain, gradients, modal, spectra, statistics, structures, tracking, transport
from ..operators import matching as M
from ..plans import sections
from ..plans.views import BOXES, FLOW, GRID, SMP, boxes, final, flow, grid, piv, rounded
from ..sources.shared import written
from . import boundary as Q
from .dynamics import FS, clean
from .fields import DELTA, DOMAIN, HOW, SHAPE, WEAK, X, Y, packed
from .flow import GRADIENT, MEANS, TRANSPORT
from .flow import transported as transport_stats
from .oracles import CATALOG, RBF, SCORED, SIDES, WELCH, blocks, catalog, recursive, retained, series
from .relational import COMPLETE, chosen_pairs, found_seen, frames, hazen_sql

H = Q.H
BLUR = structures.Blur(1.0, 1.5, 1.0, "zero")


def placed(s, d):
    return flow(s, d).select("i", "j", (2.0 * F.col("i")).alias("x_mm"), (H * F.col("j")).alias("y_mm"), "u_mean")


def profile_of(s, d):
    return B.numbered(Q.profile(s, d).withColumn("k", F.lit(1)), ["k"])


def fit_of(s, d):
    return B.clauser_fit(Q.scan(s, d), ["k"], Q.EDGE)


def friction(s, d, name):
    x = flow(s, d).select("i").distinct().select("i", (F.col("i") * 20.0).alias("x"))
    return sections.friction_section(flow(s, d), x, H, 1.0, sections.Flow(1, FS, 2.0, 8), (3, 9))[name]


def smoothed_theta(s, d):
    return B.pick_theta(Q.state(s, d), "smooth", B.moving_mean(Q.state(s, d).select("x", "theta"), "x", "theta"))


def chosen_u_tau(s, d):
    got = B.pick_u_tau(1.1, fit_of(s, d).first()["u_tau"], "local")
    return s.createDataFrame([(got["u_tau"], got["difference_percent"])], "u_tau double, difference_percent double")


def scales(s, d):
    row = Q.integral(s, d).agg(F.median("delta99").alias("d")).first()
    got = B.reference_scales(row["d"], 1.1, Q.NU)
    return s.createDataFrame([tuple(got.values())], "re_tau double, lower_plus double, upper_plus double")


def views(s, d):
    show, drag = domain.case_views(placed(s, d), ["u_mean"], 25.0, (8.0, 14.0, 1.0, 4.0))
    return show.select("i", "j", F.col("u_mean").alias("shown")).join(drag.select("i", "j", F.col("u_mean").alias("for_drag")), ["i", "j"])


def flagged(s, d):
    """Means of points with the cells that a region contaminates, and their whole columns, taken out."""
    show, drag = domain.case_views(statistics.mean_stats(piv(s, d)).join(grid(s), ["j", "i"]), ["u_mean"], 1e9, (4.0, 10.0, 1.0, 4.5))
    return show.select("j", "i", F.col("u_mean").alias("shown")).join(drag.select("j", "i", F.col("u_mean").alias("for_drag")), ["j", "i"])


def timed(s, d):
    """Frames with more than four complete structures as a run's record."""
    own = boxes(s, d).where("is_ss and not is_censored").groupBy("frame_id").agg(F.count(F.lit(1)).alias("components")).where("components > 4")
    return own.withColumn("seconds", F.col("frame_id") % 13 * 0.25)


def misses(s, d):
    found, _ = found_seen(s, d)
    return C.false_positives(found, frames(s, d), boxes(s, d).where("connectivity = 4 and is_vlsm"))


def windows(s, d):
    """Complete structures of the catalog as annotated windows of the field's columns."""
    own = boxes(s, d).select("frame_id", F.col("component_id").alias("box_id"), "sign", (F.col("col_min") % 8 + 1).alias("i0"))
    return own.withColumn("i1", F.least(F.col("i0") + 2, F.lit(8)))


def annotated(s, d):
    return C.annotation_boxes(windows(s, d), statistics.paired(piv(s, d)), statistics.pooled_rms(piv(s, d)), 0.5)


def rounds(s, d):
    # the frames' and the edges' figures both read the pairs
    pairs = written(chosen_pairs(s, d), "pairs")
    found, seen = found_seen(s, d)
    rim = boxes(s, d).where("is_censored")
    both = pairs.where("sign_match").join(rim.select(F.col("component_id").alias("found_id")), "found_id", "left_semi").join(rim.select(F.col("component_id").alias("seen_id")), "seen_id", "left_semi")
    n = lambda df, name: df.groupBy("frame_id").agg(F.count(F.lit(1)).alias(name))
    edges = frames(s, d).join(n(rim.where("connectivity = 8"), "found"), "frame_id", "left").join(n(rim.where("connectivity = 4"), "seen"), "frame_id", "left").join(n(both, "tp"), "frame_id", "left").fillna(0)
    return M.score_round(M.score_frames(pairs, found, seen, frames(s, d)), edges)


def scaled(s, d):
    profile = s.range(1, 5).select(F.col("id").cast("int").alias("j"), (F.col("id") * 5.0).alias("u_mean"))
    return spectra.wall_scaled(spectra.temporal_spectra(clean(s, d), "u", 64, FS), profile, 0.5, 1.5e-3, (1.0, 6.0), 0.8, 1, 10.0)


def outside(s, d):
    signal = clean(s, d).where("j = 2 and i = 4").select("frame_id", F.col("u").alias("signal"))
    return spectra.external_coherence(clean(s, d), signal, ["j", "i"], "u", 64, FS)


def rbf_production(s, d):
    stats = transport_stats(s, d)
    return transport.production(stats, gradients.d_dy_rbf(stats.join(grid(s), ["j", "i"]), grid(s), "u_mean"))


def detected(s, d, name, **how):
    return sections.detection_section(piv(s, d), SHAPE, X, Y, HOW, **how)[name]


def sweep(s, d):
    """Structures for all combinations of blur, thresholds, closing and holes with the core at least the growth."""
    sets = structures.factorial(WEAK, alpha=[0.5, 0.9], seed_alpha=[0.8, 1.4], closing_radius=[0, 1], max_hole=[0, 2], connectivity=[4, 8])
    out = None
    for number, blur in enumerate([None, BLUR]):
        fields = packed(s, d) if blur is None else structures.blurred(packed(s, d), SHAPE, (blur.sigma_y, blur.sigma_x), blur.size(), blur.mode)
        got = structures.hysteresis_sweep(fields, SHAPE, np.full(SHAPE, 0.12), DOMAIN, X, Y, DELTA, sets)
        one = got.groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.avg("area_mm2").alias("mean_area"), F.count(F.when(F.col("is_vlsm"), 1)).alias("vlsm"), F.sum("pixel_count").alias("pixels")).withColumn("blur", F.lit(number))
        out = one if out is None else out.unionByName(one)
    return out


def weak(fields, level):
    return structures.hysteresis_structures(fields, SHAPE, level, DOMAIN, X, Y, DELTA, replace(WEAK, alpha=0.5, seed_alpha=1.0))


def branches(s, d, which):
    snaps = modal.snapshots(piv(s, d))
    valid = modal.entropy_selection(snaps, modal.pod(snaps), np.ones(SHAPE, bool))["valid"]
    return sections.pod_branches(piv(s, d), SHAPE, (0.8, 0.9), np.full(SHAPE, 0.1), weak, 32, valid)[which]


def energy_sweep(s, d):
    """Structures by share of the energy kept, from a fifth to four fifths."""
    snaps = modal.snapshots(piv(s, d))
    return sections.pod_sweep(snaps, modal.pod(snaps), SHAPE, tuple(k / 10 for k in range(2, 9)), np.full(SHAPE, 0.1), weak, 32)


def shifts(s, d):
    rows = flow(s, d).groupBy("j").agg(F.avg("u_mean").alias("u_mean")).withColumn("y_mm", F.col("j") * H)
    own = boxes(s, d).select("component_id", ((F.col("y_min_mm") + F.col("y_max_mm")) / 2).alias("y_mm"))
    return tracking.convection_shift(own, rows, 1e-3, 2.0).select("component_id", "shift")


NEAREST = "pl AS (SELECT place, i FROM (SELECT place, i, row_number() OVER (PARTITION BY place ORDER BY abs(2.0*i-spot), i) AS p FROM (SELECT DISTINCT i FROM flow) f, (VALUES {}) v(place, spot)) q WHERE p = 1)"
PLACED = "SELECT j, u FROM (SELECT j, CASE WHEN count(*) = count(u_mean) THEN avg(u_mean) END AS u FROM flow JOIN pl ON pl.i = flow.i GROUP BY j) q WHERE u IS NOT NULL"
NUMBERED = f"{Q.PROFILE}, nn AS (SELECT u, row_number() OVER (ORDER BY j) AS n FROM prof WHERE u IS NOT NULL AND u <> 0)"


def given_sql(tau: str) -> str:
    y = f"((n-1)*{H}+0.65)*1e-3*({tau})/{Q.NU}"
    return final(NUMBERED, f"SELECT 1 AS k, {tau} AS u_tau, 2*pow(({tau})/25.0, 2) AS cf, CASE WHEN count(g) >= 3 THEN sqrt(avg(g*g)) END AS rmse, count(g) AS n_points FROM (SELECT CASE WHEN {y} BETWEEN 30 AND 300 THEN u/({tau})-(ln({y})/0.41+5.0) END AS g FROM nn) q", "k u_tau~ cf~ rmse~ n_points")


FIT = f"{Q.SCAN}, ft AS (SELECT number, rmse, u_tau FROM sn ORDER BY round(rmse, 9), number LIMIT 1)"
FRICTION = f"{FIT.replace('0.65', '1.0')}"
PARAMS = f"{FIT}, rn AS (SELECT coalesce(min(n) FILTER (u > 24.75), max(n)) AS reach, max(u) FILTER (n = 1) AS u1 FROM nn), fl AS (SELECT n+1 AS m, u FROM nn UNION ALL SELECT 1, u1 FROM rn), pr AS (SELECT (max(reach)+1)*{H} AS delta99, sum(1-u/24.75)*{H} AS delta_star, sum(u*(24.75-u))*{H}/pow(24.75, 2) AS theta FROM fl, rn WHERE m <= reach+1)"
RUN = f"{Q.STATE}, cl AS (SELECT x, theta, ue*ue AS u2, ue*ue*theta AS fl, delta_star AS ds, lag(theta) OVER w AS t0, lag(ue*ue) OVER w AS u0, lag(ue*ue*theta) OVER w AS f0, lag(delta_star) OVER w AS d0, first_value(x) OVER w AS x0 FROM sx WINDOW w AS (ORDER BY x)), pc AS (SELECT x, x0, (fl-f0)/((u2+u0)/2)+(ds+d0)/2*(u2-u0)/2/((u2+u0)/2) AS p, theta-t0 AS z FROM cl)"


def started(places: str, full: bool) -> str:
    """SQL of the secant from the mean state nearest to places."""
    start = f"st AS (SELECT avg(x) AS xs, avg(theta) AS ts, avg(ue) AS us, avg(delta_star) AS ds FROM (SELECT DISTINCT x, theta, ue, delta_star FROM (SELECT sx.*, row_number() OVER (PARTITION BY q ORDER BY abs(x-q), x) AS p FROM sx, (VALUES {places}) v(q) WHERE theta IS NOT NULL) z WHERE p = 1) y)"
    views = Q.SECANT[: Q.SECANT.index("st AS (SELECT")] + start + Q.SECANT[Q.SECANT.index(",\nen AS") :]
    return final(views, f"SELECT x_end, x_e, theta_e, status, CASE WHEN status = 'ok' THEN {'fullcf' if full else 'zpg'} END AS cf FROM sc", "x_end~ x_e~ theta_e~ status cf~")


EDGED = f"{SCORED}, rims AS (SELECT count(*) AS etp FROM chosen JOIN boxes a ON a.component_id = found_id JOIN boxes b ON b.component_id = seen_id WHERE sign_match AND a.is_censored AND b.is_censored), sq AS (SELECT *, CASE WHEN precision+recall > 0 THEN 2*precision*recall/(precision+recall) WHEN precision+recall = 0 THEN 1.0 END AS f1 FROM sp), eg AS (SELECT count(*) FILTER (connectivity = 8) AS ef, count(*) FILTER (connectivity = 4) AS es FROM boxes WHERE is_censored), tt AS (SELECT count(*) AS frames, median(precision) AS median_precision, median(recall) AS median_recall, median(f1) AS median_f1, CAST(sum(tp) AS BIGINT) AS tp, sum(tp)/CAST(sum(found) AS DOUBLE) AS precision, sum(tp)/CAST(sum(seen) AS DOUBLE) AS recall, sum(tp)/CAST(sum(pairs) AS DOUBLE) AS sign_accuracy FROM sq), te AS (SELECT (SELECT etp FROM rims)/CAST(ef AS DOUBLE) AS edge_precision, (SELECT etp FROM rims)/CAST(es AS DOUBLE) AS edge_recall FROM eg)"
TEMPORAL = f"{WELCH}, ts AS (SELECT j, frequency, avg(psd) AS psd FROM ws GROUP BY j, frequency), wl AS (SELECT j, frequency, psd, CASE WHEN j = 1 THEN 5.0 ELSE 4.0*j END/frequency AS l FROM ts WHERE frequency BETWEEN 1 AND 6)"
OUTSIDE = f"{SMP}, three AS (SELECT a.frame_id, a.j, a.i, a.u, b.u AS g FROM smp a JOIN smp b ON b.frame_id = a.frame_id AND b.j = 2 AND b.i = 4), {series('three', 'j, i', 'frame_id', 'u', 'su')}, {series('three', 'j, i', 'frame_id', 'g', 'sv')}, {blocks('su', 'j, i', 'bu')}, {blocks('sv', 'j, i', 'bv')}, xs AS (SELECT bu.j, bu.i, bu.f, avg(bu.c*bv.c+bu.s*bv.s) AS re, avg(bu.s*bv.c-bu.c*bv.s) AS im, avg(bu.c*bu.c+bu.s*bu.s) AS pp, avg(bv.c*bv.c+bv.s*bv.s) AS qq FROM bu JOIN bv ON bu.j = bv.j AND bu.i = bv.i AND bu.b = bv.b AND bu.f = bv.f GROUP BY bu.j, bu.i, bu.f)"
WEIGHTS = f"{TRANSPORT}, {GRID}, uo AS (SELECT j, i, CASE WHEN ok THEN u_mean END AS u_mean FROM tr){RBF[len(GRADIENT):]}"


def blur_sql(source: str, name: str) -> str:
    return f"{name} AS (SELECT a.repeat_id, a.frame_id, a.j, a.i, CASE WHEN max(CASE WHEN a.j = b.j AND a.i = b.i THEN b.u END) IS NOT NULL THEN sum(b.u*exp(-pow(a.j-b.j, 2)/2)*exp(-pow(a.i-b.i, 2)/4.5))/sum(CASE WHEN b.u IS NOT NULL THEN exp(-pow(a.j-b.j, 2)/2)*exp(-pow(a.i-b.i, 2)/4.5) END) END AS u, max(CASE WHEN a.j = b.j AND a.i = b.i THEN b.u END) AS raw FROM {source} a JOIN {source} b ON a.frame_id = b.frame_id AND abs(a.j-b.j) <= 1 AND abs(a.i-b.i) <= 2 GROUP BY a.repeat_id, a.frame_id, a.j, a.i)"


BLURRED = f"{SMP}, {MEANS}, rms AS (SELECT s.j, sqrt(avg((u-m)*(u-m))) AS level FROM smp s JOIN (SELECT j, i, avg(u) AS m FROM smp GROUP BY j, i) a ON s.j = a.j AND s.i = a.i GROUP BY s.j), du AS (SELECT s.repeat_id, s.frame_id, s.j, s.i, u-mu AS u FROM smp s JOIN rm ON s.repeat_id = rm.repeat_id AND s.j = rm.j AND s.i = rm.i), {blur_sql('du', 'bl')}, lv AS (SELECT bl.*, level FROM bl JOIN rms ON rms.j = bl.j), {catalog('lv')}, {retained('found')}, chosen AS (SELECT found.* REPLACE (CASE WHEN is_censored THEN is_ss ELSE coalesce(kept, false) END AS is_ss), coalesce(kept, false) AS kept, coalesce(NOT kept, false) AS suppressed FROM found LEFT JOIN fold f ON f.frame_id = found.frame_id AND f.connectivity = found.connectivity AND f.sign = found.sign AND f.component_id = found.component_id)"
RECORD = f"{BOXES}, rec AS (SELECT frame_id, count(*) AS components, (frame_id % 13)*CAST(0.25 AS DOUBLE) AS seconds, 1 AS k FROM boxes WHERE {COMPLETE} GROUP BY frame_id HAVING count(*) > 4), gp AS (SELECT *, frame_id-row_number() OVER (ORDER BY frame_id) AS g FROM rec), hz AS ({hazen_sql('SELECT * FROM rec', 'k', 'seconds', {'p95_seconds': 0.95})})"

QUERIES = {
    "profile_fixed": (lambda s, d: rounded(B.profile_at(placed(s, d), "u_mean", [7.3])), final(f"{FLOW}, {NEAREST.format('(0, 7.3)')}", PLACED, "j u~")),
    "profile_places": (lambda s, d: rounded(B.profile_at(placed(s, d), "u_mean", [3.2, 9.0, 21.9, 22.1])), final(f"{FLOW}, {NEAREST.format('(0, 3.2), (1, 9.0), (2, 21.9), (3, 22.1)')}", PLACED, "j u~")),
    "clauser_semi": (lambda s, d: rounded(B.clauser_at(profile_of(s, d), ["k"], Q.EDGE, Q.NU, H, 0.65, number=3.5).drop("number")), given_sql(f"sqrt((5e-3-2e-4*3.5)*{Q.EDGE}*{Q.EDGE}/2)")),
    "clauser_utau": (lambda s, d: rounded(B.clauser_at(profile_of(s, d), ["k"], Q.EDGE, Q.NU, H, 0.65, u_tau=1.1).drop("number")), given_sql("CAST(1.1 AS DOUBLE)")),
    "chart_params": (lambda s, d: rounded(B.chart_params(profile_of(s, d), ["k"], fit_of(s, d), Q.EDGE, Q.NU, H, 0.65).drop("k")), final(PARAMS, f"SELECT delta99, delta_star, theta, u_tau, delta_star/theta AS shape, delta99*1e-3*u_tau/{Q.NU} AS re_tau FROM pr, ft", "delta99~ delta_star~ theta~ u_tau~ shape~ re_tau~")),
    "secant_fixed": (lambda s, d: rounded(B.system_secant(Q.state(s, d), Q.ends(s), (101.0,), (60.0, 90.0), True, "places")), started("(101.0)", True)),
    "secant_places": (lambda s, d: rounded(B.system_secant(Q.state(s, d), Q.ends(s), (99.0, 101.0, 139.0), (60.0, 90.0), False, "places")), started("(99.0), (101.0), (139.0)", False)),
    "theta_source": (lambda s, d: rounded(smoothed_theta(s, d)), final(Q.STATE, "SELECT x, avg(theta) OVER (ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS theta, ue, delta_star FROM sx", "x~ theta~ ue~ delta_star~")),
    "u_tau_source": (lambda s, d: rounded(chosen_u_tau(s, d)), final(FIT, "SELECT u_tau, 100*(u_tau-1.1)/1.1 AS difference_percent FROM ft", "u_tau~ difference_percent~")),
    "friction_chart": (lambda s, d: rounded(friction(s, d, "chart").drop("case")), final(FRICTION, "SELECT number, rmse, u_tau, 2*pow(u_tau/25.0, 2) AS cf FROM ft", "number~ rmse~ u_tau~ cf~")),
    "friction_plus": (lambda s, d: rounded(friction(s, d, "plus")), final(FRICTION, f"SELECT j, u, (j-1+2.0)*{H}*1e-3*u_tau/{Q.NU} AS y_plus, u/u_tau AS u_plus FROM prof, ft WHERE u IS NOT NULL", "j u~ y_plus~ u_plus~")),
    "friction_delta": (lambda s, d: rounded(friction(s, d, "delta")), final(Q.INTEGRAL, "SELECT median(delta99) AS delta99, count(delta99) AS columns FROM ip", "delta99~ columns")),
    "friction_secant_full": (lambda s, d: rounded(friction(s, d, "secant_full")), final(RUN, "SELECT x, 2*s/(x-x0) AS cf FROM (SELECT x, x0, sum(p) OVER (ORDER BY x) AS s FROM pc) t WHERE x > x0", "x~ cf~")),
    "friction_secant_zpg": (lambda s, d: rounded(friction(s, d, "secant_zpg")), final(RUN, "SELECT x, 2*s/(x-x0) AS cf FROM (SELECT x, x0, sum(z) OVER (ORDER BY x) AS s FROM pc) t WHERE x > x0", "x~ cf~")),
    "reference_scales": (lambda s, d: rounded(scales(s, d)), final(f"{Q.INTEGRAL}, re AS (SELECT median(delta99)*1e-3*1.1/{Q.NU} AS re FROM ip)", "SELECT re AS re_tau, 2.6*sqrt(re) AS lower_plus, re/2 AS upper_plus FROM re", "re_tau~ lower_plus~ upper_plus~")),
    "contaminated": (lambda s, d: rounded(flagged(s, d)), final(f"{SMP}, {GRID}, mn AS (SELECT j, i, avg(u) AS u FROM smp GROUP BY j, i)", "SELECT g.j, g.i, CASE WHEN NOT (x_mm >= 4 AND x_mm < 10 AND y_mm BETWEEN 1 AND 4.5) THEN u END AS shown, CASE WHEN NOT (x_mm >= 4 AND x_mm < 10) THEN u END AS for_drag FROM grid g JOIN mn ON g.j = mn.j AND g.i = mn.i", "j i shown~ for_drag~")),
    "case_views": (lambda s, d: rounded(views(s, d)), final(FLOW, f"SELECT i, j, CASE WHEN NOT (2.0*i >= 8 AND 2.0*i < 14 AND j*{H} BETWEEN 1 AND 4) THEN u_mean END AS shown, CASE WHEN NOT (2.0*i >= 8 AND 2.0*i < 14) THEN u_mean END AS for_drag FROM flow WHERE 2.0*i <= 25", "i j shown~ for_drag~")),
    "performance_summary": (lambda s, d: rounded(C.performance(timed(s, d), 12000)[0]), final(RECORD, "SELECT count(*) AS n_frames, avg(seconds) AS mean_seconds, median(seconds) AS median_seconds, sum(seconds) AS total_seconds, avg(seconds)*12000 AS planned_seconds, max(p95_seconds) AS p95_seconds FROM rec JOIN hz ON hz.k = rec.k", "n_frames mean_seconds~ median_seconds~ total_seconds~ planned_seconds~ p95_seconds~")),
    "performance_segments": (lambda s, d: rounded(C.performance(timed(s, d), 12000)[1]), final(RECORD, "SELECT CAST(row_number() OVER (ORDER BY min(frame_id)) AS INTEGER) AS segment, min(frame_id) AS first_frame, max(frame_id) AS last_frame, count(*) AS n_frames, avg(seconds) AS mean_seconds, CAST(sum(components) AS BIGINT) AS components FROM gp GROUP BY g", "segment first_frame last_frame n_frames mean_seconds~ components")),
    "false_positives": (lambda s, d: rounded(misses(s, d)), final(f"{BOXES}, ng AS (SELECT DISTINCT frame_id FROM boxes WHERE frame_id NOT IN (SELECT frame_id FROM boxes WHERE connectivity = 4 AND is_vlsm)), fn AS (SELECT ng.frame_id, count(component_id) AS n FROM ng LEFT JOIN boxes b ON b.frame_id = ng.frame_id AND connectivity = 8 GROUP BY ng.frame_id)", "SELECT count(*) AS negative_frames, CAST(coalesce(sum(n), 0) AS BIGINT) AS false_positives, avg(n) AS per_frame FROM fn", "negative_frames false_positives per_frame~")),
    "annotation_boxes": (lambda s, d: rounded(annotated(s, d)), final(f"{SMP}, {BOXES}, rms AS (SELECT s.j, sqrt(avg((u-m)*(u-m))) AS r FROM smp s JOIN (SELECT j, i, avg(u) AS m FROM smp GROUP BY j, i) a ON s.j = a.j AND s.i = a.i GROUP BY s.j), wn AS (SELECT frame_id, component_id AS box_id, sign, col_min % 8 + 1 AS i0, least(col_min % 8 + 3, 8) AS i1 FROM boxes)", "SELECT w.frame_id, box_id, sign, i0, i1, min(CASE WHEN sign*u > 0.5*r THEN s.j END) AS j0, max(CASE WHEN sign*u > 0.5*r THEN s.j END) AS j1, count(CASE WHEN sign*u > 0.5*r THEN 1 END) AS pixels, count(CASE WHEN sign*u > 0.5*r THEN 1 END)/CAST(count(*) AS DOUBLE) AS share, max(sign*u/r) AS strength FROM wn w JOIN smp s ON s.frame_id = w.frame_id AND s.i BETWEEN i0 AND i1 AND u IS NOT NULL JOIN rms ON rms.j = s.j GROUP BY w.frame_id, box_id, sign, i0, i1", "frame_id box_id sign i0 i1 j0 j1 pixels share~ strength~")),
    "score_round": (lambda s, d: rounded(rounds(s, d)), recursive(EDGED, "SELECT frames, median_precision, median_recall, median_f1, tp, precision, recall, 2*precision*recall/(precision+recall) AS f1, sign_accuracy, edge_precision, edge_recall, CASE WHEN edge_precision+edge_recall > 0 THEN 2*edge_precision*edge_recall/(edge_precision+edge_recall) ELSE 1 END AS edge_f1 FROM tt, te", "frames median_precision~ median_recall~ median_f1~ tp precision~ recall~ f1~ sign_accuracy~ edge_precision~ edge_recall~ edge_f1~")),
    "wall_scaled_spectra": (lambda s, d: rounded(scaled(s, d)), final(TEMPORAL, "SELECT j, frequency, psd, l AS lambda_m, l*0.5/1.5e-3 AS lambda_plus, frequency*psd/0.25 AS premultiplied_f, frequency*psd/0.25 AS premultiplied_lambda FROM wl", "j frequency~ psd~ lambda_m~ lambda_plus~ premultiplied_f~ premultiplied_lambda~")),
    "external_coherence": (lambda s, d: rounded(outside(s, d)), final(OUTSIDE, f"SELECT j, i, f/4.0 AS frequency, re*{SIDES} AS re, im*{SIDES} AS im, (re*re+im*im)/(pp*qq) AS coherence FROM xs", "j i frequency~ re~ im~ coherence~")),
    "transport_production_rbf": (lambda s, d: rounded(rbf_production(s, d)), final(WEIGHTS, "SELECT tr.j, tr.i, CASE WHEN bool_and(s.u_mean IS NOT NULL) AND bool_and(ok) THEN max(total_uv)*sum(w*s.u_mean) END AS production FROM tr JOIN wt ON wt.j = tr.j JOIN uo s ON s.j = wt.k AND s.i = tr.i GROUP BY tr.j, tr.i", "j i production~")),
    "section_detection_blurred": (lambda s, d: rounded(detected(s, d, "catalog", blur=BLUR).drop("passes")), recursive(BLURRED, "SELECT * FROM chosen", f"{CATALOG} kept suppressed")),
    "section_detection_pod": (lambda s, d: rounded(detected(s, d, "catalog", energy=0.8, own_rms=True).drop("passes")), None),
    "preprocess_counts": (lambda s, d: rounded(structures.preprocessed(packed(s, d), SHAPE, (1.0, 1.5), BLUR.size(), "zero")), final(f"{SMP}, {blur_sql('smp', 'bl')}", "SELECT repeat_id, frame_id, CAST(count(raw) AS INTEGER) AS valid, CAST(count(*)-count(raw) AS INTEGER) AS missing, CAST(count(u) AS INTEGER) AS valid_after, CAST(count(CASE WHEN abs(u-raw) > 1e-9 THEN 1 END) AS INTEGER) AS changed, max(abs(u-raw)) AS largest_change FROM bl GROUP BY repeat_id, frame_id", "repeat_id frame_id valid missing valid_after changed largest_change~")),
    "factorial_sweep": (lambda s, d: rounded(sweep(s, d)), None),
    "pod_branches": (lambda s, d: rounded(branches(s, d, 0)), None),
    "pod_energy_sweep": (lambda s, d: rounded(energy_sweep(s, d)), None),
    "pod_recommendation": (lambda s, d: rounded(branches(s, d, 1)), None),
    "convection_shift": (lambda s, d: shifts(s, d), final(f"{BOXES}, {FLOW}, pf AS (SELECT j, avg(u_mean) AS u FROM flow GROUP BY j), nr AS (SELECT component_id, u, row_number() OVER (PARTITION BY component_id ORDER BY abs(j*{H}-(y_min_mm+y_max_mm)/2), j) AS p FROM boxes, pf)", "SELECT component_id, CAST(round(u*1e-3*1e3/2.0) AS INTEGER) AS shift FROM nr WHERE p = 1", "component_id shift")),
}
