"""Queries on what a streamwise study hands on, coherent structures, joint modes of well-covered points, and merged structures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import modal, phase, quadrants, structures, transport
from ..plans import sections
from ..plans.views import BOXES, GRID, SMP, boxes, final, grid, piv, rounded
from . import flow
from .dynamics import FS
from .fields import DELTA, DOMAIN, SHAPE, X, Y
from .oracles import MERGED, WELCH, recursive
from .relational import box_pixels

HEIGHTS = [0.4, 3.0, 3.25, 50.0]


def handed(s, d, name):
    products = transport.production(flow.transported(s, d), flow.gradient(s, d))
    heights = s.createDataFrame([(h,) for h in HEIGHTS], "target double")
    return sections.handoff_section(piv(s, d), grid(s), products, quadrants.quadrant_stats(flow.total_quadrants(s, d)), heights, 64, FS)[name]


def covered(s, d, limit=0.90905):
    return modal.snapshots(piv(s, d), limit)


def joint(s, d):
    """Spectrum of the points with enough valid samples."""
    model = modal.pod(covered(s, d))
    values = model.eigenvalues
    return s.createDataFrame([(model.dof, float(values.sum()), float((values**2).sum()))], "dof int, total double, squared double")


def joint_rank(s, d):
    model = modal.pod(covered(s, d))
    got = [model.chosen_rank(energy=t) for t in (0.5, 0.8, 1.0)] + [model.chosen_rank(fixed=3)]
    return s.createDataFrame([(k, g["rank"], g["positive"], g["share"]) for k, g in enumerate(got)], "rule int, rank int, positive int, share double")


def merged(s, d):
    own = boxes(s, d).select(F.lit(1).alias("repeat_id"), "frame_id", "sign", F.col("component_id").alias("structure_id"), "x_min_mm", "x_max_mm", "y_min_mm", "y_max_mm", box_pixels().alias("pixels"))
    return structures.merged_geometry(own, 4.0, 2.0, 1.5)


def bins(s, d):
    return phase.phase_means(flow.phased(s, d), ["bin"], flow.FEW)


def planar_by_phase(s, d):
    return sections.phase_planar(bins(s, d), flow.stats(s, d), grid(s))


def coherent_found(s, d):
    parts = phase.coherent(bins(s, d), flow.stats(s, d))
    return sections.coherent_structures(parts, SHAPE, DOMAIN, X, Y, DELTA, structures.Hysteresis(alpha=0.7, seed_alpha=0.7), 1.2)


def planar_rows(rows: str, name: str) -> str:
    """View `name` of the criteria of rows (frame_id, j, i, u, v)."""
    body = flow.PLANAR_BODY.replace("FROM d2)", f"FROM {name}2)")
    two = flow.PLANAR[flow.PLANAR.index("d2 AS (") :].replace("d2 AS", f"{name}2 AS").replace("FROM d1)", f"FROM {name}1)")
    return f"{name}1 AS (SELECT r.*, x_mm, y_mm FROM ({rows}) r JOIN grid g ON r.j = g.j AND r.i = g.i), {two}, {name} AS ({body})"


PHASED = f"{flow.COH}, {GRID}, {planar_rows('SELECT bin AS frame_id, j, i, u_phase AS u, v_phase AS v FROM pooled', 'own')}, {planar_rows('SELECT 0 AS frame_id, j, i, u_mean AS u, v_mean AS v FROM stats', 'mean')}"
WHOLE = f"{flow.COH}, en AS (SELECT *, (uc*uc+vc*vc)/2 AS ec FROM coh), ratio AS (SELECT bin, uc/sqrt(avg(uc*uc) OVER p) AS u, vc/sqrt(avg(vc*vc) OVER p) AS v, ec/avg(ec) OVER p AS energy FROM en WINDOW p AS (PARTITION BY j, i)), fd AS (SELECT bin, 'u' AS field, u AS x, 0.7 AS a FROM ratio UNION ALL SELECT bin, 'v', v, 0.7 FROM ratio UNION ALL SELECT bin, 'energy', energy, 1.2 FROM ratio)"
PEAKS = f"{WELCH}, {GRID}, nr AS (SELECT target, j, y_mm FROM (SELECT target, j, y_mm, row_number() OVER (PARTITION BY target ORDER BY abs(y_mm-target), j) AS p FROM (SELECT DISTINCT j, y_mm FROM grid) g, (VALUES {', '.join(f'(CAST({h} AS DOUBLE))' for h in HEIGHTS)}) v(target)) q WHERE p = 1), pk AS (SELECT j, i, frequency, frequency*psd AS peak, row_number() OVER (PARTITION BY j, i ORDER BY frequency*psd DESC, frequency) AS p FROM ws WHERE frequency > 0)"
COVERED = f"{SMP}, kp AS (SELECT j, i FROM smp GROUP BY j, i HAVING count(u)/CAST(count(*) AS DOUBLE) >= 0.90905), vl AS (SELECT frame_id, j, i, c, coalesce(CASE WHEN c = 0 THEN u ELSE v END, 0) AS x FROM smp JOIN kp USING (j, i), (VALUES (0), (1)) d(c)), dv AS (SELECT frame_id, (c*4+j)*8+i AS k, x-avg(x) OVER (PARTITION BY j, i, c) AS x FROM vl), cv AS (SELECT a.k AS p, b.k AS q, sum(a.x*b.x) AS s FROM dv a JOIN dv b USING (frame_id) GROUP BY a.k, b.k), nd AS (SELECT 2*count(*) AS dof FROM kp)"
GROUPED = f'{MERGED}, px AS (SELECT f.frame_id, f.sign, f.grp, f.structure_id, i*2.0 AS x, j*1.5 AS y, 10.0+i AS dl, i-j-10.0 AS u FROM fold f JOIN boxes b ON b.component_id = f.structure_id, range(1, 65) a(i), range(1, 20) r(j) WHERE i BETWEEN col_min AND col_max AND j BETWEEN row_min AND row_max), gm AS (SELECT frame_id, sign, grp, count(DISTINCT structure_id) AS members, count(*) AS pixel_count, avg(x) AS cx, avg(y) AS cy, max(x)-min(x)+2 AS lx, max(y)-min(y)+1.5 AS ly, median(dl) AS dl, avg(u) AS um, max(abs(u)) AS pk, sum(greatest(sign*u, 0)) AS w, sum(greatest(sign*u, 0)*x) AS wx, sum(greatest(sign*u, 0)*y) AS wy FROM px GROUP BY frame_id, sign, grp)'

QUERIES = {
    "handoff_peaks": (lambda s, d: rounded(handed(s, d, "peaks")), final(PEAKS, "SELECT target, nr.j, y_mm, i, frequency, peak FROM nr JOIN pk ON pk.j = nr.j AND p = 1", "target~ j y_mm~ i frequency~ peak~")),
    "handoff_production": (lambda s, d: rounded(handed(s, d, "production")), final(f"{flow.GRADIENT}, {flow.TRANSPORT.split(flow.BINNED + ', ')[1]}", "SELECT tr.i, max(CASE WHEN ok THEN total_uv END*gradient) AS peak, avg(CASE WHEN ok THEN total_uv END*gradient) AS mean, count(CASE WHEN ok THEN total_uv END*gradient) AS n FROM tr JOIN gr ON tr.j = gr.j AND tr.i = gr.i GROUP BY tr.i", "i peak~ mean~ n")),
    "handoff_quadrants": (lambda s, d: rounded(handed(s, d, "quadrants")), final(f"{flow.STATS}, qd AS ({flow.quadrant_sql(flow.TOTAL_ROWS, 'j, i', '', 'j, i')})", "SELECT i, hole, quadrant, avg(probability) AS probability FROM qd GROUP BY i, hole, quadrant", "i hole quadrant probability~")),
    "phase_planar": (lambda s, d: rounded(planar_by_phase(s, d), 4), final(PHASED, "SELECT own.frame_id AS bin, own.j, own.i, own.vorticity, own.q, own.lambda2, own.lambda_ci, own.vorticity-mean.vorticity AS coherent_vorticity FROM own JOIN mean ON own.j = mean.j AND own.i = mean.i", "bin j i vorticity~ q~ lambda2~ lambda_ci~ coherent_vorticity~", 4)),
    "coherent_structures": (lambda s, d: coherent_found(s, d).groupBy("field", "bin", "sign").agg(F.sum("pixel_count").alias("pixels")), final(WHOLE, "SELECT field, CAST(bin AS BIGINT) AS bin, CAST(CASE WHEN x > 0 THEN 1 ELSE -1 END AS INTEGER) AS sign, count(*) AS pixels FROM fd WHERE abs(x) >= a GROUP BY 1, 2, 3", "field bin sign pixels")),
    "handoff_envelope": (lambda s, d: rounded(handed(s, d, "envelope")), None),
    "pod_joint": (lambda s, d: rounded(joint(s, d)), final(COVERED, "SELECT CAST(max(dof) AS INTEGER) AS dof, sum(CASE WHEN p = q THEN s END)/max(dof) AS total, sum(s*s)/max(dof)/max(dof) AS squared FROM cv, nd", "dof total~ squared~")),
    "pod_joint_rank": (lambda s, d: rounded(joint_rank(s, d)), None),
    "merged_geometry": (lambda s, d: rounded(merged(s, d).drop("repeat_id")), recursive(GROUPED, 'SELECT frame_id, sign, grp AS "group", members, pixel_count, cx AS centroid_x_mm, cy AS centroid_y_mm, lx AS length_mm, ly AS height_mm, dl AS delta_mm, um AS u_mean, pk AS peak, CASE WHEN w > 0 THEN wx/w END AS weighted_x_mm, CASE WHEN w > 0 THEN wy/w END AS weighted_y_mm, pixel_count*3.0 AS area_mm2, lx/dl AS lx_over_delta, ly/dl AS ly_over_delta, lx/dl >= 1 AS is_lsm, lx/dl >= 3 AS is_vlsm FROM gm', 'frame_id sign "group" members pixel_count centroid_x_mm~ centroid_y_mm~ length_mm~ height_mm~ delta_mm~ u_mean~ peak~ weighted_x_mm~ weighted_y_mm~ area_mm2~ lx_over_delta~ ly_over_delta~ is_lsm is_vlsm')),
}
