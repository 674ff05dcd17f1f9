"""SQL of queries that need more than a few lines: labelling by closure, choices made in turn, and transforms as sums."""

from __future__ import annotations

from ..plans.views import BINNED, BOXES, FLOW, GRID, SMP, final
from .flow import CENTRAL, GRADIENT, MEANS, TRANSPORT
from .relational import FRAMES, PAIR_SCORE, PAIRS, hazen_sql

RECURSIVE = "WITH RECURSIVE "


def recursive(views: str, body: str, columns: str, digits: int = 6) -> str:
    return RECURSIVE + final(views, body, columns, digits)[len("WITH ") :]


def labels(pixels: str, name: str, keys: str, connectivity: str) -> str:
    """Views `name` (keys, j, i, root, id) of the connected regions of `pixels` (keys, j, i, ..): every pixel spreads its
    number, in column order, to all that it reaches; the least that arrives is the root."""
    both = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    near = f"abs(r.j-m.j) <= 1 AND abs(r.i-m.i) <= 1 AND (abs(r.j-m.j)+abs(r.i-m.i) = 1 OR {connectivity} = 8)"
    return f"""{name}_r AS (SELECT {keys}, (i-1)*4+j AS root, j, i FROM {pixels} UNION SELECT {', '.join('r.' + k for k in keys.split(', '))}, r.root, m.j, m.i FROM {name}_r r JOIN {pixels} m ON {both('r', 'm')} AND {near}),
{name}_m AS (SELECT {keys}, j, i, min(root) AS root FROM {name}_r GROUP BY {keys}, j, i),
{name} AS (SELECT *, dense_rank() OVER (PARTITION BY {keys} ORDER BY root) AS id FROM {name}_m)"""


SIGNS = "(VALUES (1),(-1)) sg(sg)"
BOTH = "(VALUES (8),(4)) cn(connectivity)"


def catalog(rows: str) -> str:
    """Views px, lab, near_bad and found: the catalog of regions of rows (repeat_id, frame_id, j, i, u, level)."""
    return f"""px AS (SELECT repeat_id, frame_id, sg AS sign, connectivity, j, i FROM {rows}, {SIGNS}, {BOTH} WHERE sg*u > level),
{labels('px', 'lab', 'frame_id, sign, connectivity', 'r.connectivity')},
bad AS (SELECT DISTINCT a.frame_id, a.j, a.i FROM {rows} a JOIN {rows} b ON a.frame_id = b.frame_id AND b.u IS NULL AND abs(a.j-b.j) <= 1 AND abs(a.i-b.i) <= 1),
reps AS (SELECT DISTINCT repeat_id, frame_id FROM {rows}),
f0 AS (SELECT l.frame_id, sign, connectivity, id AS component_id, count(*) AS n, min(l.i) AS c0, max(l.i) AS c1, min(l.j) AS r0, max(l.j) AS r1, bool_or(b.j IS NOT NULL) AS bad FROM lab l LEFT JOIN bad b ON b.frame_id = l.frame_id AND b.j = l.j AND b.i = l.i GROUP BY l.frame_id, sign, connectivity, id),
f1 AS (SELECT *, greatest(0.5*r0*r0-0.75, 0) AS y0, 0.5*r1*r1+0.75 AS y1, (c1-c0+1)*2.0 AS lx, CAST(c0 = 1 AS INTEGER)+2*CAST(c1 = 8 AS INTEGER)+4*CAST(r1 = 4 AS INTEGER) AS code FROM f0),
found AS (SELECT repeat_id, f1.frame_id, CAST(sign AS INTEGER) AS sign, CAST(connectivity AS INTEGER) AS connectivity, component_id, n AS pixel_count, c0 AS col_min, c1 AS col_max, r0 AS row_min, r1 AS row_max, (c0-1)*2.0-1 AS x_min_mm, (c1-1)*2.0+1 AS x_max_mm, y0 AS y_min_mm, y1 AS y_max_mm, n*3.0 AS area_mm2, n/CAST((c1-c0+1)*(r1-r0+1) AS DOUBLE) AS fill, lx AS lx_mm, lx/4 AS lx_over_delta, y0*10 AS y_min_plus, y1*10 AS y_max_plus, y0*10 <= 60 AS pass_lower, y1*10 >= 10 AS pass_upper, c0 = 1 AS touches_upstream, c1 = 8 AS touches_downstream, r0 = 1 AS touches_wall, r1 = 4 AS touches_top, bad AS touches_invalid, false AS touches_exclusion, code > 0 AS is_censored, CAST(code AS INTEGER) AS censor_code, false AS edge_rejected, lx/4 > 0.4 AND y0*10 <= 60 AND y1*10 >= 10 AS is_ss FROM f1 JOIN reps ON reps.frame_id = f1.frame_id)"""


CATALOG = "repeat_id frame_id sign connectivity component_id pixel_count col_min col_max row_min row_max x_min_mm~ x_max_mm~ y_min_mm~ y_max_mm~ area_mm2~ fill~ lx_mm~ lx_over_delta~ y_min_plus~ y_max_plus~ pass_lower pass_upper touches_upstream touches_downstream touches_wall touches_top touches_invalid touches_exclusion is_censored censor_code edge_rejected is_ss"
FOUND = f"{SMP}, lv AS (SELECT *, CASE j WHEN 1 THEN 0.10 WHEN 2 THEN 0.11 WHEN 3 THEN 0.12 ELSE 0.13 END AS level FROM smp), {catalog('lv')}"


def retained(rows: str) -> str:
    """View fold: of each group of `rows` one choice after the other, longest first; kept boxes are carried along."""
    return f"""rk AS (SELECT *, row_number() OVER (PARTITION BY frame_id, connectivity, sign ORDER BY lx_over_delta DESC, pixel_count DESC, component_id) AS p FROM {rows} WHERE is_ss AND NOT is_censored),
fold AS (SELECT frame_id, connectivity, sign, p, component_id, true AS kept, [struct_pack(a := col_min, b := col_max, c := row_min, d := row_max)] AS held FROM rk WHERE p = 1
 UNION ALL SELECT rk.frame_id, rk.connectivity, rk.sign, rk.p, rk.component_id, len(list_filter(held, lambda o: rk.col_min <= o.b AND rk.col_max >= o.a AND rk.row_min <= o.d AND rk.row_max >= o.c)) = 0, CASE WHEN len(list_filter(held, lambda o: rk.col_min <= o.b AND rk.col_max >= o.a AND rk.row_min <= o.d AND rk.row_max >= o.c)) = 0 THEN list_append(held, struct_pack(a := rk.col_min, b := rk.col_max, c := rk.row_min, d := rk.row_max)) ELSE held END FROM fold JOIN rk ON rk.frame_id = fold.frame_id AND rk.connectivity = fold.connectivity AND rk.sign = fold.sign AND rk.p = fold.p+1)"""


CHOSEN = f"""{SMP}, {MEANS}, rms AS (SELECT s.j, sqrt(avg((u-m)*(u-m))) AS level FROM smp s JOIN (SELECT j, i, avg(u) AS m FROM smp GROUP BY j, i) a ON s.j = a.j AND s.i = a.i GROUP BY s.j),
lv AS (SELECT s.repeat_id, s.frame_id, s.j, s.i, u-mu AS u, level FROM smp s JOIN rm ON s.repeat_id = rm.repeat_id AND s.j = rm.j AND s.i = rm.i JOIN rms ON rms.j = s.j),
{catalog('lv')}, {retained('found')},
chosen AS (SELECT found.* REPLACE (CASE WHEN is_censored THEN is_ss ELSE coalesce(kept, false) END AS is_ss), coalesce(kept, false) AS kept, coalesce(NOT kept, false) AS suppressed FROM found LEFT JOIN fold f ON f.frame_id = found.frame_id AND f.connectivity = found.connectivity AND f.sign = found.sign AND f.component_id = found.component_id)"""
TIERS = (0.4, 0.8, 1.6)
SUMS = ", ".join(f"count(CASE WHEN is_ss AND lx_over_delta > {t} THEN 1 END) AS ss_{k}, count(CASE WHEN is_ss AND lx_over_delta > {t} AND NOT is_censored THEN 1 END) AS complete_{k}" for k, t in enumerate(TIERS))
WINDOWS = "o AS (SELECT * FROM chosen WHERE connectivity = 8 AND is_ss), tg AS (SELECT *, col_max-col_min+1 AS w FROM o WHERE NOT is_censored), cand AS (SELECT t.frame_id, t.sign, t.component_id, t.col_min, w, k AS st FROM tg t, range(1, 9) r(k) WHERE k <= 8-w+1 AND NOT EXISTS (SELECT 1 FROM o WHERE o.frame_id = t.frame_id AND t.row_min <= o.row_max AND t.row_max >= o.row_min AND k <= o.col_max AND k+w-1 >= o.col_min)), ck AS (SELECT *, row_number() OVER (PARTITION BY frame_id, sign, component_id ORDER BY abs(st-col_min), st) AS p, count(*) OVER (PARTITION BY frame_id, sign, component_id) AS n FROM cand)"
MATCHED = "SELECT tg.frame_id, tg.sign, tg.component_id, tg.col_min, tg.col_max, row_min, row_max, CAST(st AS INTEGER) AS window_min, CAST(st+tg.w-1 AS INTEGER) AS window_max, CAST(st-tg.col_min AS INTEGER) AS center_shift, st IS NOT NULL AS matched, CAST(CASE WHEN st IS NULL THEN 1 ELSE 0 END AS INTEGER) AS reason, CAST(coalesce(n, 0) AS INTEGER) AS candidates FROM tg LEFT JOIN ck ON ck.frame_id = tg.frame_id AND ck.sign = tg.sign AND ck.component_id = tg.component_id AND ck.p = 1"

SWEPT = f"""{SMP}, px AS (SELECT frame_id, a AS alpha, connectivity, sg AS sign, j, i FROM smp, (VALUES (0.5),(1.0),(1.5)) x(a), {SIGNS}, {BOTH} WHERE sg*(u/0.12) >= a),
{labels('px', 'lab', 'frame_id, alpha, connectivity, sign', 'r.connectivity')},
pc AS (SELECT frame_id, alpha, connectivity, sign, id, count(*) AS n FROM lab GROUP BY ALL), pb AS (SELECT *, max(n) OVER (PARTITION BY frame_id, alpha, connectivity) AS big FROM pc),
pm AS (SELECT frame_id, alpha, connectivity, count(*) AS components, sum(n)/32.0 AS occupancy, max(n)/CAST(sum(n) AS DOUBLE) AS largest_share, coalesce(sum(CASE WHEN n < big THEN n*n END)/CAST(sum(CASE WHEN n < big THEN n END) AS DOUBLE), 0) AS susceptibility FROM pb GROUP BY ALL)"""

GEOMETRY = "repeat_id frame_id structure_id sign component_id pixel_count area_mm2~ centroid_x_mm~ centroid_y_mm~ weighted_x_mm~ weighted_y_mm~ weight_sum~ weight_mean~ x_min_mm~ x_max_mm~ y_min_mm~ y_max_mm~ length_mm~ height_mm~ aspect~ lx_over_delta~ ly_over_delta~ area_over_delta2~ u_mean~ peak~ is_lsm is_vlsm"


def regions(least: int, lsm: float, vlsm: float, keys: str = "frame_id") -> str:
    """Views gm and gs: geometry of the regions of lab (keys, sign, j, i, id) with the values of val (frame_id, j, i, u)."""
    return f"""gm AS (SELECT {', '.join('l.' + k for k in keys.split(', '))}, l.sign, l.id, count(*) AS n, avg(2.0*(l.i-1)) AS cx, avg(0.5*l.j*l.j) AS cy, sum(greatest(sign*u, 0)*2.0*(l.i-1))/nullif(sum(greatest(sign*u, 0)), 0) AS wx, sum(greatest(sign*u, 0)*0.5*l.j*l.j)/nullif(sum(greatest(sign*u, 0)), 0) AS wy, sum(greatest(sign*u, 0)) AS ws, avg(greatest(sign*u, 0)) AS wm, min(2.0*(l.i-1)) AS x0, max(2.0*(l.i-1)) AS x1, min(0.5*l.j*l.j) AS y0, max(0.5*l.j*l.j) AS y1, avg(u) AS um, max(abs(u)) AS peak FROM lab l JOIN val v ON v.frame_id = l.frame_id AND v.j = l.j AND v.i = l.i GROUP BY {', '.join('l.' + k for k in keys.split(', '))}, l.sign, l.id HAVING count(*) >= {least}),
gs AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY sign DESC, id) AS structure_id, row_number() OVER (PARTITION BY {keys}, sign ORDER BY id) AS component_id, x1-x0+2.0 AS len, y1-y0+2.5 AS hei FROM gm),
gt AS (SELECT {keys}, structure_id, CAST(sign AS INTEGER) AS sign, component_id, n AS pixel_count, n*5.0 AS area_mm2, cx AS centroid_x_mm, cy AS centroid_y_mm, wx AS weighted_x_mm, wy AS weighted_y_mm, ws AS weight_sum, wm AS weight_mean, x0 AS x_min_mm, x1 AS x_max_mm, y0 AS y_min_mm, y1 AS y_max_mm, len AS length_mm, hei AS height_mm, greatest(len, hei)/least(len, hei) AS aspect, len/4 AS lx_over_delta, hei/4 AS ly_over_delta, n*5.0/16 AS area_over_delta2, um AS u_mean, peak, len/4 >= {lsm} AS is_lsm, len/4 >= {vlsm} AS is_vlsm FROM gs)"""


REPEATS = "reps AS (SELECT DISTINCT repeat_id, frame_id FROM smp)"
OBJECTS = f"{SMP}, {REPEATS}, val AS (SELECT frame_id, j, i, sign(u)*abs(u*v)/0.0144 AS u FROM smp WHERE u IS NOT NULL), px AS (SELECT frame_id, sg AS sign, j, i FROM val, {SIGNS} WHERE sg*u >= 1), {labels('px', 'lab', 'frame_id, sign', '4')}, {regions(1, 1.0, 3.0)}"


def held(sets: str) -> str:
    """Views up to lab of hysteresis regions: sets (s, alpha, seed, connectivity), a closing of radius 1, holes of at most two pixels."""
    at = "a.s = b.s AND a.frame_id = b.frame_id AND a.sign = b.sign"
    same = f"{at} AND a.j = b.j AND a.i = b.i"
    keys = "s, connectivity, frame_id, sign"
    return f"""{SMP}, {REPEATS}, val AS (SELECT frame_id, j, i, u FROM smp WHERE u IS NOT NULL), sets AS (SELECT * FROM (VALUES {sets}) t(s, alpha, seed, connectivity)),
allpx AS (SELECT s, connectivity, frame_id, sg AS sign, j, i, u, alpha, seed FROM smp, sets, {SIGNS}),
wk AS (SELECT * FROM allpx WHERE sign*(u/0.12) >= alpha), {labels('wk', 'wl', keys, 'r.connectivity')},
core AS (SELECT DISTINCT b.s, b.frame_id, b.sign, b.id FROM wk a JOIN wl b ON {same} WHERE a.sign*(u/0.12) >= seed),
raw AS (SELECT a.* FROM wl a JOIN core b ON {at} AND a.id = b.id),
wide AS (SELECT DISTINCT s, connectivity, frame_id, sign, b.j, b.i FROM raw a, (SELECT x.j, y.i FROM (VALUES (1),(2),(3),(4)) x(j), range(1, 9) y(i)) b WHERE abs(a.j-b.j) <= 1 AND abs(a.i-b.i) <= 1),
cls AS (SELECT a.s, a.connectivity, a.frame_id, a.sign, a.j, a.i FROM wide a JOIN wide b ON {at} AND abs(a.j-b.j) <= 1 AND abs(a.i-b.i) <= 1 GROUP BY a.s, a.connectivity, a.frame_id, a.sign, a.j, a.i HAVING count(*) = 9),
new AS (SELECT a.* FROM cls a JOIN val v ON v.frame_id = a.frame_id AND v.j = a.j AND v.i = a.i WHERE NOT EXISTS (SELECT 1 FROM raw b WHERE {same})), {labels('new', 'nl', keys, 'r.connectivity')},
fill1 AS (SELECT s, connectivity, frame_id, sign, j, i FROM (SELECT *, count(*) OVER (PARTITION BY {keys}, id) AS n FROM nl) q WHERE n <= 2),
m1 AS (SELECT s, connectivity, frame_id, sign, j, i FROM raw UNION SELECT * FROM fill1),
inv AS (SELECT s, connectivity, frame_id, sign, j, i, u FROM allpx a WHERE NOT EXISTS (SELECT 1 FROM m1 b WHERE {same}) AND EXISTS (SELECT 1 FROM m1 b WHERE {at})), {labels('inv', 'il', keys, '12-r.connectivity')},
hole AS (SELECT s, connectivity, frame_id, sign, j, i FROM (SELECT a.*, count(*) OVER w AS n, bool_or(a.j IN (1, 4) OR a.i IN (1, 8) OR b.u IS NULL) OVER w AS opened FROM il a JOIN inv b ON {same} WINDOW w AS (PARTITION BY a.s, a.connectivity, a.frame_id, a.sign, a.id)) q WHERE n <= 2 AND NOT opened),
made AS (SELECT * FROM m1 UNION SELECT * FROM hole),
m2 AS (SELECT a.* FROM made a WHERE NOT EXISTS (SELECT 1 FROM made b WHERE a.s = b.s AND a.frame_id = b.frame_id AND a.j = b.j AND a.i = b.i AND b.sign = -a.sign AND NOT EXISTS (SELECT 1 FROM raw c WHERE c.s = b.s AND c.frame_id = b.frame_id AND c.sign = b.sign AND c.j = b.j AND c.i = b.i) AND EXISTS (SELECT 1 FROM raw c WHERE c.s = a.s AND c.frame_id = a.frame_id AND c.sign = a.sign AND c.j = a.j AND c.i = a.i))),
m3 AS (SELECT a.* FROM m2 a JOIN val v ON v.frame_id = a.frame_id AND v.j = a.j AND v.i = a.i WHERE NOT EXISTS (SELECT 1 FROM m2 b WHERE a.s = b.s AND a.frame_id = b.frame_id AND a.j = b.j AND a.i = b.i AND b.sign = -a.sign) OR CASE WHEN a.sign = 1 THEN u >= 0 ELSE u < 0 END),
{labels('m3', 'lab', keys, 'r.connectivity')}"""


HELD = f"{held('(0, 0.8, 1.4, 4)')}, {regions(2, 0.8, 1.6)}"
SETS = ", ".join(f"({k}, {a}, {b}, {c})" for k, (a, b, c) in enumerate((a, b, c) for a in (0.6, 0.9) for b in (0.8, 1.4) if b >= a for c in (4, 8)))
SENSITIVE = f"{held(SETS)}, {regions(2, 0.8, 1.6, 's, frame_id')}, gr AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY area_mm2 DESC, concat(frame_id, '-', structure_id)) AS p, count(*) OVER (PARTITION BY s) AS m FROM gt)"

MERGED = f"""{BOXES}, mk AS (SELECT *, row_number() OVER (PARTITION BY frame_id, sign ORDER BY x_min_mm, component_id) AS p FROM boxes),
fold AS (SELECT frame_id, sign, p, component_id AS structure_id, component_id AS grp, component_id AS head, x_max_mm AS stop, y_min_mm AS low, y_max_mm AS high FROM mk WHERE p = 1
 UNION ALL SELECT frame_id, sign, p, component_id, CASE WHEN near AND met THEN head ELSE component_id END, CASE WHEN near THEN head ELSE component_id END, CASE WHEN near AND met THEN greatest(stop, x_max_mm) WHEN near THEN stop ELSE x_max_mm END, CASE WHEN near AND met THEN least(low, y_min_mm) WHEN near THEN low ELSE y_min_mm END, CASE WHEN near AND met THEN greatest(high, y_max_mm) WHEN near THEN high ELSE y_max_mm END
 FROM (SELECT mk.frame_id, mk.sign, mk.p, mk.component_id, mk.x_max_mm, mk.y_min_mm, mk.y_max_mm, head, stop, low, high, mk.x_min_mm-stop <= 4.0 AS near, greatest(low, mk.y_min_mm) <= least(high, mk.y_max_mm) AS met FROM fold JOIN mk ON mk.frame_id = fold.frame_id AND mk.sign = fold.sign AND mk.p = fold.p+1) q)"""

GREEDY = f"""{PAIRS}, sn AS (SELECT frame_id, box_id, row_number() OVER (PARTITION BY frame_id ORDER BY box_id) AS p FROM bx WHERE connectivity = 4),
best AS (SELECT frame_id, seen_id, list(found_id ORDER BY box_iou DESC, found_id) FILTER (box_iou >= 0.3) AS likes FROM pm GROUP BY frame_id, seen_id),
turn AS (SELECT sn.frame_id, p, coalesce(likes, []) AS likes FROM sn LEFT JOIN best ON best.frame_id = sn.frame_id AND best.seen_id = sn.box_id),
fold AS (SELECT DISTINCT frame_id, CAST(0 AS BIGINT) AS p, CAST([] AS BIGINT[]) AS taken FROM bx
 UNION ALL SELECT turn.frame_id, turn.p, CASE WHEN len(list_filter(likes, lambda x: NOT list_contains(taken, x))) > 0 THEN list_append(taken, list_filter(likes, lambda x: NOT list_contains(taken, x))[1]) ELSE taken END FROM fold JOIN turn ON turn.frame_id = fold.frame_id AND turn.p = fold.p+1),
hits AS (SELECT frame_id, max(len(taken)) AS tp FROM fold GROUP BY frame_id),
cnt AS (SELECT frame_id, count(*) FILTER (connectivity = 8) AS nf, count(*) FILTER (connectivity = 4) AS ns FROM bx GROUP BY frame_id),
gi AS (SELECT cnt.frame_id, CAST(tp AS BIGINT) AS tp, CAST(nf-tp AS BIGINT) AS fp, CAST(ns-tp AS BIGINT) AS fn FROM cnt JOIN hits ON hits.frame_id = cnt.frame_id)"""

#: All one-to-one choices of eligible pairs of a frame, found box by found box; key: the annotated box of each, -1 for
#: none. Of the best ones the smallest key is chosen.
ASSIGNED = f"""{PAIRS}, {FRAMES}, el AS (SELECT *, {PAIR_SCORE} AS score, dense_rank() OVER (PARTITION BY frame_id ORDER BY found_id) AS p FROM pm WHERE eligible),
moves AS (SELECT frame_id, p, seen_id, score FROM el UNION ALL SELECT DISTINCT frame_id, p, -1, 0 FROM el),
ways AS (SELECT DISTINCT frame_id, CAST(0 AS BIGINT) AS p, CAST([] AS BIGINT[]) AS key, CAST(0 AS DOUBLE) AS score FROM el
 UNION ALL SELECT w.frame_id, m.p, list_append(key, m.seen_id), w.score+m.score FROM ways w JOIN moves m ON m.frame_id = w.frame_id AND m.p = w.p+1 AND (m.seen_id = -1 OR NOT list_contains(key, m.seen_id))),
tops AS (SELECT frame_id, max(p) AS p, max(score) AS score FROM ways GROUP BY frame_id),
first AS (SELECT ways.frame_id, min(key) AS key FROM ways JOIN tops ON ways.frame_id = tops.frame_id AND ways.p = tops.p AND ways.score >= tops.score-1e-9 GROUP BY ways.frame_id),
chosen AS (SELECT el.* FROM (SELECT frame_id, unnest(key) AS seen_id, generate_subscripts(key, 1) AS p FROM first) k JOIN el ON el.frame_id = k.frame_id AND el.p = k.p AND el.seen_id = k.seen_id),
won AS (SELECT frame_id, sum(score) AS score, count(*) AS n, count(*) FILTER (sign_match) AS tp FROM chosen GROUP BY frame_id)"""
SCORED = f"""{ASSIGNED}, sf AS (SELECT f.frame_id, count(b.box_id) FILTER (connectivity = 8) AS found, count(b.box_id) FILTER (connectivity = 4) AS seen, coalesce(max(n), 0) AS pairs, coalesce(max(tp), 0) AS tp FROM frames f LEFT JOIN bx b ON b.frame_id = f.frame_id LEFT JOIN won w ON w.frame_id = f.frame_id GROUP BY f.frame_id),
sp AS (SELECT *, CASE WHEN found > 0 THEN tp/CAST(found AS DOUBLE) WHEN seen = 0 THEN 1.0 ELSE 0.0 END AS precision, CASE WHEN seen > 0 THEN tp/CAST(seen AS DOUBLE) WHEN found = 0 THEN 1.0 ELSE 0.0 END AS recall FROM sf)"""


def series(rows: str, keys: str, order: str, value: str, name: str) -> str:
    """View `name` (keys, t, n, y): value in order, numbered from 0, gaps filled linearly and the ends with the nearest."""
    w = f"PARTITION BY {keys} ORDER BY t"
    return f"""{name}_0 AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY {order})-1 AS t, count(*) OVER (PARTITION BY {keys}) AS n, count({value}) OVER (PARTITION BY {keys}) AS ok, {value} AS y FROM {rows}),
{name}_1 AS (SELECT *, last_value(y IGNORE NULLS) OVER a AS y0, last_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t0, first_value(y IGNORE NULLS) OVER b AS y1, first_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t1 FROM {name}_0 WINDOW a AS ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{name} AS (SELECT {keys}, t, n, ok, CASE WHEN y IS NOT NULL THEN y WHEN y0 IS NULL THEN y1 WHEN y1 IS NULL THEN y0 ELSE y0+(y1-y0)*(t-t0)/(t1-t0) END AS y FROM {name}_1)"""


def detrended(rows: str, keys: str, name: str) -> str:
    return f"{name} AS (SELECT {keys}, t, n, ok, y-avg(y) OVER w-coalesce(regr_slope(y, t) OVER w, 0)*(t-avg(t) OVER w) AS y FROM {rows} WINDOW w AS (PARTITION BY {keys}))"


def blocks(rows: str, keys: str, name: str, nfft: int = 64) -> str:
    """View `name` (keys, b, f, c, s): sums of Hann-windowed values times cos and sin, by half-overlapping block."""
    return f"{name} AS (SELECT {keys}, b, f, sum(y*(0.5-0.5*cos(2*pi()*(t-b*{nfft // 2})/{nfft}))*cos(2*pi()*f*(t-b*{nfft // 2})/{nfft})) AS c, sum(y*(0.5-0.5*cos(2*pi()*(t-b*{nfft // 2})/{nfft}))*sin(2*pi()*f*(t-b*{nfft // 2})/{nfft})) AS s FROM {rows}, range(100000) bb(b), range({nfft // 2 + 1}) ff(f) WHERE b <= (n-{nfft})//{nfft // 2} AND t BETWEEN b*{nfft // 2} AND b*{nfft // 2}+{nfft - 1} GROUP BY {keys}, b, f)"


SIDES = "CASE WHEN f IN (0, 32) THEN 1 ELSE 2 END/(16.0*24)"
WELCH = f"{SMP}, {series('smp', 'j, i', 'frame_id', 'u', 'sr')}, {detrended('sr', 'j, i', 'dt')}, {blocks('dt', 'j, i', 'bk')}, ws AS (SELECT j, i, f/4.0 AS frequency, avg(c*c+s*s)*max({SIDES}) AS psd FROM bk GROUP BY j, i, f)"
TEMPORAL = f"{WELCH}, ts AS (SELECT j, frequency, avg(psd) AS psd, count(*) AS n, frequency*avg(psd) AS premultiplied FROM ws GROUP BY j, frequency)"
CROSS = f"{SMP}, three AS (SELECT * FROM smp), {series('three', 'j, i', 'frame_id', 'u', 'su')}, {series('three', 'j, i', 'frame_id', 'v', 'sv')}, {blocks('su', 'j, i', 'bu')}, {blocks('sv', 'j, i', 'bv')}, xs AS (SELECT bu.j, bu.i, bu.f, avg(bu.c*bv.c+bu.s*bv.s) AS re, avg(bu.s*bv.c-bu.c*bv.s) AS im, avg(bu.c*bu.c+bu.s*bu.s) AS pp, avg(bv.c*bv.c+bv.s*bv.s) AS qq FROM bu JOIN bv ON bu.j = bv.j AND bu.i = bv.i AND bu.b = bv.b AND bu.f = bv.f GROUP BY bu.j, bu.i, bu.f)"
SPATIAL = f"{SMP}, {series('smp', 'frame_id, j', 'i', 'u', 'sr')}, {detrended('sr', 'frame_id, j', 'dt')}, fx AS (SELECT frame_id, j, f, sum(y*(0.5-0.5*cos(2*pi()*t/8))*cos(2*pi()*f*t/8)) AS c, sum(y*(0.5-0.5*cos(2*pi()*t/8))*sin(2*pi()*f*t/8)) AS s FROM dt, range(1, 5) ff(f) WHERE ok >= 6 GROUP BY frame_id, j, f), xs AS (SELECT j, f/0.016 AS wavenumber, avg(c*c+s*s)*0.002/3*max(CASE WHEN f = 4 THEN 1 ELSE 2 END) AS psd, count(*) AS n FROM fx GROUP BY j, f)"

#: Three-node weights of d/dy: a central difference, and so much (t) of the combination that the constant and the line
#: don't see, that the radial functions are met as well.
RBF = f"""{GRADIENT}, ys AS (SELECT j, y_mm*1e-3 AS y FROM (SELECT DISTINCT j, y_mm FROM grid) g),
nd AS (SELECT j, lag(y) OVER w-y AS a, lead(y) OVER w-y AS b, 0.5/greatest(y-lag(y) OVER w, lead(y) OVER w-y) AS e FROM ys WINDOW w AS (ORDER BY j)),
ng AS (SELECT *, exp(-pow(e*a, 2)) AS g1, exp(-pow(e*b, 2)) AS g2, exp(-pow(e*(b-a), 2)) AS g3 FROM nd WHERE a IS NOT NULL AND b IS NOT NULL),
nt AS (SELECT *, (b*(2*e*e*a*g1-(g3-1)/(b-a))+(a-b)*(-(g2-g1)/(b-a))-a*(2*e*e*b*g2-(1-g3)/(b-a)))/(b*(b+(a-b)*g1-a*g3)+(a-b)*(b*g1+(a-b)-a*g2)-a*(b*g3+(a-b)*g2-a)) AS t FROM ng),
wt AS (SELECT j, j-1 AS k, -1/(b-a)+t*b AS w FROM nt UNION ALL SELECT j, j, t*(a-b) FROM nt UNION ALL SELECT j, j+1, 1/(b-a)-t*a FROM nt
 UNION ALL SELECT j, k, CASE WHEN k > j OR (k = j AND NOT first) THEN 1 ELSE -1 END/step FROM (SELECT nd.j, m.j AS k, nd.a IS NULL AS first, coalesce(nd.b, -nd.a) AS step FROM nd JOIN nd m ON (nd.a IS NULL AND m.j IN (nd.j, nd.j+1)) OR (nd.b IS NULL AND m.j IN (nd.j-1, nd.j))) q)"""

PRODUCED = f"{TRANSPORT}, {GRID}, uo AS (SELECT j, i, CASE WHEN ok THEN u_mean END AS u_mean FROM tr), gr AS (SELECT s.j, s.i, {CENTRAL} AS gradient FROM uo s JOIN grid g ON s.j = g.j AND s.i = g.i WINDOW w AS (PARTITION BY s.i ORDER BY s.j)), kp AS (SELECT a.j, a.i FROM tr a JOIN tr b ON abs(a.j-b.j) <= 1 AND abs(a.i-b.i) <= 2 GROUP BY a.j, a.i HAVING count(*) = 15 AND bool_and(b.ok))"
CLOSED = f"{TRANSPORT}, pt AS (SELECT o.j, o.i, count(*) AS n, sum(CASE WHEN a*b_ <> 0 THEN -a*b_ ELSE 0 END) AS parts, sum(-a*b_) AS stress FROM own o JOIN tr ON tr.j = o.j AND tr.i = o.i AND ok GROUP BY o.j, o.i)"
SLOPES = f"{FLOW}, lp AS (SELECT ln(j*0.5) AS x, avg(u_mean) AS y, row_number() OVER (ORDER BY j) AS n FROM flow GROUP BY j), sm AS (SELECT a.n, max(a.x) AS x, max(a.y) AS y, count(*) AS m, sum(b.x-a.x) AS s1, sum(pow(b.x-a.x, 2)) AS s2, sum(pow(b.x-a.x, 3)) AS s3, sum(pow(b.x-a.x, 4)) AS s4, sum(b.y) AS t0, sum((b.x-a.x)*b.y) AS t1, sum(pow(b.x-a.x, 2)*b.y) AS t2 FROM lp a JOIN lp b ON abs(a.n-b.n) <= 2 GROUP BY a.n)"
#: Traces of the covariance of snapshots (dof: u, then v) and of its square: sums of eigenvalues and of their squares.
TRACES = f"{SMP}, dofs AS (SELECT frame_id, (j-1)*8+i AS k, coalesce(u, 0) AS x FROM smp UNION ALL SELECT frame_id, 32+(j-1)*8+i, coalesce(v, 0) FROM smp), cv AS (SELECT a.k AS p, b.k AS q, covar_pop(a.x, b.x)*count(*)/64 AS c FROM dofs a JOIN dofs b ON a.frame_id = b.frame_id GROUP BY a.k, b.k)"

SQL: dict[str, str] = {
    "find_structures": recursive(FOUND, "SELECT * FROM found", CATALOG),
    "section_detection_catalog": recursive(CHOSEN, "SELECT * FROM chosen", f"{CATALOG} kept suppressed"),
    "section_detection_frames": recursive(f"{CHOSEN}, every AS (SELECT DISTINCT frame_id FROM smp)", f"SELECT f.frame_id, CAST(sg AS INTEGER) AS sign, CAST(cn.connectivity AS INTEGER) AS connectivity, count(component_id) AS components, {SUMS} FROM every f CROSS JOIN {SIGNS} CROSS JOIN {BOTH} LEFT JOIN chosen b ON b.frame_id = f.frame_id AND b.sign = sg AND b.connectivity = cn.connectivity GROUP BY f.frame_id, sg, cn.connectivity", "frame_id sign connectivity components " + " ".join(f"{a}_{k}" for k in range(3) for a in ("ss", "complete"))),
    "section_detection_windows": recursive(f"{CHOSEN}, {WINDOWS}", MATCHED, "frame_id sign component_id col_min col_max row_min row_max window_min window_max center_shift matched reason candidates"),
    "percolation_sweep": recursive(SWEPT, "SELECT alpha, CAST(connectivity AS INTEGER) AS connectivity, avg(occupancy) AS occupancy, avg(largest_share) AS largest_share, avg(susceptibility) AS susceptibility, CAST(sum(components) AS BIGINT) AS components FROM pm GROUP BY alpha, connectivity", "alpha~ connectivity occupancy~ largest_share~ susceptibility~ components"),
    "quadrant_objects": recursive(OBJECTS, "SELECT repeat_id, gt.* FROM gt JOIN reps ON reps.frame_id = gt.frame_id", GEOMETRY),
    "hysteresis_structures": recursive(HELD, "SELECT repeat_id, gt.* FROM gt JOIN reps ON reps.frame_id = gt.frame_id", GEOMETRY),
    "sensitivity_sweep": recursive(f"{SENSITIVE}, ha AS ({hazen_sql('SELECT * FROM gt', 's', 'area_mm2', {'median_area': 0.5, 'p90_area': 0.9})}), hb AS ({hazen_sql('SELECT * FROM gt', 's', 'aspect', {'median_aspect': 0.5, 'p95_aspect': 0.95})})", 'SELECT CAST(gr.s AS INTEGER) AS "set", count(*) AS n, avg(area_mm2) AS mean_area, sum(area_mm2) AS total_area, avg(aspect) AS mean_aspect, count(*) FILTER (pixel_count <= 4)/CAST(count(*) AS DOUBLE) AS small_share, sum(CASE WHEN p <= greatest(1, round(m*CAST(0.1 AS DOUBLE))) THEN area_mm2 ELSE 0 END)/sum(area_mm2) AS tail_share, count(*) FILTER (is_lsm) AS lsm, count(*) FILTER (is_vlsm) AS vlsm, max(lx_over_delta) AS max_length, max(median_area) AS median_area, max(p90_area) AS p90_area, max(median_aspect) AS median_aspect, max(p95_aspect) AS p95_aspect FROM gr JOIN ha ON ha.s = gr.s JOIN hb ON hb.s = gr.s GROUP BY gr.s', '"set" n mean_area~ total_area~ mean_aspect~ small_share~ tail_share~ lsm vlsm max_length~ median_area~ p90_area~ median_aspect~ p95_aspect~'),
    "retain_nonoverlapping": recursive(f"{BOXES}, {retained('boxes')}", "SELECT b.component_id, coalesce(kept, false) AS kept, coalesce(NOT kept, false) AS suppressed FROM boxes b LEFT JOIN fold f ON f.component_id = b.component_id", "component_id kept suppressed"),
    "merge_streamwise": recursive(MERGED, 'SELECT structure_id, grp AS "group" FROM fold', 'structure_id "group"'),
    "greedy_iou": recursive(GREEDY, "SELECT * FROM gi", "frame_id tp fp fn"),
    "f_scores": recursive(f"{GREEDY}, t AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM gi)", "SELECT *, tp/CAST(tp+fp AS DOUBLE) AS precision, tp/CAST(tp+fn AS DOUBLE) AS recall, 2*tp/CAST(2*tp+fp+fn AS DOUBLE) AS f1 FROM t", "tp fp fn precision~ recall~ f1~"),
    "assign_pairs": recursive(ASSIGNED, "SELECT frame_id, found_id, seen_id, score FROM chosen", "frame_id found_id seen_id score~"),
    "score_frames": recursive(SCORED, "SELECT *, CASE WHEN precision+recall > 0 THEN 2*precision*recall/(precision+recall) ELSE CASE WHEN precision+recall = 0 THEN 1.0 END END AS f1, CASE WHEN pairs > 0 THEN tp/CAST(pairs AS DOUBLE) ELSE 1.0 END AS sign_accuracy FROM sp", "frame_id found seen pairs tp precision~ recall~ f1~ sign_accuracy~"),
    "welch_series": final(WELCH, "SELECT * FROM ws", "j i frequency~ psd~"),
    "temporal_spectra": final(TEMPORAL, "SELECT * FROM ts", "j frequency~ psd~ n premultiplied~"),
    "spectral_peak": final(TEMPORAL, "SELECT j, arg_max(frequency, premultiplied) AS frequency, max(premultiplied) AS peak FROM ts WHERE frequency > 0 GROUP BY j", "j frequency~ peak~"),
    "cross_spectra": final(CROSS, f"SELECT j, i, f/4.0 AS frequency, re*{SIDES} AS re, im*{SIDES} AS im, (re*re+im*im)/(pp*qq) AS coherence FROM xs", "j i frequency~ re~ im~ coherence~"),
    "spatial_spectra": final(SPATIAL, "SELECT *, wavenumber*psd AS premultiplied FROM xs", "j wavenumber~ psd~ n premultiplied~"),
    "spatial_peak": final(SPATIAL, "SELECT j, arg_max(wavenumber, wavenumber*psd) AS frequency, max(wavenumber*psd) AS peak FROM xs GROUP BY j", "j frequency~ peak~"),
    "gradient_rbf": final(RBF, "SELECT st.j, st.i, CASE WHEN bool_and(s.u_mean IS NOT NULL) THEN sum(w*s.u_mean) END AS gradient FROM stats st JOIN wt ON wt.j = st.j JOIN stats s ON s.j = wt.k AND s.i = st.i GROUP BY st.j, st.i", "j i gradient~"),
    "section_production_inside": final(PRODUCED, "SELECT tr.j, tr.i, CASE WHEN ok THEN total_uv END*gradient AS production FROM tr JOIN gr ON tr.j = gr.j AND tr.i = gr.i JOIN kp ON kp.j = tr.j AND kp.i = tr.i", "j i production~"),
    "section_transport_closure": final(CLOSED, "SELECT count(*) AS points, max(abs((parts-stress)/n)) AS max_abs FROM pt", "points max_abs~"),
    "local_slope": final(SLOPES, "SELECT x, y, CASE WHEN m = 5 THEN (5*(t1*s4-t2*s3)-t0*(s1*s4-s3*s2)+s2*(s1*t2-s2*t1))/(5*(s2*s4-s3*s3)-s1*(s1*s4-s3*s2)+s2*(s1*s3-s2*s2)) END AS slope FROM sm", "x~ y~ slope~", 4),
    "pod_traces": final(TRACES, "SELECT sum(CASE WHEN p = q THEN c END) AS total, sum(c*c) AS squared FROM cv", "total~ squared~"),
}
