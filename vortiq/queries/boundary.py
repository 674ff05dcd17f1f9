"""Queries on boundary-layer parameters and wall friction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import hazen
from ..operators import boundary as B
from ..operators import wall
from ..plans.views import FLOW, final, flow, rounded
from .relational import hazen_sql

H, DY, NU, EDGE = 0.5, 1.0, 1.48e-5, 25.0
R = 2


def profile(s, d):
    return B.velocity_profile(flow(s, d), "u_mean", 3, 9)


def integral(s, d):
    return B.integral_params(flow(s, d), H, DY)


def state(s, d):
    """Streamwise state at x = 20 i, in millimetres; columns 3 and 4 lie in the polluted part."""
    return integral(s, d).select((F.col("i") * 20.0).alias("x"), "theta", F.col("u_edge").alias("ue"), "delta_star")


def ends(s):
    return s.createDataFrame([(x,) for x in (60.0, 110.0, 203.0, 250.0, 30.0)], "x_end double")


def scan(s, d):
    return B.clauser_scan(B.numbered(profile(s, d).withColumn("k", F.lit(1)), ["k"]), ["k"], EDGE, NU, H, 0.65, 0.41, 5.0, (30.0, 300.0))


def smoothed(s, d):
    return wall.smooth_series(integral(s, d).select(F.lit("theta").alias("name"), (F.col("i") * 20.0).alias("x"), F.col("theta").alias("y")).unionByName(integral(s, d).select(F.lit("ue").alias("name"), (F.col("i") * 20.0).alias("x"), F.col("u_edge").alias("y"))), "name", 0.01, (60.0, 90.0))


def momentum(s, d):
    both = smoothed(s, d).groupBy("x").agg(*[F.max(F.when(F.col("name") == n, F.col(c))).alias(a) for n, c, a in (("theta", "smooth", "theta"), ("theta", "slope", "dtheta"), ("ue", "smooth", "ue"), ("ue", "slope", "due"))])
    return B.local_momentum(both.join(state(s, d).select("x", "delta_star"), "x").where("theta is not null"))


def log_profile(s, d):
    return flow(s, d).groupBy("j").agg(F.avg("u_mean").alias("u")).select(F.ln(F.col("j") * H).alias("x"), F.col("u").alias("y"))


def energies(s, d):
    return B.coherent_energy(flow(s, d).select("i", (F.col("j") * H).alias("y_mm"), (26.0 - F.col("u_mean")).alias("e")), ["i"], "e")


def chart(s, d):
    """Three curves side by side: the profile of every third column, from the first, second and third one on."""
    rows = flow(s, d).groupBy("j").agg(*[F.avg(F.when(F.col("i") % 3 == k, F.col("u_mean"))).alias(f"u{k}") for k in range(3)])
    return rows.select(F.col("j").cast("double").alias("c0"), F.col("u1").alias("c1"), F.when(F.col("j") <= 12, F.col("j") * 1.5).alias("c2"), F.col("u2").alias("c3"), (F.col("j") * 2.0).alias("c4"), F.col("u0").alias("c5"))


PROFILE = f"{FLOW}, prof AS (SELECT j, CASE WHEN count(*) = count(u_mean) THEN avg(u_mean) END AS u FROM flow WHERE i BETWEEN 3 AND 9 GROUP BY j)"
INTEGRAL = f"""{FLOW}, nb AS (SELECT i, u_mean AS u, row_number() OVER (PARTITION BY i ORDER BY j) AS n, row_number() OVER (PARTITION BY i ORDER BY u_mean DESC, j) AS tp FROM flow WHERE u_mean IS NOT NULL AND u_mean <> 0),
ed AS (SELECT i, avg(u) FILTER (tp <= 5) AS ue, count(*) AS pts, max(u) FILTER (n = 1) AS u1 FROM nb GROUP BY i HAVING count(*) >= 5),
rc AS (SELECT nb.i, min(n) AS reach FROM nb JOIN ed ON nb.i = ed.i WHERE u > 0.99*ue GROUP BY nb.i),
full_ AS (SELECT nb.i, u, n FROM nb UNION ALL SELECT i, u1*k/{R}.0, k-{R} FROM ed, range(1, {R + 1}) t(k)),
ip AS (SELECT f.i, max(ue) AS u_edge, (max(reach)+{R})*{H} AS delta99, sum(CASE WHEN n <= reach THEN 1-u/(0.99*ue) END)*{H} AS delta_star, sum(CASE WHEN n <= reach THEN u*(0.99*ue-u) END)*{H}/pow(max(0.99*ue), 2) AS theta FROM full_ f JOIN ed ON ed.i = f.i LEFT JOIN rc ON rc.i = f.i GROUP BY f.i)"""
STATE = f"{INTEGRAL}, sx AS (SELECT i*20.0 AS x, theta, u_edge AS ue, delta_star FROM ip)"
SECANT = f"""{STATE}, st AS (SELECT avg(x) AS xs, avg(theta) AS ts, avg(ue) AS us, avg(delta_star) AS ds FROM sx WHERE x >= 100 AND x < 150 AND theta IS NOT NULL),
en AS (SELECT xe_, x AS xe, theta AS te, ue AS ue, delta_star AS de FROM (SELECT xe_, sx.*, row_number() OVER (PARTITION BY xe_ ORDER BY abs(x-xe_), x) AS p FROM sx, (VALUES (60.0),(110.0),(203.0),(250.0),(30.0)) v(xe_) WHERE theta IS NOT NULL) q WHERE p = 1),
sc AS (SELECT CAST(xe_ AS DOUBLE) AS x_end, xe AS x_e, te AS theta_e, CASE WHEN (xe_ >= 60 AND xe_ < 90) OR (xe >= 60 AND xe < 90) THEN 'contaminated_endpoint' WHEN xe <= xs THEN 'invalid_interval' ELSE 'ok' END AS status, 2*(te-ts)/nullif(xe-xs, 0) AS zpg, 2*((ue*ue*te-us*us*ts)/((us*us+ue*ue)/2)+(ds+de)/2*(ue*ue-us*us)/(us*us+ue*ue))/nullif(xe-xs, 0) AS fullcf FROM en, st)"""
CALIBRATION = f"{STATE}, cl AS (SELECT x, theta, ue*ue AS u2, ue*ue*theta AS fl, delta_star AS ds, lag(ue*ue) OVER w AS u0, lag(ue*ue*theta) OVER w AS f0, lag(delta_star) OVER w AS d0 FROM sx WHERE x BETWEEN 80 AND 328 WINDOW w AS (ORDER BY x)), pc AS (SELECT x, (fl-f0)/((u2+u0)/2)+(ds+d0)/2*(u2-u0)/2/((u2+u0)/2) AS p FROM cl)"
SCAN = f"{PROFILE}, nn AS (SELECT u, row_number() OVER (ORDER BY j) AS n FROM prof WHERE u IS NOT NULL AND u <> 0), gr AS (SELECT k/100.0 AS number, sqrt((5e-3-2e-4*(k/100.0))*{EDGE}*{EDGE}/2) AS ut FROM range(2401) t(k)), rs AS (SELECT CAST(number AS DOUBLE) AS number, ut, u/ut-(ln(((n-1)*{H}+0.65)*1e-3*ut/{NU})/0.41+5.0) AS gap FROM nn, gr WHERE ((n-1)*{H}+0.65)*1e-3*ut/{NU} BETWEEN 30 AND 300), sn AS (SELECT number, sqrt(avg(gap*gap)) AS rmse, count(*) AS n_points, max(ut) AS u_tau FROM rs GROUP BY number HAVING count(*) >= 3)"

QUERIES = {
    "velocity_profile": (lambda s, d: rounded(profile(s, d)), final(PROFILE, "SELECT * FROM prof WHERE u IS NOT NULL", "j u~")),
    "edge_velocity": (lambda s, d: rounded(B.edge_velocity(flow(s, d).select("i", "j", F.col("u_mean").alias("u")), ["i"])), final(FLOW, "SELECT i, avg(u_mean) AS u_edge FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY u_mean DESC, j) AS p FROM flow) t WHERE p <= 5 GROUP BY i", "i u_edge~")),
    "integral_params": (lambda s, d: rounded(integral(s, d)), final(INTEGRAL, "SELECT i, u_edge, delta99, CASE WHEN delta99 IS NOT NULL THEN delta_star END AS delta_star, CASE WHEN delta99 IS NOT NULL THEN theta END AS theta, delta_star/nullif(theta, 0) AS shape FROM ip", "i u_edge~ delta99~ delta_star~ theta~ shape~")),
    "clauser_scan": (lambda s, d: rounded(scan(s, d).select("number", "rmse", "n_points", "u_tau")), final(SCAN, "SELECT * FROM sn", "number~ rmse~ n_points u_tau~")),
    "clauser_fit": (lambda s, d: rounded(B.clauser_fit(scan(s, d), ["k"], EDGE).drop("k")), final(SCAN, "SELECT number, rmse, u_tau, 2*pow(u_tau/25.0, 2) AS cf FROM sn ORDER BY round(rmse, 9), number LIMIT 1", "number~ rmse~ u_tau~ cf~")),
    "delta99": (lambda s, d: rounded(B.delta99(profile(s, d).select((F.col("j") * H).alias("y_mm"), "u"), 25.0)), final(f"{PROFILE}, nx AS (SELECT j*{H} AS y, u, lead(j*{H}) OVER (ORDER BY j) AS y1, lead(u) OVER (ORDER BY j) AS u1 FROM prof WHERE u IS NOT NULL)", "SELECT (SELECT y+(24.75-u)*(y1-y)/(u1-u) FROM nx WHERE u < 24.75 AND u1 >= 24.75 ORDER BY y LIMIT 1) AS delta99", "delta99~")),
    "secant_zpg": (lambda s, d: rounded(B.system_secant(state(s, d), ends(s), (100.0, 150.0), (60.0, 90.0))), final(SECANT, "SELECT x_end, x_e, theta_e, status, CASE WHEN status = 'ok' THEN zpg END AS cf FROM sc", "x_end~ x_e~ theta_e~ status cf~")),
    "secant_full": (lambda s, d: rounded(B.system_secant(state(s, d), ends(s), (100.0, 150.0), (60.0, 90.0), True)), final(SECANT, "SELECT x_end, x_e, theta_e, status, CASE WHEN status = 'ok' THEN fullcf END AS cf FROM sc", "x_end~ x_e~ theta_e~ status cf~")),
    "secant_calibration": (lambda s, d: rounded(B.calibration_secant(state(s, d))), final(CALIBRATION, "SELECT x, 2*s/(x-80) AS cf FROM (SELECT x, sum(p) OVER (ORDER BY x) AS s FROM pc) t WHERE x > 80", "x~ cf~")),
    "smooth_series": (lambda s, d: rounded(smoothed(s, d)), None),
    "local_momentum": (lambda s, d: rounded(momentum(s, d)), None),
    "momentum_quality": (lambda s, d: rounded(B.momentum_quality(momentum(s, d).where("x >= 100"), B.calibration_secant(state(s, d)))), None),
    "composite_fit": (lambda s, d: rounded(wall.composite_fit(profile(s, d).select(F.lit(1).alias("k"), (F.col("j") * H).alias("y_mm"), "u"), "k", NU), 3), None),
    "local_slope": (lambda s, d: rounded(B.local_slope(log_profile(s, d), "x", "y"), 4), None),
    "moving_mean": (lambda s, d: rounded(B.moving_mean(log_profile(s, d), "x", "y")), final(f"{FLOW}, lp AS (SELECT ln(j*{H}) AS x, avg(u_mean) AS y FROM flow GROUP BY j)", "SELECT x, y, avg(y) OVER (ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM lp", "x~ y~ smooth~")),
    "coherent_energy": (lambda s, d: rounded(energies(s, d)), final(f"{FLOW}, e AS (SELECT i, j*{H} AS y, 26.0-u_mean AS e FROM flow), p AS (SELECT i, y, coalesce((e+lag(e) OVER w)/2*(y-lag(y) OVER w), 0) AS a FROM e WINDOW w AS (PARTITION BY i ORDER BY y)), c AS (SELECT i, y, sum(a) OVER (PARTITION BY i ORDER BY y) AS c, sum(a) OVER (PARTITION BY i) AS t FROM p)", "SELECT i, max(t) AS energy, min(CASE WHEN c >= 0.9*t THEN y END) AS height FROM c GROUP BY i", "i energy~ height~")),
    "chart_curves": (lambda s, d: rounded(B.chart_curves(chart(s, d), 3)), final(FLOW, "SELECT CAST(2 AS INTEGER) AS number, CAST(j AS DOUBLE) AS x, avg(u_mean) AS u FROM flow WHERE i % 3 = 1 GROUP BY j UNION ALL SELECT 1, j*1.5, avg(u_mean) FROM flow WHERE i % 3 = 2 AND j <= 12 GROUP BY j UNION ALL SELECT 0, j*2.0, avg(u_mean) FROM flow WHERE i % 3 = 0 GROUP BY j", "number x~ u~")),
    "chart_value": (lambda s, d: rounded(B.chart_value(B.chart_curves(chart(s, d), 3), 0.25, s.createDataFrame([(3.3,), (10.0,), (17.25,)], "x double"))), final(f"{FLOW}, cv AS (SELECT 1 AS n, j*1.5 AS x, avg(u_mean) AS u FROM flow WHERE i % 3 = 2 AND j <= 12 GROUP BY j UNION ALL SELECT 0, j*2.0, avg(u_mean) FROM flow WHERE i % 3 = 0 GROUP BY j), sp AS (SELECT n, x AS x0, u AS u0, lead(x) OVER (PARTITION BY n ORDER BY x) AS x1, lead(u) OVER (PARTITION BY n ORDER BY x) AS u1 FROM cv)", "SELECT q AS x, sum((u0+(u1-u0)*(q-x0)/(x1-x0))*CASE WHEN n = 0 THEN 0.75 ELSE 0.25 END) AS u FROM sp, (VALUES (3.3),(10.0),(17.25)) v(q) WHERE q > x0 AND q <= x1 GROUP BY q", "x~ u~")),
    "percentile_hazen": (lambda s, d: rounded(hazen(flow(s, d), ["i"], "u_mean", {"low": 0.02, "high": 0.98})), final(FLOW, hazen_sql("SELECT * FROM flow", "i", "u_mean", {"low": 0.02, "high": 0.98}), "i low~ high~")),
}
