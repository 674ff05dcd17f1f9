"""Small flows with known results, and their edge cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vortiq.functions.phase import assign_phase
from vortiq.operators import boundary, domain, gradients, phase, quadrants, statistics, transport, wall
from vortiq.operators.statistics import paired

SCHEMA = "repeat_id int, frame_id long, j int, i int, u double, v double, valid boolean"
Y = [0.0, 1.0, 4.0, 9.0]


def rows(bad=()):
    """Two offset repeats of 16 frames on 4 x 2 points: a signal of period 4 and independent noise."""
    signal, noise = [-3, -1, 1, 3], [-0.5, 0.5, -0.5, 0.5]
    out = []
    for f in range(1, 33):
        r = 1 if f <= 16 else 2
        s, n = signal[(f - 1) % 4], noise[((f - 1) // 4) % 4]
        for j in range(1, 5):
            for i in (1, 2):
                u = (10 + s + n if r == 1 else 30 - s + n) + 2 * Y[j - 1]
                v = 2 - 2 * s - n if r == 1 else 8 + 2 * s - n
                out.append((r, f, j, i, float(u), float(v), (f, j, i) not in bad))
    return out


@pytest.fixture(scope="module")
def flow(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


def binned(df):
    return assign_phase(df, 16.0, 4.0, 4)


def test_repeat_centred_moments(spark, flow):
    got = statistics.mean_stats(flow, statistics.repeat_means(flow)).where("i = 1").orderBy("j").collect()
    for r, y in zip(got, Y):
        assert r.u_mean == pytest.approx(20 + 2 * y) and r.uu == pytest.approx(5.25) and r.vv == pytest.approx(20.25) and r.uv == pytest.approx(10.25)
        assert r.tke == pytest.approx(0.5 * 25.5 / 625)
    alone = statistics.mean_stats(flow.where("repeat_id = 1")).first()
    assert alone.uu == pytest.approx(5.25)


def test_transport(spark, flow):
    cells = transport.transport_cells(binned(flow), 2)
    got = transport.transport_stats(cells, 32, 0.7).collect()
    for r in got:
        assert r.total_uu == pytest.approx(5.25) and r.total_vv == pytest.approx(20.25) and r.total_uv == pytest.approx(10.25)
        assert r.coherent_uv == pytest.approx(10) and r.random_uv == pytest.approx(0.25)
    phases = transport.transport_phases(cells, transport.transport_stats(cells, 32, 0.7))
    assert {r.n for r in phases.collect()} == {8}
    for r in phases.collect():
        assert r.v_phase == pytest.approx(5) and r.u_phase == pytest.approx(20 + 2 * Y[r.j - 1])
    y = spark.createDataFrame([(j + 1, Y[j]) for j in range(4)], "j int, y_mm double")
    grad = gradients.d_dy(transport.transport_stats(cells, 32, 0.7).join(y, "j"), "u_mean")
    assert all(r.gradient == pytest.approx(2000) for r in grad.collect())
    rbf = gradients.d_dy_rbf(transport.transport_stats(cells, 32, 0.7).join(y, "j"), y, "u_mean")
    assert all(r.gradient == pytest.approx(2000) for r in rbf.collect())
    made = transport.production(transport.transport_stats(cells, 32, 0.7), grad)
    assert all(r.production == pytest.approx(20500) for r in made.collect())


def test_rejected_cell(spark):
    lost = {(5, 2, 1), (9, 2, 1), (13, 2, 1)}
    df = binned(spark.createDataFrame(rows(lost), SCHEMA))
    cells = transport.transport_cells(df, 2)
    got = transport.transport_stats(cells, 32, 0.7).where("j = 2 and i = 1").first()
    assert got["count"] == 28 and got.coherent_uv is not None
    assert cells.where("j = 2 and i = 1 and bin = 1").first().n == 4
    assert phase.phase_means(df, ["repeat_id", "bin"], 2).where("j = 2 and i = 1 and bin = 1 and repeat_id = 1").first().u_phase is None


def test_too_few_samples_are_not_accepted(spark):
    lost = {(f, 1, 1) for f in range(1, 31)}
    df = spark.createDataFrame(rows(lost), SCHEMA)
    got = statistics.mean_stats(df).where("j = 1 and i = 1").first()
    assert got.valid_count == 2 and not got.accepted and got.u_mean is None and got.uu is None


def test_not_finite_is_missing_in_both(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, float("nan"), 1.0, True), (1, 2, 1, 1, 2.0, float("inf"), True), (1, 3, 1, 1, 2.0, 3.0, False), (1, 4, 1, 1, 2.0, None, True), (1, 5, 1, 1, 4.0, 5.0, True)], SCHEMA)
    assert [(r.u, r.v) for r in paired(df).orderBy("frame_id").collect()] == [(None, None)] * 4 + [(4.0, 5.0)]


def test_phase_ties_take_the_first_centre(spark):
    df = spark.range(1, 9).select(F.col("id").alias("frame_id"))
    got = assign_phase(df, 8.0, 1.0, 4, 90.0).orderBy("frame_id").collect()
    assert [r.bin for r in got] == [1, 1, 2, 2, 3, 3, 4, 1]
    assert got[7].mechanical_deg == pytest.approx(45) and got[0].cycle == 1


def test_quadrants_are_strict(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 1.0), (1, 1, -1.0, 1.0), (1, 1, -2.0, 1.0), (1, 1, 0.0, 5.0)], "j int, i int, du double, dv double")
    scale = spark.createDataFrame([(1, 1, 1.0, 1.0)], "j int, i int, u_rms double, v_rms double")
    cells = quadrants.quadrant_cells(df, scale, [0.0, 1.0])
    got = {(r.hole, r.quadrant): r for r in quadrants.quadrant_stats(cells).collect()}
    assert got[0.0, 2].events == 2 and got[1.0, 2].events == 1 and got[1.0, 1].events == 0
    assert got[1.0, 1].probability == 0 and got[1.0, 1].conditional_mean is None and got[0.0, 2].n == 4


def test_domains(spark):
    mask = spark.createDataFrame([(j, i, not (j == 3 and i == 3)) for j in range(1, 6) for i in range(1, 6)], "j int, i int, ok boolean")
    kept = {(r.j, r.i) for r in domain.eroded(mask, 1, 1).where("kept").collect()}
    assert kept == set()
    whole = mask.withColumn("ok", F.lit(True))
    assert {(r.j, r.i) for r in domain.eroded(whole, 1, 1).where("kept").collect()} == {(j, i) for j in (2, 3, 4) for i in (2, 3, 4)}
    dead = spark.createDataFrame([(f, j, 1, 0.0 if j <= f else 1.0, 0.0) for f in (1, 2) for j in range(1, 5)], "frame_id long, j int, i int, u double, v double")
    assert domain.wall_rows(dead).first().crop == 2


def test_delta99_and_profile(spark):
    prof = spark.createDataFrame([(float(k), min(2.0 * k, 10.0)) for k in range(0, 8)], "y_mm double, u double")
    assert boundary.delta99(prof, 10.0).first().delta99 == pytest.approx(4.95)
    stats = spark.createDataFrame([(1, 1, 1.0), (1, 2, None), (2, 1, 2.0), (2, 2, 4.0)], "j int, i int, u_mean double")
    assert [(r.j, r.u) for r in boundary.velocity_profile(stats, "u_mean", 1, 2).collect()] == [(2, 3.0)]


def test_clauser_scan_finds_its_own_law(spark):
    tau, nu, h = math.sqrt((5e-3 - 2e-4 * 9.5) * 25**2 / 2), 1.48e-5, 0.5
    prof = spark.createDataFrame([(1, n, tau * (math.log(((n - 1) * h + 0.65) * 1e-3 * tau / nu) / 0.41 + 5.0)) for n in range(1, 12)], "k int, n int, u double")
    got = boundary.clauser_fit(boundary.clauser_scan(prof, ["k"], 25.0, nu, h, 0.65), ["k"], 25.0).first()
    assert got.number == pytest.approx(9.5) and got.rmse < 1e-9 and got.u_tau == pytest.approx(tau)


def test_smoothing_spline_limits():
    x = np.array([0.0, 1.0, 2.5, 3.0, 5.0, 6.0])
    y = np.array([1.0, 0.0, 2.0, 2.5, 1.0, 3.0])
    a, _ = wall.spline(x, y, 1.0)
    assert a == pytest.approx(y)
    a, s = wall.spline(x, y, 1e-12)
    assert a == pytest.approx(np.polyval(np.polyfit(x, y, 1), x), abs=1e-6) and s == pytest.approx(np.full(6, np.polyfit(x, y, 1)[0]), abs=1e-6)
    a, s = wall.spline(x, 2 * x + 1, 0.3)
    assert a == pytest.approx(2 * x + 1) and s == pytest.approx(np.full(6, 2.0))


def test_smoothing_spline_is_the_least():
    """A small change of the values can't lower misfit and curvature together."""
    x, p = np.arange(6.0), 0.4
    y = np.array([0.0, 2.0, 1.0, 3.0, 2.0, 5.0])

    def cost(a):
        h = np.diff(x)
        q = np.zeros((4, 6))
        r = np.zeros((4, 4))
        for k in range(4):
            q[k, k : k + 3] = 1 / h[k], -1 / h[k] - 1 / h[k + 1], 1 / h[k + 1]
            r[k, k] = (h[k] + h[k + 1]) / 3
            if k:
                r[k, k - 1] = r[k - 1, k] = h[k] / 6
        m = np.linalg.solve(r, q @ a)
        return p * ((y - a) ** 2).sum() + (1 - p) * m @ r @ m

    a, _ = wall.spline(x, y, p)
    base = cost(a)
    rng = np.random.default_rng(0)
    assert all(cost(a + 1e-3 * rng.standard_normal(6)) > base for _ in range(50))


def test_composite_fit_recovers_its_parameters(spark):
    y = np.geomspace(0.3, 60, 50)
    u = wall.composite(y, 1.0, 0.4, 30.0, 1.48e-5, 0.384, wall.musker(0.384, 4.17, 60e-3 * 3 / 1.48e-5 * 1.2))
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(y, u)], "k int, y_mm double, u double")
    got = wall.composite_fit(df, "k", 1.48e-5).first()
    assert got.u_tau == pytest.approx(1.0, rel=0.01) and got.delta_mm == pytest.approx(30, rel=0.05) and got.error < 0.005


def test_partitions_do_not_matter(spark, flow):
    a = statistics.mean_stats(flow.repartition(1), statistics.repeat_means(flow)).orderBy("j", "i").collect()
    b = statistics.mean_stats(flow.repartition(7), statistics.repeat_means(flow)).orderBy("j", "i").collect()
    for x, y in zip(a, b):
        assert x.uu == pytest.approx(y.uu, rel=1e-13)


def test_empty_samples(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert statistics.mean_stats(none).count() == 0
    assert transport.transport_cells(binned(none), 2).count() == 0
