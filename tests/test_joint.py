"""Pairs of catalogs, gates, edge splines and the experiment's tables against plain versions."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from vortiq.operators import compare, wall
from vortiq.plans import experiment
from vortiq.plans.views import piv
from vortiq.queries import fields

KIND = "repeat_id int, frame_id long, sign int, structure_id long, pixel_count long, pixels array<struct<j:int,i:int>>"


def catalog(spark, sets):
    return spark.createDataFrame([(1, f, s, k, len(p), sorted(p)) for (f, s, k), p in sets.items()], KIND)


def test_pairs_of_catalogs(spark):
    line = lambda j, a, b: {(j, i) for i in range(a, b + 1)}
    before = {(1, 1, 1): line(1, 1, 4), (1, 1, 2): line(2, 1, 9), (1, 1, 3): line(3, 1, 2), (1, 1, 4): line(3, 4, 5), (1, -1, 1): line(4, 1, 3), (2, 1, 1): line(1, 1, 3)}
    after = {(1, 1, 1): line(1, 2, 6), (1, 1, 2): line(2, 1, 3), (1, 1, 3): line(2, 6, 8), (1, 1, 4): line(3, 1, 6), (1, 1, 9): line(4, 1, 3), (2, 1, 5): line(2, 1, 3)}
    got = {(r.frame_id, r.before, r.after): (r.kind, r.shared) for r in compare.paired(catalog(spark, before), catalog(spark, after)).collect() if r.sign == 1}
    assert got == {(1, 1, 1): ("kept", 3), (1, 2, 2): ("split", 3), (1, 2, 3): ("split", 3), (1, 3, 4): ("joined", 2), (1, 4, 4): ("joined", 2), (1, None, 9): ("new", 0), (2, 1, None): ("lost", 0), (2, None, 5): ("new", 0)}
    rows = compare.paired(catalog(spark, before), catalog(spark, after), 0.8)
    assert {(r.before, r.after) for r in rows.where("kind = 'kept' and frame_id = 1").collect()} == set() and rows.where("before = 1 and frame_id = 1 and sign = 1").first().kind == "lost"
    assert compare.paired(catalog(spark, before).limit(0), catalog(spark, after)).groupBy("kind").count().collect()[0]["kind"] == "new"


def test_gates_one_by_one(spark):
    rng = np.random.default_rng(3)
    u = {(f, j, i): None if rng.random() < 0.1 else float(rng.normal()) for f, j, i in product((1, 2), range(1, 4), range(1, 7))}
    samples = spark.createDataFrame([(*k, v) for k, v in u.items()], "frame_id long, j int, i int, u double")
    scale = {1: 0.5, 2: 1.0, 3: 2.0}
    windows = [(1, 7, 1, 2, 4), (2, 8, -1, 1, 6), (2, 9, 1, 3, 3)]
    s = F.col("sign") * F.col("u")
    gates = {"alpha": s >= F.col("u_rms"), "floor": F.abs("u") >= 0.7}
    frame = spark.createDataFrame(windows, "frame_id long, box_id long, sign int, i0 int, i1 int")
    rms = spark.createDataFrame(list(scale.items()), "j int, u_rms double")
    for r in compare.gate_audit(frame, samples, rms, gates).collect():
        f, b, sign, lo, hi = next(w for w in windows if w[1] == r.box_id)
        px = [(sign * v >= scale[j], abs(v) >= 0.7) for (g, j, i), v in u.items() if g == f and lo <= i <= hi and v is not None]
        n = len(px)
        assert r.pixels == n and r.share_alpha == pytest.approx(sum(a for a, _ in px) / n) and r.share_all == pytest.approx(sum(a and b for a, b in px) / n)
        assert r.without_alpha == pytest.approx(sum(b for _, b in px) / n)
        gain = {"alpha": r.without_alpha - r.share_all, "floor": r.without_floor - r.share_all}
        assert r.binding == (None if max(gain.values()) == 0 else max(gain, key=gain.get))
    rows = {r.j: r for r in compare.gate_rows(frame, samples, rms, gates).collect()}
    for j in scale:
        px = [(sign * v >= scale[j], abs(v) >= 0.7) for f, b, sign, lo, hi in windows for (g, k, i), v in u.items() if g == f and k == j and lo <= i <= hi and v is not None]
        assert (rows[j].pixels, rows[j].passed, rows[j].only_alpha, rows[j].only_floor) == (len(px), sum(a and b for a, b in px), sum(b and not a for a, b in px), sum(a and not b for a, b in px))


def test_edge_velocity_spline(spark):
    x = np.arange(12.0)
    u = 10 + 0.5 * x + 0.01 * x**2
    u[[0, 6]] = np.nan
    u[11] = -1.0
    df = spark.createDataFrame([(1, float(a), None if np.isnan(b) else float(b)) for a, b in zip(x, u)], "k int, x double, u_edge double")
    got = {r.x: r for r in wall.edge_velocity_spline(df, "k", 1.0).collect()}
    assert all(got[float(k)].smooth is None and got[float(k)].raw is None for k in (0, 1, 10, 11)) and got[6.0].interpolated and got[6.0].raw is None
    assert got[6.0].smooth == pytest.approx(10 + 3 + 0.36, abs=0.02) and got[5.0].smooth == pytest.approx(u[5]) and got[5.0].slope == pytest.approx(0.6, abs=0.02)
    flat = {r.x: r for r in wall.edge_velocity_spline(df, "k", 1e-9).collect()}
    assert np.ptp([flat[float(k)].slope for k in range(2, 10)]) < 1e-6
    for bad in (df.where("x < 3"), df.withColumn("x", F.lit(1.0))):
        with pytest.raises(Exception):
            wall.edge_velocity_spline(bad, "k", 0.5).collect()
    knots, values = np.array([0.0, 1.0, 3.0, 4.0]), np.array([1.0, 2.0, 0.0, 1.0])
    a, slopes = wall.spline(knots, values, 0.7)
    back, turn = wall.between(knots, knots, a, slopes)
    assert np.allclose(back, a) and np.allclose(turn, slopes)


def test_twelve_tables_are_written(spark, sf, tmp_path):
    tables = experiment.experiment(piv(spark, sf), fields.SHAPE, fields.X, fields.Y, fields.HOW, [2, 3], [1.0, 1.4], 12, 8, 1.0)
    assert len(tables) == 12
    experiment.write_experiment(tables, str(tmp_path / "run"))
    for name, df in tables.items():
        wide = name in ("component_catalog", "frame_summary")
        back = spark.read.parquet(f"{tmp_path}/run/parquet/{name}") if wide else spark.read.option("header", "true").csv(f"{tmp_path}/run/csv/{name}")
        assert back.columns == df.columns and back.count() == df.count() > 0, name
