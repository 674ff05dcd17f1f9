"""Spectra, correlations, modes, files, artifacts and streams."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from vortiq.operators import correlation, dynamic_modes, modal, spectra, spectral_modes
from vortiq.sources import cache, tecplot
from vortiq.streaming import moments as stream

SAMPLE = "repeat_id int, frame_id long, j int, i int, u double, v double, valid boolean"


def field(spark, u, v=None):
    """u[frame, j, i]"""
    v = np.zeros_like(u) if v is None else v
    return spark.createDataFrame([(1, f + 1, j + 1, i + 1, float(u[f, j, i]), float(v[f, j, i]), True) for f in range(u.shape[0]) for j in range(u.shape[1]) for i in range(u.shape[2])], SAMPLE)


def test_welch_holds_the_variance(spark):
    t = np.arange(512)
    u = np.sin(2 * np.pi * t * 8 / 64)[:, None, None]
    got = spectra.welch(field(spark, u), ["j", "i"], "u", 64, 64.0).toPandas()
    assert got.psd.sum() * 1.0 == pytest.approx(0.5, rel=0.01)
    assert got.frequency[got.psd.idxmax()] == 8.0
    gaps = u.copy()
    gaps[5] = np.nan
    assert spectra.welch(field(spark, gaps).withColumn("u", F.when(~F.isnan("u"), F.col("u"))), ["j", "i"], "u", 64, 64.0, min_valid=0.999).count() == 0


def test_periodogram_parseval():
    y = np.random.default_rng(2).standard_normal(100)
    f, p = spectra.periodogram(y, 0.5)
    w = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(100) / 100)
    assert (p.sum() * (f[1] - f[0])) == pytest.approx(((y * w) ** 2).sum() / (w**2).sum())


def test_spatial_spectrum_finds_the_wave(spark):
    u = np.sin(2 * np.pi * np.arange(32) * 4 / 32)[None, None, :].repeat(3, 0)
    got = spectra.spatial_spectra(field(spark, u), "u", 0.01).orderBy(F.desc("psd")).first()
    assert got.wavenumber == pytest.approx(4 / 0.32) and got.n == 3


def test_coherence_of_a_signal_with_itself(spark):
    u = np.random.default_rng(3).standard_normal((256, 1, 1))
    got = spectra.cross_spectra(field(spark, u, 2 * u), ["j", "i"], "u", "v", 64, 1.0).collect()
    assert all(r.coherence == pytest.approx(1) for r in got)


def test_correlation_bounds_and_convection(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(120)
    u = np.stack([np.roll(base, k) for k in range(6)], axis=1)[:, None, :]
    df = field(spark, u)
    lagged = correlation.space_time(df, 1, 1, 5)
    assert correlation.convection(lagged, 1, 2.0, 10.0, 0.8).first().velocity == pytest.approx(2e-3 * 10)
    own = {r.i: r.ruu for r in correlation.two_point(df, 1, 1).collect()}
    assert own[1] == pytest.approx(1)
    flat = field(spark, np.ones((5, 1, 2)))
    assert {r.ruu for r in correlation.two_point(flat, 1, 1).collect()} == {None}


def low_rank(spark, n=40, rank=3, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, rank)) @ rng.standard_normal((rank, 24)) + 2.0
    return x, spark.createDataFrame([(k + 1, row.tolist()) for k, row in enumerate(x)], "frame_id long, x array<double>")


def test_pod(spark):
    x, df = low_rank(spark)
    model = modal.pod(df.repartition(5))
    c = x - x.mean(0)
    assert model.eigenvalues[:3] == pytest.approx(np.linalg.svd(c, compute_uv=False)[:3] ** 2 / 24)
    assert model.eigenvalues[3:] == pytest.approx(np.zeros(21), abs=1e-9) and model.energy_rank(0.999999) == 3
    back = np.array([r.x for r in modal.reconstruct(df, model, 3).orderBy("frame_id").collect()])
    assert back == pytest.approx(x, abs=1e-9)
    assert modal.coefficients(df, model, 2).count() == 80


def test_threshold_rank_finds_planted_modes(spark):
    rng = np.random.default_rng(6)
    x = 20 * np.outer(rng.standard_normal(60), rng.standard_normal(60)) + rng.standard_normal((60, 60))
    got = modal.pod(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "frame_id long, x array<double>")).threshold_rank()
    assert got["omega"] == pytest.approx(2.86, abs=0.01) and got["rank"] == 1


def test_dmd_of_a_rotation(spark):
    t = np.arange(50) * 0.1
    a = np.random.default_rng(7).standard_normal((2, 6))
    x = np.stack([np.exp(-0.1 * t) * np.cos(2 * np.pi * t), np.exp(-0.1 * t) * np.sin(2 * np.pi * t)], axis=1) @ a
    got = dynamic_modes.spectrum(spark.createDataFrame([(k + 1, r.tolist()) for k, r in enumerate(x)], "frame_id long, x array<double>"), 2, 0.1)
    assert sorted(got.frequency) == pytest.approx([-1, 1], abs=1e-6) and list(got.growth) == pytest.approx([-0.1, -0.1], abs=1e-6)


def test_spod_peaks_where_it_should(spark):
    t = np.arange(256)
    x = np.outer(np.cos(2 * np.pi * t * 4 / 32), np.array([1.0, 2.0, -1.0])) + 0.01 * np.random.default_rng(8).standard_normal((256, 3))
    got = spectral_modes.spod(spark.createDataFrame([(k + 1, r.tolist()) for k, r in enumerate(x)], "frame_id long, x array<double>"), 32, 32.0).where("mode = 1").orderBy(F.desc("eigenvalue")).first()
    assert got.frequency == pytest.approx(4)
    assert spectral_modes.spod(low_rank(spark, 10)[1], 32, 1.0).count() == 0


def test_spod_sides_and_pieces_agree(spark):
    x = np.random.default_rng(11).standard_normal((90, 6))
    df = spark.createDataFrame([(k + 1, r.tolist()) for k, r in enumerate(x)], "frame_id long, x array<double>")
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(16) / 16)
    q = np.stack([np.fft.rfft(x[8 * b : 8 * b + 16] * w[:, None], axis=0) for b in range(10)]) / np.sqrt(4.0 * (w**2).sum() * 10)
    q[:, 1:-1] *= np.sqrt(2)
    want = np.array([np.linalg.eigvalsh(p.conj().T @ p)[::-1] for p in q.transpose(1, 0, 2)])
    for side, task_bytes in ((None, 1 << 30), ("dof", 64 * 6 * 3), ("blocks", 64 * 16 * 2)):
        got = spectral_modes.spod(df, 16, 4.0, side=side, task_bytes=task_bytes).where("mode <= 6").orderBy("frequency", "mode").toPandas()
        assert got.eigenvalue.to_numpy().reshape(9, 6) == pytest.approx(want, abs=1e-9)


def test_two_lines_break():
    values = np.r_[np.linspace(1, 2, 8), np.linspace(6, 6.5, 12)] + 1e-3 * np.random.default_rng(9).standard_normal(20)
    got = modal.two_lines(values)
    assert got["valid"] and sorted(got["chosen"].tolist()) == list(range(8))
    assert not modal.two_lines(np.arange(4.0))["valid"]


def test_files_round_trip(spark, tmp_path):
    for r in (1, 2):
        folder = tmp_path / f"r{r}"
        folder.mkdir()
        for f in (1, 2, 3):
            lines = [f"{i * 2.0} {j * 1.5} {5 + r + 0.1 * i} {0.01 * j} 1" for j in (1, 2) for i in (1, 2, 3)]
            (folder / f"B{f:04d}.dat").write_text("a\nb\nc\nd\n" + "\n".join(lines) + "\n")
    repeats = [tecplot.parse(tecplot.read_frames(spark, str(tmp_path / f"r{r}")), 3) for r in (1, 2)]
    seq = cache.sequence(repeats, 3)
    assert cache.problems(seq, 6, 2, 3).count() == 0
    cache.write(seq, str(tmp_path / "cache"), "case", "raw", frames_per_file=2)
    got = cache.read(spark, str(tmp_path / "cache"), "case", "raw", frames=(4, 4), rows=(2, 2))
    assert [(r.repeat_id, r.i, round(r.u, 4)) for r in got.orderBy("i").collect()] == [(2, 1, 7.1), (2, 2, 7.2), (2, 3, 7.3)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(frame_id,4)" in plan and "PartitionFilters" in plan
    files = tecplot.manifest(spark, str(tmp_path / "r1"))
    assert files.count() == 3 and [(r.frame_no, r.n) for r in tecplot.manifest_faults(files, 1, 4).collect()] == [(4, 0)]


def test_results_are_reused_by_contract(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    first, a = cache.saved(spark, str(tmp_path), "r", {"p": 1}, make)
    again, b = cache.saved(spark, str(tmp_path), "r", {"p": 1}, make)
    other, c = cache.saved(spark, str(tmp_path), "r", {"p": 2}, make, parents=(a,))
    assert len(made) == 2 and a == b != c and again.count() == 3 and other.count() == 3
    assert cache.contract_difference({"p": 1, "q": 2}, {"p": 3, "q": 2}) == {"p": (1, 3)}
    cache.write_tables({"t": spark.range(2)}, str(tmp_path / "out"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "out" / "t")).count() == 2


def test_stream_gives_the_batch_moments(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(seconds=k), 1, k + 1, 1, 1, float(k % 5), float(k % 3), k % 7 != 0) for k in range(120)]
    df = spark.createDataFrame(rows, "ts timestamp, " + SAMPLE)
    df.write.parquet(str(tmp_path / "in"))
    got = stream.stream_moments(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "10 seconds", "1 minute")
    q = got.writeStream.format("memory").queryName("moments").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    first = spark.table("moments").orderBy("window").first()
    own = [r for r in rows[:60] if r[7]]
    assert first["count"] == len(own) and first.u_mean == pytest.approx(np.mean([r[5] for r in own])) and first.uu == pytest.approx(np.var([r[5] for r in own]))
    other = stream.stream_phase_means(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "10 seconds", "1 minute", 16.0, 2.0, 8)
    q = other.writeStream.format("memory").queryName("phases").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("phases").count() == 16


def test_conditional_pairs_are_those_of_the_catalog(spark, sf):
    """Structures and free windows of all frames, found again one by one."""
    from vortiq.queries import dynamics, fields

    every = fields.found(spark, sf).where("connectivity = 8 and is_ss").collect()
    u = {(r.frame_id, r.j, r.i): r.u for r in dynamics.clean(spark, sf).collect()}
    by_frame = {}
    for r in every:
        by_frame.setdefault(r.frame_id, []).append(r)
    want, count = set(), {}
    for r in every:
        width = r.col_max - r.col_min + 1
        met = [o for o in by_frame[r.frame_id] if r.row_min <= o.row_max and r.row_max >= o.row_min]
        free = [a for a in range(1, 8 - width + 2) if not any(a <= o.col_max and a + width - 1 >= o.col_min for o in met)]
        if r.is_censored or not free:
            continue
        start = min(free, key=lambda a: (abs(a - r.col_min), a))
        want.add((r.frame_id, r.sign, r.component_id, r.col_min, r.col_max, start, start + width - 1, r.lx_over_delta))
        for j in (2, 3):
            if all(u[r.frame_id, j, a + k] is not None for a in (r.col_min, start) for k in range(width)):
                for t in (1.0, 1.4):
                    count[t, j] = count.get((t, j), 0) + (width >= 2 and r.lx_over_delta > t)
    got = dynamics.pairs(spark, sf).select("frame_id", "sign", "component_id", "col_min", "col_max", "window_min", "window_max", "lx_over_delta").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want and max(r.frame_id for r in got) > 400
    assert {(r.threshold, r.j): r.pairs for r in dynamics.windows(spark, sf)[1].collect()} == {k: n for k, n in count.items() if n}


def test_files_and_flow_maps_of_all_frames(spark, sf):
    from vortiq.queries import fields

    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    got = {r.repeat_id: r for r in fields.sequence(spark, sf).groupBy("repeat_id").agg(F.min("frame_id").alias("first"), F.max("frame_id").alias("last"), F.count(F.lit(1)).alias("n")).collect()}
    assert (got[1].first, got[1].last, got[2].first, got[2].last) == (1, n // 2, n // 2 + 1, n)
    assert got[1].n + got[2].n == 32 * n
    starts = {r.start for r in fields.QUERIES["ftle"][0](spark, sf).select("start").distinct().collect()}
    assert starts == {*range(1, n // 2 - 3), *range(n // 2 + 1, n - 3)}


def test_both_sides_of_the_decomposition_agree(spark):
    """Fewer frames than degrees of freedom, spatial blocks of a few columns, gaps between frame numbers."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((5, 40))
    x = 3 + rng.standard_normal((18, 5)) @ base * [[1.0]] + 0.01 * rng.standard_normal((18, 40))
    rows = spark.createDataFrame([(int(k), [float(v) for v in r]) for k, r in zip(range(1, 19), x)], "frame_id long, x array<double>")
    dof, frames = modal.pod(rows, "dof"), modal.pod(rows, task_bytes=4 * 8 * 18 * 7)
    assert isinstance(frames, modal.FramePod) and np.allclose(dof.eigenvalues[:17], frames.eigenvalues[:17], atol=1e-9)
    a, b = ({r.frame_id: np.array(r.x) for r in modal.reconstruct(rows, m, 4).collect()} for m in (dof, frames))
    assert all(np.allclose(a[k], b[k], atol=1e-9) for k in a) and len(a) == len(b) == 18
    only = {r.frame_id: np.array(r.x) for r in modal.reconstruct(rows, frames, 4, fluctuations=True).collect()}
    assert all(np.allclose(only[k] + x.mean(0), b[k], atol=1e-9) for k in b)
    made = {}
    for r in modal.mode_blocks(rows, frames, 4).orderBy("mode", "first").collect():
        made.setdefault(r.mode, []).extend(r["values"])
    modes = np.array([made[k] for k in (1, 2, 3, 4)])
    assert np.allclose(np.abs((modes * dof.modes[:, :4].T).sum(1)), 1, atol=1e-9)
    c, d = ({(r.frame_id, r.mode): abs(r.a) for r in modal.coefficients(rows, m, 4).collect()} for m in (dof, frames))
    assert all(abs(c[k] - d[k]) < 1e-9 for k in c)
    p, q = dynamic_modes.spectrum(rows, 5, 0.1, "dof"), dynamic_modes.spectrum(rows, 5, 0.1, "frames", 4 * 8 * 18 * 7)
    assert np.allclose(p.sort_values(["re", "im"]).to_numpy(), q.sort_values(["re", "im"]).to_numpy(), atol=1e-6)


def test_envelope_and_ranks(spark, sf):
    from vortiq.plans.views import grid, piv

    rows = modal.snapshots(piv(spark, sf)).where("frame_id <= 40")
    small, large = modal.pod(rows, "dof"), modal.pod(rows, "frames", 4 * 8 * 40 * 10)
    a, b = ({r.i: r.amplitude for r in modal.envelope(rows, m, grid(spark), 2).collect()} for m in (small, large))
    assert a == pytest.approx(b, abs=1e-9) and 4 * sum(v * v for v in a.values()) == pytest.approx(1)
    for model in (small, large):
        got = model.chosen_rank(energy=0.5)
        assert got["rank"] == model.energy_rank(0.5) and got["positive"] <= 39 and got["share"] >= 0.5
        assert model.chosen_rank(fixed=2)["rank"] == 2 and model.chosen_rank(energy=1.0)["rank"] == got["positive"]
        for bad in ({"fixed": 0}, {"fixed": 40}, {"energy": 0.0}, {"energy": 1.1}, {}):
            with pytest.raises(ValueError):
                model.chosen_rank(**bad)
    still = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], "frame_id long, x array<double>")
    with pytest.raises(ValueError):
        modal.pod(still).chosen_rank(fixed=1)
