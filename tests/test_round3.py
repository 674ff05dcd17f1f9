"""Assignment, places among knots, runs of rows, modes of either side, and masks, against plain versions."""

from __future__ import annotations

from functools import cache
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from vortiq.operators import asof, assignment, domain, dynamic_modes, matching, modal, spectral_modes


def plain_assignment(score, allowed):
    """All choices, by recursion; the first of the best."""
    n, m = score.shape

    @cache
    def solve(i, used):
        if i == n:
            return 0.0, ()
        best = solve(i + 1, used)
        for j in range(m):
            if allowed[i, j] and not used >> j & 1:
                total, pairs = solve(i + 1, used | 1 << j)
                if score[i, j] + total > best[0] + 1e-12:
                    best = score[i, j] + total, ((i, j), *pairs)
        return best

    return list(solve(0, 0)[1])


def test_assignment_with_ties():
    rng = np.random.default_rng(1)
    for trial in range(600):
        n, m = rng.integers(1, 7, 2)
        score = rng.integers(0, 5, (n, m)) / rng.choice([4.0, 3.0, 7.0]) if trial % 2 else rng.random((n, m))
        allowed = rng.random((n, m)) < 0.7
        assert assignment.first_optimum(score, allowed) == plain_assignment(score, allowed)


def test_assignment_beyond_fourteen():
    """Groups of three by three side by side make frames of 42 boxes whose best choice is that of each group."""
    rng = np.random.default_rng(2)
    scores, want = {}, set()
    for g in range(14):
        score, allowed = rng.integers(0, 4, (3, 3)) / 3, rng.random((3, 3)) < 0.8
        for i, j in product(range(3), repeat=2):
            if allowed[i, j]:
                scores[3 * g + i, 3 * g + j] = score[i, j]
        want |= {(3 * g + i, 3 * g + j) for i, j in plain_assignment(score, allowed)}
    assert assignment.best_pairs(scores) == want
    # one group of 40, where a greedy choice loses
    chain = {(k, k): 0.9 for k in range(40)} | {(k, k + 1): 1.0 for k in range(39)}
    total = sum(chain[p] for p in assignment.best_pairs(chain))
    assert total == pytest.approx(max(39 * 1.0, 40 * 0.9, max(0.9 * k + (39 - k) * 1.0 for k in range(40))))
    assert assignment.best_pairs({}) == set()


def test_places_among_knots(spark):
    rng = np.random.default_rng(3)
    x = [*rng.integers(0, 12, 200).astype(float).tolist(), None, float("nan"), -1.0, 99.0]
    knots = [1.0, 3.0, 3.0, 7.5, None, 11.0]
    points = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "id long, x double")
    table = spark.createDataFrame([(k,) for k in knots], "k double")
    want = {k: None if v is None or v != v else sum(q is not None and q <= v for q in knots) for k, v in enumerate(x)}
    for most in (100, 2):
        got = {r.id: r.n for r in asof.placed(points, "x", table, "k", "n", most).collect()}
        assert got == want
    plan = asof.placed(points, "x", table, "k", "n", 100)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_interpolation_has_no_range_join(spark):
    knots = spark.createDataFrame([(0.0, 1.0), (2.0, 5.0), (3.0, None), (4.0, 1.0)], "x double, y double")
    points = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0)], "x double")
    done = matching.interpolate(points, knots, "x", "y")
    assert {r.x: r.y for r in done.collect()} == {-1.0: None, 0.0: 1.0, 1.0: 3.0, 2.0: 5.0, 3.0: 3.0, 4.0: 1.0, 5.0: None}
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and " <= x" not in plan


def test_links_by_runs_are_links_by_pixels(spark):
    rng = np.random.default_rng(4)
    pixels, regions = [], {}
    for frame, node in product((1, 2, 3), range(5)):
        cells = {(int(j), int(i)) for j, i in zip(rng.integers(1, 5, 14), rng.integers(1, 10, 14))}
        shift = int(rng.integers(-1, 3))
        regions[frame, 10 * frame + node] = (cells, shift)
        pixels += [(1, frame, 10 * frame + node, j, i, shift) for j, i in cells]
    df = spark.createDataFrame(pixels, "repeat_id int, frame_id long, node long, j int, i int, shift int")
    rows = matching.runs(df, ["repeat_id", "frame_id", "node", "shift"])
    assert rows.count() < df.count() and rows.agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0] == df.count()
    last = max(p[4] for p in pixels)
    want = {}
    for (f, a), (cells, shift) in regions.items():
        moved = {(j, i + shift) for j, i in cells if 1 <= i + shift <= last}
        for (g, b), (other, _) in regions.items():
            if g == f + 1 and moved & other and len(moved & other) / min(len(moved), len(other)) >= 0.2:
                want[a, b] = len(moved & other)
    assert {(r.node_from, r.node_to): r.shared for r in matching.overlap_links(rows).collect()} == want and len(want) > 5


def snapshots(spark, n, dof, seed=5, rank=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dof)) if rank is None else (rng.normal(size=(n, rank)) * 3.0 ** -np.arange(rank)) @ rng.normal(size=(rank, dof)) + 1e-3 * rng.normal(size=(n, dof))
    return x, spark.createDataFrame([(k + 1, r.tolist()) for k, r in enumerate(x)], "frame_id long, x array<double>")


SMALL = 4 * 8 * 12 * 9  # blocks of nine degrees of freedom for a dozen frames


def test_entropies_of_both_sides(spark):
    """Fewer frames than degrees of freedom, and more: the same modes, the same choice."""
    mask = np.ones((5, 8), bool)
    mask[1, 2] = mask[3, 6] = False
    _, rows = snapshots(spark, 24, 2 * int(mask.sum()), rank=10)
    models = modal.pod(rows, "dof"), modal.pod(rows, "frames", SMALL)
    a, b = (modal.entropy_selection(rows, m, mask, rank=10) for m in models)
    assert a["modes"] == b["modes"] and np.allclose(a["entropy"], b["entropy"], atol=1e-6) and a["jaccard"] == b["jaccard"]
    with pytest.raises(ValueError):
        modal.mode_entropies(rows, models[0], np.zeros((5, 8), bool))


def test_sweep_over_ranks(spark):
    x, rows = snapshots(spark, 14, 60, rank=8)
    for side in ("dof", "frames"):
        model = modal.pod(rows, side, SMALL)
        got = {(r["rank"], r.frame_id): np.array(r.x) for r in modal.reconstruct_sweep(rows, model, [1, 2, 5, 7, 13]).collect()}
        for rank in (1, 2, 5, 7, 13):
            for r in modal.reconstruct(rows, model, rank, fluctuations=True).collect():
                assert np.allclose(got[rank, r.frame_id], r.x, atol=1e-9)
        assert np.allclose(got[13, 3], (x - x.mean(0))[2], atol=1e-9)
        with pytest.raises(ValueError):
            modal.reconstruct_sweep(rows, model, [3, 2])


def test_leading_modes(spark):
    x, rows = snapshots(spark, 60, 150, rank=25)
    own = modal.leading(rows, 6, task_bytes=8 * 8 * 60 * 20)
    c = x - x.mean(0)
    values = np.sort(np.linalg.eigvalsh(c @ c.T))[::-1] / 150
    assert np.allclose(own.eigenvalues, values[:6], rtol=1e-8) and own.total == pytest.approx(values.sum(), rel=1e-9)
    full = modal.pod(rows, "frames")
    assert own.energy_rank(0.5) == full.energy_rank(0.5) and np.allclose(np.abs((own.vectors * full.vectors[:, :6]).sum(0)), 1, atol=1e-6)
    with pytest.raises(ValueError):
        own.energy_rank(0.999999)
    with pytest.raises(ValueError):
        own.threshold_rank()


def test_products_in_tiles_far_smaller_than_the_matrix(spark):
    x, rows = snapshots(spark, 23, 40)
    ids, got = modal.gramian(rows, 23, 40, True, SMALL, tile=4)
    c = x - x.mean(0)
    assert np.allclose(got, c @ c.T) and ids.tolist() == list(range(1, 24))


def shapes(df, place):
    """Modes put together from their rows."""
    out: dict = {}
    for r in df.collect():
        out.setdefault(tuple(r[c] for c in place), []).append((r["first"], np.array(r.re) + 1j * np.array(r.im)))
    return {k: np.concatenate([v for _, v in sorted(parts, key=lambda p: p[0])]) for k, parts in out.items()}


def test_spectral_modes(spark):
    x, rows = snapshots(spark, 72, 22, rank=None)
    for side in ("dof", "blocks"):
        found = spectral_modes.decompose(rows, 16, 4.0, side=side, task_bytes=64 * 16 * 7)
        assert found.blocks == 8 and (side == "dof" or found.width < 22)
        values = {(r.frequency, r.mode): r.eigenvalue for r in spectral_modes.eigenvalues(found).collect()}
        modes = shapes(spectral_modes.modes(found), ("frequency", "mode"))
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(16) / 16)
        for b in (0, 3, 8):
            own = np.stack([v for (f, _), v in sorted(modes.items()) if f == b * 4.0 / 16])
            assert np.allclose(own.conj() @ own.T, np.eye(len(own)), atol=1e-6)
            q = np.stack([np.fft.rfft(x[8 * k : 8 * k + 16] * w[:, None], axis=0)[b] for k in range(8)]) / np.sqrt(4.0 * (w**2).sum() * 8) * (1 if b in (0, 8) else np.sqrt(2))
            # the cross-spectral matrix from all modes, and each transform from its own projections
            made = sum(values[b * 4.0 / 16, k + 1] * np.outer(v, v.conj()) for k, v in enumerate(own))
            assert np.allclose(made, q.T @ q.conj(), atol=1e-8) and np.allclose((q @ own.conj().T) @ own, q, atol=1e-6)
        power = {(r.frequency, r.k): r.power for r in spectral_modes.rebuilt_power(found).collect()}
        assert power[0.75, 5] == pytest.approx(sum(v * abs(modes[0.75, m][5]) ** 2 for (f, m), v in values.items() if f == 0.75 and (f, m) in modes), rel=1e-6)


def test_selected_frequencies(spark):
    t = np.arange(1, 129)
    x = np.stack([np.sin(2 * np.pi * 2.0 * t / 16) * 5, np.cos(2 * np.pi * 1.0 * t / 16), np.random.default_rng(0).normal(size=128) * 0.01], axis=1)
    rows = spark.createDataFrame([(int(k), r.tolist()) for k, r in zip(t, x)], "frame_id long, x array<double>")
    found = spectral_modes.decompose(rows, 32, 16.0, keep=1)
    values = spectral_modes.eigenvalues(found)
    assert spectral_modes.selected(values) == [2.0] and spectral_modes.selected(values, 1.1) == [2.0, 1.0, 3.5]
    one = shapes(spectral_modes.modes(found, 1, [2.0]), ("frequency", "mode"))
    assert list(one) == [(2.0, 1)] and abs(one[2.0, 1][0]) == pytest.approx(1, abs=1e-3)


def rotation(spark, n, dof, f=2.0, fs=16.0):
    """A planted pair of shapes that turn into each other at frequency f, slowly growing."""
    rng = np.random.default_rng(8)
    q, _ = np.linalg.qr(rng.normal(size=(dof, 2)))
    z = np.exp((0.1 + 2j * np.pi * f) * np.arange(n) / fs)
    x = np.outer(z.real, q[:, 0]) - np.outer(z.imag, q[:, 1])
    return q, spark.createDataFrame([(k + 1, r.tolist()) for k, r in enumerate(x)], "frame_id long, x array<double>")


def test_dynamic_modes_of_both_sides(spark):
    q, rows = rotation(spark, 20, 30)
    told = []
    for side in ("dof", "frames"):
        found = dynamic_modes.decompose(rows, 4, 1 / 16, 1.9, side, SMALL)
        s = found.spectrum
        assert sorted(np.round(s["frequency"], 6)) == [-2.0, 2.0] and np.allclose(s["growth"], 0.1, atol=1e-5) and list(s["harmonic"]) == [1, 1] and np.allclose(s["mismatch"], 0.1, atol=1e-5) and not s["replaced"].any()
        modes = shapes(dynamic_modes.modes(rows, found), ("mode",))
        for v in modes.values():
            assert np.linalg.norm(v) == pytest.approx(1, abs=1e-9)
            assert np.linalg.norm(q @ (q.T @ v)) == pytest.approx(1, abs=1e-6)
        told.append([modes[1,], modes[2,]])
        for step in (0, 7):
            want = np.array(rows.where(F.col("frame_id") == step + 1).first().x)
            got = {r.k: r.x for r in dynamic_modes.at_step(rows, found, step).collect()}
            assert np.allclose([got[k] for k in range(30)], want, atol=1e-6)
    for a, b in zip(*told):
        assert abs(np.vdot(a, b)) == pytest.approx(1, abs=1e-6)


def test_dynamic_modes_that_vanish(spark):
    """A direction that is mapped to zero has no exact mode; the projected one stands in."""
    x = np.zeros((6, 9))
    x[:, 0] = 1.5 ** np.arange(6)
    x[0, 1] = 1.0
    rows = spark.createDataFrame([(k + 1, r.tolist()) for k, r in enumerate(x)], "frame_id long, x array<double>")
    for side in ("dof", "frames"):
        found = dynamic_modes.decompose(rows, 5, 0.1, None, side, SMALL)
        assert found.spectrum["replaced"].sum() == 1 and np.isfinite(found.spectrum[["growth", "amplitude"]]).all(axis=None) and found.spectrum["harmonic"].isna().all()
        for v in shapes(dynamic_modes.modes(rows, found), ("mode",)).values():
            assert np.isfinite(v).all() and np.linalg.norm(v) == pytest.approx(1, abs=1e-9)
    with pytest.raises(ValueError):
        dynamic_modes.decompose(rows.where("frame_id = 1"), 2, 0.1, None, "frames")


def test_masks_by_frame(spark):
    rng = np.random.default_rng(6)
    ok = rng.random((3, 5, 6)) < 0.9
    df = spark.createDataFrame([(f, j + 1, i + 1, float(j), bool(ok[f, j, i])) for f, j, i in np.ndindex(ok.shape)], "frame_id int, j int, i int, y_mm double, ok boolean")
    kept = {(r.frame_id, r.j, r.i): r.kept for r in domain.eroded(df, 1, 1, ("frame_id",)).collect()}
    good = {(r.frame_id, r.j, r.i): r.trusted for r in domain.trusted(df, 1, 2, ("frame_id",)).collect()}
    for f, j, i in np.ndindex(ok.shape):
        inner = 0 < j < 4 and 0 < i < 5
        assert kept[f, j + 1, i + 1] == (inner and bool(ok[f, j - 1 : j + 2, i - 1 : i + 2].all()))
        assert good[f, j + 1, i + 1] == bool(ok[f, j, i] and 1 <= i <= 4 and j < 3)


def test_an_empty_mask_is_an_error(spark):
    grid = spark.createDataFrame([(x, y) for x in (0.0, 1.0) for y in (0.0, 1.0)], "x_mm double, y_mm double")
    assert domain.without(grid, (0.0, 0.5, 0.0, 9.0)).count() == 2 and domain.without(grid, None).count() == 4
    with pytest.raises(ValueError):
        domain.without(grid, (0.0, 1.0, 0.0, 1.0))
