"""Structures, matching and tracking on constructed fields."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vortiq.operators import catalog, domain, frames, matching, structures, tracking


def flood(mask, connectivity):
    """Regions by flood fill, numbered in column order."""
    out, n = np.zeros(mask.shape, int), 0
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 8 else [])
    for i in range(mask.shape[1]):
        for j in range(mask.shape[0]):
            if mask[j, i] and not out[j, i]:
                n += 1
                todo = [(j, i)]
                out[j, i] = n
                while todo:
                    a, b = todo.pop()
                    for dj, di in steps:
                        c, d = a + dj, b + di
                        if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not out[c, d]:
                            out[c, d] = n
                            todo.append((c, d))
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 7), st.integers(1, 9), st.integers(0, 2**31), st.sampled_from([4, 8]))
def test_labels(rows, cols, seed, connectivity):
    mask = np.random.default_rng(seed).random((rows, cols)) < 0.55
    assert (structures.label(mask, connectivity) == flood(mask, connectivity)).all()


def packed(spark, fields):
    return spark.createDataFrame([(1, k + 1, [None if x != x else float(x) for x in f.ravel()]) for k, f in enumerate(fields)], "repeat_id int, frame_id long, u array<double>")


def test_thresholds_are_strict_and_edges_marked(spark):
    u = np.zeros((4, 8))
    u[1, 2:6] = 1.5
    u[2, 5] = 1.0
    u[0, 0] = u[3, 7] = -2.0
    u[0, 6] = np.nan
    how = structures.Detection(thresholds=(3.0,), dx_mm=1, dy_mm=1, delta99_mm=1, upper_plus=0, edge_buffer=2)
    got = structures.find_structures(packed(spark, [u]), (4, 8), np.ones(4), np.arange(8.0), np.arange(4.0), how).where("connectivity = 8").orderBy("sign", "component_id").collect()
    assert [(r.sign, r.pixel_count, r.col_min, r.col_max) for r in got] == [(-1, 1, 1, 1), (-1, 1, 8, 8), (1, 4, 3, 6)]
    assert got[0].touches_upstream and got[0].censor_code == 1 and got[1].censor_code == 6 and got[2].touches_invalid
    assert got[2].passes == [True] and got[2].edge_rejected and not got[2].is_ss
    how = structures.Detection(thresholds=(4.0,), edge_buffer=1)
    assert not structures.find_structures(packed(spark, [u]), (4, 8), np.ones(4), np.arange(8.0), np.arange(4.0), how).where("sign = 1").first().passes[0]


def test_hysteresis(spark):
    u = np.zeros((5, 7))
    u[2, 1:6] = 0.6
    u[2, 3] = 1.2
    u[0, 0] = 0.7
    how = structures.Hysteresis(alpha=0.5, seed_alpha=1.0)
    masks = structures.hysteresis_masks(u, np.ones((5, 7)), np.ones((5, 7), bool), how)
    assert masks[1].sum() == 5 and not masks[1][0, 0] and not masks[-1].any()
    ring = np.zeros((5, 5))
    ring[1:4, 1:4] = 1.5
    ring[2, 2] = -1.5
    filled = structures.hysteresis_masks(ring, np.ones((5, 5)), np.ones((5, 5), bool), structures.Hysteresis(max_hole=1))
    assert filled[1].sum() == 9 and not filled[-1].any()
    got = structures.hysteresis_structures(packed(spark, [u]), (5, 7), np.ones((5, 7)), np.ones((5, 7), bool), np.arange(7.0), np.arange(5.0), np.full(7, 2.0), structures.Hysteresis(alpha=0.5, seed_alpha=1.0, min_lsm=2.5, min_vlsm=2.6)).first()
    assert got.length_mm == 5 and got.lx_over_delta == 2.5 and got.is_lsm and not got.is_vlsm and got.centroid_x_mm == 3 and len(got.pixels) == 5


def test_filled_pixels_alone_have_no_weighted_centre_but_a_mean_weight(spark):
    # filled pixels can be left without the core that they were joined to
    u, v = np.array([0.0, -0.1, 0.4]), np.zeros(3, int)
    made = structures.geometry(u, 1, v, np.arange(3), np.array([0, 2]), np.array([2, 1]), np.arange(3.0), np.zeros(1), 1.0, 1.0, np.ones(3))
    assert [c.tolist() for c in made[4:8]] == [[None, 2.0], [None, 0.0], [0.0, 0.4], [0.0, 0.4]]


def test_blur_keeps_constants(spark):
    u = np.full((4, 6), 3.0)
    u[1, 1] = np.nan
    got = np.array([np.nan if x is None else x for x in structures.blurred(packed(spark, [u]), (4, 6), (1.0, 1.0), (3, 3), "zero").first().u]).reshape(4, 6)
    assert np.isnan(got[1, 1]) and np.nanmax(np.abs(got - 3)) < 1e-12


def boxes(spark, rows):
    made = [(1, 1, 8, k + 1, n, a, b, c, d, lx, True, cens) for k, (n, a, b, c, d, lx, cens) in enumerate(rows)]
    return spark.createDataFrame(made, "frame_id long, sign int, connectivity int, component_id long, pixel_count long, col_min int, col_max int, row_min int, row_max int, lx_over_delta double, is_ss boolean, is_censored boolean")


def test_longest_is_kept(spark):
    df = boxes(spark, [(5, 1, 5, 1, 2, 4.0, False), (6, 5, 9, 2, 3, 5.0, False), (6, 10, 14, 2, 3, 3.5, False), (9, 6, 8, 2, 3, 9.0, True)])
    got = {r.component_id: (r.kept, r.suppressed) for r in matching.retain_nonoverlapping(df).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (True, False), 4: (False, False)}
    assert matching.retain_nonoverlapping(df, 1).where("kept").count() == 1


def test_window_ties_take_the_smaller_start(spark):
    df = boxes(spark, [(4, 5, 6, 1, 1, 4.0, False)])
    got = matching.match_windows(df, 10).first()
    assert (got.window_min, got.window_max, got.matched, got.reason, got.candidates) == (3, 4, True, 0, 6)
    none = matching.match_windows(boxes(spark, [(4, 2, 9, 1, 1, 4.0, False)]), 10).first()
    assert not none.matched and none.reason == 1 and none.candidates == 0


def test_merge_passes_over_what_does_not_overlap(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, 0.0, 10.0, 0.0, 2.0), (1, 1, 1, 2, 11.0, 12.0, 5.0, 6.0), (1, 1, 1, 3, 12.0, 20.0, 1.0, 3.0), (1, 1, 1, 4, 40.0, 50.0, 0.0, 2.0)], "repeat_id int, frame_id long, sign int, structure_id long, x_min_mm double, x_max_mm double, y_min_mm double, y_max_mm double")
    got = {r.structure_id: r.group for r in structures.merge_streamwise(df, 3.0).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}
    assert {r.structure_id: r.group for r in structures.merge_islands(df, 3.0).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_interfaces():
    x = np.arange(7.0)
    v = np.array([1.0, 1.0, -1.0, -1.0, 0.1, 1.0, 1.0])
    assert structures.split_points(x, v, 0.5, 0.5) == [1.5, pytest.approx(3 + 1 / 1.1)]
    assert structures.split_points(x, v, 0.5, 2.0) == [pytest.approx(3 + 1 / 1.1)]
    assert structures.split_points(x, np.abs(v), 0.5, 0.5) == []


def test_tracks_follow_shifted_pixels(spark):
    """One structure moves two columns a frame; another splits; a third dies."""
    nodes, px = [], []

    def add(f, node, cells, shift):
        cols = [c for _, c in cells]
        nodes.append((1, f, node, len(cells), 1.0, False, min(cols), max(cols)))
        px.extend((1, f, node, j, i, shift) for j, i in cells)

    for f in (1, 2, 3):
        add(f, 10 * f + 1, [(1, 2 * f + k) for k in range(2)], 2)
    add(1, 12, [(3, k) for k in range(1, 9)], 0)
    add(2, 22, [(3, k) for k in range(1, 4)], 0)
    add(2, 23, [(3, k) for k in range(6, 9)], 0)
    nodes_df = spark.createDataFrame(nodes, "repeat_id int, frame_id long, node long, pixel_count long, lx_over_delta double, is_vlsm boolean, col_min int, col_max int")
    px_df = spark.createDataFrame(px, "repeat_id int, frame_id long, node long, j int, i int, shift int")
    events = tracking.link_frames(matching.runs(px_df, ["repeat_id", "frame_id", "node", "shift"]), nodes_df).cache()
    got = {(r.node_from, r.node_to): r.event for r in events.collect()}
    assert got == {(11, 21): "continuation", (21, 31): "continuation", (12, 22): "split", (12, 23): "split", (22, None): "death", (23, None): "death"}
    named = tracking.track_ids(events, nodes_df, lambda df: df.cache())
    table = {r.track: r for r in tracking.tracks(named, nodes_df, events, 8).collect()}
    assert table[11].lifetime == 3 and table[12].splits == 1 and table[12].touches_window


def test_assignment_is_optimal(spark):
    rows = [(1, a, b, s, True) for a, b, s in [(1, 1, 0.9), (1, 2, 0.8), (2, 1, 0.8), (2, 2, 0.1)]]
    df = spark.createDataFrame(rows, "frame_id long, found_id long, seen_id long, score double, eligible boolean")
    assert {(r.found_id, r.seen_id) for r in matching.assign_pairs(df).collect()} == {(1, 2), (2, 1)}


def test_gallery_slots_are_unique(spark):
    df = spark.createDataFrame([(f, 1 if f % 3 else -1, f, 3.1 + f % 20 / 10, True, False) for f in range(1, 25)], "frame_id long, sign int, component_id long, lx_over_delta double, is_ss boolean, is_censored boolean")
    got = matching.gallery(df, 100).collect()
    taken = [r.component_id for r in got if r.selected]
    assert len(got) == 30 and len(taken) == len(set(taken)) == 24


def test_wall_attached_is_strict(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (0.2,)], "y_min_over_delta double")
    assert [r.wall_attached for r in catalog.wall_attached(df).collect()] == [True, False, False]
    assert all(r.wall_attached for r in catalog.wall_attached(df, 0.25).collect())


def test_pareto_and_plateaus(spark):
    df = spark.createDataFrame([(1.0, 3.0), (0.8, 1.0), (0.8, 2.0), (0.5, 1.0), (1.0, 3.0)], "recall double, fp double")
    assert sorted((r.recall, r.fp) for r in matching.pareto(df, "recall", "fp").collect()) == [(0.8, 1.0), (1.0, 3.0), (1.0, 3.0)]
    s = spark.createDataFrame([(k, 1.0 if k < 4 else 5.0 * k, 0.0, 100.0) for k in range(7)], "k int, median double, low double, high double")
    assert [(r.first, r.last, r.length) for r in catalog.plateaus(s).collect()] == [(0, 3, 4)]


def test_ftle_of_a_strain(spark):
    x, y = np.arange(0.0, 11.0), np.arange(0.0, 9.0)
    px, py = np.meshgrid(x - 5, y - 4)
    rows = [(1, f, (0.1 * px).ravel().tolist(), (-0.1 * py).ravel().tolist()) for f in (1, 2)]
    df = spark.createDataFrame(rows, "repeat_id int, frame_id long, u array<double>, v array<double>")
    got = [r.ftle for r in structures.ftle(df, (9, 11), x, y, 1.0, 2).collect() if r.start == 1 and r.ftle is not None]
    assert got and np.allclose(got[len(got) // 2], np.log(1.1**4) / 4, atol=1e-9)


def test_pack_order(spark):
    df = spark.createDataFrame([(1, 1, 2, 1, 3.0), (1, 1, 1, 2, 2.0), (1, 1, 1, 1, None)], "repeat_id int, frame_id long, j int, i int, u double")
    assert frames.pack(df, ["u"]).first().u == [None, 2.0, 3.0]
    assert df.select(F.lit(1)).count() == 3


def test_bootstrap_median_takes_every_structure(spark, tmp_path):
    """Short structures in the first sixty frames, long ones in all later ones."""
    from vortiq.queries import relational

    rows = [(k, 2, 4994.0 if k < 720 else 5015.0) for k in range(3000)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.k: r for r in relational.bootstrap_rows(spark, str(tmp_path)).collect()}
    long = max(r.lx_over_delta for r in relational.boxes(spark, str(tmp_path)).select("lx_over_delta").distinct().collect())
    assert {k: (r.median, r.low, r.high) for k, r in got.items()} == {k: (long,) * 3 for k in (4, 8)}


def test_bootstrap_median_is_that_of_whole_resamples(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 61, 400):
        own = np.round(rng.normal(size=n) * 10)
        plain = np.median(rng.choice(own, (20_000, n)), axis=1)
        got = catalog.bootstrap_median(spark.createDataFrame([(1, float(v)) for v in own], "k int, v double"), ["k"], "v", 4000).first()
        assert got.median == np.median(own)
        for side, p in ((got.low, 0.025), (got.high, 0.975)):
            assert np.quantile(plain, p - 0.015 if p > 0.02 else 0) <= side <= np.quantile(plain, min(p + 0.015, 1))


def test_gallery_spans_all_frames(spark, tmp_path):
    """Spans of time are fifths of the catalog's own frames, however many."""
    from vortiq.queries import relational

    rows = [(k, 2, 5015.0) for k in range(36_000)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = [r for r in relational.gallery_rows(spark, str(tmp_path)).collect() if r.reason == "exact_slot"]
    assert {r.time_bin for r in got} == {1, 2, 3, 4, 5}
    assert all((r.time_bin - 1) * 600 < r.frame_id <= r.time_bin * 600 for r in got)


def test_runs_and_places_cross_spans(spark):
    ids = [1, 2, 3, 4, 5, 9, 10, 16, 17, 18, 19, 20, 21, 22, 40]
    df = spark.createDataFrame([(k, k % 3) for k in ids + [3]], "frame_id long, a int")
    for span in (2, 5, 4096):
        got = {r.frame_id: r.first_frame for r in domain.frame_runs(df, span).collect()}
        assert got == {k: 1 if k < 9 else 9 if k < 16 else 16 if k < 40 else 40 for k in ids}
        rows = sorted((r.place, r.frame_id) for r in domain.numbered_by_frame(df, ["a"], "place", span).collect())
        assert rows == list(enumerate(sorted(ids + [3]), 1))
    assert domain.frame_runs(df.limit(0)).count() == 0 and domain.numbered_by_frame(df.limit(0), ["a"], "place").count() == 0
