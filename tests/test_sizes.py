"""What once grew faster than its input: work by frame that is not a task's start each, and steps taken once."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from vortiq.operators import assignment, matching
from vortiq.queries import relational, studies


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_matching_goes_through_many_frames_a_batch(spark, sf):
    found, seen = relational.found_seen(spark, sf)
    for df in (matching.assign_pairs(relational.pair_table(spark, sf)), matching.greedy_iou(seen, found, 0.3)):
        assert "FlatMapGroupsIn" not in plan(df)
    none = matching.greedy_iou(seen.limit(0), found.limit(0))
    assert none.count() == 0 and matching.assign_pairs(relational.pair_table(spark, sf).where("frame_id < 0")).count() == 0
    only = matching.greedy_iou(seen.where("frame_id = 2").limit(0), found.where("frame_id = 2")).collect()
    assert [(r.tp, r.fp, r.fn) for r in only] == [(0, found.where("frame_id = 2").count(), 0)]


def test_pairs_are_assigned_once(spark, sf):
    assert plan(relational.scored(spark, sf)).count("MapInArrow") == 1
    assert "MapInArrow" not in plan(studies.rounds(spark, sf))


def test_what_is_not_scored_stays_out_of_the_choice(spark, sf):
    for df in (relational.scored(spark, sf), relational.QUERIES["assign_pairs"][0](spark, sf)):
        lists = [line for line in plan(df).splitlines() if "collect_list(struct(" in line]
        assert lists and not any(name in line for line in lists for name in ("box_iou", "length_error", "position_match"))


def test_one_row_or_column_is_settled_without_a_search(monkeypatch):
    draw = random.Random(8)
    for _ in range(200):
        n, level = draw.randint(1, 6), [0.0, 1e-10, 0.25, 0.5, 0.5 + 1e-10, draw.random()]
        row = {(4, b): draw.choice(level) for b in range(n)}
        column = {(a, 4): draw.choice(level) for a in range(n)}
        first = assignment.first_of_few([[(b, row[4, b]) for b in range(n)]])[0]
        last = assignment.first_of_few([[(0, column[a, 4])] for a in range(n)])
        with monkeypatch.context() as m:
            m.setattr(assignment, "first_of_few", None)
            assert assignment.best_pairs(row) == ({(4, first)} if first >= 0 else set())
            assert assignment.best_pairs(column) == {(a, 4) for a, c in enumerate(last) if c == 0}


def test_few_and_many_columns_choose_alike():
    draw = random.Random(5)
    for _ in range(150):
        n, m = draw.randint(1, 7), draw.randint(1, 6)
        scores = {(a * 3, b * 7): draw.choice([draw.random(), 0.25, 0.5, 0.75]) for a in range(n) for b in range(m) if draw.random() < 0.5}
        few, limit = assignment.best_pairs(scores), assignment.FEW
        try:
            assignment.FEW = 0
            assert assignment.best_pairs(scores) == few
        finally:
            assignment.FEW = limit


def test_structures_go_through_in_stacks(spark, monkeypatch):
    import numpy as np

    from vortiq.operators import structures

    u = np.random.default_rng(4).standard_normal((40, 4, 8))
    for connectivity in (4, 8):
        marks = structures.label(u > 0.3, connectivity)
        assert (marks == np.stack([structures.label(one > 0.3, connectivity) for one in u])).all()
    how = structures.Hysteresis(alpha=0.4, seed_alpha=1.0, closing_radius=1, max_hole=2)
    ones = np.ones((4, 8))
    stack = structures.hysteresis_masks(u, ones, ones > 0, how)
    for k, one in enumerate(u):
        assert all((mask[k] == structures.hysteresis_masks(one, ones, ones > 0, how)[s]).all() for s, mask in stack.items())
    # no batch holds the structures of all sets, whatever the number of frames
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1] * 5000), pa.array(range(5000)), pa.array([[0.0] * 32] * 5000)], names=["repeat_id", "frame_id", "u"])
    parts = [part.num_rows for part, _ in structures.stacks(iter([batch]), (4, 8))]
    assert sum(parts) == 5000 and max(parts) * 32 <= structures.STACK


def test_largest_tenth_needs_no_order_of_all_structures(spark, sf):
    from vortiq.operators import catalog
    from vortiq.plans.views import boxes

    got = catalog.geometry_metrics(boxes(spark, sf), ["sign"], 32)
    assert "row_number" not in plan(got)


def packed_regions(spark):
    kind = "repeat_id int, frame_id long, sign int, structure_id long, x_min_mm double, x_max_mm double, y_min_mm double, y_max_mm double, pixels array<struct<x_mm: double, y_mm: double, delta_mm: double, u: double>>"
    first = [(0.0, 0.0, 4.0, -1.0), (2.0, 0.0, 1.0, 3.0), (4.0, 1.5, 1.0, None), (4.0, 3.0, None, float("nan"))]
    return spark.createDataFrame([(1, 1, 1, 1, 0.0, 6.0, 0.0, 3.0, first), (1, 1, 1, 2, 7.0, 9.0, 1.0, 2.0, [(8.0, 1.5, 6.0, 1.0)]), (1, 1, -1, 3, 0.0, 2.0, 0.0, 2.0, [(1.0, 1.0, None, None)]), (1, 2, 1, 4, 0.0, 2.0, 0.0, 2.0, [])], kind)


def test_geometry_is_added_up_where_pixels_lie(spark, sf):
    from vortiq.operators import structures

    got = structures.structure_geometry(packed_regions(spark), ["structure_id"], 2.0, 1.5)
    assert "Exchange" not in plan(got)
    rows = {r.structure_id: r for r in got.collect()}
    a, b = rows[1], rows[3]
    assert sorted(rows) == [1, 2, 3]
    assert (a.pixel_count, a.centroid_x_mm, a.centroid_y_mm, a.length_mm, a.height_mm, a.delta_mm, a.u_mean, a.peak, a.weighted_x_mm, a.weighted_y_mm, a.area_mm2, a.lx_over_delta) == (4, 2.5, 1.125, 6.0, 4.5, 1.0, 1.0, 3.0, 2.0, 0.0, 12.0, 6.0)
    assert (b.pixel_count, b.delta_mm, b.u_mean, b.peak, b.weighted_x_mm, b.lx_over_delta) == (1, None, None, None, None, None)
    assert "explode" not in plan(relational.geometry_table(spark, sf))


def test_groups_are_measured_with_one_row_a_structure_dealt_once(spark, sf):
    from vortiq.operators import structures
    from vortiq.queries import handoff

    rows = {r.group: r for r in structures.merged_geometry(packed_regions(spark), 1.0, 2.0, 1.5).collect()}
    a = rows[1]
    assert sorted(rows) == [1, 3]
    assert (a.members, a.pixel_count, a.length_mm, a.height_mm, a.delta_mm, a.u_mean, a.weighted_x_mm, a.is_vlsm) == (2, 5, 10.0, 4.5, 2.5, 1.0, 3.5, True)
    assert plan(handoff.merged(spark, sf)).count("hashpartitioning") == 1
