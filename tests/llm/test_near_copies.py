"""Neighbours among rows that short codes tell apart badly."""

from __future__ import annotations

import numpy as np
import pytest

from vortiq.llm import ann


@pytest.mark.parametrize("measure", ["inner", "l2"])
def test_neighbours_of_close_and_shifted_rows(spark, measure):
    rng = np.random.default_rng(9)
    close = rng.standard_normal((2, 32))[np.arange(1600) % 2] + 1e-4 * rng.standard_normal((1600, 32))
    x = np.concatenate([close, 50 + 0.01 * rng.standard_normal((800, 32)), rng.standard_normal((400, 32)) * np.exp(2 * rng.standard_normal((400, 1)))]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, "vec_id % 70 = 0", measure=measure, rerank=60).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    y = x.astype(float)
    for q in range(0, len(x), 70):
        score = (y * y[q]).sum(1) if measure == "inner" else -((y - y[q]) ** 2).sum(1)
        want = sorted((k for k in range(len(x)) if k != q), key=lambda k: (-score[k], k))[:20]
        assert [(v, s) for _, v, s in sorted(got[q])] == [(v, score[v]) for v in want]
