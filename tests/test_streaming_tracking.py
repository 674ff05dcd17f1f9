"""Events of a stream against those of all frames at once, in disorder and after a restart."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from vortiq.operators import matching, tracking
from vortiq.streaming import tracking as stream

START = dt.datetime(2024, 1, 1)


def field(seed, frames, skip=()):
    """Runs of random structures by frame; frames in skip have none."""
    rng, rows = np.random.default_rng(seed), []
    for repeat in (1, 2):
        for f in range(1, frames + 1):
            if (repeat, f) in skip:
                continue
            for n in range(int(rng.integers(1, 5))):
                shift = int(rng.integers(0, 3))
                for j in range(1, 1 + int(rng.integers(1, 4))):
                    a = int(rng.integers(1, 14))
                    rows.append((repeat, f, repeat * 10_000 + f * 10 + n, shift, j, a, a + int(rng.integers(1, 8)), START + dt.timedelta(seconds=f)))
    return rows


KIND = "repeat_id int, frame_id long, node long, shift int, j int, first int, last int, time timestamp"
COLUMNS = ["repeat_id", "frame_from", "frame_to", "node_from", "node_to", "event"]


def batch_events(spark, rows):
    df = spark.createDataFrame(rows, KIND)
    nodes = df.select("repeat_id", "frame_id", "node").distinct()
    got = tracking.classify(matching.overlap_links(df), nodes)
    return {tuple(r[c] for c in COLUMNS): None if r.overlap is None else round(r.overlap, 9) for r in got.collect()}


def run(spark, folder, out, last, checkpoint):
    frames = spark.readStream.schema(stream.FRAMES).option("maxFilesPerTrigger", 2).parquet(folder)
    query = stream.follow(frames, "5 seconds", last).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_stream_is_the_batch_after_a_restart_too(spark, tmp_path):
    skip = {(1, 4), (2, 9)}
    rows = field(1, 12, skip)
    last = max(r[6] for r in rows)
    packed = stream.packed(spark.createDataFrame(rows, KIND), "time")
    # frames that are missing come empty, so that none has to wait
    empty = spark.createDataFrame([(r, f, START + dt.timedelta(seconds=f), "[]") for r, f in skip], stream.FRAMES)
    every = packed.unionByName(empty).select("repeat_id", "frame_id", "time", "nodes").cache()
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    # odd frames first, and two files a batch: each half is out of order and full of gaps
    for k, part in enumerate((3, 1)):
        every.where(F.col("frame_id") <= 8).where(F.col("frame_id") % 4 == part % 4).coalesce(1).write.mode("append").parquet(folder)
    every.where("frame_id <= 8 and frame_id % 2 = 0").coalesce(1).write.mode("append").parquet(folder)
    run(spark, folder, out, last, checkpoint)
    first = spark.read.schema(stream.EVENTS).parquet(out).count()
    every.where("frame_id > 8").repartition(3).write.mode("append").parquet(folder)
    run(spark, folder, out, last, checkpoint)
    got = [r for r in spark.read.schema(stream.EVENTS).parquet(out).collect()]
    want = batch_events(spark, rows)
    assert {tuple(r[c] for c in COLUMNS): None if r.overlap is None else round(r.overlap, 9) for r in got} == want
    assert len(got) == len(want) and 0 < first < len(want) and {"continuation", "split", "merge", "birth", "death"} <= {k[-1] for k in want}


def test_a_frame_that_never_comes(spark, tmp_path):
    """The watermark gives it up: what follows is linked among itself; a frame later than its turn is dropped."""
    rows = field(2, 30, {(1, 3), (2, 3), (2, 4)})
    last = max(r[6] for r in rows)
    every = stream.packed(spark.createDataFrame(rows, KIND), "time").select("repeat_id", "frame_id", "time", "nodes").cache()
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    for lo, hi in ((1, 6), (7, 20), (21, 30)):
        every.where(F.col("frame_id").between(lo, hi)).coalesce(1).write.mode("append").parquet(folder)
        run(spark, folder, out, last, checkpoint)
    got = {tuple(r[c] for c in COLUMNS) for r in spark.read.schema(stream.EVENTS).parquet(out).collect()}
    want = {k for k in batch_events(spark, rows) if k[2] <= 20 or k[1] <= 19}
    assert {k for k in got if k[2] <= 20} == {k for k in want if k[2] <= 20} and got <= set(batch_events(spark, rows))


def test_links_of_plain_frames():
    before = {1: (2, [(1, 1, 4)]), 2: (0, [(2, 1, 3)])}
    after = {7: (0, [(1, 3, 8)]), 8: (0, [(2, 3, 9)])}
    assert stream.links(before, after, 0.2, 8) == [(1, 7, 1.0), (2, 8, pytest.approx(1 / 3))]
    assert [e[4] for e in stream.frame_events(1, before, 3, after, 0.2, 8)] == ["death", "death", "birth", "birth"]
