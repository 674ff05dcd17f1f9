"""The data source of frame files against the parser of whole files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vortiq.sources import frame_files, tecplot


@pytest.fixture
def folder(tmp_path):
    head = 'TITLE = "f"\nVARIABLES = "x"\nZONE\nDATAPACKING=POINT\n'
    for n in range(1, 13):
        lines = [f"{2.0 * i} {0.5 * j} {n + 0.1 * i} {0.01 * j} {int((n + i + j) % 5 > 0)}" for j in range(1, 4) for i in range(1, 5)]
        (tmp_path / "a" if n % 2 else tmp_path / "b").mkdir(exist_ok=True)
        (tmp_path / ("a" if n % 2 else "b") / f"B{n:04d}.dat").write_text(head + "\n".join(lines) + ("\n1 2 x\n" if n == 7 else "\n"))
    (tmp_path / "notes.dat").write_text("no frame")
    (tmp_path / "a" / "B0099.txt").write_text("other")
    return str(tmp_path)


def rows(df):
    return sorted(tuple(r)[1:] for r in df.collect())


def test_source_reads_as_the_parser(spark, folder):
    frame_files.register(spark)
    mine = spark.read.format("velocity_frames").option("columns", 4).option("filesPerPartition", 5).load(folder)
    theirs = tecplot.parse(tecplot.read_frames(spark, folder), 4).where("frame_no is not null")
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(key, (tuple(r)[1:] for r in mine.collect()))) == sorted(map(key, (tuple(r)[1:] for r in theirs.select(mine.columns).collect()))) and mine.count() == 12 * 12 + 1
    assert mine.rdd.getNumPartitions() == 3


def test_only_files_asked_for_are_opened(spark, folder, tmp_path):
    """All others hold bytes that can't be decoded: opening one fails the job."""
    frame_files.register(spark)
    load = lambda: spark.read.format("velocity_frames").option("columns", 4).load(folder)
    whole = rows(load().where("frame_no is not null and v is not null"))
    for n in (1, 2, 4, 5, 6, 8, 9, 10, 11, 12):
        (tmp_path / ("a" if n % 2 else "b") / f"B{n:04d}.dat").write_bytes(b"\xff\xfe\xff")
    got = load().where("frame_no in (3, 7) and j >= 2 and i = 4 and v is not null and u > 0")
    assert rows(got) == [r for r in whole if r[0] in (3, 7) and r[1] >= 2 and r[2] == 4] and len(rows(got)) == 4
    assert rows(load().where((F.col("frame_no") > 6) & (F.col("frame_no") < 8) & (F.col("i") < 2) & F.col("v").isNotNull())) == [r for r in whole if r[0] == 7 and r[2] == 1]
    assert load().where("frame_no = 1000").count() == 0
    with pytest.raises(Exception):
        load().where("frame_no <= 3").collect()
