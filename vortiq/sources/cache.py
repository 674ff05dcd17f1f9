"""Sequence tables: samples of all repeats as Parquet, laid out for scans by case, role and repeat."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = "case_id string, source_role string, repeat_id int, frame_id long, j int, i int, u float, v float, valid boolean"
KEYS = ["case_id", "source_role", "repeat_id"]


def sequence(repeats: list[DataFrame], n_frames: int) -> DataFrame:
    """Repeats (frame_no from 1, j, i, u, v, valid) one after the other: frame_id runs on, repeat_id counts from 1."""
    parts = [df.select(F.lit(r + 1).alias("repeat_id"), (F.col("frame_no") + r * n_frames).alias("frame_id"), "j", "i", "u", "v", "valid") for r, df in enumerate(repeats)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write(samples: DataFrame, path: str, case_id: str, role: str, mode: str = "error", frames_per_file: int | None = None) -> None:
    """Writes samples partitioned by case, role and repeat, sorted by frame within files, so that ranges of frames skip
    row groups."""
    rows = samples.select(F.lit(case_id).alias("case_id"), F.lit(role).alias("source_role"), "repeat_id", "frame_id", "j", "i", F.col("u").cast("float"), F.col("v").cast("float"), "valid")
    if frames_per_file:
        rows = rows.repartition(F.col("repeat_id"), F.floor(F.col("frame_id") / frames_per_file))
    rows.sortWithinPartitions("repeat_id", "frame_id", "j", "i").write.mode(mode).partitionBy(*KEYS).parquet(path)


def read(spark: SparkSession, path: str, case_id: str | None = None, role: str | None = None, frames: tuple[int, int] | None = None, rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None) -> DataFrame:
    """The samples asked for; every condition reaches the scan."""
    df = spark.read.schema(SAMPLES).parquet(path)
    for name, value in (("case_id", case_id), ("source_role", role)):
        if value is not None:
            df = df.where(F.col(name) == value)
    for name, span in (("frame_id", frames), ("j", rows), ("i", columns)):
        if span is not None:
            df = df.where(F.col(name).between(*span))
    return df


def problems(samples: DataFrame, n_frames: int, n_rows: int, n_columns: int) -> DataFrame:
    """What keeps samples from being a dense sequence: (problem, n) with n > 0 only."""
    points = samples.groupBy("frame_id", "j", "i").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("repeat_id").alias("repeats"))
    n = lambda c: F.count(F.when(c, 1))
    got = points.agg(n(F.col("n") > 1).alias("repeated_points"), n(F.col("repeats") > 1).alias("frames_in_two_repeats"), n(~F.col("frame_id").between(1, n_frames)).alias("frames_outside"), n(~F.col("j").between(1, n_rows) | ~F.col("i").between(1, n_columns)).alias("points_outside"), (F.lit(n_frames * n_rows * n_columns) - F.count(F.lit(1))).alias("missing_points"))
    return got.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in got.columns]), F.array(*[F.col(c).cast("long") for c in got.columns]))).alias("problem", "n")).where("n > 0")


def contract(parameters: dict, parents: tuple[str, ...] = ()) -> str:
    """A digest of what made a result: its parameters and the results it was made from."""
    return hashlib.sha256(json.dumps({"parameters": parameters, "parents": sorted(parents)}, sort_keys=True, allow_nan=False).encode()).hexdigest()


def saved(spark: SparkSession, root: str, name: str, parameters: dict, make, parents: tuple[str, ...] = (), reuse: bool = True) -> tuple[DataFrame, str]:
    """A result by its contract: read where a complete one is there, else made (make()) and written first.

    The path holds the digest, so results of other parameters or parents are never mistaken for it.
    """
    digest = contract({"name": name, **parameters}, parents)
    path = f"{root.rstrip('/')}/{name}-{digest[:24]}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if not (there and reuse):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), digest


def contract_difference(a: dict, b: dict) -> dict[str, tuple]:
    """Parameters that differ, with both values; None where one lacks it."""
    return {k: (a.get(k), b.get(k)) for k in sorted(a.keys() | b.keys()) if a.get(k) != b.get(k)}


def write_tables(tables: dict[str, DataFrame], path: str, form: str = "csv") -> None:
    """Each table below path under its name; csv has headers. Spark's commit makes every table appear whole."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.option("header", "true") if form == "csv" else writer).format(form).save(f"{path.rstrip('/')}/{name}")
