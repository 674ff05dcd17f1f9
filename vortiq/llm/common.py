"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be of any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a new one if the
    master is local (tests); a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.getCheckpointDir() is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back: cuts the lineage, survives lost executors.

    The files stay until discard() or until the folder is cleared, as those of a checkpoint do.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vortiq-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that materialize() wrote and nothing reads any more."""
    spark = df.sparkSession
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/vortiq-" in path:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def signature(edges: DataFrame) -> tuple:
    """Count and order-free hash of an edge table."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Labels (node, root) of every node that an edge (u, v) of longs touches; root is the smallest node of its component.

    Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and Beyond"),
    each written to the shared folder, where the table of the round before is then deleted. A hub's neighbours meet only in partial minima and in a plain equi-join,
    which adaptive execution splits. Loops and null ends are ignored; an empty input gives an empty result.
    """
    ends = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = materialize(ends.where("u > v").distinct(), "cc")
    last = signature(now)
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        discard(before)
        this = signature(now)
        if this == last:
            break
        last = this
    else:
        raise RuntimeError("connected components did not converge")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def fresh(columns: Iterable[str], stem: str = "own") -> str:
    """A prefix that none of the columns begins with, whatever the case."""
    taken = [c.lower() for c in columns]
    prefix = f"_{stem}_"
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return prefix


def annotate(docs: DataFrame, columns: tuple[str, ...], added: str, work: Callable[[], Callable[[list[str]], list[pa.Array]]], prefix: str = "") -> DataFrame:
    """The given columns of docs and those of the DDL string added, worked out from the column text in one pass.

    work() runs once a task and returns what turns a batch of texts (null: empty) into arrays. text travels once. The
    names of the added columns begin with prefix, by which a caller keeps them apart from columns of docs.
    """
    has = "text" in columns
    at = columns.index("text") if has else len(columns)
    rows = docs.select(*columns) if has else docs.select(*columns, docs["text"].cast("string").alias(f"{fresh(columns)}text"))
    more = T.StructType([T.StructField(prefix + f.name, f.dataType) for f in T.StructType.fromDDL(added).fields])
    kept = [*columns]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = work()
        for batch in batches:
            arrays = of([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *arrays], names=[*kept, *more.names])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[: len(kept)], *more.fields]))
