"""Velocity frames in text files: four header lines, then x y u v isValid for each point, x running fastest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = 4


def read_frames(spark: SparkSession, path: str, pattern: str = "*.dat") -> DataFrame:
    """(path, text) of every file below path, whole: a file is a frame, some megabytes at most."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def frame_number(path: Column) -> Column:
    """The digits before the extension, 0 in B0000.dat; NULL where there are none."""
    return F.regexp_extract(path, r"(\d+)\.[^./]*$", 1).try_cast("long")


def parse(files: DataFrame, columns: int) -> DataFrame:
    """Samples (path, frame_no, j, i, x_mm, y_mm, u, v, valid) of whole files of `columns` points a row.

    Rows and columns count from 1 in the order of the file. A line with fewer than five numbers ends in NULLs.
    """
    lines = F.filter(F.split("text", "\r?\n"), lambda x: F.trim(x) != "")
    rows = files.select("path", frame_number(F.col("path")).alias("frame_no"), F.posexplode(F.slice(lines, HEADER + 1, F.greatest(F.size(lines) - HEADER, F.lit(0)))).alias("at", "line"))
    parts = F.split(F.trim("line"), r"[\s,]+")
    number = lambda k: F.try_element_at("p", F.lit(k)).try_cast("double")
    return rows.withColumn("p", parts).select("path", "frame_no", (F.floor(F.col("at") / columns) + 1).cast("int").alias("j"), (F.col("at") % columns + 1).cast("int").alias("i"), number(1).alias("x_mm"), number(2).alias("y_mm"), number(3).cast("float").alias("u"), number(4).cast("float").alias("v"), (number(5) > 0).alias("valid"))


def mean_spacing(samples: DataFrame) -> DataFrame:
    """Mean positive step of x along rows."""
    from pyspark.sql import Window

    step = F.col("x_mm") - F.lag("x_mm").over(Window.partitionBy("path", "j").orderBy("i"))
    return samples.withColumn("_d", step).agg(F.avg(F.when(F.col("_d") > 0, F.col("_d"))).alias("h_mm"))


def render(samples: DataFrame, key: str = "frame_id") -> DataFrame:
    """The text of each frame of samples (key, j, i, x_mm, y_mm, u, v, valid), as parse() reads it."""
    line = F.concat_ws(" ", F.col("x_mm").cast("string"), F.col("y_mm").cast("string"), F.col("u").cast("string"), F.col("v").cast("string"), F.col("valid").cast("int").cast("string"))
    head = F.lit("TITLE = \"frame\"\nVARIABLES = \"x\", \"y\", \"Vx\", \"Vy\", \"isValid\"\nZONE T=\"frame\"\nDATAPACKING=POINT\n")
    return samples.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("j", "i", line.alias("line")))).alias("p")).select(F.format_string("B%04d.dat", F.col(key)).alias("path"), F.concat(head, F.array_join(F.transform("p", lambda x: x["line"]), "\n")).alias("text"))


def manifest(spark: SparkSession, path: str, pattern: str = "*.dat") -> DataFrame:
    """Name, number, size and time of every file, from the listing alone; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), frame_number(F.col("path")).alias("frame_no"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def manifest_faults(files: DataFrame, first: int, last: int) -> DataFrame:
    """Frame numbers of first..last that have no file or more than one."""
    counts = files.groupBy("frame_no").agg(F.count(F.lit(1)).alias("n"))
    wanted = files.sparkSession.range(first, last + 1).select(F.col("id").alias("frame_no"))
    return wanted.join(counts, "frame_no", "left").select("frame_no", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")
