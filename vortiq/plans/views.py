"""Deterministic views of the driver's tables as this library's schemas, each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS, COLUMNS = 4, 8
BOX_COLUMNS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames: components 0..31 are u and 32..63 v on a grid of 4 rows and 8 columns; two repeats."""
    rows = table(spark, sf_dir, "embeddings")
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    k = F.explode(F.sequence(F.lit(0), F.lit(31))).alias("k")
    frames = rows.where(F.size("embedding") == 64).select((F.col("vec_id") + 1).alias("frame_id"), "embedding").join(n, F.lit(True))
    got = frames.select("frame_id", "embedding", F.when(2 * F.col("frame_id") <= F.col("n"), 1).otherwise(2).alias("repeat_id"), k)
    j, i = (F.floor(F.col("k") / 8) + 1).cast("int"), (F.col("k") % 8 + 1).cast("int")
    got = got.select("repeat_id", "frame_id", j.alias("j"), i.alias("i"), F.get("embedding", F.col("k")).cast("double").alias("u"), F.get("embedding", F.col("k") + 32).cast("double").alias("v"))
    return got.withColumn("valid", (F.col("frame_id") * 7 + F.col("j") * 3 + F.col("i")) % 11 != 0)


PIV = "piv AS (SELECT CAST(CASE WHEN 2*(vec_id+1) <= n THEN 1 ELSE 2 END AS INTEGER) AS repeat_id, vec_id+1 AS frame_id, CAST(k//8+1 AS INTEGER) AS j, CAST(k%8+1 AS INTEGER) AS i, CAST(embedding[k+1] AS DOUBLE) AS u, CAST(embedding[k+33] AS DOUBLE) AS v, ((vec_id+1)*7+(k//8+1)*3+(k%8+1)) % 11 <> 0 AS valid FROM embeddings, (SELECT count(*) AS n FROM embeddings) c, range(32) t(k) WHERE len(embedding) = 64)"
SMP = f"{PIV}, smp AS (SELECT repeat_id, frame_id, j, i, CASE WHEN valid THEN u END AS u, CASE WHEN valid THEN v END AS v FROM piv)"
#: Samples with their bin of eight (clock 16 Hz, forcing 2 Hz), found as the nearest of all centres.
BINNED = f"{SMP}, frames AS (SELECT DISTINCT frame_id, ((frame_id-1)*45.0) % 360 AS phi FROM piv), near AS (SELECT frame_id, b, row_number() OVER (PARTITION BY frame_id ORDER BY abs((phi - b*45.0 + 540) % 360 - 180), b) AS p FROM frames, range(8) t(b)), binned AS (SELECT s.*, CAST(n.b+1 AS INTEGER) AS bin, (s.frame_id-1)//8+1 AS cycle FROM smp s JOIN near n ON s.frame_id = n.frame_id AND n.p = 1)"


def grid(spark: SparkSession) -> DataFrame:
    """Places of the points of piv, with rows unevenly spaced."""
    got = spark.range(ROWS * COLUMNS).select((F.floor(F.col("id") / COLUMNS) + 1).cast("int").alias("j"), (F.col("id") % COLUMNS + 1).cast("int").alias("i"))
    return got.select("j", "i", (2.0 * (F.col("i") - 1)).alias("x_mm"), (0.5 * F.col("j") * F.col("j")).alias("y_mm"))


GRID = "grid AS (SELECT CAST(k//8+1 AS INTEGER) AS j, CAST(k%8+1 AS INTEGER) AS i, 2.0*(k%8) AS x_mm, 0.5*(k//8+1)*(k//8+1) AS y_mm FROM range(32) t(k))"


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boundary layer of 20 rows and 16 columns: a power law with what lineitem adds to it; u_mean, v_rms and points."""
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 16 + 1).cast("int").alias("i"), (F.col("l_partkey") % 20 + 1).cast("int").alias("j")).agg(F.avg("l_discount").alias("d"))
    return rows.select("i", "j", (25.0 * F.pow(F.least(F.col("j") / 12.0, F.lit(1.0)), F.lit(1.0) / 7.0) * (0.95 + F.col("d"))).alias("u_mean"))


FLOW = "flow AS (SELECT CAST(l_suppkey % 16 + 1 AS INTEGER) AS i, CAST(l_partkey % 20 + 1 AS INTEGER) AS j, 25.0*pow(least((l_partkey % 20 + 1)/12.0, 1.0), 1.0/7.0)*(0.95+avg(l_discount)) AS u_mean FROM lineitem GROUP BY l_suppkey % 16, l_partkey % 20)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a catalog of structures, twelve a frame."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("component_id"), F.col("o_custkey").alias("c"), F.floor("o_totalprice").cast("long").alias("p"))
    o = o.select("component_id", "c", (F.floor(F.col("component_id") / 12) + 1).cast("long").alias("frame_id"), F.when(F.col("component_id") % 2 == 0, 1).otherwise(-1).alias("sign"), F.when(F.floor(F.col("component_id") / 2) % 3 == 0, 4).otherwise(8).alias("connectivity"), (F.col("c") % 40 + 1).cast("int").alias("col_min"), (F.col("p") % 22).cast("int").alias("w"), (F.floor(F.col("p") / 100) % 12 + 1).cast("int").alias("row_min"), (F.floor(F.col("p") / 7) % 5).cast("int").alias("h"))
    o = o.withColumns({"col_max": F.least(F.col("col_min") + F.col("w") + 2, F.lit(BOX_COLUMNS)), "row_max": F.col("row_min") + F.col("h")})
    wide, high = F.col("col_max") - F.col("col_min") + 1, F.col("row_max") - F.col("row_min") + 1
    o = o.withColumns({"pixel_count": (F.floor(wide * high * 3 / 4) + 1).cast("long"), "lx_over_delta": wide * 0.25})
    return o.select(
        "frame_id", "sign", "connectivity", "component_id", "pixel_count", "col_min", "col_max", "row_min", "row_max", "lx_over_delta",
        (F.col("lx_over_delta") > 3).alias("is_ss"), ((F.col("col_min") == 1) | (F.col("col_max") == BOX_COLUMNS)).alias("is_censored"), (F.col("c") % 7 == 0).alias("touches_exclusion"),
        (F.col("lx_over_delta") >= 1).alias("is_lsm"), (F.col("lx_over_delta") >= 3).alias("is_vlsm"), (F.col("pixel_count") * 2.0).alias("area_mm2"), (high * 1.5 + 0.01 * (F.col("c") % 10)).alias("height_mm"), ((F.col("row_min") - 1) * 0.03).alias("y_min_over_delta"),
        ((F.col("col_min") + F.col("col_max")) * 1.0).alias("centroid_x_mm"), (F.greatest(wide, high) / F.least(wide, high)).alias("aspect"), (wide % 4 + 1).alias("n_sub"), (F.col("lx_over_delta") / (wide % 4 + 1) + 0.01 * (F.col("c") % 5)).alias("sub_length"),
        (F.col("col_min") * 2.0 - 2).alias("x_min_mm"), (F.col("col_max") * 2.0).alias("x_max_mm"), (F.col("row_min") * 1.5 - 1.5).alias("y_min_mm"), (F.col("row_max") * 1.5).alias("y_max_mm"),
    )


BOXES = """b0 AS (SELECT o_orderkey AS component_id, o_custkey AS c, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders),
b1 AS (SELECT component_id, c, component_id//12+1 AS frame_id, CAST(CASE WHEN component_id % 2 = 0 THEN 1 ELSE -1 END AS INTEGER) AS sign, CAST(CASE WHEN (component_id//2) % 3 = 0 THEN 4 ELSE 8 END AS INTEGER) AS connectivity, CAST(c % 40 + 1 AS INTEGER) AS col_min, CAST(least(c % 40 + 1 + p % 22 + 2, 64) AS INTEGER) AS col_max, CAST((p//100) % 12 + 1 AS INTEGER) AS row_min, CAST((p//100) % 12 + 1 + (p//7) % 5 AS INTEGER) AS row_max FROM b0),
b2 AS (SELECT *, col_max-col_min+1 AS wide, row_max-row_min+1 AS high, (col_max-col_min+1)*(row_max-row_min+1)*3//4+1 AS pixel_count, (col_max-col_min+1)*CAST(0.25 AS DOUBLE) AS lx_over_delta FROM b1),
boxes AS (SELECT frame_id, sign, connectivity, component_id, CAST(pixel_count AS BIGINT) AS pixel_count, col_min, col_max, row_min, row_max, lx_over_delta, lx_over_delta > 3 AS is_ss, (col_min = 1 OR col_max = 64) AS is_censored, c % 7 = 0 AS touches_exclusion, lx_over_delta >= 1 AS is_lsm, lx_over_delta >= 3 AS is_vlsm, pixel_count*CAST(2.0 AS DOUBLE) AS area_mm2, high*CAST(1.5 AS DOUBLE)+CAST(0.01 AS DOUBLE)*(c % 10) AS height_mm, (row_min-1)*CAST(0.03 AS DOUBLE) AS y_min_over_delta, CAST(col_min+col_max AS DOUBLE) AS centroid_x_mm, CAST(greatest(wide,high) AS DOUBLE)/least(wide,high) AS aspect, wide % 4 + 1 AS n_sub, lx_over_delta/(wide % 4 + 1)+CAST(0.01 AS DOUBLE)*(c % 5) AS sub_length, col_min*CAST(2.0 AS DOUBLE)-2 AS x_min_mm, col_max*CAST(2.0 AS DOUBLE) AS x_max_mm, row_min*CAST(1.5 AS DOUBLE)-1.5 AS y_min_mm, row_max*CAST(1.5 AS DOUBLE) AS y_max_mm FROM b2)"""


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples of one row: a point for each type, u the value, v its change, in order of time."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events")
    kinds = Window.partitionBy("event_type").orderBy("ts", "event_id")
    got = rows.select("ts", "event_id", F.lit(1).alias("repeat_id"), F.row_number().over(kinds).cast("long").alias("frame_id"), F.lit(1).alias("j"), F.length("event_type").alias("i"), "event_type", F.col("value").alias("u"), (F.col("value") - F.lag("value").over(kinds)).alias("v"))
    return got.withColumn("valid", F.col("v").isNotNull())


EVENTS = "ev AS (SELECT ts, event_id, row_number() OVER w AS frame_id, event_type, value AS u, value - lag(value) OVER w AS v FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros, so that another order of summation gives the same values."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def final(views: str, body: str, columns: str, digits: int = 6) -> str:
    """SQL of a query over views whose columns are named; "name~" is a double and rounded."""
    out = [f"round(CAST({c[:-1]} AS DOUBLE), {digits}) + 0.0 AS {c[:-1]}" if c.endswith("~") else c for c in columns.split()]
    return f"WITH {views} SELECT {', '.join(out)} FROM ({body}) AS result"
