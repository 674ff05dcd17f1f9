"""Where values lie among sorted knots, without comparing every value with every knot."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Knots that may travel to the tasks as one array (8 bytes each); beyond it both sides are sorted together.
MOST = 100_000


def placed(points: DataFrame, x: str, knots: DataFrame, knot: str, name: str, most: int = MOST) -> DataFrame:
    """points with the number of knots at or below x; NULL where x is NULL or NaN. Missing knots don't count.

    Knots are counted first. A profile's worth is searched by bisection inside the tasks. More of them are sorted
    together with the points in ranges of x; what lies in the ranges before comes from one row a range.
    """
    own = knots.select(F.col(knot).cast("double").alias("_x")).where("_x is not null and not isnan(_x)")
    few = own.limit(most + 1).toPandas()["_x"].to_numpy()
    if len(few) <= most:
        edges = np.sort(few)

        @F.pandas_udf("long")
        def below(values: pd.Series) -> pd.Series:
            got = pd.Series(np.searchsorted(edges, values.to_numpy(float), "right"), index=values.index, dtype="Int64")
            return got.mask(values.isna())

        return points.withColumn(name, below(F.col(x).cast("double")))
    number = F.col(x).cast("double")
    both = points.select(F.struct("*").alias("_p"), F.when(~F.isnan(number), number).alias("_x")).unionByName(own, allowMissingColumns=True)
    dealt = written(both.repartitionByRange("_x").withColumn("_part", F.spark_partition_id()), "places")
    mark = F.col("_p").isNull().cast("long")
    before = dealt.groupBy("_part").agg(F.sum(mark).alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    upto = Window.partitionBy("_part").orderBy("_x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    told = dealt.withColumn("_own", F.sum(mark).over(upto)).join(before.select("_part", "_before"), "_part").where("_p is not null")
    return told.select("_p.*", F.when(F.col("_x").isNotNull(), F.col("_own") + F.coalesce("_before", F.lit(0))).alias(name))


def numbered(knots: DataFrame, knot: str, name: str, most: int = MOST) -> DataFrame:
    """knots (places unlike each other) numbered from 1 in order of place."""
    return placed(knots, knot, knots, knot, name, most)
