"""Column expressions that keep missing data NULL: NaN and infinities never get past them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column | str) -> Column:
    """The value as a double; NULL where it is missing, NaN or infinite."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return F.when(F.abs(c) < float("inf"), c)


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """top / bottom as a double; NULL where the bottom is zero or missing."""
    top, bottom = (F.col(c) if isinstance(c, str) else c for c in (top, bottom))
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def strict_mean(c: Column | str) -> Column:
    """Aggregate: the mean, NULL as soon as one member is NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def pearson(a: Column, b: Column) -> Column:
    """Aggregate: correlation over rows with both values, within [-1, 1]; NULL for fewer than two or without variance."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    r = F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))
    return F.when((F.count(x) >= 2) & r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def slope(y: Column, x: Column) -> Column:
    """Aggregate: slope of the line through (x, y); NULL without variance of x."""
    return F.try_divide(F.covar_pop(y, x), F.var_pop(F.when(y.isNotNull(), x)))


def hazen(df: DataFrame, keys: list[str], value: str, levels: dict[str, float]) -> DataFrame:
    """Midpoint percentiles (order p n + 1/2, clamped) of each group, exactly; one row a group, one column a level.

    Equal values are counted first, so a window holds distinct values, not rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_hi", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    ranked = ranked.withColumn("_lo", F.col("_hi") - F.col("_n") + 1)
    out = []
    for name, p in levels.items():
        place = F.least(F.greatest(F.col("_all") * p + 0.5, F.lit(1.0)), F.col("_all").cast("double"))
        low, part = F.floor(place), place - F.floor(place)
        at = lambda k: (F.col("_lo") <= k) & (F.col("_hi") >= k)
        out.append(F.sum(F.when(at(low), F.col(value) * (1 - part)).otherwise(0.0) + F.when(at(low + 1) & (part > 0), F.col(value) * part).otherwise(0.0)).alias(name))
    return ranked.groupBy(*keys).agg(*out)
