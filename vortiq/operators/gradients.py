"""Derivatives on the grid."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio

def _slope(value: Column, place: Column, over) -> Column:
    """Central difference over the neighbours, one-sided at the ends, for places in millimetres; per metre."""
    before, after = (f(value, 1).over(over) for f in (F.lag, F.lead))
    lower, upper = (F.coalesce(f(place, 1).over(over), place) for f in (F.lag, F.lead))
    first, last = F.lag(place, 1).over(over).isNull(), F.lead(place, 1).over(over).isNull()
    return ratio((F.when(last, value).otherwise(after) - F.when(first, value).otherwise(before)) * 1000.0, upper - lower)


def d_dy(field: DataFrame, value: str) -> DataFrame:
    """field (j, i, y_mm, value) with gradient, per metre."""
    return field.withColumn("gradient", _slope(F.col(value), F.col("y_mm"), Window.partitionBy("i").orderBy("j")))


def rbf_weights(nodes: np.ndarray, at: int, scale: float) -> np.ndarray:
    """Weights of the first derivative at nodes[at] from Gaussian radial functions and a straight line."""
    x = nodes - nodes[at]
    eps = scale / np.abs(x).max()
    n = len(x)
    whole = np.zeros((n + 2, n + 2))
    whole[:n, :n] = np.exp(-((eps * (x[:, None] - x[None])) ** 2))
    whole[:n, n] = whole[n, :n] = 1
    whole[:n, n + 1] = whole[n + 1, :n] = x
    right = np.zeros(n + 2)
    right[:n] = 2 * eps**2 * x * np.exp(-((eps * x) ** 2))
    right[n + 1] = 1
    return np.linalg.solve(whole, right)[:n]


def d_dy_rbf(field: DataFrame, rows: DataFrame, value: str, scale: float = 0.5) -> DataFrame:
    """Like d_dy, by three-node radial-function weights. rows (j, y_mm) are the grid's rows, read on the driver: a
    number for each of at most some hundreds of rows. The end rows keep the one-sided differences."""
    listed = sorted((r["j"], r["y_mm"]) for r in rows.select("j", "y_mm").distinct().collect())
    y = np.array([p for _, p in listed]) * 1e-3
    out = []
    for k in range(len(y)):
        if 0 < k < len(y) - 1:
            start, weights = k - 1, rbf_weights(y[k - 1 : k + 2], 1, scale)
        else:
            start = min(max(k - 1, 0), len(y) - 2)
            weights = np.array([-1.0, 1.0]) / (y[start + 1] - y[start])
        out += [(listed[k][0], listed[start + m][0], float(w)) for m, w in enumerate(weights)]
    spark = field.sparkSession
    terms = spark.createDataFrame(out, "j int, _from int, _weight double")
    source = field.select(F.col("j").alias("_from"), "i", F.col(value).alias("_value"))
    got = source.join(terms, "_from").groupBy("j", "i").agg(F.sum(F.col("_weight") * F.col("_value")).alias("gradient"), F.every(F.col("_value").isNotNull()).alias("_whole"))
    return field.join(got.select("j", "i", F.when(F.col("_whole"), F.col("gradient")).alias("gradient")), ["j", "i"])


def planar_criteria(field: DataFrame) -> DataFrame:
    """Vorticity, Q, lambda2 and swirling strength of a planar field (keys, j, i, x_mm, y_mm, u, v), per frame."""
    key = [c for c in ("frame_id", "bin") if c in field.columns]
    up, right = Window.partitionBy(*key, "i").orderBy("j"), Window.partitionBy(*key, "j").orderBy("i")
    got = field.withColumns({"ux": _slope(F.col("u"), F.col("x_mm"), right), "uy": _slope(F.col("u"), F.col("y_mm"), up), "vx": _slope(F.col("v"), F.col("x_mm"), right), "vy": _slope(F.col("v"), F.col("y_mm"), up)})
    ux, uy, vx, vy = map(F.col, ("ux", "uy", "vx", "vy"))
    spin, shear = (vx - uy) / 2, (uy + vx) / 2
    q = (2 * spin * spin - (ux * ux + vy * vy + 2 * shear * shear)) / 2
    # the symmetric part squared plus the antisymmetric part squared, and the smaller of its two eigenvalues
    a, b, d = ux * ux + shear * shear - spin * spin, shear * (ux + vy), vy * vy + shear * shear - spin * spin
    half = F.sqrt(F.greatest(((a - d) / 2) * ((a - d) / 2) + b * b, F.lit(0.0)))
    disc = (ux + vy) * (ux + vy) / 4 - (ux * vy - uy * vx)
    return got.select(*key, "j", "i", (vx - uy).alias("vorticity"), q.alias("q"), ((a + d) / 2 - half).alias("lambda2"), F.when(disc < 0, F.sqrt(-disc)).when(disc.isNotNull(), 0.0).alias("lambda_ci"))


def complete_stencil(mask: DataFrame) -> DataFrame:
    """Points of mask (j, i, ok) whose 3 by 3 neighbourhood is all ok."""
    from .domain import eroded

    return eroded(mask, 1, 1)
