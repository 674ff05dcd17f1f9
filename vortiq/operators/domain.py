"""Grids, masks and domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frame_to_repeat(frame: Column, boundaries: list[int]) -> Column:
    """1 plus the number of boundaries before the frame."""
    out = F.lit(1)
    for b in boundaries:
        out = out + F.when(frame > b, 1).otherwise(0)
    return out


def frame_window(samples: DataFrame, mode: str | tuple[int, int], n_frames: int) -> DataFrame:
    """Frames of a window: "all", "first_half", "second_half" or (first, last)."""
    first, last = {"all": (1, n_frames), "first_half": (1, n_frames // 2), "second_half": (n_frames // 2 + 1, n_frames)}[mode] if isinstance(mode, str) else mode
    return samples.where(F.col("frame_id").between(first, last))


def spread_frames(first: int, last: int, n: int) -> Column:
    """Frame ids floor(linspace(first, last, n)), without repeats."""
    step = (last - first) / max(n - 1, 1)
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(F.lit(float(first)) + k * F.lit(step)).cast("long")))


def frame_runs(frames: DataFrame, span: int = 4096) -> DataFrame:
    """frame_id with first_frame, the first of the unbroken run of frame numbers that holds it.

    Starts are told by an equi-join with the frame before and carried on within spans of frame numbers; a run that comes
    from an earlier span is looked up in one row a span, so no window sees all frames.
    """
    own = frames.select(F.col("frame_id").cast("long").alias("frame_id")).distinct()
    before = own.select((F.col("frame_id") + 1).alias("frame_id"), F.lit(True).alias("_follows"))
    own = own.join(before, "frame_id", "left").withColumn("_span", F.floor(F.col("frame_id") / span))
    own = own.withColumn("_start", F.when(F.col("_follows").isNull(), F.col("frame_id")))
    upto = Window.partitionBy("_span").orderBy("frame_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = own.groupBy("_span").agg(F.max("_start").alias("_last")).select("_span", F.max("_last").over(earlier).alias("_carried"))
    return own.withColumn("_own", F.max("_start").over(upto)).join(spans, "_span").select("frame_id", F.coalesce("_own", "_carried").alias("first_frame"))


def numbered_by_frame(rows: DataFrame, order: list[Column | str], place: str, span: int = 4096) -> DataFrame:
    """rows with their place from 1 in the order of frame_id, then `order`: places within spans of frames, and one row a
    span that tells how many come before."""
    own = rows.withColumn("_span", F.floor(F.col("frame_id") / span))
    earlier = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = own.groupBy("_span").agg(F.count(F.lit(1)).alias("_n")).select("_span", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_span").orderBy("frame_id", *order))
    return own.withColumn(place, within).join(spans, "_span").withColumn(place, (F.col(place) + F.col("_before")).cast("int")).drop("_span", "_before")


def strided(samples: DataFrame, first: int = 1, stride: int = 1, most: int | None = None, space: int = 1) -> DataFrame:
    """Every stride-th frame from the first, at most so many, and every space-th row and column."""
    at = F.col("frame_id") - first
    own = samples.where((at >= 0) & (at % stride == 0) & ((F.col("j") - 1) % space == 0) & ((F.col("i") - 1) % space == 0))
    return own if most is None else own.where(at < stride * most)


def eroded(mask: DataFrame, rows: int, cols: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, j, i, kept): whether the whole window of rows and cols around a point of mask (keys, j, i, ok) is there and
    ok; keys tell masks apart, such as those of frames.

    Two passes of sums along one direction each; what lies outside the grid counts as not ok.
    """
    ok = F.col("ok").cast("int")
    along = Window.partitionBy(*keys, "j").orderBy("i").rangeBetween(-cols, cols)
    across = Window.partitionBy(*keys, "i").orderBy("j").rangeBetween(-rows, rows)
    got = mask.withColumn("_row", F.sum(ok).over(along)).withColumn("_all", F.sum("_row").over(across))
    return got.select(*keys, "j", "i", (F.col("_all") == (2 * rows + 1) * (2 * cols + 1)).alias("kept"))


def trusted(mask: DataFrame, edge_columns: int, top_rows: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, j, i, trusted): ok points off the outer columns and off the largest-y rows of their column (mask: keys, j,
    i, y_mm, ok)."""
    order = Window.partitionBy(*keys, "i").orderBy(F.desc("y_mm"), F.desc("j"))
    ends = mask.groupBy(*keys).agg(F.min("i").alias("_first"), F.max("i").alias("_last"))
    span = mask.withColumn("_place", F.row_number().over(order)).join(ends, list(keys) or F.lit(True))
    inside = F.col("i").between(F.col("_first") + edge_columns, F.col("_last") - edge_columns)
    return span.select(*keys, "j", "i", (F.col("ok") & (F.col("_place") > top_rows) & inside).alias("trusted"))


def without(points: DataFrame, box: tuple[float, float, float, float] | None) -> DataFrame:
    """points (x_mm, y_mm, ..) whose centre lies outside the closed rectangle; None excludes nothing. A rectangle that
    leaves no point at all is an error."""
    if box is None:
        return points
    left = points.where(~excluded(F.col("x_mm"), F.col("y_mm"), box))
    if left.isEmpty():
        raise ValueError("the excluded rectangle leaves no point")
    return left


def excluded(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a cell's centre lies in the closed rectangle (x0, x1, y0, y1)."""
    return x.between(box[0], box[1]) & y.between(box[2], box[3])


def contaminated(x: Column, y: Column, box: tuple[float, float, float, float], every_y: bool = False) -> Column:
    """Contaminated cells: x half open, y closed; with every_y (drag views) whole columns."""
    inside = (x >= box[0]) & (x < box[1])
    return inside if every_y else inside & y.between(box[2], box[3])


def case_views(stats: DataFrame, values: list[str], x_max: float, region: tuple[float, float, float, float] | None) -> tuple[DataFrame, DataFrame]:
    """Two views of stats (x_mm, y_mm, values) up to x_max: for showing, with the contaminated cells' values NULL, and for
    drag, with those of their whole columns NULL. A region of None leaves both as they are."""
    own = stats.where(F.col("x_mm") <= x_max)

    def view(every_y: bool) -> DataFrame:
        if region is None:
            return own
        bad = contaminated(F.col("x_mm"), F.col("y_mm"), region, every_y)
        return own.withColumns({v: F.when(~bad, F.col(v)) for v in values})

    return view(False), view(True)


def wall_distance(j: Column, h: float, dy_h: float) -> Column:
    """Distance of row j (from 1) from the wall, for spacing h and offset dy_h in spacings."""
    return (j - 1 + dy_h) * h


def wall_rows(samples: DataFrame, frames: list[int] | None = None) -> DataFrame:
    """crop: how many leading rows are all zero in u and v, the most over the frames (or those given)."""
    own = samples if frames is None else samples.where(F.col("frame_id").isin(frames))
    alive = own.groupBy("frame_id", "j").agg(F.some((F.col("u") != 0) | (F.col("v") != 0)).alias("alive"))
    first = alive.groupBy("frame_id").agg(F.coalesce(F.min(F.when(F.col("alive"), F.col("j"))) - 1, F.max("j")).alias("n"))
    return first.agg(F.max("n").cast("int").alias("crop"))


def oriented(samples: DataFrame, n_rows: int, wall_side: str) -> DataFrame:
    """Rows counted from the wall and v away from it: "bottom" turns the rows round, "top" turns v."""
    if wall_side == "bottom":
        return samples.withColumn("j", F.lit(n_rows + 1) - F.col("j"))
    return samples.withColumn("v", -F.col("v"))


def remapped(samples: DataFrame, grid: DataFrame, crop: int) -> DataFrame:
    """Rows above the crop, renumbered, with y_mm = j times the median spacing of y over rows of the grid (j, i, y_mm)."""
    kept = grid.where(F.col("j") > crop)
    step = F.abs(F.col("y_mm") - F.lag("y_mm").over(Window.partitionBy("i").orderBy("j")))
    spacing = kept.withColumn("_step", step).agg(F.median("_step").alias("_h"))
    return samples.where(F.col("j") > crop).withColumn("j", F.col("j") - crop).join(spacing, F.lit(True)).withColumn("y_mm", F.col("j") * F.col("_h")).drop("_h")


def grid_differences(a: DataFrame, b: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """How many points two grids (j, i, x_mm, y_mm) share, lack, and place more than the tolerance apart."""
    both = a.withColumn("_a", F.lit(1)).join(b.select("j", "i", F.col("x_mm").alias("_x"), F.col("y_mm").alias("_y"), F.lit(1).alias("_b")), ["j", "i"], "full")
    apart = (F.abs(F.col("x_mm") - F.col("_x")) > tolerance) | (F.abs(F.col("y_mm") - F.col("_y")) > tolerance)
    return both.agg(F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("shared"), F.count(F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1)).alias("lacking"), F.count(F.when(apart, 1)).alias("apart"))


def drawable_span(points: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys, i, ok) with inside: whether i lies between the first and the last ok column of its group."""
    own = Window.partitionBy(*keys)
    first, last = F.min(F.when(F.col("ok"), F.col("i"))).over(own), F.max(F.when(F.col("ok"), F.col("i"))).over(own)
    return points.withColumn("inside", F.coalesce(F.col("i").between(first, last), F.lit(False)))
