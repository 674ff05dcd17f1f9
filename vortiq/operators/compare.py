"""Two catalogs of the same frames side by side, and which gates keep annotated structures from being found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .matching import runs

FRAME = ("repeat_id", "frame_id", "sign")


def row_runs(catalog: DataFrame, keys: tuple[str, ...] = FRAME, node: str = "structure_id") -> DataFrame:
    """Structures (keys, node, pixels) as runs of their rows: keys, node, j, first, last."""
    return runs(catalog.select(*keys, F.col(node).alias("node"), F.explode("pixels").alias("_p")).select(*keys, "node", "_p.j", "_p.i"), [*keys, "node"])


def paired(before: DataFrame, after: DataFrame, threshold: float = 0.0, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """What became of the structures of one catalog in another: keys, before, after, kind, shared, overlap.

    Both have keys, structure_id, pixel_count and pixels. Structures of one key (frame and sign) are linked if they share
    pixels, more than threshold times the smaller one's. kind of a link: kept (one to one), split (one became several),
    joined (several became one) or regrouped (both); lost and new stand for structures without a link.
    """
    sizes = lambda df, name: df.select(*keys, F.col("structure_id").alias(name), F.col("pixel_count").alias(f"_{name}"))
    rows = lambda df, name: row_runs(df, keys).withColumnRenamed("node", name)
    common = F.least("last", "_l") - F.greatest("first", "_f") + 1
    other = rows(after, "after").withColumnsRenamed({"first": "_f", "last": "_l"})
    met = rows(before, "before").join(other, [*keys, "j"]).where(common > 0).groupBy(*keys, "before", "after").agg(F.sum(common).alias("shared"))
    linked = met.join(sizes(before, "before"), [*keys, "before"]).join(sizes(after, "after"), [*keys, "after"]).withColumn("overlap", F.col("shared") / F.least("_before", "_after")).where(F.col("overlap") > threshold)
    of = lambda name: F.count(F.lit(1)).over(Window.partitionBy(*keys, name))
    out, into = F.col("_o") > 1, F.col("_i") > 1
    kind = F.when(out & into, "regrouped").when(out, "split").when(into, "joined").otherwise("kept")
    links = linked.withColumns({"_o": of("before"), "_i": of("after")}).select(*keys, "before", "after", kind.alias("kind"), "shared", "overlap")
    alone = lambda df, name, word: sizes(df, name).join(links.select(*keys, name).distinct(), [*keys, name], "left_anti").select(*keys, *[F.col(name) if n == name else F.lit(None).cast("long").alias(n) for n in ("before", "after")], F.lit(word).alias("kind"), F.lit(0).cast("long").alias("shared"), F.lit(None).cast("double").alias("overlap"))
    return links.unionByName(alone(before, "before", "lost")).unionByName(alone(after, "after", "new"))


def pair_summary(pairs: DataFrame) -> DataFrame:
    """By sign and kind: links or structures, frames they occur in, shared pixels and mean overlap."""
    return pairs.groupBy("sign", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("frame_id").alias("frames"), F.sum("shared").alias("shared"), F.avg("overlap").alias("overlap"))


def _pixels(windows: DataFrame, samples: DataFrame, scale: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """Valid samples within annotated windows (frame_id, box_id, sign, i0, i1) with the verdict of every gate."""
    own = samples.where("u is not null").join(scale.select("j", "u_rms"), "j").select("frame_id", "j", "i", "u", "u_rms")
    met = windows.join(own, "frame_id").where(F.col("i").between(F.col("i0"), F.col("i1")))
    return met.select("frame_id", "box_id", "sign", "j", *[F.coalesce(g, F.lit(False)).alias(f"_{name}") for name, g in gates.items()])


def _every(names: list[str], without: str | None = None) -> Column:
    out = F.lit(True)
    for name in names:
        if name != without:
            out = out & F.col(f"_{name}")
    return out


def gate_audit(windows: DataFrame, samples: DataFrame, scale: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """Each annotated window: the share of its valid pixels that each gate passes alone, that all pass together, and
    that would pass without it; binding is the gate without which most would pass (the first in order at ties; NULL
    where leaving one out changes nothing).

    gates: conditions on sign, u and u_rms (scale: j, u_rms). Pixels are read once; all shares are conditional counts of
    one aggregation.
    """
    names, whole = list(gates), F.count(F.lit(1))
    share = lambda c: ratio(F.count(F.when(c, 1)), whole)
    got = _pixels(windows, samples, scale, gates).groupBy("frame_id", "box_id", "sign").agg(whole.alias("pixels"), *[share(F.col(f"_{n}")).alias(f"share_{n}") for n in names], *[share(_every(names, n)).alias(f"without_{n}") for n in names], share(_every(names)).alias("share_all"))
    best = F.greatest(*[F.col(f"without_{n}") for n in names]) if len(names) > 1 else F.col(f"without_{names[0]}")
    binding = F.coalesce(*[F.when((F.col(f"without_{n}") == best) & (best > F.col("share_all")), n) for n in names])
    return got.withColumn("binding", binding)


def gate_rows(windows: DataFrame, samples: DataFrame, scale: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """The same by distance from the wall: by row j the pixels within windows, those that all gates pass, those that one
    gate alone keeps out, and which gate keeps most out alone (the first at ties, NULL for none)."""
    names = list(gates)
    alone = lambda n: F.count(F.when(~F.col(f"_{n}") & _every(names, n), 1))
    got = _pixels(windows, samples, scale, gates).groupBy("j").agg(F.count(F.lit(1)).alias("pixels"), F.count(F.when(_every(names), 1)).alias("passed"), *[alone(n).alias(f"only_{n}") for n in names])
    most = F.greatest(*[F.col(f"only_{n}") for n in names]) if len(names) > 1 else F.col(f"only_{names[0]}")
    return got.withColumn("binding", F.coalesce(*[F.when((F.col(f"only_{n}") == most) & (most > 0), n) for n in names]))
