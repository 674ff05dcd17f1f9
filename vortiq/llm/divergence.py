"""Audit of how far the sources of a language drift apart in their terms, with wide term vectors.

Terms are counted in the tasks that read the texts, by (lang, source, term), and summed. Each kept term then becomes
one row with an array indexed by the language's sources; higher-order functions turn that array into shares and into
the contributions of all pairs of sources, which are summed map-side again. Nothing is joined source with source.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

# Fixed values of the contract: what a term's bytes are, the share's unit, the count added to every term.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNIT, ADDED = 1_000_000_000, 5
#: Bytes of UTF-8 to themselves, A-Z to a-z, and those between terms to a space.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Distinct terms and groups that a task counts before it hands them on.
HELD = 300_000


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + ADDED) / (total + ADDED * kept)), exact for counts of any size."""
    wide = lambda c: c.cast("decimal(19,0)")
    return (F.expr("1L") + F.call_function("div", wide(count + F.lit(ADDED)) * F.lit(UNIT).cast("decimal(10,0)"), wide(total + F.lit(ADDED) * kept))).cast("long")


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and rows of docs that hold the term. Nulls count as ''.

    A group without terms has one row whose term is null. Tasks count the terms of their rows by group, in tables of at
    most HELD terms and one text's, before anything is shuffled.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, rows) in found.items():
                terms = list(rows) or [None]
                column = lambda v: pa.array([v] * len(terms), pa.string())
                yield pa.RecordBatch.from_arrays([column(lang), column(source), pa.array(terms, pa.string()), pa.array([times[t] for t in terms], pa.int64()), pa.array([rows[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            found.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = (text.as_py() or "").encode().translate(TERM_BYTES).split(b" ")
                times, rows = found.setdefault((lang, source), (Counter(), Counter()))
                held -= len(rows)
                times.update(words)
                rows.update(set(words))
                del times[b""], rows[b""]
                held += len(rows)
                if held + len(found) > HELD:
                    yield from told()
                    held = 0
        yield from told()

    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    each = docs.select(text("lang"), text("source"), text("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def wide_vectors(counts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(vectors, langs): one row a kept term with its counts in the order of the language's sources, and one row a
    language with its sources, their totals over kept terms, and the number of kept terms."""
    sources = counts.groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    found = counts.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("some"))
    kept = found.where(F.col("docs") >= least).join(sources, "lang")
    # a zero for each source, behind what was counted; the first of each source stays
    padded = F.array_sort(F.concat(F.transform("some", lambda x: F.struct(x["source"].alias("source"), (-x["n"]).alias("n"))), F.transform("sources", lambda s: F.struct(s.alias("source"), F.lit(0).cast("long").alias("n")))))
    first = F.filter("padded", lambda x, i: (i == 0) | (F.element_at("padded", F.greatest(i, F.lit(1)))["source"] != x["source"]))
    vectors = materialize(kept.select("lang", "term", padded.alias("padded")).select("lang", "term", F.transform(first, lambda x: -x["n"]).alias("counts")), "terms")
    totals = vectors.select("lang", F.posexplode("counts").alias("at", "n")).groupBy("lang", "at").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kept"))
    per_lang = totals.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "total"))), lambda x: x["total"]).alias("totals"), F.max("kept").alias("kept"))
    langs = sources.join(per_lang, "lang", "left").select("lang", "sources", F.coalesce("totals", F.transform("sources", lambda s: F.lit(0).cast("long"))).alias("totals"), F.coalesce("kept", F.lit(0)).cast("long").alias("kept"))
    return vectors, materialize(langs, "langs")


def audit(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """Divergence of sources: lang, source, part, item, value, rank.

    Part 'pair': the sum over the language's kept terms (those in at least `least` rows) of |p - q| for each other
    source, all ranks; 0 where no term is kept. Part 'term': the `top` kept terms of which the source has more than
    its language. Ranks fall with the value; ties go by the item's UTF-8 bytes.

    Null lang, source and text count as ''; repeated rows and ids count each; other columns are ignored; an empty
    table gives an empty result. Only whole groups and vectors travel: a row's size is the number of sources of a
    language, and the number of pairs is that of the result.
    """
    vectors, langs = wide_vectors(materialize(term_counts(docs), "counts"), least)
    shares = vectors.join(langs, "lang").select(
        "lang", "term", "counts", "sources",
        F.zip_with("counts", "totals", lambda n, t: share(n, t, F.col("kept"))).alias("shares"),
        share(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n), F.aggregate("totals", F.lit(0).cast("long"), lambda a, n: a + n), F.col("kept")).alias("whole"),
    )

    # contributions of all pairs i < j of a term, as one array
    later = lambda i: F.transform(F.sequence(i + 1, F.size("shares") - 1), lambda j: F.struct(i.alias("i"), j.alias("j"), F.abs(F.element_at("shares", i + 1) - F.element_at("shares", j + 1)).alias("f")))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.size("shares") - 2), later))
    sums = shares.where(F.size("shares") > 1).select("lang", F.explode(pairs).alias("x")).groupBy("lang", "x.i", "x.j").agg(F.sum("x.f").alias("value"))
    both = sums.select("lang", "i", "j", "value").union(sums.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    ends = langs.select("lang", "sources", F.posexplode("sources").alias("i", "source")).select("lang", "i", "source", F.posexplode("sources").alias("j", "item")).where("i <> j")
    by_pair = ends.join(both, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    own = F.filter(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("n"), F.col("shares").alias("p")), lambda x: (x["n"] > 0) & (x["p"] > F.col("whole")))
    by_term = shares.select("lang", "term", "whole", F.explode(own).alias("x")).select("lang", "x.source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("x.p") - F.col("whole")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(by_pair).union(ranked(by_term).where(F.col("rank") <= top))
