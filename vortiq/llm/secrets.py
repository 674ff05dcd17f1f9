"""Secret scans with a trigram inverted index, by DataFrame functions only.

Each rule's regular expression is turned into a Boolean query over trigrams. The index holds, for every trigram of
these queries and every segment of texts, the texts that hold it; intersecting its lists gives candidates, and only
these are verified by the expression. Rules without mandatory trigrams scan every text. Texts are known to the index
by a 64-bit hash: equal texts share an entry, and a collision costs a vain verification at most.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .trigrams import as_alternation, query


@dataclass(frozen=True)
class Rule:
    """least: characters that the group must have; a match that falls short is dropped, but its text is used up."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0


# The three base kinds, in order, and the further ones.
BASE = [
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
]
MORE = [
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}"),
    Rule("service", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("login", r"[a-z]{2,10}://[A-Za-z0-9_.-]{1,64}:[A-Za-z0-9_.-]{1,64}@"),
]
#: Texts in one posting list, on average at most.
SEGMENT = 20_000


def build_index(texts: DataFrame, trigrams: list[str], segments: int) -> DataFrame:
    """Postings (trigram, segment, keys) of texts (key, text); only the given trigrams are indexed."""
    held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(as_alternation(trigrams)), F.lit(1)))
    entries = texts.select("key", F.explode(held).alias("trigram"))
    return entries.groupBy("trigram", F.pmod("key", F.lit(segments)).alias("segment")).agg(F.collect_set("key").alias("keys"))


def candidates(index: DataFrame, rules: dict[str, frozenset[frozenset[str]]]) -> DataFrame:
    """(key, rules) of texts that satisfy some rule's query: posting lists are intersected segment by segment."""
    spark = index.sparkSession
    terms = [(t, name, k, len(part)) for name, q in rules.items() for k, part in enumerate(sorted(map(sorted, q))) for t in part]
    wanted = spark.createDataFrame(terms, "trigram string, rule string, part int, size int")
    lists = index.join(F.broadcast(wanted), "trigram").groupBy("segment", "rule", "part", "size").agg(F.collect_list("keys").alias("lists"))
    met = lists.where(F.size("lists") == F.col("size")).select("rule", F.explode(F.aggregate(F.slice("lists", F.lit(2), F.col("size")), F.element_at("lists", 1), F.array_intersect)).alias("key"))
    return met.groupBy("key").agg(F.collect_set("rule").alias("rules"))


#: Matches whose places are added up in one array; longer lists are worked on in such chunks.
CHUNK = 512


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """Spans (start, number, end, name) by code points of a rule's matches, leftmost first, without overlaps.

    The text is walked as gaps and hits, whose lengths add up to places: first chunk by chunk, then within each chunk,
    so that a text of very many hits takes time by their number and not by its square.
    """
    walk = rf"(?s)(.*?)(?:({rule.pattern})|\z)"
    gaps, hits = (F.regexp_extract_all(text, F.lit(walk), F.lit(k)) for k in (1, 2))
    long = lambda x: F.char_length(x).cast("long")
    sized = F.zip_with(gaps, hits, lambda g, h: F.struct(long(g).alias("gap"), long(h).alias("own"), (F.char_length(F.regexp_extract(h, rule.pattern, rule.group)) >= rule.least).alias("right")))
    none = F.array().cast("array<struct<start:long,number:int,end:long,name:string>>")
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))
    zero = F.lit(0).cast("long")

    def step(held: Column, x: Column) -> Column:
        begin = held["at"] + x["gap"]
        span = F.struct(begin.alias("start"), F.lit(number).alias("number"), (begin + x["own"]).alias("end"), F.lit(rule.name).alias("name"))
        return state(begin + x["own"], F.when((x["own"] > 0) & x["right"], F.concat(held["out"], F.array(span))).otherwise(held["out"]))

    def spans(chunks: Column) -> Column:
        lengths = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda a, x: a + x["gap"] + x["own"]))
        starts = F.aggregate(lengths, state(zero, F.array().cast("array<bigint>")), lambda held, n: state(held["at"] + n, F.concat(held["out"], F.array(held["at"]))), lambda held: held["out"])
        return F.flatten(F.zip_with(chunks, starts, lambda c, at: F.aggregate(c, state(at, none), step, lambda held: held["out"])))

    chunked = lambda z: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(z) - 1, F.lit(0)) / CHUNK).cast("int")), lambda k: F.slice(z, k * CHUNK + 1, F.lit(CHUNK)))
    return _let(sized, lambda z: _let(chunked(z), spans))


def scan(docs: DataFrame, base: list[Rule] = BASE, more: list[Rule] = MORE) -> DataFrame:
    """doc_id and spans (sorted by start, then rule) of every row.

    A null text counts as empty. Rows of equal id or text each get their own row; an empty table gives an empty
    result; other columns are ignored.
    """
    rules = [*base, *more]
    queries = {r.name: query(r.pattern) for r in rules}
    indexed = {name: q for name, q in queries.items() if q is not None}
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    segments = max(1, -(-texts.count() // SEGMENT))
    index = materialize(build_index(texts, sorted({t for q in indexed.values() for part in q for t in part}), segments), "trigrams")
    found = candidates(index, indexed)
    joined = texts.join(found, "key", "left")
    empty = F.array().cast("array<struct<start:long,number:int,end:long,name:string>>")
    parts = []
    for number, rule in enumerate(rules):
        may = F.col("text").rlike(rule.pattern)
        if rule.name in indexed:
            may = F.coalesce(F.array_contains("rules", rule.name), F.lit(False)) & may
        parts.append(F.when(may, spans_of(F.col("text"), rule, number)).otherwise(empty))
    return joined.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def digest(found: DataFrame, base: list[Rule] = BASE) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as kind:start:end, comma-joined."""
    shown = lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))
    own = F.filter("spans", lambda s: s["number"] < len(base))
    of = lambda k: F.filter("spans", lambda s: s["number"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{r.name}") for k, r in enumerate(base)]
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(own, shown), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", shown), ",").alias("spans"))
