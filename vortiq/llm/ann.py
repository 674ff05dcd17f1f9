"""Approximate nearest neighbours by additive quantisation.

A vector is a sum of one code word from each of several full-dimensional codebooks. The codebooks are trained on the
residuals of a bounded sample and refitted by least squares; beam search picks the words. A query's inner products
with all words make a lookup table; a row's score is a sum of looked-up numbers (less half its stored norm where
nearness is Euclidean). The best rows by these scores are ranked again by the original vectors. What a code leaves out of
its vector is known by length, and bounds how wrong its score can be: every row that could still be among the nearest
by that bound is ranked exactly as well, so that rows that codes tell apart badly are not missed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vectors import matrix, parted, precision


class Codebooks:
    """words: codebooks x words x dim."""

    def __init__(self, words: np.ndarray, beam: int = 2):
        self.words, self.beam = words.astype(np.float32), beam
        self.norms = (self.words**2).sum(2)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes (rows x codebooks) by beam search: what the best few partial sums leave is coded by the next codebook."""
        m, k, dim = self.words.shape
        left = x.astype(np.float32)[:, None]
        codes = np.zeros((len(x), 1, 0), dtype=np.int64)
        for c in range(m):
            error = (left**2).sum(2)[:, :, None] - 2 * (left @ self.words[c].T) + self.norms[c]
            flat = error.reshape(len(x), -1)
            width = min(self.beam if c + 1 < m else 1, flat.shape[1])
            best = np.argpartition(flat, width - 1, axis=1)[:, :width]
            parent, word = best // k, best % k
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None]], axis=2)
            left = np.take_along_axis(left, parent[:, :, None], 1) - self.words[c][word]
        return codes[:, 0].astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[c][codes[:, c]].astype(float) for c in range(len(self.words)))

    def slack(self, dim: int) -> float:
        """By how much single precision may falsify a look-up, for a query of length 1."""
        return (len(self.words) + dim) * 2.0**-22 * float(np.sqrt(self.norms.max(1).astype(float)).sum())

    def lookup(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of queries with all words: codebooks x words x queries."""
        return np.einsum("mkd,qd->mkq", self.words, queries.astype(np.float32), optimize=True)


def fit(sample: np.ndarray, codebooks: int = 24, words: int = 128, rounds: int = 5, refits: int = 1, seed: int = 11) -> Codebooks:
    """Residual k-means for each codebook in turn, then beam encoding and least-squares refitting."""
    rng = np.random.default_rng(seed)
    x = sample.astype(np.float32)
    dim, left, books = x.shape[1], x.copy(), []
    for _ in range(codebooks):
        centres = left[rng.choice(len(left), words, replace=len(left) < words)].copy()
        for _ in range(rounds):
            near = ((centres * centres).sum(1) - 2 * (left @ centres.T)).argmin(1)
            member = (near == np.arange(words)[:, None]).astype(np.float32)
            n = member.sum(1)
            centres[n > 0] = (member @ left)[n > 0] / n[n > 0, None]
        near = ((centres * centres).sum(1) - 2 * (left @ centres.T)).argmin(1)
        left -= centres[near]
        books.append(centres)
    own = Codebooks(np.stack(books))
    for _ in range(refits):
        codes = own.encode(x).astype(np.int64) + np.arange(codebooks) * words
        normal, right = np.zeros((codebooks * words,) * 2), np.zeros((codebooks * words, dim))
        for a in range(codebooks):
            np.add.at(right, codes[:, a], x)
            for b in range(codebooks):
                np.add.at(normal, (codes[:, a], codes[:, b]), 1.0)
        prior = own.words.reshape(-1, dim)
        own = Codebooks(np.linalg.solve((normal + np.eye(len(normal))).astype(np.float32), (right + prior).astype(np.float32)).reshape(codebooks, words, dim))
    return own


def first_of(rough: np.ndarray, n: int) -> np.ndarray:
    """Rows (by column) of the n largest numbers of each column; equal ones at the border go by smaller row."""
    if n >= len(rough):
        return np.broadcast_to(np.arange(len(rough))[:, None], rough.shape)
    best = np.argpartition(-rough, n - 1, axis=0)[:n]
    least = np.take_along_axis(rough, best, 0).min(0)
    for q in np.flatnonzero((rough >= least).sum(0) > n):
        above, level = np.flatnonzero(rough[:, q] > least[q]), np.flatnonzero(rough[:, q] == least[q])
        best[:, q] = np.concatenate([above, level[: n - len(above)]])
    return best


def nearest(books: Codebooks, x: np.ndarray, codes: np.ndarray, gap: np.ndarray, queries: np.ndarray, wide: int, most: int, measure: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows (queries x wide, nearest first, smaller rows at ties) and scores of the nearest of all x by the exact measure.

    The `most` best by the codes give a level that the wide nearest reach; a row whose code, with all that its error can
    add (gap: the length of what the code leaves out), stays below it is out; all others are scored exactly.
    """
    length = np.sqrt((queries**2).sum(1))
    table = books.lookup(queries)
    reach = np.zeros((len(x), len(queries)), dtype=np.float32)
    for c in range(codes.shape[1]):
        reach += table[c][codes[:, c]]
    reach = reach.astype(float)
    size = (x**2).sum(1)
    if measure != "inner":
        reach -= size[:, None] / 2

    def exact(r: np.ndarray, q: np.ndarray) -> np.ndarray:
        parts = [(x[a], queries[b]) for a, b in zip(np.array_split(r, len(r) // (1 << 16) + 1), np.array_split(q, len(q) // (1 << 16) + 1))]
        return np.concatenate([(a * b).sum(1) if measure == "inner" else -((a - b) ** 2).sum(1) for a, b in parts])

    every = np.arange(len(queries))
    first = first_of(reach, min(len(x), most))
    score = exact(first.ravel(), np.tile(every, len(first))).reshape(first.shape)
    wide = min(wide, len(x))
    level = np.partition(score, len(score) - wide, axis=0)[len(score) - wide]
    # the same level in terms of the inner product less half the row's square
    limit = level if measure == "inner" else (level + length**2) / 2
    rounding = 1e-13 * x.shape[1] * (np.sqrt(size)[:, None] * length + (0 if measure == "inner" else size[:, None] + length**2))
    left = reach + gap[:, None] * (length * (1 + 1e-6)) + books.slack(x.shape[1]) * length + rounding >= limit
    if np.count_nonzero(left) > left.size // 50:
        product = x @ queries.T
        left &= product - (0 if measure == "inner" else size[:, None] / 2) + rounding >= limit
    left[first, every] = True
    q, r = np.nonzero(left.T)
    score = exact(r, q)
    order = np.lexsort((r, -score, q))
    starts = np.searchsorted(q, every)
    pick = order[starts[:, None] + np.arange(wide)]
    return r[pick], score[pick]


def search(embeddings: DataFrame, is_query: str, k: int = 20, measure: str = "inner", max_sample: int = 6000, row_block: int = 65536, query_block: int = 8192, rerank: int = 400) -> DataFrame:
    """The k nearest rows of every query row: query_id, rank, vec_id, score.

    is_query is a condition on vec_id. Rows without a usable vector take no part (see vectors.parted). Every distinct
    vector is indexed once, with the k + 1 smallest ids that have it, and asked once, however many rows share it. About
    the `rerank` best by approximate scores, and all others that the bound of their error leaves in reach, are ranked by
    the exact measure on the original vectors in double precision: "inner" (largest product) or "l2" (smallest distance,
    score its negative square). A row isn't
    its own neighbour; ties go to the smaller vec_id, however many rows tie. Rows equal in id and vector count once.
    Unlike vectors under one id are candidates of their own; if that id asks, a candidate's score is the best that any
    of them gives. Fewer candidates than k give them all. The codebooks are fitted to about max_sample vectors, chosen
    by a hash. Vectors with their codes and queries meet in cells of bounded size (a block of each); no side is broadcast.
    A cell passes on its own nearest, k and as many as an id has vectors.
    """
    rows = materialize(parted(embeddings)[0].distinct().select("vec_id", F.xxhash64("embedding").alias("own"), "embedding"), "rows")
    # a vector goes by its smallest id and its hash; of its ids no more than k + 1 are kept, before anything is collected
    nth = F.row_number().over(Window.partitionBy("own", "embedding").orderBy("vec_id"))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    vectors = materialize(few.groupBy("own", "embedding").agg(F.min("vec_id").alias("head"), F.array_sort(F.collect_list("vec_id")).alias("members")), "vectors")
    asks = materialize(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "own", "embedding").join(vectors, ["own", "embedding"]).select("query_id", F.col("head").alias("q_head"), F.col("own").alias("q_own")), "asks")
    wanted = asks.select(F.col("q_head").alias("head"), F.col("q_own").alias("own")).distinct()
    asking = materialize(vectors.join(wanted, ["head", "own"]).select(F.col("head").alias("q_head"), F.col("own").alias("q_own"), F.col("embedding").alias("query")), "asking")
    total, asked = vectors.count(), asking.count()
    if not total or not asked:
        return rows.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    # an id with several vectors may have to leave out more than one of its own
    repeats = asks.groupBy("query_id").count().agg(F.max("count")).first()[0]
    dim = len(vectors.first()["embedding"])
    share = min(1 << 20, -(-(max_sample << 20) // total))
    sample = vectors.where(F.pmod(F.xxhash64("head", "own"), F.lit(1 << 20)) < share).select("head", "own", "embedding").toArrow().sort_by([("head", "ascending"), ("own", "ascending")])
    books = fit(matrix(sample.column("embedding"), dim) if sample.num_rows else np.zeros((1, dim)))
    # a query leaves its nearest in each block of rows, so these are large; smaller ones of queries share out the work
    row_blocks, query_blocks = -(-total // row_block), -(-asked // min(query_block, max(512, asked // 8)))
    wide = k + repeats
    most = max(wide, -(-max(rerank, wide) // row_blocks))
    kind = precision(embeddings)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = matrix(part.column(3), dim)
                codes = books.encode(x)
                gap = np.sqrt(((x.astype(float) - books.decode(codes)) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(gap)], names=["head", "own", "members", "embedding", "codes", "gap"])

    index = vectors.select("head", "own", "members", "embedding").mapInArrow(encode, f"head long, own long, members array<long>, embedding array<{kind}>, codes binary, gap double")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = index.withColumn("r", F.pmod(F.xxhash64("head", "own"), F.lit(row_blocks)).cast("int")).withColumn("q", numbers(query_blocks))
    theirs = asking.withColumn("q", F.pmod(F.xxhash64("q_head", "q_own", F.lit(1)), F.lit(query_blocks)).cast("int")).withColumn("r", numbers(row_blocks))
    names = ["q_head", "q_own", "head", "own", "members", "score"]

    def meet(held: pa.Table, queries: pa.Table) -> pa.Table:
        if not held.num_rows or not queries.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4 + [pa.array([], pa.list_(pa.int64())), pa.array([], pa.float64())], names=names)
        held = held.sort_by([("head", "ascending"), ("own", "ascending")])
        codes = np.frombuffer(b"".join(held.column("codes").to_pylist()), dtype=np.uint8).reshape(held.num_rows, -1)
        x, gap = matrix(held.column("embedding"), dim).astype(float), held.column("gap").to_numpy()
        near = [nearest(books, x, codes, gap, matrix(queries.column("query").slice(at, 32), dim).astype(float), wide, most, measure) for at in range(0, queries.num_rows, 32)]
        rows, score = np.concatenate([n[0].ravel() for n in near]), np.concatenate([n[1].ravel() for n in near])
        asked_ = np.repeat(np.arange(queries.num_rows), min(wide, held.num_rows))
        own, who = held.select(["head", "own", "members"]).take(pa.array(rows)), queries.select(["q_head", "q_own"]).take(pa.array(asked_))
        return pa.table([*who.columns, *own.columns, pa.array(score)], names=names)

    query = ["q_head", "q_own"]
    found = mine.groupBy("r", "q").cogroup(theirs.groupBy("r", "q")).applyInArrow(meet, "q_head long, q_own long, head long, own long, members array<long>, score double")
    # vectors beyond the first k + repeats, of those that tie the ones with larger ids, can't be among the k of any id
    kept = found.withColumn("place", F.row_number().over(Window.partitionBy(*query).orderBy(F.desc("score"), "head", "own"))).where(F.col("place") <= wide)
    rows_of = kept.select(*query, "own", "score", F.explode("members").alias("vec_id"))
    short = rows_of.withColumn("place", F.row_number().over(Window.partitionBy(*query).orderBy(F.desc("score"), "vec_id", "own"))).where(F.col("place") <= wide).drop("place")
    told = asks.join(short, query).where("vec_id <> query_id").groupBy("query_id", "vec_id", "own").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "own")
    return told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
