"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with a cosine of at least t lie within a squared distance of 2 - 2t. A random rotation spreads it over
blocks of dimensions: some block holds at most its proportional share. Each block is range-joined under that budget:
cells along the block's first coordinate, with the vectors near a cell's lower end also sent to the cell below, and
cells beyond a bound split into chunks that meet pair by pair. What passes a block's budget is verified by the exact
cosine. A pair counts in the first block, and the one cell, that it must meet in, so no pair is listed or counted
twice, and tasks return counts and spanning edges, never lists of pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize
from .vectors import listed, matrix, parted, precision

SLACK = 1e-6
#: What single precision may be off by in a squared distance of unit vectors, with room to spare.
ROUGH = 1e-5


class Subspaces:
    """Rotation, blocks of dimensions, and each block's budget and cell width."""

    def __init__(self, dim: int, threshold: float, block_dims: int = 16, seed: int = 7):
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
        self.rotation = q * np.sign(np.diag(r))
        self.blocks = [(a, min(a + block_dims, dim)) for a in range(0, dim, block_dims)]
        self.budgets = [(2 - 2 * threshold) * (b - a) / dim for a, b in self.blocks]
        self.widths = [2 * (x + SLACK) ** 0.5 for x in self.budgets]
        self.threshold = threshold

    def rotate(self, unit: np.ndarray) -> np.ndarray:
        """Element by element, so that a row's result is the same in whatever batch it comes."""
        out = np.zeros_like(unit)
        for k in range(unit.shape[1]):
            out += unit[:, k : k + 1] * self.rotation[k]
        return out

    def cells(self, z: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(block, rows, cell, home): every row at home, and below where its lower end is near."""
        everyone = np.arange(len(z))
        for block, ((a, _), width) in enumerate(zip(self.blocks, self.widths)):
            home = np.floor(z[:, a] / width).astype(np.int64)
            near = np.flatnonzero(z[:, a] - home * width <= width / 2)
            yield block, everyone, home, home
            yield block, near, home[near] - 1, home[near]


def unit(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float64)
    return y / np.sqrt((y * y).sum(1, keepdims=True))


def compare(x: np.ndarray, counts: np.ndarray, home: np.ndarray, side: np.ndarray, spaces: Subspaces, block: int, cell: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Of rows that meet in one cell: links to others (weighted by counts) and the root, an index, of each row.

    One matrix product a tile gives the squared distances within the block, in single precision with slack; what
    passes is settled in double precision, and its block by the same rotation of single rows everywhere.
    """
    y, raw = unit(x), x.astype(np.float64)
    norms = np.sqrt((raw * raw).sum(1))
    a, b = spaces.blocks[block]
    own = y @ spaces.rotation[:, a:b]
    square, one = (own * own).sum(1, keepdims=True), np.ones((len(x), 1))
    first_half = np.hstack([own, square, one]).astype(np.float32)
    second_half = np.hstack([-2 * own, one, square]).astype(np.float32)
    limit = np.float32(spaces.budgets[block] + ROUGH)
    links, label = np.zeros(len(x), np.int64), np.arange(len(x))
    left, right = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
    same = side.min() == side.max()
    for i0, j0 in product(range(0, len(left), tile), range(0, len(right), tile)):
        if same and j0 < i0:
            continue
        rows, cols = left[i0 : i0 + tile], right[j0 : j0 + tile]
        close = first_half[rows] @ second_half[cols].T <= limit
        if same and i0 == j0:
            close = np.triu(close, 1)
        flat = np.flatnonzero(close)
        for at in range(0, len(flat), 1 << 15):
            i, j = rows[flat[at : at + (1 << 15)] // len(cols)], cols[flat[at : at + (1 << 15)] % len(cols)]
            met = np.minimum(home[i], home[j]) == cell
            i, j = i[met], j[met]
            cosine = np.einsum("ij,ij->i", raw[i], raw[j]) / (norms[i] * norms[j])
            i, j = i[cosine >= spaces.threshold], j[cosine >= spaces.threshold]
            if not len(i):
                continue
            who, where = np.unique(np.concatenate([i, j]), return_inverse=True)
            z = spaces.rotate(y[who])
            apart = (z[where[: len(i)]] - z[where[len(i) :]]) ** 2
            first = np.full(len(i), len(spaces.blocks))
            for k in range(block, -1, -1):
                lo, hi = spaces.blocks[k]
                first[sum(apart[:, c] for c in range(lo, hi)) <= spaces.budgets[k] * (1 + 1e-9) + 1e-12] = k
            i, j = i[first == block], j[first == block]
            links += np.bincount(i, counts[j], len(x)).astype(np.int64) + np.bincount(j, counts[i], len(x)).astype(np.int64)
            while len(i):
                p, q = label[i], label[j]
                differ = p != q
                if not differ.any():
                    break
                np.minimum.at(label, np.maximum(p, q)[differ], np.minimum(p, q)[differ])
                while (label[label] != label).any():
                    label = label[label]
    return links, label


def near_duplicates(embeddings: DataFrame, threshold: float = 0.9, block_dims: int = 16, chunk: int = 65536) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Equal vectors are one class: they link with each other and share the links of their class. Vectors that are null,
    zero, hold null or non-finite components, are of another length than most, or have a null id link with nothing and
    are components of their own. Repeated rows count as vectors of their own. An empty table gives an empty result;
    other columns are ignored. Beside spans of cells, only the number of rows of each cell reaches the driver: at most
    (2 / width + 2) cells a block, whatever the corpus.
    """
    rows, others = parted(embeddings)
    alone = others.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    classes = materialize(rows.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    first = classes.first()
    if first is None:
        return alone.withColumn("kept", F.lit(True))
    dim = len(first["embedding"])
    spaces = Subspaces(dim, threshold, block_dims)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, _, cell, _ in spaces.cells(spaces.rotate(unit(matrix(batch.column(0), dim)))):
                which, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), block), pa.int32()), pa.array(which), pa.array(n)], names=["block", "cell", "n"])

    sizes = {(r["block"], r["cell"]): r["n"] for r in classes.select("embedding").mapInArrow(count, "block int, cell long, n long").groupBy("block", "cell").agg(F.sum("n").alias("n")).collect()}
    chunks = {k: -(-n // chunk) for k, n in sizes.items()}

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rep = matrix(batch.column(0), dim), batch.column(1).to_numpy()
            mixed = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for block, own, cell, home in spaces.cells(spaces.rotate(unit(x))):
                for c in np.unique(cell):
                    at = np.flatnonzero(cell == c)
                    k = chunks[block, int(c)]
                    side = (mixed[own[at]] % np.uint64(k)).astype(np.int32)
                    for other in range(k):
                        who = own[at]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), block), pa.int32()), pa.array(cell[at]), pa.array(np.minimum(side, other), pa.int32()), pa.array(np.maximum(side, other), pa.int32()), pa.array(side), pa.array(home[at]), batch.column(1).take(pa.array(who)), batch.column(2).take(pa.array(who)), listed(x[who])],
                            names=["block", "cell", "low", "high", "side", "home", "rep", "n", "embedding"],
                        )

    dealt = classes.select("embedding", "rep", "n").mapInArrow(deal, f"block int, cell long, low int, high int, side int, home long, rep long, n long, embedding array<{precision(embeddings)}>")

    def meet(group: pa.Table) -> pa.Table:
        ids, n, home, side = (group.column(c).to_numpy() for c in ("rep", "n", "home", "side"))
        if group.column("low")[0] != group.column("high")[0] and side.min() == side.max():
            links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        else:
            links, label = compare(matrix(group.column("embedding"), dim), n, home, side, spaces, group.column("block")[0].as_py(), group.column("cell")[0].as_py())
        some = links > 0
        return pa.table({"rep": ids[some], "links": links[some], "root": ids[label[some]]})

    met = materialize(dealt.groupBy("block", "cell", "low", "high").applyInArrow(meet, "rep long, links long, root long"), "links")
    linked = met.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = connected_components(met.where("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v")).distinct())
    placed = classes.join(linked, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    done = rows.join(placed, "embedding").select("vec_id", "n_links", "component_id")
    return done.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
