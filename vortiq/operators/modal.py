"""Modal decompositions of sequences of fields.

A snapshot is a frame's vector of degrees of freedom (u at all kept points, then v). The smaller side is decomposed.
With fewer degrees of freedom than frames, outer products are added up per partition (dof x dof). With fewer frames,
snapshots are cut into spatial blocks: a task holds all frames of one block and emits its products tile by tile, which
Spark adds up; so no task holds more than frames x width numbers and a tile, and only frames x frames reach the driver.
Where even that is too much, leading() finds the first modes alone, with frames x rank numbers on the driver. Modes of
that side are a table of blocks, never an array on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .statistics import POINT, paired


def snapshots(samples: DataFrame, min_valid_fraction: float = 0.0) -> DataFrame:
    """frame_id and x: u then v at all points of enough valid samples, in order of row, then column; 0 where missing."""
    own = paired(samples)
    kept = own.groupBy(*POINT).agg((F.count("u") / F.count(F.lit(1))).alias("_f")).where(F.col("_f") >= min_valid_fraction).select(*POINT)
    points = F.array_sort(F.collect_list(F.struct("j", "i", F.coalesce("u", F.lit(0.0)).alias("u"), F.coalesce("v", F.lit(0.0)).alias("v"))))
    got = own.join(kept, POINT, "left_semi").groupBy("frame_id").agg(points.alias("_p"))
    return got.select("frame_id", F.concat(F.transform("_p", lambda p: p["u"]), F.transform("_p", lambda p: p["v"])).alias("x"))


def _tree(partials: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of packed arrays (column m), added up in stages so that the driver receives a handful."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            for m in batch.m:
                part = np.frombuffer(m, dtype=float)
                total = part.copy() if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"m": [total.tobytes()]})

    merged = partials.repartition(4).mapInPandas(add, "m binary")
    out = np.zeros(int(np.prod(shape)))
    for row in merged.toLocalIterator():
        out += np.frombuffer(row["m"], dtype=float)
    return out.reshape(shape)


def moments(rows: DataFrame, dof: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of snapshots, their mean, and the centred sum of outer products (dof x dof), merged with their means."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, mean, square = 0, np.zeros(dof), np.zeros((dof, dof))
        for batch in batches:
            if len(batch):
                x = np.stack(batch.x.to_numpy()).astype(float)
                own = x.mean(0)
                gap = own - mean
                square += (x - own).T @ (x - own) + np.outer(gap, gap) * (n * len(x) / (n + len(x)))
                mean += gap * (len(x) / (n + len(x)))
                n += len(x)
        if n:
            yield pd.DataFrame({"n": [n], "centre": [mean.tobytes()], "square": [square.tobytes()]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, mean, square = 0, np.zeros(dof), np.zeros((dof, dof))
        for batch in batches:
            for r in batch.itertuples():
                own, other = np.frombuffer(r.centre, float), np.frombuffer(r.square, float).reshape(dof, dof)
                gap = own - mean
                square += other + np.outer(gap, gap) * (n * r.n / (n + r.n))
                mean += gap * (r.n / (n + r.n))
                n += r.n
        if n:
            yield pd.DataFrame({"n": [n], "centre": [mean.tobytes()], "square": [square.tobytes()]})

    kind = "n long, centre binary, square binary"
    few = rows.select("x").mapInPandas(run, kind).repartition(4).mapInPandas(merge, kind)
    got = list(merge([pd.DataFrame([r.asDict() for r in few.toLocalIterator()], columns=["n", "centre", "square"])]))
    if not got:
        return 0, np.zeros(dof), np.zeros((dof, dof))
    r = got[0].iloc[0]
    return int(r.n), np.frombuffer(r.centre, float), np.frombuffer(r.square, float).reshape(dof, dof)


class Pod:
    """Modes (columns), eigenvalues of X'X / dof in falling order, the mean snapshot and the number of snapshots."""

    def __init__(self, n: int, mean: np.ndarray, square: np.ndarray):
        values, vectors = np.linalg.eigh((square + square.T) / 2)
        order = np.argsort(-values, kind="stable")[: min(len(values), n)]
        self.n, self.mean, self.dof = n, mean, len(mean)
        self.eigenvalues = values[order] / len(mean)
        self.modes = vectors[:, order]
        self.total = float(np.maximum(self.eigenvalues, 0).sum())

    def energy_rank(self, target: float) -> int:
        """The first number of modes whose cumulative energy reaches the target."""
        share = self.cumulative()
        if share[-1] < target - 1e-9:
            raise ValueError("the modes that are known do not hold so much energy")
        return min(int(np.searchsorted(share, target - 1e-15) + 1), len(share))

    def cumulative(self) -> np.ndarray:
        """Share of the energy of all modes that the first ones hold together."""
        return np.cumsum(np.maximum(self.eigenvalues, 0)) / max(self.total, 1e-300)

    def chosen_rank(self, fixed: int | None = None, energy: float | None = None) -> dict[str, float]:
        """Number of modes asked for, or that hold the energy asked for, among those above the numerical noise.

        A clearly negative eigenvalue, a spectrum without energy, and more modes than there are, are errors.
        """
        values = np.asarray(self.eigenvalues, float)
        noise = max(100 * np.spacing(max(values[0], 1.0)) * max(self.dof, len(values)), np.finfo(float).tiny)
        if (values < -noise).any():
            raise ValueError("the spectrum has a negative eigenvalue")
        positive = values[values > noise]
        if not len(positive):
            raise ValueError("the snapshots have no energy")
        if fixed is not None:
            if not 1 <= fixed <= len(positive):
                raise ValueError("there are not so many modes")
            rank = fixed
        else:
            if energy is None or not 0 < energy <= 1:
                raise ValueError("the share of energy must lie in (0, 1]")
            held = np.cumsum(positive) / positive.sum()
            rank = min(int(np.searchsorted(held, energy - 1e-15)) + 1, len(positive))
        return {"rank": rank, "positive": len(positive), "noise": noise, "share": float(positive[:rank].sum() / positive.sum())}

    def threshold_rank(self) -> dict[str, float]:
        """Rank by the optimal hard threshold for singular values of unknown noise; needs all of them."""
        dof = self.dof
        if len(self.eigenvalues) < min(dof, self.n):
            raise ValueError("the threshold rests on the median of all singular values")
        s = np.sqrt(np.maximum(self.eigenvalues, 0) * dof)
        beta = min(dof, self.n) / max(dof, self.n)
        omega = 0.56 * beta**3 - 0.95 * beta**2 + 1.82 * beta + 1.43
        limit = omega * float(np.median(s[s > 0]))
        return {"beta": beta, "omega": omega, "threshold": limit, "rank": max(1, int((s > limit).sum()))}


def cut(rows: DataFrame, dof: int, width: int) -> DataFrame:
    """Snapshots (frame_id, x) as (block, frame_id, x): runs of at most width degrees of freedom."""
    parts = F.transform(F.sequence(F.lit(0), F.lit((dof - 1) // width)), lambda k: F.slice("x", k * width + 1, F.lit(width)))
    return rows.select("frame_id", F.posexplode(parts).alias("block", "x"))


def _block(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Frame ids in order and their values (frames x width) of one block."""
    order = np.argsort(group.column("frame_id").to_numpy(), kind="stable")
    lists = group.column("x").combine_chunks()
    values = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(order), -1).astype(float, copy=False)
    return group.column("frame_id").to_numpy()[order], values[order]


def block_width(n: int, task_bytes: int) -> int:
    """Degrees of freedom of a block, so that all its frames take about a quarter of what a task may hold."""
    return max(1, task_bytes // (4 * 8 * max(n, 1)))


def gramian(rows: DataFrame, n: int, dof: int, centred: bool = True, task_bytes: int = 1 << 30, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Frame ids and the frames x frames products of snapshots, centred about their mean or as they are."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, x = _block(pa.Table.from_batches(batches))
        if centred:
            x = x - x.mean(0)
        for a in range(0, len(x), tile):
            for b in range(a, len(x), tile):
                yield pa.RecordBatch.from_pydict({"a": [a], "b": [b], "m": pa.array([(x[a : a + tile] @ x[b : b + tile].T).tobytes()], pa.binary())})

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(m.as_py(), float) for batch in batches for m in batch.column("m"))
        yield pa.RecordBatch.from_pydict({"a": [key[0].as_py()], "b": [key[1].as_py()], "m": pa.array([total.tobytes()], pa.binary())})

    kind = "a long, b long, m binary"
    tiles = cut(rows, dof, block_width(n, task_bytes)).groupBy("block").applyInArrow(products, kind).groupBy("a", "b").applyInArrow(add, kind)
    out = np.zeros((n, n))
    for r in tiles.toLocalIterator():
        a, b = r["a"], r["b"]
        part = np.frombuffer(r["m"], float).reshape(min(tile, n - a), min(tile, n - b))
        out[a : a + tile, b : b + tile] = part
        out[b : b + tile, a : a + tile] = part.T
    ids = np.array([r["frame_id"] for r in rows.select("frame_id").orderBy("frame_id").collect()])
    return ids, out


class FramePod(Pod):
    """The same from the frames' side: `vectors` (frames x modes) are the modes' courses in time, to unit length."""

    def __init__(self, ids: np.ndarray, products: np.ndarray, dof: int, task_bytes: int = 1 << 30):
        values, vectors = np.linalg.eigh((products + products.T) / 2)
        order = np.argsort(-values, kind="stable")[: min(len(values), dof)]
        self.n, self.dof, self.ids, self.task_bytes = len(ids), dof, ids, task_bytes
        self.eigenvalues, self.vectors = values[order] / dof, vectors[:, order]
        self.total = float(np.maximum(self.eigenvalues, 0).sum())

    @classmethod
    def of(cls, ids: np.ndarray, eigenvalues: np.ndarray, vectors: np.ndarray, total: float, dof: int, task_bytes: int) -> FramePod:
        """From modes that are known already, and the energy of all."""
        made = cls.__new__(cls)
        made.n, made.dof, made.ids, made.task_bytes, made.eigenvalues, made.vectors, made.total = len(ids), dof, ids, task_bytes, eigenvalues, vectors, total
        return made


def pod(rows: DataFrame, side: str | None = None, task_bytes: int = 1 << 30) -> Pod:
    """Proper orthogonal decomposition of snapshots (frame_id unique, x of one length), from the smaller side, or from
    that named: "dof" or "frames". Its square must fit the driver."""
    first, n = rows.first(), rows.count()
    dof = len(first["x"])
    if side == "dof" or (side is None and dof <= n):
        return Pod(*moments(rows, dof))
    return FramePod(*gramian(rows, n, dof, True, task_bytes), dof, task_bytes)


def _packed(rows: DataFrame, dof: int, width: int) -> DataFrame:
    """(block, energy, x): one row a spatial block with all its frames in order, centred, as bytes (frames x width), and
    the sum of their squares."""

    def pack(group: pa.Table) -> pa.Table:
        x = _block(group)[1]
        x = x - x.mean(0)
        return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()), "energy": pa.array([float((x * x).sum())]), "x": pa.array([x.tobytes()], pa.binary())})

    return cut(rows, dof, width).groupBy("block").applyInArrow(pack, "block int, energy double, x binary")


def _times(blocks: DataFrame, q: np.ndarray, tile: int = 2048) -> np.ndarray:
    """(sum over blocks of X X') q, the products of all snapshots with each other times q; one pass over the blocks."""
    n, k = q.shape
    shared = blocks.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for m in batch.column("x"):
                x = np.frombuffer(m.as_buffer(), float).reshape(n, -1)
                own = x @ (x.T @ shared.value)
                total = own if total is None else total + own
        for at in range(0, n if total is not None else 0, tile):
            yield pa.RecordBatch.from_pydict({"at": [at], "m": pa.array([total[at : at + tile].tobytes()], pa.binary())})

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(m.as_py(), float) for batch in batches for m in batch.column("m"))
        yield pa.RecordBatch.from_pydict({"at": [key[0].as_py()], "m": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((n, k))
    for r in blocks.select("x").mapInArrow(run, "at long, m binary").groupBy("at").applyInArrow(add, "at long, m binary").toLocalIterator():
        out[r["at"] : r["at"] + tile] = np.frombuffer(r["m"], float).reshape(-1, k)
    shared.unpersist()
    return out


def leading(rows: DataFrame, rank: int, tolerance: float = 1e-9, rounds: int = 200, task_bytes: int = 1 << 30, seed: int = 0) -> FramePod:
    """The first `rank` modes alone, from the frames' side, without the frames x frames products.

    Blocked iteration on a subspace with its residuals and its last step (locally optimal, as conjugate gradients are):
    each round is one pass over the spatial blocks, which are cut and written once. Ends when no residual of the first
    `rank` is above a hundredth of the root of tolerance times its eigenvalue, so that these agree to about tolerance;
    raises if that takes more than `rounds` passes. The driver holds some frames x (12 rank) numbers.
    """
    first, n = rows.first(), rows.count()
    dof = len(first["x"])
    block_bytes = min(task_bytes // 8, 1 << 25)
    blocks = written(_packed(rows, dof, max(1, block_bytes // (8 * n))), "blocks")
    ids = np.array([r["frame_id"] for r in rows.select("frame_id").orderBy("frame_id").collect()])
    k = min(rank + max(4, rank // 4), n)
    q, seek = np.zeros((n, 0)), np.random.default_rng(seed).standard_normal((n, k))
    for _ in range(rounds):
        # an orthonormal basis of the modes so far, what they miss, and where the last step led
        seek = seek - q @ (q.T @ seek)
        basis, _ = np.linalg.qr(np.hstack([q, seek / np.maximum(np.linalg.norm(seek, axis=0), 1e-300)]))
        images = _times(blocks, basis)
        values, turn = np.linalg.eigh((basis.T @ images + images.T @ basis) / 2)
        order = np.argsort(-values, kind="stable")[:k]
        values, turn = values[order], turn[:, order]
        before, q = q, basis @ turn
        residual = images @ turn - q * values
        bound = np.sqrt(tolerance) * 1e-2 * np.maximum(values[:rank], 1e-9 * max(abs(values[0]), 1e-300))
        if (np.linalg.norm(residual[:, :rank], axis=0) <= bound).all():
            total = blocks.agg(F.sum("energy")).first()[0]
            return FramePod.of(ids, values[:rank] / dof, q[:, :rank], total / dof, dof, task_bytes)
        seek = np.hstack([residual, q - before @ (before.T @ q)])[:, : n - k]
    raise RuntimeError("the leading modes did not settle")


def mode_blocks(rows: DataFrame, model: Pod, rank: int) -> DataFrame:
    """(block, first, mode, values): the modes as runs of degrees of freedom from `first` (0 for the first of all).

    From the frames' side each run is made where its block of snapshots lies: frames x rank numbers travel to the tasks.
    """
    kind = "block int, first long, mode int, values array<double>"
    if not isinstance(model, FramePod):
        return rows.sparkSession.createDataFrame([(0, 0, k + 1, [float(v) for v in model.modes[:, k]]) for k in range(rank)], kind)
    width = block_width(model.n, model.task_bytes)
    scale = np.sqrt(np.maximum(model.eigenvalues[:rank] * model.dof, 1e-300))
    vectors = model.vectors[:, :rank] / scale

    def run(group: pa.Table) -> pa.Table:
        _, x = _block(group)
        modes = (x - x.mean(0)).T @ vectors
        block = group.column("block")[0].as_py()
        return pa.table({"block": pa.array([block] * rank, pa.int32()), "first": pa.array([block * width] * rank, pa.int64()), "mode": pa.array(np.arange(1, rank + 1), pa.int32()), "values": pa.array(list(modes.T), pa.list_(pa.float64()))})

    return cut(rows, model.dof, width).withColumn("block", F.col("block").cast("int")).groupBy("block").applyInArrow(run, kind)


def coefficients(rows: DataFrame, model: Pod, rank: int) -> DataFrame:
    """(frame_id, mode, a): projections of the centred snapshots on the first modes."""
    if isinstance(model, FramePod):
        a = model.vectors[:, :rank] * np.sqrt(np.maximum(model.eigenvalues[:rank] * model.dof, 0))
        table = pd.DataFrame({"frame_id": np.repeat(model.ids, rank), "mode": np.tile(np.arange(1, rank + 1), model.n), "a": a.ravel()})
        return rows.sparkSession.createDataFrame(table, "frame_id long, mode int, a double")
    modes, mean = model.modes[:, :rank], model.mean

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a = (np.stack(batch.x.to_numpy()).astype(float) - mean) @ modes
                yield pd.DataFrame({"frame_id": np.repeat(batch.frame_id.to_numpy(), rank), "mode": np.tile(np.arange(1, rank + 1), len(batch)), "a": a.ravel()})

    return rows.mapInPandas(run, "frame_id long, mode int, a double")


def reconstruct(rows: DataFrame, model: Pod, rank: int, chosen: list[int] | None = None, fluctuations: bool = False) -> DataFrame:
    """Snapshots rebuilt from the mean (left out for fluctuations) and the first (or the chosen, from 1) modes.

    From the frames' side every spatial block is projected on the modes' courses in time, and the blocks of a frame are
    put together again.
    """
    pick = list(range(rank)) if chosen is None else [k - 1 for k in chosen]
    if isinstance(model, FramePod):
        vectors = model.vectors[:, pick]

        def project(group: pa.Table) -> pa.Table:
            ids, x = _block(group)
            mean = x.mean(0)
            made = vectors @ (vectors.T @ (x - mean)) + (0 if fluctuations else mean)
            return pa.table({"frame_id": ids, "block": pa.array([group.column("block")[0].as_py()] * len(ids), pa.int32()), "x": pa.array(list(made), pa.list_(pa.float64()))})

        parts = cut(rows, model.dof, block_width(model.n, model.task_bytes)).withColumn("block", F.col("block").cast("int")).groupBy("block").applyInArrow(project, "frame_id long, block int, x array<double>")
        return parts.groupBy("frame_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "x"))), lambda p: p["x"])).alias("x"))
    modes, mean = model.modes[:, pick], model.mean
    base = np.zeros_like(mean) if fluctuations else mean

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch.x.to_numpy()).astype(float) - mean
                yield pd.DataFrame({"frame_id": batch.frame_id, "x": list(base + (x @ modes) @ modes.T)})

    return rows.mapInPandas(run, "frame_id long, x array<double>")


def reconstruct_sweep(rows: DataFrame, model: Pod, ranks: list[int]) -> DataFrame:
    """(frame_id, rank, x): fluctuations rebuilt from each of the rising numbers of modes, in one scan of the snapshots:
    only the modes between one rank and the next are added to what is there."""
    if list(ranks) != sorted(set(ranks)) or not ranks or ranks[0] < 1 or ranks[-1] > len(model.eigenvalues):
        raise ValueError("ranks must rise, from 1 to the number of modes")
    steps = list(zip([0, *ranks], ranks))
    if isinstance(model, FramePod):
        vectors = model.vectors[:, : ranks[-1]]

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group = pa.Table.from_batches(batches)
            ids, x = _block(group)
            x = x - x.mean(0)
            block, made = group.column("block")[0].as_py(), np.zeros_like(x)
            for a, b in steps:
                made = made + vectors[:, a:b] @ (vectors[:, a:b].T @ x)
                yield pa.RecordBatch.from_pydict({"frame_id": ids, "rank": pa.array([b] * len(ids), pa.int32()), "block": pa.array([block] * len(ids), pa.int32()), "x": pa.array(list(made), pa.list_(pa.float64()))})

        parts = cut(rows, model.dof, block_width(model.n, model.task_bytes)).withColumn("block", F.col("block").cast("int")).groupBy("block").applyInArrow(project, "frame_id long, rank int, block int, x array<double>")
        return parts.groupBy("frame_id", "rank").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "x"))), lambda p: p["x"])).alias("x"))
    modes, mean = model.modes[:, : ranks[-1]], model.mean

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch.x.to_numpy()).astype(float) - mean
                made = np.zeros_like(x)
                for a, b in steps:
                    made = made + (x @ modes[:, a:b]) @ modes[:, a:b].T
                    yield pd.DataFrame({"frame_id": batch.frame_id, "rank": b, "x": list(made)})

    return rows.mapInPandas(run, "frame_id long, rank int, x array<double>")


def as_frames(snapshots: DataFrame, repeat: int | str = 1, frame: str = "frame_id") -> DataFrame:
    """Snapshots of whole grids as packed frames (repeat_id, frame_id, u, v), for work on fields; repeat is a number or
    the column that holds it."""
    half = F.size("x") / 2
    number = F.col(repeat) if isinstance(repeat, str) else F.lit(repeat)
    return snapshots.select(number.cast("int").alias("repeat_id"), F.col(frame).alias("frame_id"), F.slice("x", F.lit(1), half.cast("int")).alias("u"), F.slice("x", (half + 1).cast("int"), half.cast("int")).alias("v"))


def energy_table(model: Pod, spark, targets: list[float]) -> DataFrame:
    """Modes with their share and cumulative share of the energy, and how many each target takes."""
    share = np.maximum(model.eigenvalues, 0) / max(np.maximum(model.eigenvalues, 0).sum(), 1e-300)
    total = np.cumsum(share)
    ranks = [model.energy_rank(t) for t in targets]
    return spark.createDataFrame([(k + 1, float(s), float(c), [t for t, r in zip(targets, ranks) if r == k + 1]) for k, (s, c) in enumerate(zip(share, total))], "mode int, share double, cumulative double, reaches array<double>")


def energy_modes(eigenvalues: DataFrame, targets: DataFrame) -> DataFrame:
    """The same for eigenvalues in a table (mode, eigenvalue): for each target the first mode that reaches it."""
    from pyspark.sql import Window

    order = Window.orderBy("mode").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    positive = F.greatest("eigenvalue", F.lit(0.0))
    rows = eigenvalues.withColumn("cumulative", F.sum(positive).over(order) / F.sum(positive).over(Window.partitionBy()))
    return targets.join(rows, F.col("cumulative") >= F.col("target")).groupBy("target").agg(F.min("mode").alias("modes"), F.min("cumulative").alias("achieved"))


def envelope(rows: DataFrame, model: Pod, points: DataFrame, mode: int = 1) -> DataFrame:
    """Streamwise course of a mode: by column i the root of the wall-normal mean of u^2 + v^2.

    points (j, i): those of the snapshots, which take their places in order of row, then column.
    """
    values = mode_blocks(rows, model, mode).where(F.col("mode") == mode).select("first", F.posexplode("values").alias("_k", "a"))
    half = model.dof // 2
    at = points.select("j", "i").distinct().agg(F.array_sort(F.collect_list(F.struct("j", "i"))).alias("_p")).select(F.posexplode("_p").alias("place", "_p")).select("place", "_p.i")
    own = values.select(F.pmod(F.col("first") + F.col("_k"), F.lit(half)).alias("place"), "a").join(at, "place")
    return own.groupBy("i").agg(F.sqrt(F.sum(F.col("a") * F.col("a")) / (F.count(F.lit(1)) / 2)).alias("amplitude"))


def total_energy(samples: DataFrame) -> DataFrame:
    """Sum of all eigenvalues, without a decomposition: n over dof times the variances, missing values as zero."""
    own = paired(samples).groupBy(*POINT).agg(F.count(F.lit(1)).alias("n"), (F.var_pop(F.coalesce("u", F.lit(0.0))) + F.var_pop(F.coalesce("v", F.lit(0.0)))).alias("e"))
    return own.agg((F.max("n") * F.sum("e") / (2 * F.count(F.lit(1)))).alias("total_energy"))


def dct(n: int) -> np.ndarray:
    k, j = np.arange(n)[:, None], np.arange(n)[None]
    t = np.sqrt(2 / n) * np.cos(np.pi * k * (2 * j + 1) / (2 * n))
    t[0] /= np.sqrt(2)
    return t


def spectral_entropy(field: np.ndarray) -> float:
    """Shannon entropy (bits) of the energies of a field's cosine transform."""
    energy = (dct(field.shape[0]) @ field @ dct(field.shape[1]).T) ** 2
    total = energy.sum()
    p = energy.ravel() / total if total > 0 else np.zeros(0)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum()) if len(p) else float("inf")


def two_lines(values: np.ndarray, fewest: int = 3) -> dict[str, object]:
    """Where two straight lines fit the sorted values best: fit over error, and how the best peak compares to the next."""
    order = np.argsort(values, kind="stable")
    y, n = values[order], len(values)
    if n < 2 * fewest:
        return {"valid": False, "chosen": np.zeros(0, int), "ppr": float("nan")}
    scores = []
    for cut in range(fewest, n - fewest + 1):
        error = 0.0
        for part in (slice(0, cut), slice(cut, n)):
            x = np.arange(n)[part] + 1.0
            error += float(((y[part] - np.polyval(np.polyfit(x, y[part], 1), x)) ** 2).sum())
        fit = max(0.0, 1 - error / max(float(((y - y.mean()) ** 2).sum()), 2.2e-16))
        scores.append(fit / max((error / max(n - 4, 1)) ** 0.5, 2.2e-16))
    s = np.array(scores)
    wide = np.r_[-np.inf, s, -np.inf]
    peaks = np.flatnonzero((s >= wide[:-2]) & (s >= wide[2:]))
    best = peaks[np.argmax(s[peaks])]
    rest = s[peaks[peaks != best]]
    return {"valid": True, "chosen": order[: fewest + best], "ppr": float(s[best] / max(rest.max(), 2.2e-16)) if len(rest) else float("inf")}


def mode_vectors(rows: DataFrame, model: Pod, rank: int) -> DataFrame:
    """(mode, values): the first modes whole, each put together from its blocks in one row."""
    parts = F.array_sort(F.collect_list(F.struct("first", "values")))
    return mode_blocks(rows, model, rank).groupBy("mode").agg(F.flatten(F.transform(parts, lambda p: p["values"])).alias("values"))


def mode_entropies(rows: DataFrame, model: Pod, mask: np.ndarray, rank: int | None = None) -> DataFrame:
    """(mode, filled, zeros): the smaller spectral entropy of a mode's two components over the box around the mask,
    holes filled with neighbours or with zeros; worked out mode by mode in tasks."""
    if not mask.any():
        raise ValueError("the mask is empty")
    at_rows, at_cols = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    box = (slice(at_rows[0], at_rows[-1] + 1), slice(at_cols[0], at_cols[-1] + 1))
    n = int(mask.sum())

    def filled(values: np.ndarray) -> np.ndarray:
        out, known = np.zeros(mask.shape), mask.copy()
        out[mask] = values
        out, known = out[box], known[box]
        while not known.all():
            wide, seen = np.pad(np.where(known, out, 0), 1), np.pad(known, 1).astype(int)
            total = wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:]
            count = seen[:-2, 1:-1] + seen[2:, 1:-1] + seen[1:-1, :-2] + seen[1:-1, 2:]
            new = ~known & (count > 0)
            out = np.where(new, total / np.maximum(count, 1), out)
            known = known | new
        return out

    def zeros(values: np.ndarray) -> np.ndarray:
        out = np.zeros(mask.shape)
        out[mask] = values
        return out[box]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [[min(spectral_entropy(f(m[:n])), spectral_entropy(f(m[n:]))) for m in map(np.asarray, batch["values"])] for f in (filled, zeros)]
            yield pd.DataFrame({"mode": batch["mode"], "filled": got[0], "zeros": got[1]})

    return mode_vectors(rows, model, rank or len(model.eigenvalues)).mapInPandas(run, "mode int, filled double, zeros double")


def entropy_selection(rows: DataFrame, model: Pod, mask: np.ndarray, min_ppr: float = 1.8, min_jaccard: float = 0.9, rank: int | None = None) -> dict[str, object]:
    """Modes of low spectral entropy: those below the break of the sorted entropies, if the break is distinct and holes
    filled with neighbours or with zeros lead to nearly the same modes. Two numbers a mode reach the driver."""
    table = sorted(tuple(r) for r in mode_entropies(rows, model, mask, rank).toLocalIterator())
    entropy = [np.array([r[k] for r in table]) for k in (1, 2)]
    a, b = (two_lines(e) for e in entropy)
    first, second = set(np.asarray(a["chosen"]).tolist()), set(np.asarray(b["chosen"]).tolist())
    jaccard = len(first & second) / len(first | second) if first | second else 0.0
    return {"modes": sorted(k + 1 for k in first), "ppr": a["ppr"], "jaccard": jaccard, "valid": bool(a["valid"] and b["valid"] and a["ppr"] >= min_ppr and jaccard >= min_jaccard), "entropy": entropy[0]}
