"""Spectral proper orthogonal decomposition: modes of each frequency over Hann blocks of snapshots.

A frame goes to every block that holds it (two at half overlap). Snapshots are cut into spatial pieces, and a block's
piece is transformed in one task. Where there are fewer blocks than degrees of freedom, the products of all blocks are
added up over pieces, by frequency; their eigenvectors weigh the blocks, and every piece of a mode is made where the
piece's transforms lie. Otherwise dof x dof products of runs of blocks are added up, whose eigenvectors are the modes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .modal import _block, cut

COMPLEX = np.complex128
#: Modes whose energy is below this share of their frequency's first one are rounding errors, and have no shape.
NOISE = 1e-12


@dataclass
class Spectral:
    """transforms: (bin, piece, block, q); solved: (bin, values, vectors), one vector (bytes) a block or degree of
    freedom, with the kept modes side by side."""

    transforms: DataFrame
    solved: DataFrame
    nfft: int
    fs: float
    dof: int
    blocks: int
    width: int
    by_dof: bool

    def frequency(self, column="bin"):
        return F.col(column) * F.lit(self.fs / self.nfft)


def decompose(rows: DataFrame, nfft: int, fs: float, overlap: float = 0.5, side: str | None = None, keep: int | None = None, task_bytes: int = 1 << 30) -> Spectral | None:
    """The decomposition of snapshots (frame_id, x) of frames from 1; None if no block is complete.

    The smaller side is solved, or the one named ("dof" or "blocks"), and its square must fit a task. keep bounds the
    number of modes whose vectors are kept. Transforms and vectors are written to the shared folder.
    """
    step = nfft - int(overlap * nfft)
    shape = rows.agg(F.max("frame_id").alias("last"), F.max(F.size("x")).alias("dof")).first()
    n_blocks, dof = max(0, ((shape["last"] or 0) - nfft) // step + 1), shape["dof"]
    if not n_blocks:
        return None
    by_dof = side == "dof" or (side is None and dof <= n_blocks)
    width = dof if by_dof else max(1, task_bytes // (64 * max(nfft, n_blocks)))
    run = max(1, task_bytes // (64 * dof)) if by_dof else n_blocks
    first = F.greatest(F.lit(0), F.ceil((F.col("frame_id") - nfft) / step)).cast("int")
    final = F.least(F.lit(n_blocks - 1), F.floor((F.col("frame_id") - 1) / step)).cast("int")
    pieces = cut(rows.where(final >= first), dof, width).withColumnRenamed("block", "piece")
    dealt = pieces.select("frame_id", "piece", "x", F.explode(F.sequence(first, final)).alias("block"))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nfft) / nfft)

    def transform(group: pa.Table) -> pa.Table:
        _, x = _block(group)
        if len(x) < nfft:
            return pa.table({c: pa.array([], t) for c, t in (("bin", pa.int32()), ("piece", pa.int32()), ("block", pa.int32()), ("q", pa.binary()))})
        q = np.fft.rfft(x * w[:, None], axis=0) / np.sqrt(fs * (w**2).sum() * n_blocks)
        q[1 : -1 if nfft % 2 == 0 else None] *= np.sqrt(2)
        same = lambda c: pa.array([group.column(c)[0].as_py()] * len(q), pa.int32())
        return pa.table({"bin": pa.array(np.arange(len(q)), pa.int32()), "piece": same("piece"), "block": same("block"), "q": pa.array([r.tobytes() for r in q], pa.binary())})

    def products(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("block").to_numpy())
        at = group.column("block").to_numpy()[order]
        q = np.stack([np.frombuffer(v.as_py(), COMPLEX) for v in group.column("q").take(pa.array(order))])
        if by_dof:
            square = q.T @ q.conj()
        else:
            # blocks that miss a frame have no transform: their rows and columns stay zero
            square = np.zeros((n_blocks, n_blocks), COMPLEX)
            square[np.ix_(at, at)] = q.conj() @ q.T
        return pa.table({"bin": group.column("bin")[:1], "m": pa.array([square.tobytes()], pa.binary())})

    def solve(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(m.as_py(), COMPLEX) for m in group.column("m"))
        size = int(round(len(total) ** 0.5))
        values, vectors = np.linalg.eigh(total.reshape(size, size))
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1][:, : keep or size]
        some = vectors[:, values[: vectors.shape[1]] > NOISE * max(values[0], 1e-300)]
        return pa.table({"bin": group.column("bin")[:1], "values": pa.array([values], pa.list_(pa.float64())), "vectors": pa.array([[np.ascontiguousarray(v).tobytes() for v in some]], pa.list_(pa.binary()))})

    made = written(dealt.groupBy("block", "piece").applyInArrow(transform, "bin int, piece int, block int, q binary"), "transforms")
    squares = made.groupBy("bin", "piece", F.floor(F.col("block") / run)).applyInArrow(products, "bin int, m binary")
    solved = written(squares.groupBy("bin").applyInArrow(solve, "bin int, values array<double>, vectors array<binary>"), "spectral")
    return Spectral(made, solved, nfft, fs, dof, n_blocks, width, by_dof)


def eigenvalues(found: Spectral) -> DataFrame:
    """(frequency, mode, eigenvalue), as many modes as the smaller side has."""
    return found.solved.select("bin", F.posexplode("values").alias("k", "eigenvalue")).select(found.frequency().alias("frequency"), (F.col("k") + 1).cast("int").alias("mode"), "eigenvalue")


def spod(rows: DataFrame, nfft: int, fs: float, overlap: float = 0.5, side: str | None = None, task_bytes: int = 1 << 30) -> DataFrame:
    """The eigenvalues alone; an empty table if no block is complete."""
    found = decompose(rows, nfft, fs, overlap, side, 1, task_bytes)
    return eigenvalues(found) if found else rows.sparkSession.createDataFrame([], "frequency double, mode int, eigenvalue double")


def modes(found: Spectral, count: int | None = None, frequencies: list[float] | None = None) -> DataFrame:
    """(frequency, mode, piece, first, re, im): modes of length one, as runs of degrees of freedom from `first` (0 for the
    first of all). Modes without energy have no rows. count and frequencies choose; the default is all that was kept."""
    kind = "bin int, mode int, piece int, first long, re array<double>, im array<double>"
    solved, transforms, width = found.solved, found.transforms, found.width
    if frequencies is not None:
        bins = [int(round(f * found.nfft / found.fs)) for f in frequencies]
        solved, transforms = (df.where(F.col("bin").isin(bins)) for df in (solved, transforms))

    def table(bin_: int, piece: int, shapes: np.ndarray) -> pa.Table:
        n = shapes.shape[1]
        column = lambda v, t: pa.array([v] * n, t)
        return pa.table({"bin": column(bin_, pa.int32()), "mode": pa.array(np.arange(1, n + 1), pa.int32()), "piece": column(piece, pa.int32()), "first": column(piece * width, pa.int64()), "re": pa.array(list(shapes.T.real), pa.list_(pa.float64())), "im": pa.array(list(shapes.T.imag), pa.list_(pa.float64()))})

    def whole(group: pa.Table) -> pa.Table:
        vectors = np.stack([np.frombuffer(v, COMPLEX) for v in group.column("vectors")[0].as_py()])
        return table(group.column("bin")[0].as_py(), 0, vectors[:, :count])

    def piece(group: pa.Table) -> pa.Table:
        q, v = (np.stack([np.frombuffer(x.as_py(), COMPLEX) for x in group.column(c)]) for c in ("q", "vector"))
        values = np.array(group.column("values")[0].as_py())
        n = min(v.shape[1], count or v.shape[1])
        return table(group.column("bin")[0].as_py(), group.column("piece")[0].as_py(), (q.T @ v[:, :n]) / np.sqrt(values[:n]))

    if found.by_dof:
        got = solved.groupBy("bin").applyInArrow(whole, kind)
    else:
        weights = solved.select("bin", "values", F.posexplode("vectors").alias("block", "vector"))
        got = transforms.join(weights, ["bin", "block"]).groupBy("bin", "piece").applyInArrow(piece, kind)
    return got.select(found.frequency().alias("frequency"), "mode", "piece", "first", "re", "im")


def selected(values: DataFrame, f0: float | None = None, harmonics: int = 3) -> list[float]:
    """Frequencies worth a look, of eigenvalues(): the one beyond zero whose first mode holds most (the lower at ties),
    then those nearest to the forcing and its harmonics, each once. A number a frequency reaches the driver."""
    table = sorted(tuple(r) for r in values.where("mode = 1").select("frequency", "eigenvalue").toLocalIterator())
    if not table:
        return []
    known = np.array([r[0] for r in table])
    beyond = table[1:] if len(table) > 2 else table[-1:]
    asked = [max(beyond, key=lambda r: (r[1], -r[0]))[0], *([] if f0 is None else [f0 * k for k in range(1, harmonics + 1)])]
    nearest = [float(known[np.abs(known - f).argmin()]) for f in asked]
    return list(dict.fromkeys(nearest))


def rebuilt_power(found: Spectral) -> DataFrame:
    """(frequency, k, power): of every degree of freedom what all modes hold together, eigenvalue times square."""
    parts = modes(found).select("frequency", "mode", "first", F.posexplode(F.zip_with("re", "im", lambda a, b: a * a + b * b)).alias("_k", "square"))
    return parts.join(eigenvalues(found), ["frequency", "mode"]).groupBy("frequency", (F.col("first") + F.col("_k")).alias("k")).agg(F.sum(F.col("eigenvalue") * F.col("square")).alias("power"))
