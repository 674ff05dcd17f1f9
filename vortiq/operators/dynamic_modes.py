"""Exact dynamic mode decomposition of snapshots of consecutive frames.

With X and Y the snapshots and their successors, the products of all snapshots with each other are all that is needed
from the frames' side; from the other, X X' and Y X' (dof x dof), where a snapshot meets its successor in an equi-join on
the frame. From the frames' side a mode is a sum of snapshots with complex weights, made block by block where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .modal import _block, _tree, block_width, cut, gramian

KIND = "mode int, block int, first long, re array<double>, im array<double>"


@dataclass
class Dynamics:
    """spectrum: one row a mode, strongest first. vectors: the modes themselves (dof x modes), or the weights of the
    snapshots (frames x modes) that make them."""

    spectrum: pd.DataFrame
    vectors: np.ndarray
    dof: int
    frames: np.ndarray | None
    task_bytes: int


def _directions(square: np.ndarray, rank: int, dof: int) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of the snapshots above their rounding errors, at most rank, and their vectors."""
    values, vectors = np.linalg.eigh((square + square.T) / 2)
    order = np.argsort(-values, kind="stable")
    s = np.sqrt(np.maximum(values[order], 0))
    if not s[0] > 0:
        raise ValueError("the snapshots have no singular value above zero")
    n = max(1, min(rank, int((s > max(dof, 2) * np.finfo(float).eps ** 0.5 * s[0]).sum())))
    return s[:n], vectors[:, order[:n]]


def _floor(lam: np.ndarray) -> float:
    return max(1e-12, 100 * np.spacing(max(1.0, np.abs(lam).max())))


def decompose(rows: DataFrame, rank: int, dt: float, f0: float | None = None, side: str | None = None, task_bytes: int = 1 << 30) -> Dynamics:
    """Eigenvalues and modes of the map from each snapshot to the next, of at most rank directions.

    Modes have length one. An exact mode that vanishes, is not finite, or whose eigenvalue is zero to rounding is
    replaced by the projected one (`replaced`). growth and frequency are those of the continuous logarithm, with a floor
    under eigenvalues of zero. amplitude: of the first snapshot in terms of the modes. harmonic and mismatch: the
    multiple of f0 nearest to the frequency's size and how far it is off; NULL without f0. The smaller side is taken, or
    the one named ("frames" or "dof").
    """
    first = rows.orderBy("frame_id").first()
    dof, n = len(first["x"]), rows.count()
    if side == "frames" or (side is None and n < dof):
        ids, every = gramian(rows, n, dof, False, task_bytes)
        at = {k: p for p, k in enumerate(ids.tolist())}
        x = np.array([p for k, p in at.items() if k + 1 in at], int)
        y = np.array([at[k + 1] for k in at if k + 1 in at], int)
        if not len(x):
            raise ValueError("no frame has a successor")
        s, v = _directions(every[np.ix_(x, x)], rank, dof)
        v = v / s
        lam, turn = np.linalg.eig(v.T @ every[np.ix_(x, y)] @ v)
        weights, other = np.zeros((2, n, len(lam)), complex)
        weights[y], other[x] = v @ turn, v @ turn
        size = lambda w: np.sqrt(np.maximum(np.einsum("km,km->m", w.conj(), every @ w).real, 0))
        weights, bad = _replaced(weights, size(weights), other, size(other), lam)
        squares = weights.conj().T @ every @ weights
        amplitude = np.linalg.pinv(squares, hermitian=True) @ (weights.conj().T @ every[:, at[first["frame_id"]]])
        return _sorted(lam, amplitude, weights, bad, dt, f0, dof, ids, task_bytes)
    pairs = rows.join(rows.select((F.col("frame_id") - 1).alias("frame_id"), F.col("x").alias("y")), "frame_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, dof, dof))
        for batch in batches:
            if len(batch):
                x, y = np.stack(batch.x.to_numpy()).astype(float), np.stack(batch.y.to_numpy()).astype(float)
                total += np.stack([x.T @ x, y.T @ x])
        yield pd.DataFrame({"m": [total.tobytes()]})

    xx, yx = _tree(pairs.select("x", "y").mapInPandas(run, "m binary"), (2, dof, dof))
    s, u = _directions(xx, rank, dof)
    # A = U' Y V / s with V = X' U / s
    lam, turn = np.linalg.eig((u.T @ yx @ u) / s**2)
    exact, projected = (yx @ u / s**2) @ turn, u @ turn
    modes, bad = _replaced(exact, np.linalg.norm(exact, axis=0), projected, np.linalg.norm(projected, axis=0), lam)
    return _sorted(lam, np.linalg.pinv(modes) @ np.array(first["x"], float), modes, bad, dt, f0, dof, None, task_bytes)


def _replaced(own: np.ndarray, size: np.ndarray, other: np.ndarray, other_size: np.ndarray, lam: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """own to unit length, with the columns of other where one cannot be used."""
    # the exact mode is the projected one times its eigenvalue, up to what lies outside the directions kept
    bad = ~np.isfinite(size) | (size <= np.finfo(float).eps * np.maximum(other_size, 1)) | (np.abs(lam) < _floor(lam))
    return np.where(bad, other / np.maximum(other_size, 1e-300), own / np.maximum(np.where(bad, 1, size), 1e-300)), bad


def _sorted(lam: np.ndarray, amplitude: np.ndarray, vectors: np.ndarray, bad: np.ndarray, dt: float, f0: float | None, dof: int, ids: np.ndarray | None, task_bytes: int) -> Dynamics:
    floor, lam = _floor(lam), lam.astype(complex)
    log = np.where(np.abs(lam) < floor, np.log(floor) + 1j * np.angle(lam), np.log(np.where(lam == 0, 1, lam)))
    table = pd.DataFrame({"re": lam.real, "im": lam.imag, "growth": log.real / dt, "frequency": log.imag / dt / (2 * np.pi), "amplitude": np.abs(amplitude), "amplitude_re": amplitude.real, "amplitude_im": amplitude.imag, "replaced": bad})
    hertz = table["frequency"].abs()
    table["harmonic"] = np.round(hertz / f0) if f0 else np.nan
    table["mismatch"] = (hertz - table["harmonic"] * f0).abs() if f0 else np.nan
    # amplitudes that differ by rounding alone, as those of conjugate pairs do, go by frequency
    level = (table["amplitude"] / max(table["amplitude"].max(), 1e-300)).round(9)
    order = table.assign(_level=level).sort_values(["_level", "frequency"], ascending=[False, True]).index.to_numpy()
    return Dynamics(table.loc[order].reset_index(drop=True), vectors[:, order], dof, ids, task_bytes)


def spectrum(rows: DataFrame, rank: int, dt: float, side: str | None = None, task_bytes: int = 1 << 30) -> pd.DataFrame:
    """Eigenvalues with growth, frequency and amplitude alone."""
    return decompose(rows, rank, dt, None, side, task_bytes).spectrum[["re", "im", "growth", "frequency", "amplitude"]]


def modes(rows: DataFrame, found: Dynamics) -> DataFrame:
    """(mode, block, first, re, im): modes of length one as runs of degrees of freedom from `first` (0 for the first of
    all), numbered from 1 as in the spectrum. Frames x modes numbers travel to the tasks."""
    weights, count = found.vectors, found.vectors.shape[1]

    def table(block: int, first: int, values: np.ndarray) -> pa.Table:
        same = lambda v, t: pa.array([v] * count, t)
        return pa.table({"mode": pa.array(np.arange(1, count + 1), pa.int32()), "block": same(block, pa.int32()), "first": same(first, pa.int64()), "re": pa.array(list(values.T.real), pa.list_(pa.float64())), "im": pa.array(list(values.T.imag), pa.list_(pa.float64()))})

    if found.frames is None:
        return rows.sparkSession.createDataFrame(table(0, 0, found.vectors), KIND)
    width = block_width(len(found.frames), found.task_bytes)

    def run(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        return table(block, block * width, _block(group)[1].T @ weights)

    return cut(rows, found.dof, width).groupBy("block").applyInArrow(run, KIND)


def at_step(rows: DataFrame, found: Dynamics, step: int) -> DataFrame:
    """(k, x): the snapshot `step` steps after the first as the modes tell it; step 0 is the first in terms of them."""
    weights = found.spectrum.assign(mode=np.arange(1, len(found.spectrum) + 1))
    factor = (weights["amplitude_re"] + 1j * weights["amplitude_im"]) * (weights["re"] + 1j * weights["im"]) ** step
    told = rows.sparkSession.createDataFrame([(int(m), float(c.real), float(c.imag)) for m, c in zip(weights["mode"], factor)], "mode int, a double, b double")
    parts = modes(rows, found).join(told, "mode").select("first", F.posexplode(F.zip_with("re", "im", lambda r, i: F.col("a") * r - F.col("b") * i)).alias("_k", "x"))
    return parts.groupBy((F.col("first") + F.col("_k")).alias("k")).agg(F.sum("x").alias("x"))
