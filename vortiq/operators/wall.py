"""Smoothing and fitting of whole streamwise series and profiles: a case's worth of numbers in one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def spline(x: np.ndarray, y: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Values and slopes at x of the cubic smoothing spline that weighs misfit by p and curvature by 1 - p."""
    n, h = len(x), np.diff(x)
    if n == 2:
        slope = (y[1] - y[0]) / h[0]
        return y.astype(float).copy(), np.full(2, slope)
    q = np.zeros((n - 2, n))
    r = np.zeros((n - 2, n - 2))
    for k in range(n - 2):
        q[k, k], q[k, k + 1], q[k, k + 2] = 1 / h[k], -1 / h[k] - 1 / h[k + 1], 1 / h[k + 1]
        r[k, k] = 2 * (h[k] + h[k + 1])
        if k:
            r[k, k - 1] = r[k - 1, k] = h[k]
    u = np.linalg.solve(6 * (1 - p) * (q @ q.T) + p * r, q @ y)
    a = y - 6 * (1 - p) * (q.T @ u)
    m = np.r_[0.0, 6 * p * u, 0.0]
    slope = np.r_[(a[1:] - a[:-1]) / h - h * (2 * m[:-1] + m[1:]) / 6, 0.0]
    slope[-1] = (a[-1] - a[-2]) / h[-1] + h[-1] * (m[-2] + 2 * m[-1]) / 6
    return a, slope


def smooth_series(series: DataFrame, key: str, p: float, polluted: tuple[float, float] | None = None) -> DataFrame:
    """series (key, x, y) with smooth and slope: a smoothing spline over every unbroken run of at least two values.

    Gaps and the polluted interval (half open) break runs. A series is a case's columns, some hundreds of numbers.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("x").reset_index(drop=True)
        x, y = group.x.to_numpy(float), group.y.to_numpy(float)
        ok = np.isfinite(y) & (~((x >= polluted[0]) & (x < polluted[1])) if polluted else True)
        smooth, slope = np.full(len(x), np.nan), np.full(len(x), np.nan)
        edges = np.flatnonzero(np.diff(np.r_[False, ok, False].astype(int)))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= 2:
                smooth[a:b], slope[a:b] = spline(x[a:b], y[a:b], p)
        return group[[key, "x", "y"]].assign(smooth=pd.Series(smooth).astype(object).where(np.isfinite(smooth), None), slope=pd.Series(slope).astype(object).where(np.isfinite(slope), None))

    kind = series.schema[key].dataType.simpleString()
    return series.select(key, "x", "y").groupBy(key).applyInPandas(run, f"`{key}` {kind}, x double, y double, smooth double, slope double")


def between(x: np.ndarray, knots: np.ndarray, values: np.ndarray, slopes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and slopes at x of the piecewise cubic with the given values and slopes at its knots."""
    k = np.clip(np.searchsorted(knots, x, "right") - 1, 0, len(knots) - 2)
    h = knots[k + 1] - knots[k]
    t, rise = (x - knots[k]) / h, (values[k + 1] - values[k]) / h
    c, d = 3 * rise - 2 * slopes[k] - slopes[k + 1], slopes[k] + slopes[k + 1] - 2 * rise
    return values[k] + h * t * (slopes[k] + t * (c + t * d)), slopes[k] + t * (2 * c + 3 * t * d)


def edge_velocity_spline(series: DataFrame, key: str, p: float) -> DataFrame:
    """Edge velocities along x (key, x, u_edge) with raw, smooth, slope and interpolated.

    Values that are missing or not above zero don't count. The first and the last station that do count are left out,
    with all beyond them: raw, smooth and slope are NULL there. Between, one smoothing spline runs through what is left,
    and gives values at stations without one too (interpolated). Fewer than three stations, or fewer than two to fit,
    or a spline that isn't above zero everywhere, are errors. A series is a case's columns, some hundreds of numbers.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("x").reset_index(drop=True)
        x, u = group.x.to_numpy(float), group.u_edge.to_numpy(float)
        if not np.isfinite(x).all() or (np.diff(x) <= 0).any():
            raise ValueError("places must be finite and unlike each other")
        ok = np.isfinite(u) & (u > 0)
        at = np.flatnonzero(ok)
        if len(at) < 3 or at[-1] - at[0] < 2:
            raise ValueError("three stations with an edge velocity are needed")
        fit = at[1:-1]
        if len(fit) < 2:
            raise ValueError("fewer than two stations are left to fit")
        inside = np.arange(fit[0], fit[-1] + 1)
        smooth, slope = (np.full(len(x), np.nan) for _ in range(2))
        smooth[inside], slope[inside] = between(x[inside], x[fit], *spline(x[fit], u[fit], p))
        if not (smooth[inside] > 0).all():
            raise ValueError("the spline is not above zero everywhere")
        raw = np.where(ok, u, np.nan)
        raw[: at[0] + 1] = raw[at[-1] :] = np.nan
        null = lambda v: pd.Series(v).astype(object).where(np.isfinite(v), None)
        filled = np.zeros(len(x), bool)
        filled[inside] = ~ok[inside]
        return group[[key, "x"]].assign(raw=null(raw), smooth=null(smooth), slope=null(slope), interpolated=filled)

    kind = series.schema[key].dataType.simpleString()
    return series.select(key, "x", "u_edge").groupBy(key).applyInPandas(run, f"`{key}` {kind}, x double, raw double, smooth double, slope double, interpolated boolean")


def simplex(f, start: np.ndarray, rounds: int = 2000, tolerance: float = 1e-8) -> np.ndarray:
    """Nelder and Mead's downhill simplex."""
    points = [start] + [start + (0.05 * start[k] if start[k] else 0.00025) * np.eye(len(start))[k] for k in range(len(start))]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = [points[k] for k in order], [values[k] for k in order]
        if max(abs(v - values[0]) for v in values) <= tolerance and max(np.abs(p - points[0]).max() for p in points) <= tolerance:
            break
        centre, worst = np.mean(points[:-1], axis=0), points[-1]
        tries = {k: centre + k * (centre - worst) for k in (1.0, 2.0, 0.5, -0.5)}
        got = f(tries[1.0])
        if got < values[0]:
            far = f(tries[2.0])
            points[-1], values[-1] = (tries[2.0], far) if far < got else (tries[1.0], got)
        elif got < values[-2]:
            points[-1], values[-1] = tries[1.0], got
        else:
            k = 0.5 if got < values[-1] else -0.5
            near = f(tries[k])
            if near < min(got, values[-1]):
                points[-1], values[-1] = tries[k], near
            else:
                points = [points[0]] + [points[0] + (p - points[0]) / 2 for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    return points[int(np.argmin(values))]


def musker(kappa: float, b: float, y_max: float, step: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Musker's inner law on a grid: its constant makes the profile meet the log law far from the wall."""

    def slope(y, s):
        return (y * y / kappa + 1 / s) / (y**3 + y * y / kappa + 1 / s)

    far = np.concatenate([np.linspace(0, 200, 20001), np.geomspace(200, 2e4, 20001)[1:]])

    def intercept(s):
        v = slope(far, s)
        return float(np.sum((v[1:] + v[:-1]) / 2 * np.diff(far)) - np.log(far[-1]) / kappa)

    lo, hi = np.log(1e-6), np.log(1e2)
    low_sign = intercept(np.exp(lo)) - b
    for _ in range(80):
        mid = (lo + hi) / 2
        gap = intercept(np.exp(mid)) - b
        lo, hi = (mid, hi) if (gap > 0) == (low_sign > 0) else (lo, mid)
    y = np.arange(0, y_max + step, step)
    v = slope(y, np.exp((lo + hi) / 2))
    return y, np.r_[0.0, np.cumsum((v[1:] + v[:-1]) / 2 * step)]


# Coefficients of the wake function and of the bump.
WAKE = (132.8410, -166.2041, 71.9114)
BUMP = (30.0, 2.85)


def composite(y_mm: np.ndarray, u_tau: float, wake: float, delta_mm: float, nu: float, kappa: float, inner: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Velocity of the composite profile: inner law, bump and wake; constant beyond delta."""

    def bump(y):
        return np.where(y > 0, np.exp(-(np.log(np.maximum(y, 1e-300) / BUMP[0]) ** 2)) / BUMP[1], 0.0)

    y, eta = y_mm * 1e-3 * u_tau / nu, y_mm / delta_mm
    a, b, c = WAKE
    e = np.clip(eta, 0, 1)
    q = 0.25 * (5 * a + 6 * b + 7 * c) * e**4 - a * e**5 - b * e**6 - c * e**7
    shape = (1 - np.exp(-q)) / (1 - np.exp(-0.25 * (a + 2 * b + 3 * c)))
    outer = np.where(e > 0, shape * (2 * wake - np.log(np.maximum(e, 1e-300))) / kappa, 0.0)
    edge = delta_mm * 1e-3 * u_tau / nu
    top = np.interp(edge, *inner) + float(bump(np.array(edge))) + 2 * wake / kappa
    return u_tau * np.where(eta > 1, top, np.interp(y, *inner) + bump(y) + outer)


def composite_fit(profiles: DataFrame, key: str, nu: float, kappa: float = 0.384, b: float = 4.17, bounds: tuple = ((0.2, 3.0), (0.0, 2.0), (5.0, 200.0))) -> DataFrame:
    """Friction velocity, wake strength and thickness of each profile (key, y_mm, u): least mean relative error, within
    bounds by a logistic transform. One profile is one task's work."""
    lo, hi = (np.array([x[k] for x in bounds]) for k in (0, 1))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group[(group.u > 0) & (group.y_mm > 0)].sort_values("y_mm")
        y, u = group.y_mm.to_numpy(float), group.u.to_numpy(float)
        if len(y) < 5:
            return pd.DataFrame({key: [], "u_tau": [], "wake": [], "delta_mm": [], "error": []})
        inner = musker(kappa, b, max(y.max(), hi[2]) * 1e-3 * hi[0] / nu * 1.05)

        def decode(t):
            return lo + (hi - lo) / (1 + np.exp(-np.clip(t, -500, 500)))

        def cost(t):
            model = composite(y, *decode(t), nu, kappa, inner)
            return float(np.mean(np.abs((model - u) / np.maximum(np.abs(model), 1e-9))))

        edge = np.sort(u)[-5:].mean()
        first = np.array([0.04 * edge, 0.5, y[np.argmax(u >= 0.99 * edge)]])
        part = np.clip((first - lo) / (hi - lo), 1e-8, 1 - 1e-8)
        best = simplex(cost, np.log(part / (1 - part)))
        return pd.DataFrame({key: [group[key].iloc[0]], "u_tau": [decode(best)[0]], "wake": [decode(best)[1]], "delta_mm": [decode(best)[2]], "error": [cost(best)]})

    kind = profiles.schema[key].dataType.simpleString()
    return profiles.select(key, "y_mm", "u").groupBy(key).applyInPandas(run, f"`{key}` {kind}, u_tau double, wake double, delta_mm double, error double")
