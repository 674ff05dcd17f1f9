"""Spectra in time and along x: series are gathered by point or frame and row, transformed in small Arrow tasks, and
averaged by Spark."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repaired(y: np.ndarray) -> np.ndarray:
    """Gaps filled linearly, the ends with the nearest value."""
    ok = np.isfinite(y)
    return y if ok.all() else np.interp(np.arange(len(y)), np.flatnonzero(ok), y[ok])


def detrended(y: np.ndarray) -> np.ndarray:
    t = np.arange(len(y)) - (len(y) - 1) / 2
    return y - y.mean() - t * (t @ y) / max(t @ t, 1e-300)


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def blocks(y: np.ndarray, nfft: int, overlap: float) -> np.ndarray:
    """Windowed transforms of overlapping blocks (blocks x frequencies)."""
    step = nfft - int(overlap * nfft)
    starts = range(0, len(y) - nfft + 1, step)
    return np.array([np.fft.rfft(y[s : s + nfft] * hann(nfft)) for s in starts])


def one_sided(power: np.ndarray, nfft: int, fs: float) -> np.ndarray:
    """Density of mean squared transforms: both sides in one, but for zero and an even length's last frequency."""
    out = power / (fs * (hann(nfft) ** 2).sum())
    out[1 : -1 if nfft % 2 == 0 else None] *= 2
    return out


def _series(samples: DataFrame, keys: list[str], values: list[str], order: str) -> DataFrame:
    got = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *[F.coalesce(v, F.lit(float("nan"))).alias(v) for v in values]))).alias("_s"))
    return got.select(*keys, *[F.col(f"_s.{v}").alias(v) for v in values])


def welch(samples: DataFrame, keys: list[str], value: str, nfft: int, fs: float, overlap: float = 0.5, min_valid: float = 0.0) -> DataFrame:
    """Density of each series (keys): gaps filled, a line removed, periodic Hann blocks averaged.

    Series with too many gaps, or fewer values than a block, give no rows. A point's series is as long as the record:
    it must fit a task, as in any transform of it.
    """
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                y = np.array(getattr(r, value), float)
                n = np.isfinite(y).sum()
                if n < nfft or n / len(y) < min_valid:
                    continue
                power = one_sided((np.abs(blocks(detrended(repaired(y)), nfft, overlap)) ** 2).mean(0), nfft, fs)
                out += [(*[getattr(r, k) for k in keys], k * fs / nfft, float(p)) for k, p in enumerate(power)]
            yield pd.DataFrame(out, columns=[*keys, "frequency", "psd"])

    return _series(samples, keys, [value], "frame_id").mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", frequency double, psd double")


def temporal_spectra(samples: DataFrame, value: str, nfft: int, fs: float, overlap: float = 0.5, min_valid: float = 0.7) -> DataFrame:
    """Density of each point, then the mean over x: by row and frequency, with the premultiplied form."""
    got = welch(samples, ["j", "i"], value, nfft, fs, overlap, min_valid)
    return got.groupBy("j", "frequency").agg(F.avg("psd").alias("psd"), F.count("psd").alias("n")).withColumn("premultiplied", F.col("frequency") * F.col("psd"))


def spatial_spectra(samples: DataFrame, value: str, dx_m: float, min_valid: float = 0.7, fewest: int = 8) -> DataFrame:
    """Density along x of each frame and row (uniform spacing), then the mean over frames: by row and wavenumber (cycles
    per metre). One-sided; an even length's last bin isn't doubled."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                y = np.array(getattr(r, value), float)
                ok = np.isfinite(y).sum()
                if ok < fewest or ok / len(y) < min_valid:
                    continue
                n = len(y)
                power = np.abs(np.fft.fft(detrended(repaired(y)) * hann(n))[1 : n // 2 + 1]) ** 2 * dx_m / (hann(n) ** 2).sum() * 2
                if n % 2 == 0:
                    power[-1] /= 2
                out += [(r.j, (k + 1) / (n * dx_m), float(p)) for k, p in enumerate(power)]
            yield pd.DataFrame(out, columns=["j", "wavenumber", "psd"])

    lines = _series(samples, ["repeat_id", "frame_id", "j"], [value], "i").mapInPandas(run, "j int, wavenumber double, psd double")
    return lines.groupBy("j", "wavenumber").agg(F.avg("psd").alias("psd"), F.count("psd").alias("n")).withColumn("premultiplied", F.col("wavenumber") * F.col("psd"))


def periodogram(y: np.ndarray, dx: float, padding: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided density of a Hamming-windowed record, padded to the power of two at or above
    padding times its length."""
    n = len(y)
    nfft = 1 << int(np.ceil(np.log2(padding * n)))
    w = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / n)
    p = dx / (w**2).sum() * np.abs(np.fft.rfft(y * w, nfft)) ** 2
    p[1:-1] *= 2
    return np.arange(nfft // 2 + 1) / (nfft * dx), p


def conditional_spectra(pairs: DataFrame, frames: DataFrame, rows: list[int], thresholds: list[float], dx_m: float, delta_m: float, n_lambda: int = 40, longest: int = 640, large: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """Mean premultiplied spectra of structures and their matched windows on a common logarithmic grid of wavelengths
    over delta, and their energies, by length threshold and row.

    pairs: frame_id, col_min, col_max, window_min, window_max, lx_over_delta; frames: frame_id, j, u (array along i).
    Wavelengths beyond a record's own are left out, none extrapolated; records with gaps are left out.
    """
    grid = np.geomspace(2 * dx_m / delta_m, longest * dx_m / delta_m, n_lambda)
    met = pairs.join(frames.where(F.col("j").isin(rows)), "frame_id").select("frame_id", "j", "lx_over_delta", F.expr("slice(u, col_min, col_max - col_min + 1)").alias("a"), F.expr("slice(u, window_min, window_max - window_min + 1)").alias("b"))

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                got = []
                for side in (r.a, r.b):
                    y = np.array([np.nan if v is None else v for v in side], float)
                    if len(y) < 2 or not np.isfinite(y).all():
                        break
                    f, p = periodogram(y, dx_m)
                    ok = (f > 0) & (f >= 1 / (len(y) * dx_m) * (1 - 1e-12))
                    rho = 1 / (f[ok] * delta_m)
                    at = np.argsort(rho)
                    inside = (grid >= rho.min()) & (grid <= rho.max())
                    curve = np.where(inside, np.interp(np.log(grid), np.log(rho[at]), (f * p)[ok][at]), np.nan)
                    far = ok & (f <= 1 / (large * delta_m))
                    got.append((curve, f[1] * p[far].sum(), f[1] * p[ok].sum()))
                if len(got) < 2:
                    continue
                both = np.isfinite(got[0][0]) & np.isfinite(got[1][0])
                for t in thresholds:
                    if r.lx_over_delta > t:
                        out += [(t, r.j, float(grid[k]), float(got[0][0][k]), float(got[1][0][k])) for k in np.flatnonzero(both)]
                        out += [(t, r.j, -1.0, float(got[0][1]), float(got[1][1])), (t, r.j, -2.0, float(got[0][2]), float(got[1][2]))]
            yield pd.DataFrame(out, columns=["threshold", "j", "wavelength", "ss", "noss"])

    lines = met.mapInPandas(run, "threshold double, j int, wavelength double, ss double, noss double").groupBy("threshold", "j", "wavelength").agg(F.avg("ss").alias("ss"), F.avg("noss").alias("noss"), F.count(F.lit(1)).alias("n"))
    curves = lines.where("wavelength > 0")
    part = lambda k, c: F.max(F.when(F.col("wavelength") == k, F.col(c)))
    energy = lines.where("wavelength < 0").groupBy("threshold", "j").agg(F.max("n").alias("pairs"), part(-1, "ss").alias("large_ss"), part(-1, "noss").alias("large_noss"), part(-2, "ss").alias("total_ss"), part(-2, "noss").alias("total_noss"))
    return curves, energy.withColumns({"ratio": F.try_divide("large_ss", "large_noss"), "share_ss": F.try_divide("large_ss", "total_ss"), "share_noss": F.try_divide("large_noss", "total_noss")})


def cross_spectra(samples: DataFrame, keys: list[str], a: str, b: str, nfft: int, fs: float, overlap: float = 0.5) -> DataFrame:
    """Cross density (re, im) and coherence of two signals of each series; gaps filled."""
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                x, y = np.array(getattr(r, a), float), np.array(getattr(r, b), float)
                if min(np.isfinite(x).sum(), np.isfinite(y).sum()) < max(3, min(nfft, len(x))):
                    continue
                p, q = blocks(repaired(x), nfft, overlap), blocks(repaired(y), nfft, overlap)
                cross = (np.conj(p) * q).mean(0)
                pp, qq = (np.abs(p) ** 2).mean(0), (np.abs(q) ** 2).mean(0)
                density = one_sided(cross.copy(), nfft, fs)
                with np.errstate(invalid="ignore", divide="ignore"):
                    same = np.abs(cross) ** 2 / (pp * qq)
                out += [(*[getattr(r, k) for k in keys], k * fs / nfft, float(d.real), float(d.imag), float(c) if np.isfinite(c) else None) for k, (d, c) in enumerate(zip(density, same))]
            yield pd.DataFrame(out, columns=[*keys, "frequency", "re", "im", "coherence"])

    return _series(samples, keys, [a, b], "frame_id").mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", frequency double, re double, im double, coherence double")


def spectral_peak(spectra: DataFrame, keys: list[str]) -> DataFrame:
    """Frequency and value of the largest premultiplied density of each group; the lower frequency at ties."""
    return spectra.where("frequency > 0").groupBy(*keys).agg(F.max_by("frequency", F.struct("premultiplied", -F.col("frequency"))).alias("frequency"), F.max("premultiplied").alias("peak"))


def wall_scaled(spectra: DataFrame, profile: DataFrame, u_tau: float, nu: float, band: tuple[float, float], fraction: float = 1.0, near_wall: int = 0, near_wall_plus: float = 10.0) -> DataFrame:
    """Temporal spectra (j, frequency, psd) within a band, scaled by the friction velocity, with the wavelength by frozen
    convection: `fraction` of each row's mean velocity (profile: j, u_mean), near_wall_plus times u_tau in the first
    near_wall rows. A row without a positive convection velocity has no wavelength."""
    speed = F.when(F.col("j") <= near_wall, F.lit(near_wall_plus * u_tau)).otherwise(fraction * F.col("u_mean"))
    rows = spectra.where((F.col("frequency") > 0) & F.col("frequency").between(*band)).join(profile.select("j", "u_mean"), "j", "left").withColumn("_c", F.when(speed > 0, speed))
    length = F.col("_c") / F.col("frequency")
    scaled = F.col("frequency") * F.col("psd") / u_tau**2
    return rows.select("j", "frequency", "psd", length.alias("lambda_m"), (length * (u_tau / nu)).alias("lambda_plus"), scaled.alias("premultiplied_f"), F.when(length.isNotNull(), scaled).alias("premultiplied_lambda"))


def external_coherence(samples: DataFrame, signal: DataFrame, keys: list[str], value: str, nfft: int, fs: float, overlap: float = 0.5) -> DataFrame:
    """cross_spectra() of each series with one signal from outside (frame_id, signal), joined on the frame; frames that
    the signal lacks count as gaps."""
    return cross_spectra(samples.join(signal.select("frame_id", "signal"), "frame_id", "left"), keys, value, "signal", nfft, fs, overlap)
