"""Queries on spectra, correlations in time, and modes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import correlation as R
from ..operators import dynamic_modes, matching, modal, spectra, spectral_modes, statistics
from ..plans.views import COLUMNS, SMP, final, piv, rounded
from ..sources.shared import written
from .fields import found

FS = 16.0


def clean(s, d):
    return statistics.paired(piv(s, d))


def probe(s, d):
    return clean(s, d).where("j = 2 and i = 4").select(F.lit(1).alias("k"), "frame_id", F.coalesce("u", F.lit(0.0)).alias("u"), F.coalesce("v", F.lit(0.0)).alias("v"))


def lagged(s, d):
    return R.space_time(piv(s, d), 2, 3, 6)


def snaps(s, d):
    return modal.snapshots(piv(s, d))


def energies(s, d):
    return modal.energy_table(modal.pod(snaps(s, d)), s, [0.5, 0.8, 0.95])


def traces(s, d):
    """Sums of the eigenvalues and of their squares."""
    values = modal.pod(snaps(s, d)).eigenvalues
    return s.createDataFrame([(float(values.sum()), float((values**2).sum()))], "total double, squared double")


def spectral_power(s, d):
    """Sum of the eigenvalues of each frequency."""
    return spectral_modes.spod(snaps(s, d), 64, FS).groupBy("frequency").agg(F.sum("eigenvalue").alias("power"), F.count(F.lit(1)).alias("modes"))


def rebuilt_spectra(s, d):
    """Power of every value of a frame, from the eigenvalues and the squares of all modes."""
    return spectral_modes.rebuilt_power(spectral_modes.decompose(snaps(s, d), 64, FS))


def spectral_shapes(s, d):
    """Modes of the dominant frequency and of the forcing's harmonics: length, and share of the upper half of the rows."""
    found = spectral_modes.decompose(snaps(s, d), 64, FS, keep=3)
    values = spectral_modes.eigenvalues(found)
    square = F.zip_with("re", "im", lambda a, b: a * a + b * b)
    parts = spectral_modes.modes(found, 3, spectral_modes.selected(values, 2.0)).select("frequency", "mode", F.posexplode(square).alias("k", "e"))
    got = parts.groupBy("frequency", "mode").agg(F.sum("e").alias("length"), F.sum(F.when(F.col("k") % 32 >= 16, F.col("e"))).alias("upper"))
    return got.join(values, ["frequency", "mode"])


def dynamic_table(s, d):
    """Spectrum with the nearest harmonic of the forcing (2 Hz), and the length of each mode."""
    found = dynamic_modes.decompose(snaps(s, d), 8, 1 / FS, 2.0)
    table = s.createDataFrame(found.spectrum.assign(mode=range(1, len(found.spectrum) + 1))[["mode", "growth", "frequency", "amplitude", "replaced", "harmonic", "mismatch"]])
    size = dynamic_modes.modes(snaps(s, d), found).groupBy("mode").agg(F.sum(F.aggregate(F.zip_with("re", "im", lambda a, b: a * a + b * b), F.lit(0.0), lambda a, x: a + x)).alias("length"))
    return table.join(size, "mode")


def dynamic_start(s, d):
    """The first snapshot, put together from all modes and their amplitudes."""
    return dynamic_modes.at_step(snaps(s, d), dynamic_modes.decompose(snaps(s, d), 64, 1 / FS), 0)


def modes(s, d):
    model = modal.pod(snaps(s, d))
    return modal.coefficients(snaps(s, d), model, 5).groupBy("mode").agg(F.avg(F.col("a") * F.col("a")).alias("energy"), F.count(F.lit(1)).alias("n")).withColumn("dof", F.lit(model.dof))


def rebuilt(s, d):
    model = modal.pod(snaps(s, d))
    both = modal.reconstruct(snaps(s, d), model, model.dof).withColumnRenamed("x", "y").join(snaps(s, d), "frame_id")
    return both.select("frame_id", F.aggregate(F.zip_with("x", "y", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: F.greatest(a, b)).alias("worst"), F.aggregate("y", F.lit(0.0), lambda a, x: a + x * x).alias("energy"), F.get("y", F.lit(40)).alias("at40"))


def denoised(s, d):
    model = modal.pod(snaps(s, d))
    got = model.threshold_rank()
    return s.createDataFrame([(got["beta"], got["omega"], got["threshold"], int(got["rank"]))], "beta double, omega double, threshold double, rank int")


def entropy(s, d):
    got = modal.entropy_selection(snaps(s, d), modal.pod(snaps(s, d)), np.ones((4, 8), bool))
    return s.createDataFrame([(got["modes"], float(got["ppr"]), float(got["jaccard"]), got["valid"])], "modes array<int>, ppr double, jaccard double, valid boolean")


def pairs(s, d):
    """Complete structures of all frames and their matched windows."""
    catalog = written(found(s, d).where("connectivity = 8"), "catalog")
    key = ["frame_id", "sign", "component_id"]
    return matching.match_windows(catalog, COLUMNS).where("matched").join(catalog.select(*key, "lx_over_delta"), key)


def windows(s, d):
    lines = clean(s, d).groupBy("frame_id", "j").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "u"))), lambda p: p["u"]).alias("u"))
    return spectra.conditional_spectra(pairs(s, d), lines, [2, 3], [1.0, 1.4], 2e-3, 4e-3, 12, 8, 1.0)


SERIES = f"{SMP}, pb AS (SELECT frame_id, coalesce(u, 0) AS u, coalesce(v, 0) AS v FROM smp WHERE j = 2 AND i = 4)"
AUTO = f"{SERIES}, ac AS (SELECT lag, sum(a.u*b.u)/(SELECT sum(u*u) FROM pb) AS r FROM pb a, range(11) l(lag), pb b WHERE b.frame_id = a.frame_id+lag GROUP BY lag)"
LAGGED = f"{SMP}, sp AS (SELECT l.lag, b.i, corr(CASE WHEN b.u IS NOT NULL THEN a.u END, CASE WHEN a.u IS NOT NULL THEN b.u END) AS r, count(CASE WHEN a.u IS NOT NULL THEN b.u END) AS n FROM smp a, range(7) l(lag), smp b WHERE a.j = 2 AND a.i = 3 AND b.j = 2 AND b.frame_id = a.frame_id+l.lag GROUP BY l.lag, b.i)"

#: Hann blocks of 64 frames, 32 apart, of all 64 values of a frame, and their transforms.
POWER = f"""{SMP}, bn AS (SELECT (max(frame_id)-64)//32+1 AS n FROM smp), wn AS (SELECT sum(pow(0.5-0.5*cos(2*pi()*t/64), 2)) AS w2 FROM range(64) r(t)),
bx AS (SELECT b, j, i, c, frame_id-1-32*b AS t, coalesce(CASE WHEN c = 0 THEN u ELSE v END, 0)*(0.5-0.5*cos(2*pi()*(frame_id-1-32*b)/64)) AS x FROM smp JOIN (SELECT unnest(range(n)) AS b FROM bn) k ON frame_id BETWEEN 32*b+1 AND 32*b+64, (VALUES (0), (1)) d(c)),
tf AS (SELECT b, j, i, c, f, sum(x*cos(2*pi()*f*t/64)) AS re, sum(x*sin(2*pi()*f*t/64)) AS im FROM bx, range(33) r(f) GROUP BY b, j, i, c, f)"""

QUERIES = {
    "temporal_spectra": (lambda s, d: rounded(spectra.temporal_spectra(piv(s, d).withColumn("u", F.when(F.col("valid"), F.col("u"))), "u", 64, FS)), None),
    "welch_series": (lambda s, d: rounded(spectra.welch(clean(s, d), ["j", "i"], "u", 64, FS)), None),
    "spectral_peak": (lambda s, d: rounded(spectra.spectral_peak(spectra.temporal_spectra(clean(s, d), "u", 64, FS), ["j"])), None),
    "spatial_spectra": (lambda s, d: rounded(spectra.spatial_spectra(clean(s, d), "u", 2e-3, 0.5, 6)), None),
    "conditional_spectra": (lambda s, d: rounded(windows(s, d)[0]), None),
    "conditional_energy": (lambda s, d: rounded(windows(s, d)[1]), None),
    "cross_spectra": (lambda s, d: rounded(spectra.cross_spectra(clean(s, d), ["j", "i"], "u", "v", 64, FS)), None),
    "autocorrelation": (lambda s, d: rounded(R.autocorrelation(probe(s, d), ["k"], "u", "u", 10).drop("k")), final(AUTO, "SELECT CAST(lag AS INTEGER) AS lag, r FROM ac", "lag r~")),
    "cross_correlation": (lambda s, d: rounded(R.autocorrelation(probe(s, d), ["k"], "u", "v", 10).drop("k")), final(SERIES, "SELECT CAST(lag AS INTEGER) AS lag, sum(a.u*b.v)/sqrt((SELECT sum(u*u) FROM pb)*(SELECT sum(v*v) FROM pb)) AS r FROM pb a, range(11) l(lag), pb b WHERE b.frame_id = a.frame_id+lag GROUP BY lag", "lag r~")),
    "integral_time": (lambda s, d: rounded(R.integral_time(R.autocorrelation(probe(s, d), ["k"], "u", "u", 10), ["k"], FS).drop("k")), final(f"{AUTO}, z AS (SELECT coalesce((SELECT min(lag) FROM ac WHERE r <= 0), (SELECT max(lag) FROM ac)) AS z), p AS (SELECT lag, (r+lag(r) OVER (ORDER BY lag))/2/16.0 AS a FROM ac)", "SELECT coalesce(sum(a), 0) AS time, CAST(max(lag) AS INTEGER) AS last_lag FROM p, z WHERE lag <= z", "time~ last_lag")),
    "space_time": (lambda s, d: rounded(lagged(s, d)), final(LAGGED, "SELECT CAST(lag AS INTEGER) AS lag, i, r, n FROM sp", "lag i r~ n")),
    "convection": (lambda s, d: rounded(R.convection(lagged(s, d), 3, 2.0, FS, 0.0)), final(f"{LAGGED}, bt AS (SELECT lag, i, r, row_number() OVER (PARTITION BY lag ORDER BY r DESC, i) AS p FROM sp WHERE i > 3 AND lag > 0 AND r IS NOT NULL), st AS (SELECT lag/16.0 AS t, (i-3)*2e-3 AS x FROM bt WHERE p = 1 AND r >= 0)", "SELECT count(*) AS points, CASE WHEN count(*) >= 2 AND regr_slope(x, t) > 0 THEN regr_slope(x, t) END AS velocity FROM st", "points velocity~")),
    "streamwise_correlation": (lambda s, d: rounded(R.streamwise(piv(s, d), 2, 4, 2.0 * F.col("i"), 5.0)), final(SMP, "SELECT s.i, CASE WHEN abs(2.0*(s.i-4)) <= 5 THEN corr(CASE WHEN r.u IS NOT NULL THEN s.u END, CASE WHEN s.u IS NOT NULL THEN r.u END) END AS ruu, count(CASE WHEN r.u IS NOT NULL THEN s.u END) AS n, 2.0*(s.i-4) AS delta_x FROM smp s JOIN smp r ON s.frame_id = r.frame_id AND s.j = 2 AND r.j = 2 AND r.i = 4 GROUP BY s.i", "i ruu~ n delta_x~")),
    "snapshots": (lambda s, d: rounded(snaps(s, d).select("frame_id", F.size("x").alias("dof"), F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x).alias("energy"), F.get("x", F.lit(40)).alias("at40"))), final(SMP, "SELECT frame_id, CAST(2*count(*) AS INTEGER) AS dof, sum(coalesce(u, 0)*coalesce(u, 0)+coalesce(v, 0)*coalesce(v, 0)) AS energy, max(CASE WHEN j = 2 AND i = 1 THEN coalesce(v, 0) END) AS at40 FROM smp GROUP BY frame_id", "frame_id dof energy~ at40~")),
    "pod_total_energy": (lambda s, d: rounded(modal.total_energy(piv(s, d))), final(SMP, "SELECT max(n)*sum(e)/(2*count(*)) AS total_energy FROM (SELECT j, i, count(*) AS n, var_pop(coalesce(u, 0))+var_pop(coalesce(v, 0)) AS e FROM smp GROUP BY j, i) t", "total_energy~")),
    "pod_energy": (lambda s, d: rounded(energies(s, d)), None),
    "pod_eigenvalue_sum": (lambda s, d: rounded(s.createDataFrame([(float(modal.pod(snaps(s, d)).eigenvalues.sum()),)], "total_energy double")), final(SMP, "SELECT max(n)*sum(e)/(2*count(*)) AS total_energy FROM (SELECT j, i, count(*) AS n, var_pop(coalesce(u, 0))+var_pop(coalesce(v, 0)) AS e FROM smp GROUP BY j, i) t", "total_energy~")),
    "pod_traces": (lambda s, d: rounded(traces(s, d)), None),
    "pod_modes": (lambda s, d: rounded(modes(s, d)), None),
    "pod_reconstruction": (lambda s, d: rounded(rebuilt(s, d)), final(SMP, "SELECT frame_id, 0.0 AS worst, sum(coalesce(u, 0)*coalesce(u, 0)+coalesce(v, 0)*coalesce(v, 0)) AS energy, max(CASE WHEN j = 2 AND i = 1 THEN coalesce(v, 0) END) AS at40 FROM smp GROUP BY frame_id", "frame_id worst~ energy~ at40~")),
    "pod_denoise_rank": (lambda s, d: rounded(denoised(s, d)), None),
    "pod_entropy_selection": (lambda s, d: rounded(entropy(s, d)), None),
    "dmd": (lambda s, d: rounded(s.createDataFrame(dynamic_modes.spectrum(snaps(s, d), 8, 1 / FS)), 4), None),
    "spod": (lambda s, d: rounded(spectral_modes.spod(snaps(s, d), 64, FS)), None),
    "dmd_modes": (lambda s, d: rounded(dynamic_table(s, d), 4), None),
    "dmd_start": (lambda s, d: rounded(dynamic_start(s, d), 5), final(SMP, "SELECT CAST(o+(j-1)*8+i-1 AS BIGINT) AS k, CASE WHEN o = 0 THEN coalesce(u, 0) ELSE coalesce(v, 0) END AS x FROM smp, (VALUES (0), (32)) t(o) WHERE frame_id = (SELECT min(frame_id) FROM smp)", "k x~", 5)),
    "spod_modes": (lambda s, d: rounded(spectral_shapes(s, d), 5), None),
    "spod_rebuilt": (lambda s, d: rounded(rebuilt_spectra(s, d)), final(POWER, f"SELECT f*{FS}/64 AS frequency, CAST(c*32+(j-1)*8+i-1 AS BIGINT) AS k, CASE WHEN f IN (0, 32) THEN 1 ELSE 2 END*sum(re*re+im*im)/({FS}*max(w2)*max(n)) AS power FROM tf, wn, bn GROUP BY f, c, j, i", "frequency~ k power~")),
    "spod_power": (lambda s, d: rounded(spectral_power(s, d)), final(POWER, f"SELECT f*{FS}/64 AS frequency, CASE WHEN f IN (0, 32) THEN 1 ELSE 2 END*sum(re*re+im*im)/({FS}*max(w2)*max(n)) AS power, min(CAST(least(n, 64) AS BIGINT)) AS modes FROM tf, wn, bn GROUP BY f", "frequency~ power~ modes")),
}
