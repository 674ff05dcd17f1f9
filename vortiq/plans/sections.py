"""Whole analyses: operators put together as the sections of a study."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.phase import assign_phase
from ..operators import boundary, catalog, domain, frames, gradients, matching, modal, phase, quadrants, spectra, statistics, structures, transport
from ..operators.statistics import POINT
from ..sources.shared import written


@dataclass(frozen=True)
class Flow:
    """What a study's sections share; lengths in mm, speeds in m/s."""

    n_frames: int
    fs: float
    f0: float
    n_bins: int
    min_samples: int = 20
    min_valid_fraction: float = 0.7
    u_inf: float = 25.0
    nu: float = 1.48e-5
    rho: float = 1.2
    holes: tuple[float, ...] = (0.0, 1.0, 2.0)
    edge_rows: int = 2
    edge_columns: int = 16
    stress_floor: float = 1e-6


def mean_flow(samples: DataFrame, cfg: Flow) -> dict[str, DataFrame]:
    """Repeat means, mean statistics and phase statistics."""
    clocked = assign_phase(samples, cfg.fs, cfg.f0, cfg.n_bins)
    means = statistics.repeat_means(samples)
    stats = statistics.mean_stats(samples, means, cfg.min_valid_fraction, cfg.u_inf)
    pooled = phase.phase_means(clocked, ["bin"], cfg.min_samples)
    bins, whole = phase.random_moments(clocked, cfg.min_samples)
    return {"repeat_means": means, "statistics": stats, "phase": phase.coherent(pooled, stats), "random_phase": bins, "random": whole, "coverage": phase.coverage(clocked, cfg.min_samples)}


def transport_section(samples: DataFrame, grid: DataFrame, cfg: Flow) -> dict[str, DataFrame]:
    """Transport statistics with their closures, production inside the eroded domain, and quadrants of both branches."""
    clocked = assign_phase(samples, cfg.fs, cfg.f0, cfg.n_bins)
    cells = transport.transport_cells(clocked, cfg.min_samples)
    stats = transport.transport_stats(cells, cfg.n_frames, cfg.min_valid_fraction)
    slope = gradients.d_dy(stats.join(grid, POINT), "u_mean")
    kept = domain.eroded(stats.select(*POINT, F.col("accepted").alias("ok")), cfg.edge_rows, cfg.edge_columns).where("kept").select(*POINT)
    products = transport.production(stats, slope)
    admitted = transport.support(clocked, cfg.min_samples).join(stats.where("accepted").select(*POINT), POINT, "left_semi")
    own = statistics.paired(clocked).join(admitted.select(*transport.CELL, "tu", "tv", "pu", "pv"), transport.CELL)
    total = own.select(*transport.CELL, (F.col("u") - F.col("tu")).alias("du"), (F.col("v") - F.col("tv")).alias("dv"))
    random = own.select(*transport.CELL, (F.col("u") - F.col("pu")).alias("du"), (F.col("v") - F.col("pv")).alias("dv"))
    scale = stats.select(*POINT, F.sqrt("total_uu").alias("u_rms"), F.sqrt("total_vv").alias("v_rms"))
    by_bin = transport.transport_phases(cells, stats).select("bin", *POINT, F.sqrt("random_uu").alias("u_rms"), F.sqrt("random_vv").alias("v_rms"))
    whole, bins = quadrants.quadrant_cells(total, scale, list(cfg.holes)), quadrants.quadrant_cells(random, by_bin, list(cfg.holes), ["bin"])
    return {
        "statistics": stats, "phases": transport.transport_phases(cells, stats), "identity": transport.identity(stats), "production": products, "production_inside": products.join(kept, POINT, "left_semi"),
        "quadrants": quadrants.quadrant_stats(whole, floor=cfg.stress_floor), "quadrants_phase": quadrants.quadrant_stats(bins, ["bin"], cfg.stress_floor), "quadrants_cycle": quadrants.quadrant_stats(bins, floor=cfg.stress_floor), "closure": quadrants.quadrant_closure(whole),
    }


def profiles(stats: DataFrame, grid: DataFrame, values: list[str], first: int, last: int) -> DataFrame:
    """Profiles in long form: quantity, y_mm, equal-weight mean over columns first..last and its number of points."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("quantity"), F.col(c).cast("double").alias("value")) for c in values])).alias("r")
    own = stats.where(F.col("i").between(first, last)).join(grid.select(*POINT, "x_mm", "y_mm"), POINT).select("y_mm", "x_mm", rows).select("y_mm", "x_mm", "r.*")
    return own.groupBy("quantity", "y_mm").agg(F.avg("value").alias("mean_value"), F.count("value").alias("finite_spatial_count"), F.min("x_mm").alias("x_min_mm"), F.max("x_mm").alias("x_max_mm"))


def handoff_section(samples: DataFrame, grid: DataFrame, production: DataFrame, quadrant_stats: DataFrame, heights: DataFrame, nfft: int, fs: float) -> dict[str, DataFrame]:
    """What a streamwise study hands on, by column.

    peaks: for each requested height (target) the row nearest to it and, at every column, the frequency and level of the
    largest premultiplied density; production: peak and wall-normal mean; quadrants: wall-normal mean probability by hole
    and quadrant; envelope: course of the leading mode.
    """
    rows = matching.nearest_rows(grid.select("j", "y_mm").distinct(), heights, "y_mm", "j").select("target", "j", "y_mm")
    wanted = statistics.paired(samples).join(rows.select("j").distinct(), "j", "left_semi")
    density = spectra.welch(wanted, POINT, "u", nfft, fs).withColumn("premultiplied", F.col("frequency") * F.col("psd"))
    snaps = modal.snapshots(samples)
    return {
        "peaks": rows.join(spectra.spectral_peak(density, POINT), "j"),
        "production": statistics.column_metrics(production, "production"),
        "quadrants": quadrant_stats.groupBy("i", "hole", "quadrant").agg(F.avg("probability").alias("probability")),
        "envelope": modal.envelope(snaps, modal.pod(snaps), grid),
    }


def friction_section(stats: DataFrame, x_mm: DataFrame, h_mm: float, dy_mm: float, cfg: Flow, columns: tuple[int, int]) -> dict[str, DataFrame]:
    """Profile, chart fit, integral parameters and the secant friction coefficient along x (x_mm: i, x)."""
    prof = boundary.velocity_profile(stats, "u_mean", *columns)
    scan = boundary.clauser_scan(boundary.numbered(prof.withColumn("case", F.lit(1)), ["case"]), ["case"], cfg.u_inf, cfg.nu, h_mm, dy_mm)
    params = boundary.integral_params(stats, h_mm, dy_mm)
    state = params.join(x_mm, "i").select("x", "theta", F.col("u_edge").alias("ue"), "delta_star")
    fit = boundary.clauser_fit(scan, ["case"], cfg.u_inf)
    plus = prof.join(fit.select("u_tau"), F.lit(True)).select("j", "u", (domain.wall_distance(F.col("j"), h_mm, dy_mm / h_mm) * 1e-3 * F.col("u_tau") / cfg.nu).alias("y_plus"), (F.col("u") / F.col("u_tau")).alias("u_plus"))
    pair = {f"secant_{name}": boundary.calibration_secant(state, 0.0, 1e9, full) for name, full in (("full", True), ("zpg", False))}
    return {"profile": prof, "chart": fit, "integral": params, "plus": plus, "delta": params.agg(F.median("delta99").alias("delta99"), F.count("delta99").alias("columns")), "secant": pair["secant_full"], **pair}


def pod_sweep(snaps: DataFrame, model: modal.Pod, shape: tuple[int, int], targets: tuple[float, ...], level: np.ndarray, search, valid_pixels: int) -> DataFrame:
    """Structures of fields rebuilt from the modes that hold each target of the energy: a row a target and scale.

    One scan of the snapshots rebuilds the fields of all ranks, which are written once; two searches, with the points'
    own scale ("raw": level) and with that of each rebuilt field ("own"), go over all of them. search turns packed
    frames and a level into a catalog. Figures are means over frames of counts, occupied share and lengths.
    """
    ranks = {t: model.energy_rank(t) for t in targets}
    every = sorted(set(ranks.values()))
    # fields of one rank go by its number as those of a repeat
    fields = written(modal.as_frames(modal.reconstruct_sweep(snaps, model, every), "rank"), "sweep")
    own = {rank: np.repeat(row_rms(fields.where(F.col("repeat_id") == rank), shape)[:, None], shape[1], 1).ravel() for rank in every}

    def divided(batches):
        for batch in batches:
            with np.errstate(invalid="ignore", divide="ignore"):
                batch["u"] = [(np.asarray(u, float) / own[r]).tolist() for r, u in zip(batch["repeat_id"], batch["u"])]
            yield batch

    share, out = model.cumulative(), None
    names = ["lsm", "vlsm", "occupied_share", "median_length", "p90_length"]
    scaled = fields.select("repeat_id", "frame_id", "u").mapInPandas(divided, "repeat_id int, frame_id long, u array<double>")
    for scale, found in (("raw", search(fields.select("repeat_id", "frame_id", "u"), level)), ("own", search(scaled, np.ones(shape)))):
        metrics = catalog.branch_metrics(found, fields, valid_pixels, ("repeat_id", "frame_id"))
        one = metrics.groupBy("repeat_id").agg(*[F.avg(c).alias(c) for c in names])
        asked = snaps.sparkSession.createDataFrame([(t, scale, r, float(share[r - 1])) for t, r in ranks.items()], "target double, scale string, rank int, energy double")
        one = asked.join(one.withColumnRenamed("repeat_id", "rank"), "rank").select("target", "scale", "rank", "energy", *names)
        out = one if out is None else out.unionByName(one)
    return out


def pod_branches(samples: DataFrame, shape: tuple[int, int], targets: tuple[float, ...], level: np.ndarray, search, valid_pixels: int, entropy_valid: bool, tolerance: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """pod_sweep() of the samples' own modes, and whether its figures settle.

    The second table compares the first two targets on the raw scale: the largest relative difference, and the rank to
    recommend where the entropy gives no valid choice and that is within the tolerance.
    """
    snaps = modal.snapshots(samples)
    names = ["lsm", "vlsm", "occupied_share", "median_length", "p90_length"]
    out = pod_sweep(snaps, modal.pod(snaps), shape, targets, level, search, valid_pixels)
    table = written(out, "branches")
    a, b = (table.where((F.col("target") == t) & (F.col("scale") == "raw")) for t in targets[:2])
    gap = lambda c: F.coalesce(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) / F.greatest(F.abs(F.col(f"a.{c}")), F.abs(F.col(f"b.{c}")), F.lit(2.220446049250313e-16)), F.lit(float("inf")))
    both = a.alias("a").join(b.alias("b"), F.lit(True)).select(F.greatest(*[gap(c) for c in names]).alias("largest_difference"), F.col("a.rank").alias("_rank"))
    stable = F.col("largest_difference") <= tolerance
    return table, both.select("largest_difference", stable.alias("stable"), F.lit(not entropy_valid).alias("triggered"), F.when(stable & F.lit(not entropy_valid), F.col("_rank")).alias("recommended"))


def fluctuation_frames(samples: DataFrame, shape: tuple[int, int], energy: float | None = None, blur: structures.Blur | None = None) -> DataFrame:
    """Packed u fluctuations to search: about the repeats' means, or rebuilt from the modes that hold so much of the
    energy; missing samples stay missing; blurred last."""
    if energy is None:
        own = statistics.total_branch(samples, statistics.repeat_means(samples)).select("repeat_id", "frame_id", *POINT, F.col("du").alias("u"))
        packed = frames.pack(own, ["u"])
    else:
        snaps = modal.snapshots(samples)
        model = modal.pod(snaps)
        rebuilt = modal.as_frames(modal.reconstruct(snaps, model, model.energy_rank(energy), fluctuations=True)).select("frame_id", F.col("u").alias("_u"))
        known = frames.pack(statistics.paired(samples), ["u"])
        packed = known.join(rebuilt, "frame_id").select("repeat_id", "frame_id", F.zip_with("u", "_u", lambda a, b: F.when(a.isNotNull(), b)).alias("u"))
    if blur is None:
        return packed
    return structures.blurred(packed, shape, (blur.sigma_y, blur.sigma_x), blur.size(), blur.mode, blur.by_mask)


def phase_planar(phases: DataFrame, stats: DataFrame, grid: DataFrame) -> DataFrame:
    """Planar criteria of every phase mean, and its vorticity less that of the mean flow."""
    places = grid.select(*POINT, "x_mm", "y_mm")
    own = gradients.planar_criteria(phases.select("bin", *POINT, F.col("u_phase").alias("u"), F.col("v_phase").alias("v")).join(places, POINT))
    mean = gradients.planar_criteria(stats.select(F.lit(0).alias("bin"), *POINT, F.col("u_mean").alias("u"), F.col("v_mean").alias("v")).join(places, POINT))
    return own.join(mean.select(*POINT, F.col("vorticity").alias("_mean")), POINT, "left").withColumn("coherent_vorticity", F.col("vorticity") - F.col("_mean")).drop("_mean")


def coherent_structures(parts: DataFrame, shape: tuple[int, int], domain: np.ndarray, x_mm: np.ndarray, y_mm: np.ndarray, delta: np.ndarray, how: structures.Hysteresis, energy_alpha: float) -> DataFrame:
    """Catalog of the coherent part of each bin (bin, j, i, u_coherent, v_coherent) by field: "u" and "v" over their rms of
    all bins, and "energy" (half the sum of squares), of one sign and with one threshold, over its mean.

    Scales have the grid's size.
    """
    rows = parts.withColumn("energy", (F.col("u_coherent") * F.col("u_coherent") + F.col("v_coherent") * F.col("v_coherent")) / 2)
    scales = rows.groupBy(*POINT).agg(F.sqrt(F.avg(F.col("u_coherent") * F.col("u_coherent"))).alias("u"), F.sqrt(F.avg(F.col("v_coherent") * F.col("v_coherent"))).alias("v"), F.avg("energy").alias("energy"))
    level = {r["j"] * shape[1] + r["i"] - shape[1] - 1: r for r in scales.collect()}
    packed = frames.pack(rows.select(F.lit(1).alias("repeat_id"), F.col("bin").cast("long").alias("frame_id"), *POINT, F.col("u_coherent").alias("u"), F.col("v_coherent").alias("v"), "energy"), ["u", "v", "energy"])
    out = None
    for name in ("u", "v", "energy"):
        scale = np.array([level[k][name] if k in level and level[k][name] is not None else np.nan for k in range(shape[0] * shape[1])]).reshape(shape)
        own = replace(how, alpha=energy_alpha, seed_alpha=energy_alpha, signs=(1,)) if name == "energy" else how
        got = structures.hysteresis_structures(packed.select("repeat_id", "frame_id", F.col(name).alias("u")), shape, scale, domain, x_mm, y_mm, delta, own)
        got = got.withColumnRenamed("frame_id", "bin").withColumn("field", F.lit(name)).drop("repeat_id")
        out = got if out is None else out.unionByName(got)
    return out


def row_rms(packed: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Root mean square of packed fluctuations by row about each point's mean: a number a row reaches the driver."""
    points = packed.select(F.posexplode("u").alias("k", "u")).where("u is not null").withColumn("j", F.floor(F.col("k") / shape[1]))
    about = points.join(points.groupBy("k").agg(F.avg("u").alias("m")), "k").groupBy("j").agg(F.sqrt(F.avg(F.pow(F.col("u") - F.col("m"), 2))).alias("r"))
    level = {int(r["j"]): r["r"] for r in about.collect()}
    return np.array([level.get(j) or np.inf for j in range(shape[0])])


def detection_section(samples: DataFrame, shape: tuple[int, int], x_mm: np.ndarray, wall_mm: np.ndarray, how: structures.Detection, limit: int | None = None, energy: float | None = None, blur: structures.Blur | None = None, own_rms: bool = False) -> dict[str, DataFrame]:
    """Structures of fluctuations about the repeats' means: catalog with the kept ones, matched windows and comparisons.

    The threshold profile, a number for each row, is read by the driver before frames are searched; the catalog, which
    all other tables are made from, is written to the shared folder once. energy and blur choose the fluctuations (see
    fluctuation_frames()); the threshold is that of the raw field, or with own_rms that of what is searched.
    """
    packed = fluctuation_frames(samples, shape, energy, blur)
    if own_rms:
        packed = written(packed, "fluctuations")
        u_rms = row_rms(packed, shape)
    else:
        level = {r["j"]: r["u_rms"] for r in statistics.pooled_rms(samples).collect()}
        u_rms = np.array([level.get(j + 1) or np.inf for j in range(shape[0])])
    found = structures.find_structures(packed, shape, u_rms, x_mm, wall_mm, how)
    kept = matching.retain_nonoverlapping(found.withColumn("is_ss", F.col("is_ss") & ~F.col("edge_rejected")), limit)
    chosen = written(kept.withColumn("is_ss", F.when(F.col("is_censored"), F.col("is_ss")).otherwise(F.col("kept"))), "catalog")
    every = samples.select("frame_id").distinct()
    thresholds = list(how.thresholds)
    return {
        "catalog": chosen, "frames": catalog.frame_summary(chosen, every, thresholds), "windows": matching.match_windows(chosen, shape[1]), "comparison": catalog.connectivity_comparison(chosen, every, thresholds[0]),
        "counts": catalog.threshold_counts(chosen, thresholds), "overlap": catalog.frame_overlap(chosen, thresholds), "lengths": catalog.length_distribution(chosen),
    }
