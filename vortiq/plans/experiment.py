"""The tables of a detection experiment, put together and written."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog, matching, spectra, statistics, structures
from ..sources.cache import write_tables
from ..sources.shared import written
from .sections import detection_section


def experiment(samples: DataFrame, shape: tuple[int, int], x_mm: np.ndarray, wall_mm: np.ndarray, how: structures.Detection, rows: list[int], lengths: list[float], n_lambda: int = 40, longest: int = 640, large: float = 3.0) -> dict[str, DataFrame]:
    """Twelve tables of one detection run, all from one written catalog: component_catalog, frame_summary, noss_pairs,
    conditional_spectra, large_scale_energy, gallery_selection, connectivity_length_distribution,
    connectivity_frame_sign_comparison, connectivity_paired_objects, connectivity_comparison_summary,
    detection_rms_profile and reference_profile.

    rows and lengths: rows and length thresholds of the conditional spectra. Paired objects are the frames and signs in
    which both connectivities find a structure.
    """
    made = detection_section(samples, shape, x_mm, wall_mm, how)
    key = ["frame_id", "sign", "component_id"]
    matched = made["windows"].where("matched").join(made["catalog"].where("connectivity = 8").select(*key, "lx_over_delta"), key)
    own = statistics.paired(samples)
    lines = own.groupBy("frame_id", "j").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "u"))), lambda p: p["u"]).alias("u"))
    spectra_table, energy = spectra.conditional_spectra(written(matched, "pairs"), lines, rows, lengths, how.dx_mm * 1e-3, how.delta99_mm * 1e-3, n_lambda, longest, large)
    compared = written(made["comparison"], "comparison")
    last = samples.agg(F.max("frame_id")).first()[0] or 1
    profile = own.groupBy("j").agg(F.avg("u").alias("u_mean"), F.count("u").alias("n")).withColumn("wall_mm", F.get(F.array(*map(F.lit, map(float, wall_mm))), F.col("j") - 1))
    return {
        "component_catalog": made["catalog"], "frame_summary": made["frames"], "noss_pairs": made["windows"], "conditional_spectra": spectra_table, "large_scale_energy": energy,
        "gallery_selection": matching.gallery(made["catalog"].where("connectivity = 8"), last), "connectivity_length_distribution": made["lengths"], "connectivity_frame_sign_comparison": compared,
        "connectivity_paired_objects": compared.where("category = 'both'"), "connectivity_comparison_summary": catalog.comparison_summary(compared), "detection_rms_profile": statistics.pooled_rms(samples), "reference_profile": profile,
    }


def write_experiment(tables: dict[str, DataFrame], path: str) -> None:
    """The catalog and the frames' summary as Parquet, all others as CSV with headers, arrays as JSON."""
    wide = ("component_catalog", "frame_summary")
    write_tables({n: tables[n] for n in wide}, f"{path}/parquet", "parquet")
    flat = lambda df: df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    write_tables({n: flat(df) for n, df in tables.items() if n not in wide}, f"{path}/csv")
