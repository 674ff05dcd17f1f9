"""The phase clock: frames of a periodically forced flow by phase, bin and cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign_phase(frames: DataFrame, fs: float, f0: float, n_bins: int, offset_deg: float | None = None) -> DataFrame:
    """frames (with frame_id, from 1) plus phase_deg, bin (from 1), cycle and mechanical_deg (NULL without an offset).

    The bin is that of the nearest centre k 360 / n_bins on the circle, the first of equally near ones. The cycle
    length fs / f0 counts as whole where it is within rounding of a whole number.
    """
    width, length = 360.0 / n_bins, fs / f0
    if abs(length - round(length)) <= 64 * 2.220446049250313e-16 * max(1.0, length):
        length = float(round(length))
    phase = F.pmod((F.col("frame_id") - 1) * F.lit(360.0 * f0 / fs), F.lit(360.0))
    out = frames.withColumn("phase_deg", phase)
    steps = F.col("phase_deg") / width
    nearest = F.when(steps >= n_bins - 0.5, F.lit(0)).otherwise(F.ceil(steps - 0.5))
    cycle = F.floor((F.col("frame_id") - 1) / F.lit(length)) + 1
    mechanical = F.lit(None).cast("double") if offset_deg is None else F.pmod(F.col("phase_deg") + offset_deg, F.lit(360.0))
    return out.withColumn("bin", (nearest + 1).cast("int")).withColumn("cycle", cycle.cast("long")).withColumn("mechanical_deg", mechanical)
