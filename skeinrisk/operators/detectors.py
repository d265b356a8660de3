"""Anomaly detectors on a return series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio

CUSUM_K, CUSUM_H, Z_LIMIT = 0.5, 5.0, 3.0


def z_scores(returns: DataFrame, window: int = 60, least: int = 20) -> DataFrame:
    """Adds z: the return against mean and deviation of the last ``window`` rows, itself included; null below ``least`` rows."""
    frame = Window.partitionBy("ticker").orderBy("dt").rowsBetween(1 - window, 0)
    z = ratio(F.col("r") - F.avg("r").over(frame), F.nullif(F.stddev_samp("r").over(frame), F.lit(0.0)))
    return returns.withColumn("z", F.when(F.count("r").over(frame) >= least, z))


def cusum(scored: DataFrame, k: float = CUSUM_K) -> DataFrame:
    """Adds cusum_pos and cusum_neg, Page's two sums of z; they hold where z is null and don't restart after an alarm.

    A reflected walk: the running sum less its running minimum (maximum for the lower one), where that is beyond 0.
    """
    order = Window.partitionBy("ticker").orderBy("dt")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    counts = F.col("z").isNotNull() & (F.row_number().over(order) > 1)
    out = scored.withColumn("up", F.sum(F.when(counts, F.col("z") - k).otherwise(0.0)).over(run)).withColumn("down", F.sum(F.when(counts, F.col("z") + k).otherwise(0.0)).over(run))
    out = out.withColumn("cusum_pos", F.col("up") - F.least(F.lit(0.0), F.min("up").over(run)))
    return out.withColumn("cusum_neg", F.col("down") - F.greatest(F.lit(0.0), F.max("down").over(run))).drop("up", "down")


def flags(scored: DataFrame, residual: str | None = None) -> DataFrame:
    """Adds detectors, the names of those that fire; ``residual``: a column of standardised GARCH residuals, if there is one."""
    fired = [F.when(F.abs("z") >= Z_LIMIT, F.lit("zscore")), F.when((F.col("cusum_pos") >= CUSUM_H) | (F.col("cusum_neg") <= -CUSUM_H), F.lit("cusum"))]
    if residual:
        fired.append(F.when(F.abs(residual) >= Z_LIMIT, F.lit("garch")))
    return scored.withColumn("detectors", F.array_compact(F.array(*fired)))


def recent_anomalies(flagged: DataFrame, n: int = 15) -> DataFrame:
    """Each ticker's last ``n`` rows that a detector flags."""
    newest = Window.partitionBy("ticker").orderBy(F.desc("dt"))
    return flagged.where(F.size("detectors") > 0).withColumn("k", F.row_number().over(newest)).where(F.col("k") <= n)
