"""Z-scores and per-column statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def column_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row ``mean_<c>``, ``std_<c>``; a constant column gets a standard deviation of 1."""
    stats = []
    for c in columns:
        std = F.stddev_samp(c)
        stats += [F.avg(c).alias(f"mean_{c}"), F.when(std == 0, 1.0).otherwise(std).alias(f"std_{c}")]
    return rows.agg(*stats)


def zscore(rows: DataFrame, columns: list[str], stats: DataFrame | dict[str, float]) -> DataFrame:
    """Add ``z_<c>``; ``stats`` is the one-row table of ``column_stats`` or its saved numbers."""
    if isinstance(stats, dict):
        return rows.withColumns({
            f"z_{c}": (F.col(c) - F.lit(stats[f"mean_{c}"])) / F.lit(stats[f"std_{c}"]) for c in columns
        })
    with_stats = rows.withColumn("_stats", stats.select(F.struct("*")).scalar())
    return with_stats.withColumns({
        f"z_{c}": (F.col(c) - F.col(f"_stats.mean_{c}")) / F.col(f"_stats.std_{c}") for c in columns
    }).drop("_stats")
