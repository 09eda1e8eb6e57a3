"""From two risk scores to one 0-100 scale with bands.

Shared by the fixed scorecard and by the fitted models, by first scoring,
rescoring, stress tests and what-ifs: there is only this one path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pdengine import fixed_values as fv
from pdengine.functions.bands import band, blend
from pdengine.operators.placed_reference import PlacedReference, place, rank_against_placed
from pdengine.operators.prefix import exact_quantiles, value_counts

META_COLS = ["borrower_id", "segment", "exposure_at_risk", "rm_note", "default", "loan_vintage_month", "split"]


def reference_distribution(train: DataFrame, gbm_col: str, cox_col: str, buckets: int | None = None) -> PlacedReference:
    """The train scores, placed for lookups."""
    return place(value_counts(train, {"gbm": gbm_col, "cox": cox_col}), buckets)


def rank_and_blend(
    rows: DataFrame, references: PlacedReference, gbm_col: str, cox_col: str, key: str = "borrower_id"
) -> DataFrame:
    """Add ``gbm_rank``, ``cox_rank`` and ``blend``; keep ``rows`` narrow, they are shuffled."""
    ranked = rank_against_placed(rows, {"gbm": gbm_col, "cox": cox_col}, references, key)
    return ranked.withColumn("blend", blend(F.col("gbm_rank"), F.col("cox_rank")))


def band_cuts(train: DataFrame, score: str = "pd_score", buckets: int | None = None) -> DataFrame:
    """One row ``(high, elevated)``: the exact 90th and 70th percentile of train scores."""
    q = exact_quantiles(train, score, [fv.HIGH_PERCENTILE, fv.ELEVATED_PERCENTILE], buckets=buckets)
    return q.select(F.col("quantiles")[0].alias("high"), F.col("quantiles")[1].alias("elevated"))


def banded(score: Column, cuts: DataFrame) -> Column:
    """Band of a score under the cuts of a one-row table."""
    return band(score, cuts.select("high").scalar(), cuts.select("elevated").scalar())
