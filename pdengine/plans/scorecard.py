"""A fixed scorecard: column arithmetic in the place of the fitted models.

It lets ranking, calibration bands, metrics, stress tests and reports be
checked to the last digit, because any SQL engine can repeat it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pdengine.operators.placed_reference import PlacedReference
from pdengine.operators.reasons import contribution, top_contributions
from pdengine.plans.fusion import META_COLS, band_cuts, banded, rank_and_blend, reference_distribution
from pdengine.sources import store
from pdengine.sources.loan_book import loan_book
from pdengine.sources.published import current
from pdengine.staging import stage, stage_artifact

BASE_HAZARD = 0.3
COX_BETA = {"months_delinquent": 0.25, "delinquency_trend": 0.15}
GBM_BETA = {
    "months_delinquent": 0.5,
    "max_delinquency": 0.2,
    "avg_util_ratio": 0.8,
    "avg_pay_ratio": -0.6,
}


def with_scores(features: DataFrame) -> DataFrame:
    margin = F.lit(2.0)
    for name, weight in GBM_BETA.items():
        margin = margin - F.lit(weight) * F.col(name)
    hazard = sum((F.lit(w) * F.col(n) for n, w in COX_BETA.items()), F.lit(0.0))
    return features.withColumns({
        "frozen_gbm": F.round(1 / (1 + F.exp(margin)), 6),
        "frozen_cox": F.round(1 - F.exp(-F.lit(BASE_HAZARD) * F.exp(hazard)), 6),
    })


def fuse(scores: DataFrame, references: PlacedReference) -> DataFrame:
    fused = rank_and_blend(scores, references, "frozen_gbm", "frozen_cox")
    return fused.withColumn("pd_score", F.round(100 * F.col("blend"), 4))


def raw_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Both scores of every loan, straight from the staged book."""
    return with_scores(loan_book(spark, folder)).select(
        "borrower_id", "split", "default", "frozen_gbm", "frozen_cox"
    )


def references(spark: SparkSession, folder: str) -> PlacedReference:
    def build():
        train = raw_scores(spark, folder).where(F.col("split") == "train")
        return reference_distribution(train, "frozen_gbm", "frozen_cox")

    path = stage_artifact(spark, f"scorecard-references:{folder}", lambda p: build().save(p))
    return PlacedReference.load(spark, path)


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Fused scores of every loan, one narrow row each."""
    return stage(
        spark,
        f"scorecard-scores:{folder}",
        lambda: fuse(raw_scores(spark, folder), references(spark, folder)),
    )


def cuts(spark: SparkSession, folder: str) -> DataFrame:
    return stage(
        spark,
        f"scorecard-cuts:{folder}",
        lambda: band_cuts(scores(spark, folder).where(F.col("split") == "train")),
    )


def join_scores(meta: DataFrame, fused: DataFrame) -> DataFrame:
    """Book metadata with fresh scores; a loan without a score keeps its row."""
    return meta.join(fused, "borrower_id", "left")


def scored_book(spark: SparkSession, folder: str) -> DataFrame:
    def build():
        fresh = scores(spark, folder).select("borrower_id", "pd_score")
        joined = join_scores(loan_book(spark, folder).select(*META_COLS), fresh)
        return joined.withColumn("band", banded(F.col("pd_score"), cuts(spark, folder)))

    return stage(spark, f"scorecard-book:{folder}", build)


def published_book(spark: SparkSession, folder: str, scored_at: float) -> tuple[DataFrame, float]:
    """The scored book as its readers see it, and when it was scored: published once, read through its manifest."""
    root = stage_artifact(
        spark, f"scorecard-published:{folder}", lambda p: store.publish_scored_book(scored_book(spark, folder), p, scored_at)
    )
    return store.read_book(spark, root), current(spark, root).published_at


def top_reasons(features: DataFrame, k: int = 4) -> DataFrame:
    """Add ``top``: the k strongest scorecard terms of each loan."""
    terms = F.array(
        *[contribution(n, F.col(n), None, F.lit(w) * F.col(n)) for n, w in GBM_BETA.items()]
    )
    return features.withColumn("top", top_contributions(terms, k))
