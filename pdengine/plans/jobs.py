"""Whole jobs with their outputs on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pdengine.plans import reports, scoring
from pdengine.plans.fusion import META_COLS
from pdengine.plans.training import RiskModel, TrainingConfig, train
from pdengine.sources import store

REPORT_NOTE = "Quality is measured on loans of later vintages than those the model was fitted on; unscored loans take no part."


def quality_report(model: RiskModel, scored: DataFrame) -> DataFrame:
    """Out-of-time quality, thresholds and what drives the model, as report rows."""
    importance = model.importance(scored.sparkSession).select(
        F.lit("feature_importance").alias("metric"), F.col("feature").alias("detail"),
        F.col("importance_pct").alias("value"),
    )
    return (
        reports.performance_report(scored)
        .unionByName(reports.threshold_rows(scored.sparkSession, model.high_cut, model.elevated_cut))
        .unionByName(importance)
    )


def training_job(book: DataFrame, path: str, config: TrainingConfig = TrainingConfig()) -> RiskModel:
    """Train on a labelled book and write model, feature book, scored book and metrics under ``path``.

    The feature book is written once: training reads what is kept.
    """
    def keep(features: DataFrame) -> DataFrame:
        features.write.mode("overwrite").parquet(f"{path}/feature_book")
        return book.sparkSession.read.parquet(f"{path}/feature_book")

    return write_job(book, path, *train(book, config, keep))


def read_feature_book(spark: SparkSession, path: str) -> DataFrame:
    """Model features, key and note of the feature book that a job left under ``path``."""
    return store.read_book(spark, f"{path}/feature_book", store.FEATURE_BOOK_COLS)


def write_job(book: DataFrame, path: str, model: RiskModel, features: DataFrame, scores: DataFrame) -> RiskModel:
    """What a training leaves under ``path``, the feature book unless it is there."""
    spark = book.sparkSession
    model.save(spark, f"{path}/model")
    if not any(f"{path}/feature_book" in f for f in features.inputFiles()):
        store.write_feature_book(features, f"{path}/feature_book")
    fresh = scores.select("borrower_id", "gbm_proba", "cox_risk", "blend", "pd_score", "band")
    scored = book.select(*META_COLS).join(fresh, "borrower_id")
    scored.write.mode("overwrite").partitionBy("split").parquet(f"{path}/scores")
    written = spark.read.parquet(f"{path}/scores")
    store.write_scored_book(written, f"{path}/scored_book")
    rows = quality_report(model, written)
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/metrics_report")
    store.write_document(spark, {"note": REPORT_NOTE}, f"{path}/metrics_note")
    return model


def rescore_job(spark: SparkSession, path: str, target: str, scored_at: float) -> DataFrame:
    """Score the stored feature book again and publish the joined book at ``target``.

    Until it is complete, and if the job fails, readers of ``target`` see the
    book before. Returns one row ``(scored_at, n_scored)``.
    """
    model = RiskModel.load(spark, f"{path}/model")
    meta = store.read_book(spark, f"{path}/scored_book", META_COLS)
    book = scoring.rescore_book(model, read_feature_book(spark, path), meta)
    done = store.publish_scored_book(book, target, scored_at)
    return spark.createDataFrame([(done.published_at, done.n_rows)], "scored_at double, n_scored long")
