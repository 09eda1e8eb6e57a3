"""Tables and artifacts on shared storage."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from pdengine import fixed_values as fv
from pdengine.sources.published import Version, folder_of, publish

SCORED_BOOK_COLS = [
    "segment", "exposure_at_risk", "rm_note", "default", "loan_vintage_month",
    "borrower_id", "pd_score", "split", "band",
]


def write_splits(book: DataFrame, path: str) -> None:
    """Full book in one table; reading one split opens only that split's files."""
    book.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    book = spark.read.parquet(path)
    return book.where(F.col("split") == split) if split else book


def write_scored_book(scored: DataFrame, path: str) -> None:
    """Sorted inside each file, so that watchlist filters skip row groups; no shuffle."""
    rows = scored.select(*SCORED_BOOK_COLS).sortWithinPartitions("split", "segment", "band")
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def publish_scored_book(scored: DataFrame, root: str, scored_at: float) -> Version:
    """Replace a scored book as a whole; readers of the old one are not disturbed."""
    return publish(scored, root, scored_at, write_scored_book)


FEATURE_BOOK_COLS = [*fv.MODEL_FEATURES, "borrower_id", "rm_note"]


def write_feature_book(
    features: DataFrame, path: str, table: str | None = None, buckets: int | None = None
) -> None:
    """Model features by loan; bucketed by loan, later joins on the key need no shuffle."""
    wanted = features.select(*FEATURE_BOOK_COLS)
    writer = wanted.write.mode("overwrite")
    if table and buckets:
        writer.option("path", path).bucketBy(buckets, "borrower_id").sortBy("borrower_id").saveAsTable(table)
    else:
        writer.parquet(path)


def read_book(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A stored book; the current version of a published one."""
    book = spark.read.parquet(folder_of(spark, path))
    return book.select(*columns) if columns else book


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """A small JSON document (configuration, metrics) on the same storage as the tables."""
    spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)
