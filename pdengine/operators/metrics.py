"""Ranking quality of a score: AUC, Gini, KS and recall in the top share.

All of them are sums over distinct scores, so rows are first merged per score.
Rows without a score take no part; ``n_unscored`` counts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pdengine.operators.prefix import prefix_counts
from pdengine.staging import materialise


def _per_score(scored: DataFrame, score: str, label: str) -> DataFrame:
    return scored.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum(1 - F.col(label).cast("long")).alias("neg"),
    )


def placed_scores(scored: DataFrame, score: str, label: str, buckets: int | None = None) -> DataFrame:
    """Distinct scores with their positives and negatives, those below, and all; written once for all figures."""
    return materialise(prefix_counts(_per_score(scored, score, label), "score", ["pos", "neg"], buckets=buckets))


def ranking_metrics(
    scored: DataFrame, score: str, label: str, buckets: int | None = None, placed: DataFrame | None = None
) -> DataFrame:
    """One row ``(auc, gini, ks_statistic, n_rows, n_positive, n_unscored)``; ties count half."""
    placed = placed_scores(scored, score, label, buckets) if placed is None else placed
    won = F.sum(F.col("pos") * (F.col("less_neg") + F.col("neg") / 2))
    gap = F.abs(
        F.col("less_neg") / F.nullif("all_neg", F.lit(0)) - F.col("less_pos") / F.nullif("all_pos", F.lit(0))
    )
    summed = placed.agg(
        won.alias("won"),
        F.max(gap).alias("ks_statistic"),
        F.max("all_pos").alias("n_positive"),
        F.max("all_neg").alias("n_negative"),
    )
    pairs = F.col("n_positive").cast("double") * F.col("n_negative")
    return summed.withColumn("auc", F.col("won") / F.nullif(pairs, F.lit(0.0))).select(
        "auc",
        (2 * F.col("auc") - 1).alias("gini"),
        "ks_statistic",
        (F.col("n_positive") + F.col("n_negative")).alias("n_rows"),
        "n_positive",
        scored.agg(F.count(F.when(F.col(score).isNull(), 1))).scalar().alias("n_unscored"),
    )


def recall_at_top(
    scored: DataFrame,
    score: str,
    label: str,
    key: str = "borrower_id",
    share: float = 0.2,
    buckets: int | None = None,
    placed: DataFrame | None = None,
) -> DataFrame:
    """Share of positives among the top ``share`` of rows, ties in key order.

    Rows above the boundary score count whole. Of the rows tied on it, which
    may be very many, the first by key are found with prefix counts again.
    """
    scored = scored.where(F.col(score).isNotNull())
    placed = placed_scores(scored, score, label, buckets) if placed is None else placed
    n, all_n = F.col("pos") + F.col("neg"), F.col("all_pos") + F.col("all_neg")
    above_n = all_n - F.col("less_pos") - F.col("less_neg") - n
    boundary = materialise(
        placed
        .withColumn("k", F.greatest(F.lit(1), F.floor(all_n * F.lit(share))))
        .where((above_n < F.col("k")) & (F.col("k") <= above_n + n))
        .select(
            F.col("score").alias("cut"),
            "k",
            (F.col("k") - above_n).alias("take"),
            (F.col("all_pos") - F.col("less_pos") - F.col("pos")).alias("above_pos"),
            F.col("all_pos").alias("n_positive"),
        )
    )
    # The boundary is one row: its join keeps the tied rows only.
    tied = scored.join(F.broadcast(boundary.select("cut", "take")), F.col(score) == F.col("cut")).select(
        key, label, "take", F.lit(1).cast("long").alias("one")
    )
    chosen = prefix_counts(tied, key, ["one"], buckets=buckets).where(F.col("less_one") < F.col("take"))
    hit = F.col("above_pos") + chosen.agg(F.coalesce(F.sum(label), F.lit(0))).scalar()
    return boundary.select(
        F.col("k").alias("n_top"),
        hit.alias("hits"),
        F.coalesce(hit / F.nullif("n_positive", F.lit(0)), F.lit(0.0)).alias("recall"),
    )
