"""First look at a book: rates, distributions, correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pdengine import fixed_values as fv
from pdengine.operators.prefix import exact_quantiles


def _one_row_to_rows(row: DataFrame, names: list[str], measures: list[str], key: str) -> DataFrame:
    """Turn one wide row ``<measure>_<name>`` into one row per name."""
    entries = F.array(*[
        F.struct(F.lit(n).alias(key), *[F.col(f"{m}_{n}").cast("double").alias(m) for m in measures])
        for n in names
    ])
    return row.select(F.explode(entries).alias("entry")).select("entry.*")


def default_rate(book: DataFrame, by: str | None = None) -> DataFrame:
    measures = [
        F.count(F.lit(1)).alias("n_loans"),
        F.sum("default").alias("n_defaults"),
        F.avg("default").alias("default_rate"),
    ]
    return book.groupBy(by).agg(*measures) if by else book.agg(*measures)


def describe(book: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of each column.

    Moments come from one pass without a shuffle of rows. Exact quartiles need
    the distinct values of every column in order and go through the bucketed
    prefix counts; ``approximate=True`` stays within the single pass.
    """
    aggregates = []
    for c in columns:
        aggregates += [
            F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}"),
            F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"),
        ]
    measures = ["n", "mean", "std", "min", "max"]
    quarters = [0.25, 0.5, 0.75]
    names = ["q25", "q50", "q75"]
    if approximate:
        for c in columns:
            cuts = F.percentile_approx(c, quarters, 10000)
            aggregates += [cuts[i].alias(f"{q}_{c}") for i, q in enumerate(names)]
        return _one_row_to_rows(book.agg(*aggregates), columns, measures + names, "feature")
    moments = _one_row_to_rows(book.agg(*aggregates), columns, measures, "feature")
    long = book.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "feature", "value"
    )
    quartiles = exact_quantiles(long, "value", quarters, by="feature").select(
        "feature", *[F.col("quantiles")[i].alias(q) for i, q in enumerate(names)]
    )
    return moments.join(F.broadcast(quartiles), "feature")


def correlation_with_default(book: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each column, and of the label itself, with the label; one pass."""
    names = columns + ["default"]
    row = book.agg(*[F.corr(F.col(c).cast("double"), F.col("default").cast("double")).alias(f"corr_{c}") for c in names])
    return _one_row_to_rows(row, names, ["corr"], "feature").orderBy(F.col("corr").desc(), "feature")


def value_shares(book: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows per value of each column; all columns in one aggregation."""
    long = book.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "column_name", "value"
    )
    counted = long.where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = counted.groupBy("column_name").agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(totals), "column_name").select(
        "column_name", "value", "n", (F.col("n") / F.col("total")).alias("share")
    )


def category_modes(book: DataFrame, columns: list[str] = fv.CATEGORICAL_FEATURES) -> DataFrame:
    """Most frequent value per column, the lowest on a tie; one wide row."""
    return book.agg(*[F.mode(c, True).alias(c) for c in columns])
