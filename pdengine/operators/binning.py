"""Quantile bins."""

from pyspark.sql import DataFrame, functions as F


def with_quantile_bin(rows: DataFrame, value_col: str, edges: DataFrame, out_col: str) -> DataFrame:
    """Add the bin number of a value among quantile edges, right-closed, duplicate edges merged.

    ``edges`` is the one-row result of ``exact_quantiles``. The two outer edges
    do not separate anything, so the bin is the count of inner edges below.
    """
    distinct = F.array_distinct("quantiles")
    inner = edges.select(F.slice(distinct, F.lit(2), F.greatest(F.size(distinct) - 2, F.lit(0)))).scalar()
    value = F.col(value_col)
    return (
        rows.withColumn("_inner", inner)
        .withColumn(
            out_col, F.when(value.isNotNull(), F.size(F.filter("_inner", lambda edge: edge < value)))
        )
        .drop("_inner")
    )
