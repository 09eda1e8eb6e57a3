"""Pages of an ordered list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pdengine.operators.prefix import prefix_counts

# Up to this row each task keeps its own first rows; beyond it positions are counted.
SHALLOW = 10_000


def page(
    rows: DataFrame, value: str, key: str, limit: int, offset: int,
    shallow: int = SHALLOW, buckets: int | None = None,
) -> DataFrame:
    """Rows ``offset .. offset + limit`` by value, largest first, ties in key order, rows without a value last.

    Both ways give the same rows; they differ in cost only.
    """
    order = [F.col(value).desc_nulls_last(), F.col(key)]
    if offset + limit <= shallow:
        return rows.orderBy(*order).offset(offset).limit(limit)
    return _deep_page(rows, value, key, limit, offset, buckets).orderBy(*order)


def _deep_page(rows, value, key, limit, offset, buckets):
    """Positions by prefix counts: first of the values, then of the keys within them.

    At most ``limit`` distinct values reach into the page, so the second count
    has at most that many groups, and only their rows are looked at.
    """
    counts = rows.groupBy(F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("n"))
    valued = counts.where(F.col("_value").isNotNull())
    above = F.col("all_n") - F.col("less_n") - F.col("n")
    lacking = counts.where(F.col("_value").isNull()).select(
        "_value", "n", F.coalesce(valued.agg(F.sum("n")).scalar(), F.lit(0)).alias("_above")
    )
    reached = (
        prefix_counts(valued, "_value", ["n"], buckets=buckets)
        .select("_value", "n", above.alias("_above"))
        .unionByName(lacking)
        .where((F.col("_above") < offset + limit) & (F.col("_above") + F.col("n") > offset))
        .select("_value", "_above")
    )
    inside = rows.join(F.broadcast(reached), F.col(value).eqNullSafe(F.col("_value")))
    placed = prefix_counts(
        inside.withColumn("_one", F.lit(1).cast("long")), key, ["_one"], by="_above", buckets=buckets
    )
    position = F.col("_above") + F.col("less__one")
    return placed.where((position >= offset) & (position < offset + limit)).select(*rows.columns)
