"""Order statistics without a global sort: prefix counts in value buckets.

Counting how much weight lies below a value needs an order over the whole
table, which a plain window would compute in one task. Here the distinct
values are cut into buckets at approximate quantiles, each bucket is counted
by its own task, and a table of bucket totals (at most ``buckets`` rows per
group) supplies what lies in the lower buckets. The result is exact wherever
the cuts fall, and equal values are merged before the shuffle, so a value held
by a third of all rows costs one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MIN_BUCKETS = 16
# A value is hot when it holds more than 1/HOT_FRACTION of all rows, so there
# are fewer than HOT_FRACTION hot values however large the table is.
HOT_FRACTION = 1000
_SALTS = 1 << 20


def bucket_count(df: DataFrame, buckets: int | None = None) -> int:
    """As many buckets as the session wants shuffle tasks."""
    wanted = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2, buckets) if buckets else max(MIN_BUCKETS, wanted)


def _cuts(order_col: str, buckets: int) -> Column:
    """Cut values, ascending."""
    shares = [i / buckets for i in range(1, buckets)]
    return F.percentile_approx(order_col, shares, max(10_000, 20 * buckets))


def _bucket(value: Column, buckets: int) -> Column:
    """Number of cuts below a value, by binary search in the array ``_cuts``."""
    steps = [1 << i for i in reversed(range(max(1, (buckets - 1).bit_length())))]
    cuts = F.col("_cuts")
    further = lambda at, step: F.when(F.try_element_at(cuts, at + step) < value, at + step).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)


def prefix_counts(
    values: DataFrame,
    order_col: str,
    weights: list[str],
    by: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``less_<w>`` (weight strictly below) and ``all_<w>`` (weight of the group).

    ``values`` holds one row per value (and per group ``by``; groups must be
    few, such as column names).
    """
    buckets = bucket_count(values, buckets)
    cuts = _cuts(order_col, buckets)
    if by is None:
        cut = values.withColumn("_cuts", values.agg(cuts).scalar())
        group = []
    else:
        group = [by]
        cut = values.join(F.broadcast(values.groupBy(by).agg(cuts.alias("_cuts"))), by)
    cut = cut.withColumn("_bucket", _bucket(F.col(order_col), buckets)).drop("_cuts")

    inside = (
        Window.partitionBy(*group, "_bucket")
        .orderBy(order_col)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    over_buckets = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_bucket")
    below = over_buckets.rowsBetween(Window.unboundedPreceding, -1)
    everything = over_buckets.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = (
        cut.groupBy(*group, "_bucket")
        .agg(*[F.sum(w).alias(f"_sum_{w}") for w in weights])
        .select(
            *group,
            "_bucket",
            *[F.coalesce(F.sum(f"_sum_{w}").over(below), F.lit(0)).alias(f"_low_{w}") for w in weights],
            *[F.sum(f"_sum_{w}").over(everything).alias(f"all_{w}") for w in weights],
        )
    )
    counted = cut.withColumns(
        {f"_in_{w}": F.coalesce(F.sum(w).over(inside), F.lit(0)) for w in weights}
    ).join(F.broadcast(totals), [*group, "_bucket"])
    return counted.withColumns(
        {f"less_{w}": F.col(f"_low_{w}") + F.col(f"_in_{w}") for w in weights}
    ).drop("_bucket", *[f"_low_{w}" for w in weights], *[f"_in_{w}" for w in weights])


def value_counts(rows: DataFrame, kinds: dict[str, str], name: str = "ref_count") -> DataFrame:
    """Distinct values with their counts, ``(kind, value, <name>)``, for several columns in one pass."""
    entries = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(c).cast("double").alias("value")) for k, c in kinds.items()
    ])
    return (
        rows.select(F.explode(entries).alias("e"))
        .select("e.*")
        .where(F.col("value").isNotNull())
        .groupBy("kind", "value")
        .agg(F.count(F.lit(1)).alias(name))
    )


def skew_safe_lookup(
    rows: DataFrame, lookup: DataFrame, row_value: str, row_key: str, out_col: str
) -> DataFrame:
    """Left join of ``lookup(value, hits, all_hits, <out_col>)`` by value.

    ``hits`` counts the rows that will look a value up, ``all_hits`` all rows.
    Hot values (fewer than HOT_FRACTION by their definition) are broadcast.
    Their rows, and rows without a value, then take part in the shuffled join
    under a salt that matches nothing, so they spread evenly over the tasks.
    """
    is_hot = F.col("hits") * HOT_FRACTION > F.col("all_hits")
    hot = lookup.where(is_hot).select(F.col("value").alias("_hv"), F.col(out_col).alias("_hot_out"))
    cold = lookup.where(~is_hot).select(
        F.col("value").alias("_cv"), F.lit(0).alias("_cs"), F.col(out_col).alias("_cold_out")
    )
    found = rows.join(F.broadcast(hot), F.col(row_value) == F.col("_hv"), "left")
    settled = F.col("_hot_out").isNotNull() | F.col(row_value).isNull()
    salted = found.withColumn(
        "_salt",
        F.when(settled, 1 + F.pmod(F.xxhash64(row_key), F.lit(_SALTS))).otherwise(0).cast("int"),
    )
    joined = salted.join(
        cold, (F.col(row_value) == F.col("_cv")) & (F.col("_salt") == F.col("_cs")), "left"
    )
    return joined.withColumn(out_col, F.coalesce("_hot_out", "_cold_out")).drop(
        "_hv", "_hot_out", "_cv", "_cs", "_cold_out", "_salt"
    )


def _quantile_terms(probability: float, n: Column) -> tuple[Column, Column, Column]:
    position = F.lit(float(probability)) * (n - 1)
    low = F.floor(position)
    return low, F.ceil(position), position - low


def exact_quantiles(
    rows: DataFrame,
    value_col: str,
    probabilities: list[float],
    by: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, in one array column ``quantiles``.

    One row in all, or one per group ``by``.
    """
    group = [by] if by else []
    counts = (
        rows.where(F.col(value_col).isNotNull())
        .groupBy(*group, F.col(value_col).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    placed = prefix_counts(counts, "value", ["n"], by=by, buckets=buckets)

    def at(index: Column) -> Column:
        inside = (F.col("less_n") <= index) & (index < F.col("less_n") + F.col("n"))
        return F.max(F.when(inside, F.col("value")))

    picks, results = [], []
    for i, p in enumerate(probabilities):
        low, high, part = _quantile_terms(p, F.col("all_n"))
        picks += [at(low).alias(f"_low{i}"), at(high).alias(f"_high{i}"), F.max(part).alias(f"_part{i}")]
        step = F.col(f"_high{i}") - F.col(f"_low{i}")
        results.append(F.col(f"_low{i}") + step * F.col(f"_part{i}"))
    picked = placed.groupBy(*group).agg(*picks) if group else placed.agg(*picks)
    return picked.select(*group, F.array(*results).alias("quantiles"))

