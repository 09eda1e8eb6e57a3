"""A reference distribution stored for lookups.

Placing a reference sorts it once: its distinct values are cut into buckets,
and each value is stored with the number of reference rows up to it. A small
index keeps the cuts and what lies below every bucket. Scoring then puts the
distinct request values into the stored cuts, reads the buckets they fall into
and takes the last reference value below them inside the bucket, so its cost
follows the requests.

A reference of at most ``PACKED`` distinct values is also packed, once, as
sorted arrays with cumulative counts; whatever is ranked against it is placed
by binary search in the task that holds it, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pdengine.operators.prefix import _bucket, _cuts, bucket_count, skew_safe_lookup, value_counts
from pdengine.staging import materialise


#: Distinct values, 16 bytes each, up to which a reference is sent to the tasks.
PACKED = 1 << 21


@dataclass
class PlacedReference:
    """``index(kind, _cuts, bases, total)``, one row per kind; ``values(kind, bucket, value, upto)``."""

    index: DataFrame
    values: DataFrame
    buckets: int
    _packed: Broadcast | None = field(default=None, repr=False)
    _size: int | None = field(default=None, repr=False)

    def packed(self) -> Broadcast | None:
        """Per kind: sorted values, reference rows below each and above the last, all rows. None for larger references."""
        if self._size is None:
            self._size = self.values.count()
            if self._size <= PACKED:
                table = self.values.select("kind", "value", "upto").toPandas().sort_values(["kind", "value"])
                kinds = {k: (t.value.to_numpy(), np.concatenate([[0], t.upto.to_numpy()])) for k, t in table.groupby("kind")}
                self._packed = self.values.sparkSession.sparkContext.broadcast(kinds)
        return self._packed

    def save(self, path: str) -> None:
        self.index.withColumn("buckets", F.lit(self.buckets)).write.mode("overwrite").parquet(f"{path}/index")
        dealt = self.values.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "value")
        dealt.write.mode("overwrite").partitionBy("kind", "bucket").parquet(f"{path}/values")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "PlacedReference":
        index = spark.read.parquet(f"{path}/index")
        values = spark.read.schema("value double, upto long, kind string, bucket int").parquet(f"{path}/values")
        first = index.select("buckets").first()
        return cls(index.drop("buckets"), values, first["buckets"] if first else 2)


def place(references: DataFrame, buckets: int | None = None) -> PlacedReference:
    """Place distinct values with their counts, ``(kind, value, ref_count)``."""
    buckets = bucket_count(references, buckets)
    by_kind = Window.partitionBy("kind")
    references = references.select("kind", F.col("value").cast("double").alias("value"), "ref_count")
    # Approximate cuts may differ between runs, so they are fixed before anything is put into them.
    cuts = materialise(references.groupBy("kind").agg(_cuts("value", buckets).alias("_cuts"), F.sum("ref_count").alias("total")))
    cut = references.join(F.broadcast(cuts), "kind").withColumn("bucket", _bucket(F.col("value"), buckets).cast("int"))
    held = cut.groupBy("kind", "bucket").agg(F.sum("ref_count").alias("n"))
    below = by_kind.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        cuts.select("kind", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
        .join(held, ["kind", "bucket"], "left")
        .withColumn("base", F.coalesce(F.sum("n").over(below), F.lit(0)))
        .groupBy("kind")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "base"))), lambda b: b["base"]).alias("bases"))
    )
    index = materialise(cuts.join(bases, "kind"))
    inside = Window.partitionBy("kind", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = cut.withColumn("inside", F.sum("ref_count").over(inside)).join(
        F.broadcast(index.select("kind", "bases")), "kind"
    )
    upto = (F.col("inside") + F.element_at("bases", F.col("bucket") + 1)).cast("long")
    return PlacedReference(index, materialise(values.select("kind", "bucket", "value", upto.alias("upto"))), buckets)


def reached(reference: PlacedReference, asked: DataFrame) -> DataFrame:
    """Reference values in the buckets that ``asked(kind, bucket)`` names; a stored reference reads no other folder.

    The names are at most one per kind and bucket, whatever is asked.
    """
    named: dict[str, list[int]] = {}
    for r in asked.where(F.col("bucket").isNotNull()).select("kind", "bucket").distinct().collect():
        named.setdefault(r["kind"], []).append(r["bucket"])
    inside = [(F.col("kind") == k) & F.col("bucket").isin(sorted(b)) for k, b in sorted(named.items())]
    return reference.values.where(reduce(or_, inside, F.lit(False)))


def _rank(packed: Broadcast, kind: str, value: Column) -> Column:
    """Rank of a value by binary search in a packed reference; null for null."""

    @F.pandas_udf("double")
    def place(values: pd.Series) -> pd.Series:
        sorted_values, below = packed.value[kind]
        last = below[-1] - 1
        found = np.minimum(below[np.searchsorted(sorted_values, values.to_numpy(), "left")], last)
        return pd.Series(found / last if last > 0 else np.zeros(len(values)))

    return F.when(value.isNotNull(), place(value.cast("double")))


def rank_against_placed(
    rows: DataFrame, kinds: dict[str, str], reference: PlacedReference, key: str = "borrower_id"
) -> DataFrame:
    """Add ``<kind>_rank``: the share of the reference strictly below the value, in [0, 1].

    ``kinds`` names the column of each kind. Ranking against a packed reference
    adds columns and nothing else. For a larger one keep ``rows`` narrow: they
    are read twice and shuffled once per kind.
    """
    if (packed := reference.packed()) is not None:
        return rows.withColumns({f"{kind}_rank": _rank(packed, kind, F.col(column)) for kind, column in kinds.items()})
    asked = materialise(
        value_counts(rows, kinds, "hits")
        .join(F.broadcast(reference.index), "kind", "left")
        .withColumn("bucket", _bucket(F.col("value"), reference.buckets).cast("int"))
        .withColumn("base", F.element_at("bases", F.col("bucket") + 1))
        .select("kind", "bucket", "value", "hits", "base", "total")
    )
    read = reached(reference, asked)
    one = asked.withColumns({"upto": F.lit(None).cast("long"), "given": F.lit(False)})
    two = read.select(
        "kind", "bucket", "value", *[F.lit(None).cast("long").alias(c) for c in ("hits", "base", "total")],
        "upto", F.lit(True).alias("given"),
    )
    before = Window.partitionBy("kind", "bucket").orderBy("value", "given").rowsBetween(Window.unboundedPreceding, -1)
    last = F.col("total") - 1
    share = F.least(F.coalesce(F.col("below"), F.col("base")), last) / F.nullif(last, F.lit(0))
    placed = (
        one.unionByName(two)
        .withColumn("below", F.last("upto", ignorenulls=True).over(before))
        .where(~F.col("given"))
        .select("kind", "value", "hits", F.coalesce(share, F.lit(0.0)).alias("rank"))
    )
    lookup = materialise(placed)
    # One small sum per kind.
    lookup = lookup.join(F.broadcast(lookup.groupBy("kind").agg(F.sum("hits").alias("all_hits"))), "kind")
    for kind, column in kinds.items():
        of_kind = lookup.where(F.col("kind") == kind).withColumnRenamed("rank", f"{kind}_rank")
        rows = skew_safe_lookup(rows, of_kind, column, key, f"{kind}_rank")
    return rows


def rank_against_reference(
    rows: DataFrame, kinds: dict[str, str], references: DataFrame, key: str = "borrower_id", buckets: int | None = None
) -> DataFrame:
    """Place a reference and rank against it at once."""
    return rank_against_placed(rows, kinds, place(references, buckets), key)
