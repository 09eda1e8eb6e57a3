"""An ordered list stored so that any page of it opens a few files.

The list is range-sorted by value and key and written in parts, a folder each.
Beside it stands, per part and combination of filter values, how many rows it
holds. A page adds up the counts of the parts before it and reads only the
parts that it reaches into.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_list(rows: DataFrame, path: str, value: str, key: str, filters: list[str], parts: int | None = None) -> None:
    """Store ``rows`` largest value first, ties in key order, rows without a value last."""
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(value).desc_nulls_last(), F.col(key)]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ranged.write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    stored.groupBy("part", *filters).agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")


def list_page(
    spark: SparkSession, path: str, value: str, key: str, limit: int, offset: int, **wanted: str | None
) -> DataFrame:
    """Rows ``offset .. offset + limit`` of the stored list, or of its rows with the given filter values.

    Every row carries ``total``, the length of that list.
    """
    match = F.lit(True)
    for name, only in wanted.items():
        if only:
            match = match & (F.col(name) == only)
    counts = spark.read.parquet(f"{path}/counts").where(match)
    sizes = sorted(tuple(r) for r in counts.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row per part
    total = sum(n for _, n in sizes)
    reached, passed = [], 0
    before = 0
    for part, n in sizes:
        if passed < offset + limit and passed + n > offset:
            if not reached:
                before = passed
            reached.append(part)
        passed += n
    rows = spark.read.parquet(f"{path}/rows").where(F.col("part").isin(reached) if reached else F.lit(False)).where(match)
    order = [F.col(value).desc_nulls_last(), F.col(key)]
    page = rows.drop("part").orderBy(*order).offset(max(offset - before, 0)).limit(limit)
    return page.withColumn("total", F.lit(total).cast("long"))
