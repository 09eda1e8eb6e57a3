"""Finding loans by key for tables of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pdengine.operators.prefix import skew_safe_lookup


def found(book: DataFrame, ids: DataFrame, key: str = "borrower_id") -> DataFrame:
    """Loans named in ``ids``."""
    return book.join(ids.select(key).distinct(), key, "left_semi")


def missing(ids: DataFrame, book: DataFrame, key: str = "borrower_id") -> DataFrame:
    """Requests whose loan is not in the book.

    Ids are made distinct before the join; those named by very many requests are broadcast.
    """
    named = ids.groupBy(key).agg(F.count(F.lit(1)).alias("hits")).join(book.select(key), key, "left_anti")
    lookup = named.select(
        F.col(key).alias("value"), "hits", F.lit(True).alias("_absent"), ids.agg(F.count(F.lit(1))).scalar().alias("all_hits")
    )
    return skew_safe_lookup(ids, lookup, key, ids.columns[0], "_absent").where("_absent").select(*ids.columns)


def attach(requests: DataFrame, book: DataFrame, request_id: str, key: str = "borrower_id") -> DataFrame:
    """Each request with the columns of its loan; many requests may name one loan.

    Requests are counted per loan first, so the few loans that many requests
    name are broadcast and the rest is joined by shuffle.
    """
    named = requests.groupBy(key).agg(F.count(F.lit(1)).alias("hits"))
    columns = [c for c in book.columns if c != key]
    lookup = (
        named.join(book, key)
        .withColumn("all_hits", requests.agg(F.count(F.lit(1))).scalar())
        .select(F.col(key).alias("value"), "hits", "all_hits", F.struct(*columns).alias("_loan"))
    )
    joined = skew_safe_lookup(requests, lookup, key, request_id, "_loan")
    return joined.where(F.col("_loan").isNotNull()).select(*requests.columns, "_loan.*")
