"""Request tables derived from the source tables, one request per source row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pdengine.functions.hashing import hash_uniform
from pdengine.sources.loan_book import loan_book, table
from pdengine.sources.note_templates import NEUTRAL


def applications(spark: SparkSession, folder: str) -> DataFrame:
    """One application per customer; some leave fields out, break the input rules or name no known segment."""
    b = F.col("c_custkey")
    histories = ["clean", "minor_delay", "moderate_delay", "severe_delinquency", "unknown"]
    history = F.element_at(F.array(*[F.lit(h) for h in histories]), (b % 5 + 1).cast("int"))
    note = F.element_at(
        F.array(*[F.lit(t) for t in NEUTRAL]), (b % len(NEUTRAL) + 1).cast("int")
    )
    balance = F.col("c_acctbal").cast("decimal(12,2)")
    return table(spark, folder, "customer").select(
        b.alias("application_id"),
        (balance * 40).cast("double").alias("loan_amount"),
        F.when(b % 11 > 0, (15 + (b % 90) * 31 % 90).cast("int")).alias("age"),
        F.when(b % 13 > 0, ((b % 400) * 7 % 400).cast("int")).alias("tenure_months"),
        F.when(b % 3 > 0, (F.abs(balance) * 200).cast("double")).alias("annual_income"),
        (F.abs(balance) * (1 + b % 7).cast("int")).cast("double").alias("existing_emi"),
        ((b % 320) * 13 % 320).cast("double").alias("credit_utilization_pct"),
        F.when(b % 17 > 0, history).alias("repayment_history"),
        F.when(b % 4 == 0, F.lit(""))
        .when(b % 4 == 1, F.lit("SME"))
        .when(b % 4 == 2, F.lit("Agri"))
        .otherwise(F.col("c_mktsegment"))
        .alias("segment"),
        F.when(b % 6 > 0, note).alias("rm_note"),
    )


def what_if_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One restructuring request per loan, in five kinds."""
    b = F.col("borrower_id")
    kind = b % 5
    draw = hash_uniform(b, 3571)
    return loan_book(spark, folder).select(
        b.alias("request_id"),
        b,
        F.when(kind.isin(0, 1, 4), F.floor(draw * 61).cast("double")).alias("new_rate_pct"),
        F.when(kind.isin(0, 2), (1 + F.floor(draw * 360)).cast("int")).alias("new_tenure_months"),
        F.when(kind.isin(2, 3), F.round(F.col("LIMIT_BAL") * (draw + 0.1), 2)).alias("new_principal"),
        F.when(kind == 4, F.round(F.col("LIMIT_BAL") * draw / 10, 2)).alias("new_emi"),
    )


def unchecked_what_ifs(spark: SparkSession, folder: str) -> DataFrame:
    """One request per customer, with or without a loan; some break the rules."""
    b = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        b.alias("request_id"), b.alias("borrower_id"),
        F.when(b % 3 > 0, (b % 90).cast("double")).alias("new_rate_pct"),
        F.when(b % 4 > 0, (b % 400).cast("int")).alias("new_tenure_months"),
        F.when(b % 5 > 0, F.col("c_acctbal").cast("double")).alias("new_principal"),
        F.lit(None).cast("double").alias("new_emi"),
    )


def requested_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Customers that ever ordered; those with fewer than six orders are not in the book."""
    return table(spark, folder, "orders").select(F.col("o_custkey").alias("borrower_id")).distinct()
