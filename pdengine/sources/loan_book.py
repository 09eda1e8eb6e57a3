"""Loan book derived from customers, their orders and the order lines.

A borrower is a customer with at least six orders. The latest six orders are
the six cycles: an order's value is the bill, the value of its shipped lines
the payment, and its returned lines the repayment status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pdengine import fixed_values as fv
from pdengine.functions.features import (
    duration,
    exposure_at_risk,
    months_delinquent,
    recode_categories,
    with_features,
)
from pdengine.functions.hashing import hash_uniform
from pdengine.operators.binning import with_quantile_bin
from pdengine.operators.prefix import exact_quantiles
from pdengine.sources.accounts import normalise_accounts
from pdengine.sources.note_templates import NEGATIVE, NEUTRAL, POSITIVE
from pdengine.staging import stage

_LIMIT_STEP = 50_000
_UNITS = 10_000.0
_DEFAULT_THRESHOLD = 1.05


def _latest_orders(orders: DataFrame) -> DataFrame:
    """Six latest orders per customer.

    Filtering a row number by a constant lets Spark drop all but six orders of
    a customer in every input partition before the shuffle, so a customer with
    a large share of all orders sends only six rows per partition.
    """
    latest_first = Window.partitionBy("o_custkey").orderBy(
        F.col("o_orderdate").desc(), F.col("o_orderkey").desc()
    )
    return (
        orders.select("o_custkey", "o_orderkey", "o_orderdate")
        .withColumn("cycle", F.row_number().over(latest_first))
        .where(F.col("cycle") <= len(fv.CYCLES))
        .select("o_custkey", "o_orderkey", "cycle")
    )


def _hundredths(amount: Column) -> Column:
    return F.floor(amount * 100 + 0.5)


def _order_totals(lines: DataFrame) -> DataFrame:
    """One row per order, pre-aggregated before the shuffle.

    Prices and discounts have two decimals, so line amounts are whole numbers
    of 1/10000: sums of longs are exact in any order and stay primitive.
    """
    amount = _hundredths(F.col("l_extendedprice")) * (100 - _hundredths(F.col("l_discount")))
    paid = F.when(F.col("l_linestatus") == "F", amount).otherwise(0)
    returned = F.when(F.col("l_returnflag") == "R", F.lit(1))
    return lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        (F.sum(amount) / _UNITS).alias("bill"),
        (F.sum(paid) / _UNITS).alias("paid"),
        F.count(returned).alias("returned"),
    )


def raw_accounts(customer: DataFrame, orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Accounts in the layout of the raw file (``ID``, ``PAY_0``, long label name)."""
    cycles = _latest_orders(orders).join(_order_totals(lines), "o_orderkey", "left").select(
        "o_custkey",
        "cycle",
        F.coalesce("bill", F.lit(0.0)).alias("bill"),
        F.coalesce("paid", F.lit(0.0)).alias("paid"),
        F.when(F.col("returned").isNull(), F.lit(-2))
        .when(F.col("returned") == 0, F.lit(-1))
        .otherwise(F.least(F.col("returned") - 1, F.lit(fv.MAX_PAY_STATUS)).cast("int"))
        .alias("status"),
    )

    def at(name: str, k: int):
        return F.max(F.when(F.col("cycle") == k, F.col(name)))

    # narrow rows go to their customer; summed up before that, six single rows would each travel as wide as an account
    wide = (
        cycles.repartition("o_custkey").groupBy("o_custkey")
        .agg(
            F.count(F.lit(1)).alias("n_cycles"),
            F.max("bill").alias("top_bill"),
            *[at("status", k).alias(f"PAY_{k}") for k in fv.CYCLES],
            *[at("bill", k).alias(f"BILL_AMT{k}") for k in fv.CYCLES],
            *[at("paid", k).alias(f"PAY_AMT{k}") for k in fv.CYCLES],
        )
        .where(F.col("n_cycles") == len(fv.CYCLES))
    )
    key = F.col("c_custkey")
    accounts = wide.join(
        customer.select("c_custkey", "c_nationkey"), wide.o_custkey == F.col("c_custkey")
    ).select(
        key.alias("ID"),
        (F.ceil(F.col("top_bill") / _LIMIT_STEP) * _LIMIT_STEP).cast("double").alias("LIMIT_BAL"),
        (1 + key % 2).cast("int").alias("SEX"),
        (F.col("c_nationkey") % 7).cast("int").alias("EDUCATION"),
        (key % 4).cast("int").alias("MARRIAGE"),
        (21 + (key % 55) * 31 % 55).cast("int").alias("AGE"),
        *fv.PAY_COLS,
        *fv.BILL_COLS,
        *fv.PAY_AMT_COLS,
    )
    worst = F.greatest(*[F.col(c) for c in fv.PAY_COLS])
    drift = F.col("PAY_1") - F.col("PAY_6")
    hazard = (
        F.lit(0.08) * months_delinquent()
        + F.lit(0.04) * F.greatest(worst, F.lit(0))
        + F.lit(0.05) * F.greatest(drift, F.lit(0))
        + hash_uniform(F.col("ID"), 7919)
    )
    return accounts.withColumn(
        "default payment next month", (hazard > _DEFAULT_THRESHOLD).cast("int")
    ).withColumnRenamed("PAY_1", "PAY_0")


def assign_segment(limit_bin: Column, key: Column) -> Column:
    """Draw a segment from the weights of the borrower's limit bin."""
    draw = hash_uniform(key, 6571)

    def pick(weights):
        reached, choice = 0.0, F
        for name, weight in zip(fv.SEGMENTS[:-1], weights):
            reached = round(reached + weight, 2)
            choice = choice.when(draw < reached, F.lit(name))
        return choice.otherwise(F.lit(fv.SEGMENTS[-1]))

    bin_or_lowest = F.coalesce(limit_bin, F.lit(0))
    chosen = F
    for number, weights in fv.SEGMENT_WEIGHTS.items():
        chosen = chosen.when(bin_or_lowest == number, pick(weights))
    return chosen.otherwise(pick(fv.OTHER_SEGMENT_WEIGHTS))


def officer_note(key: Column) -> Column:
    """Note whose tone follows the borrower's repayment history."""
    which, amount = hash_uniform(key, 3571), hash_uniform(key, 2689)

    def template(texts):
        position = F.floor(which * len(texts)).cast("int") + 1
        return F.element_at(F.array(*[F.lit(t) for t in texts]), position)

    def percent(low, span):
        return (F.lit(low) + F.floor(amount * span)).cast("string")

    late = F.greatest(F.col("months_delinquent"), F.lit(1)).cast("string")
    negative = F.replace(
        F.replace(template(NEGATIVE), F.lit("{n}"), late), F.lit("{pct}"), percent(15, 30)
    )
    positive = F.replace(template(POSITIVE), F.lit("{pct}"), percent(5, 20))
    worsening = (F.col("delinquency_trend") > 0) | (F.col("months_delinquent") >= 3)
    improving = (F.col("delinquency_trend") < 0) & (F.col("months_delinquent") == 0)
    return F.when(worsening, negative).when(improving, positive).otherwise(template(NEUTRAL))


def vintage_month(key: Column) -> Column:
    return (F.lit(1) + F.floor(hash_uniform(key, 6185) * 12)).cast("int")


def split_of(vintage: Column) -> Column:
    return F.when(vintage <= fv.LAST_TRAIN_VINTAGE, F.lit("train")).otherwise(F.lit("test"))


def build_book(accounts: DataFrame, mode: str = "serve") -> DataFrame:
    """Clean, engineer and label accounts; one row per borrower."""
    key = F.col("borrower_id")
    edges = exact_quantiles(accounts, "LIMIT_BAL", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])
    engineered = with_features(recode_categories(accounts), mode)
    return (
        with_quantile_bin(engineered, "LIMIT_BAL", edges, "limit_bin")
        .withColumns({
            "segment": assign_segment(F.col("limit_bin"), key),
            "exposure_at_risk": exposure_at_risk(),
            "rm_note": officer_note(key),
            "duration": duration(),
            "event": F.col("default"),
            "loan_vintage_month": vintage_month(key),
        })
        .withColumn("split", split_of(F.col("loan_vintage_month")))
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def accounts_of(spark: SparkSession, folder: str) -> DataFrame:
    """Raw accounts of a folder of source tables, staged once per application."""
    return stage(spark, f"accounts:{folder}", lambda: derive_accounts(spark, folder))


def derive_accounts(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_accounts(*[table(spark, folder, n) for n in ("customer", "orders", "lineitem")])
    return normalise_accounts(raw)


def loan_book(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled book of a folder of source tables, staged once per application."""
    return stage(spark, f"book:{folder}", lambda: build_book(accounts_of(spark, folder)))
