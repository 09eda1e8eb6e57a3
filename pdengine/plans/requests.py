"""Tables of requests: validation, new-loan rows, what-if terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pdengine import fixed_values as fv
from pdengine.functions.finance import emi
from pdengine.operators.lookup import attach, missing


def _needed(name: str, rule: Column) -> Column:
    """Reason for a required field: missing, or outside its range."""
    return F.when(F.coalesce(rule, F.lit(False)), F.lit(None)).otherwise(F.lit(name))


def _optional(name: str, rule: Column) -> Column:
    """Reason for a field that may be absent."""
    return F.when(~F.coalesce(rule, F.lit(True)), F.lit(name))


def application_reasons() -> Column:
    c = F.col
    return F.array_compact(F.array(
        _needed("loan_amount", (c("loan_amount") > 0) & (c("loan_amount") < float("inf"))),
        _optional("age", c("age").between(18, 100)),
        _optional("tenure_months", c("tenure_months").between(1, 360)),
        _needed("existing_emi", (c("existing_emi") >= 0) & (c("existing_emi") < float("inf"))),
        _needed("credit_utilization_pct", c("credit_utilization_pct").between(0, 300)),
        _optional("repayment_history", c("repayment_history").isin(list(fv.REPAYMENT_CODES))),
    ))


def what_if_reasons() -> Column:
    c = F.col
    return F.array_compact(F.array(
        _optional("new_rate_pct", c("new_rate_pct").between(0, 60)),
        _optional("new_tenure_months", c("new_tenure_months").between(1, 360)),
        _optional("new_principal", (c("new_principal") > 0) & (c("new_principal") < float("inf"))),
        _optional("new_emi", (c("new_emi") >= 0) & (c("new_emi") < float("inf"))),
    ))


def accepted(requests: DataFrame, reasons: Column) -> DataFrame:
    return requests.where(F.size(reasons) == 0)


def rejects(requests: DataFrame, reasons: Column, key: str) -> DataFrame:
    """One row per request and failed rule."""
    return requests.select(key, F.explode(reasons).alias("reason"))


def what_if_rejects(asked: DataFrame, book: DataFrame) -> DataFrame:
    """``(request_id, reason)`` of what-ifs that get no answer; an unknown loan is named ``borrower_id``."""
    unknown = missing(asked, book).select("request_id", F.lit("borrower_id").alias("reason"))
    return rejects(asked, what_if_reasons(), "request_id").unionByName(unknown)


def repayment_code(history: Column) -> Column:
    return F.coalesce(*[F.when(history == h, F.lit(code)) for h, code in fv.REPAYMENT_CODES.items()])


def new_loan_rows(applications: DataFrame) -> DataFrame:
    """Applications as six identical cycles; tenure and income are not model inputs.

    Age and history that were left out take their defaults.
    """
    status = repayment_code(F.coalesce("repayment_history", F.lit(fv.DEFAULT_HISTORY)))
    bill = F.col("credit_utilization_pct") / 100 * F.col("loan_amount")
    return applications.select(
        "application_id",
        F.col("loan_amount").cast("double").alias("LIMIT_BAL"),
        F.coalesce("age", F.lit(fv.DEFAULT_AGE)).alias("AGE"),
        *[status.alias(c) for c in fv.PAY_COLS],
        *[bill.alias(c) for c in fv.BILL_COLS],
        *[F.col("existing_emi").cast("double").alias(c) for c in fv.PAY_AMT_COLS],
        F.nullif("segment", F.lit("")).alias("segment"),
        F.coalesce("rm_note", F.lit("")).alias("rm_note"),
    )


def fill_defaults(rows: DataFrame, modes: DataFrame, absent_when_null: tuple[str, ...] = ("segment",)) -> DataFrame:
    """Fill categorical inputs that a request did not give with the book's modes.

    A column the table does not have was not given. In the columns named by
    ``absent_when_null`` a NULL also means "not given"; elsewhere NULL is an
    unknown category and stays.
    """
    filled = rows.withColumn("_modes", modes.select(F.struct("*")).scalar())
    for c in fv.CATEGORICAL_FEATURES:
        mode = F.col(f"_modes.{c}")
        if c not in rows.columns:
            filled = filled.withColumn(c, mode)
        elif c in absent_when_null:
            filled = filled.withColumn(c, F.coalesce(F.col(c), mode))
    return filled.drop("_modes")


def with_applied_terms(joined: DataFrame) -> DataFrame:
    """Add ``applied_emi`` and ``applied_principal``; a given instalment wins over rate and tenure."""
    c = F.col
    principal = F.coalesce(c("new_principal"), c("BILL_AMT1"))
    from_terms = emi(
        principal,
        F.coalesce(c("new_rate_pct"), F.lit(fv.DEFAULT_RATE_PCT)),
        F.coalesce(c("new_tenure_months"), F.lit(fv.DEFAULT_TENURE_MONTHS)),
    )
    has_terms = c("new_rate_pct").isNotNull() | c("new_tenure_months").isNotNull()
    return joined.withColumns({
        "applied_emi": F.coalesce(c("new_emi"), F.when(has_terms, from_terms)),
        "applied_principal": c("new_principal"),
    })


def what_if_rows(requests: DataFrame, book: DataFrame) -> DataFrame:
    """Two rows per request, ``stage`` original and new, from one join with the book.

    A new principal replaces all six bills and an instalment all six payments.
    """
    joined = with_applied_terms(attach(requests, book, "request_id"))
    replaced = {b: F.coalesce("applied_principal", b) for b in fv.BILL_COLS}
    replaced |= {p: F.coalesce("applied_emi", p) for p in fv.PAY_AMT_COLS}
    versions = F.array(
        F.struct(F.lit("original").alias("stage"), *replaced),
        F.struct(F.lit("new").alias("stage"), *[v.alias(k) for k, v in replaced.items()]),
    )
    others = [c for c in joined.columns if c not in replaced]
    return joined.select(*others, F.explode(versions).alias("_version")).select(*others, "_version.*")
