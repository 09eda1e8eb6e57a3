"""Engineered features of a six-cycle repayment history, as column expressions.

The six cycles are fixed, so every feature is written as plain arithmetic over
six columns. That keeps the whole projection inside one generated stage, which
array lambdas would leave.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from pdengine import fixed_values as fv


def clip(value: Column, low: float, high: float) -> Column:
    """NULL stays NULL: greatest and least would skip it and return a bound."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def round_to(value: Column, digits: int) -> Column:
    """Scale, round ties to even, scale back: the usual rounding of numeric libraries, in plain doubles."""
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def safe_ratio(top: Column, bottom: Column) -> Column:
    return top / F.nullif(bottom, F.lit(0.0))


def mean_of(columns: list[Column]) -> Column:
    """Mean over the values that are present."""
    total = reduce(add, [F.coalesce(c, F.lit(0.0)) for c in columns])
    present = reduce(add, [c.isNotNull().cast("int") for c in columns])
    return total / F.nullif(present, F.lit(0))


def utilization(amount: Column) -> Column:
    low, high = fv.UTILIZATION_CLIP
    return clip(F.coalesce(safe_ratio(amount, F.col("LIMIT_BAL")), F.lit(0.0)), low, high)


def pay_ratio(mode: str) -> Column:
    """Mean paid share over cycles with a bill; ``serve`` clips it, ``train`` leaves it."""
    ratios = [safe_ratio(F.col(p), F.col(b)) for p, b in zip(fv.PAY_AMT_COLS, fv.BILL_COLS)]
    mean = F.coalesce(mean_of(ratios), F.lit(0.0))
    if mode == "train":
        return mean
    if mode == "serve":
        return clip(mean, *fv.PAY_RATIO_CLIP)
    raise ValueError(f"unknown pay-ratio mode: {mode}")


def months_delinquent() -> Column:
    return reduce(add, [F.coalesce((F.col(c) > 0).cast("int"), F.lit(0)) for c in fv.PAY_COLS])


def with_features(accounts: DataFrame, mode: str = "serve") -> DataFrame:
    """Add the seven engineered columns; every path of the engine goes through here."""
    return accounts.withColumns({
        "util_ratio_1": utilization(F.col("BILL_AMT1")),
        "avg_util_ratio": utilization(mean_of([F.col(c) for c in fv.BILL_COLS])),
        "avg_pay_ratio": pay_ratio(mode),
        "months_delinquent": months_delinquent(),
        "max_delinquency": F.greatest(*[F.col(c) for c in fv.PAY_COLS]),
        "delinquency_trend": F.col("PAY_1") - F.col("PAY_6"),
        "bill_trend": F.col("BILL_AMT1") - F.col("BILL_AMT6"),
    })


def exposure_at_risk() -> Column:
    used = clip(F.col("avg_util_ratio"), *fv.EXPOSURE_UTILIZATION_CLIP)
    return round_to(F.col("LIMIT_BAL") * (F.lit(fv.EXPOSURE_BASE) + used), 2)


def duration() -> Column:
    """Index of the most recent late cycle, 6 when there is none."""
    first = F.coalesce(*[F.when(F.col(f"PAY_{k}") > 0, F.lit(k)) for k in fv.CYCLES])
    return F.coalesce(first, F.lit(fv.CENSOR_CYCLE))


def recode_categories(accounts: DataFrame) -> DataFrame:
    return (
        accounts.replace(fv.EDUCATION_RECODE, subset=["EDUCATION"])
        .replace(fv.MARRIAGE_RECODE, subset=["MARRIAGE"])
    )
