"""Book-wide shocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pdengine import fixed_values as fv
from pdengine.functions.features import with_features


def shock(book: DataFrame, scenario: str, magnitude: float) -> DataFrame:
    """Move the raw columns and derive the features again.

    Limits, payments and the note columns stay. A utilization shock raises all
    bills by a percentage; a delinquency shock adds notches to every status.
    """
    if scenario not in fv.STRESS_SCENARIOS:
        raise ValueError(f"unknown stress scenario: {scenario}")
    if scenario == "utilization_shock":
        factor = F.lit(1 + magnitude / 100)
        moved = {c: F.col(c) * factor for c in fv.BILL_COLS}
    else:
        worst = F.lit(float(fv.MAX_PAY_STATUS))
        # least alone would turn a missing status into the worst one
        moved = {
            c: F.when(F.col(c).isNotNull(), F.least(F.col(c) + F.lit(float(magnitude)), worst)) for c in fv.PAY_COLS
        }
    return with_features(book.withColumns(moved), "serve")
