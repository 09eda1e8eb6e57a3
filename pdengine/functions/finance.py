"""Loan arithmetic."""

from pyspark.sql import Column, functions as F


def emi(principal: Column, annual_rate_pct: Column, tenure_months: Column) -> Column:
    """Level instalment of a reducing-balance loan."""
    rate = annual_rate_pct / F.lit(100.0) / F.lit(12.0)
    growth = F.pow(F.lit(1.0) + rate, tenure_months)
    level = principal * rate * growth / F.nullif(growth - F.lit(1.0), F.lit(0.0))
    return F.when(rate == 0, principal / tenure_months).otherwise(level)
