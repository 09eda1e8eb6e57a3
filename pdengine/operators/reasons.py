"""Top reasons of a loan from its per-feature contributions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pdengine import fixed_values as fv
from pdengine.functions.wording import reason_text


def contribution(feature: str, value: Column | None, category: Column | None, amount: Column) -> Column:
    return F.struct(
        F.lit(feature).alias("feature"),
        (F.lit(None) if value is None else value).cast("double").alias("value"),
        (F.lit(None) if category is None else category).cast("string").alias("category"),
        amount.cast("double").alias("amount"),
    )


def top_contributions(contributions: Column, k: int = fv.TOP_REASONS) -> Column:
    """The k largest by absolute amount, ties by feature name.

    A loan's contributions sit in one array in its own row, so the ranking
    needs no shuffle.
    """
    keyed = F.transform(
        contributions,
        lambda c: F.struct(
            (-F.abs(c["amount"])).alias("order"), c["feature"].alias("feature"), c.alias("item")
        ),
    )
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda c: c["item"])


def reason_codes(top: Column, note: Column) -> Column:
    """``array<struct<text, is_nlp>>`` in the order of the contributions."""
    return F.transform(
        top,
        lambda c: F.struct(
            reason_text(c["feature"], c["value"], c["category"], c["amount"], note).alias("text"),
            c["feature"].startswith("nlp_emb_").alias("is_nlp"),
        ),
    )
