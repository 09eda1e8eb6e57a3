"""Repeatable per-borrower draws that need no shared random stream."""

from pyspark.sql import Column, functions as F

_PRIME = 10007
_SHIFT = 104729


def hash_uniform(key: Column, multiplier: int) -> Column:
    """Uniform draw in [0, 1) from a key; reducing the key first keeps the product small."""
    step = (key.cast("long") % F.lit(_PRIME)) * F.lit(multiplier) + F.lit(_SHIFT)
    return (step % F.lit(_PRIME)) / F.lit(float(_PRIME))
