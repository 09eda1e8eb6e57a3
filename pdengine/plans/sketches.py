"""Summaries of a book that are kept and merged instead of read again.

For every column and group (a split, a day) one scan leaves a row with moments
and a mergeable quantile sketch. Rows of any groups merge into the summary of
all of them, so the figures of a quarter or of the whole history need the
stored rows only. Sketches of up to ``SKETCH_SIZE`` values hold all of them; beyond
that a quantile's rank is off by about 2 / SKETCH_SIZE of the rows at most (99 %).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Size parameter of a sketch: values it holds, about.
SKETCH_SIZE = 4096


def sketched(book: DataFrame, columns: list[str], by: list[str], size: int = SKETCH_SIZE) -> DataFrame:
    """``by..., feature, n, mean, products, min, max, sketch`` of each column and group, from one scan."""
    x = {c: F.col(c).cast("double") for c in columns}
    found = book.groupBy(*by).agg(*[
        F.struct(
            F.lit(c).alias("feature"), F.count(x[c]).alias("n"), F.avg(x[c]).alias("mean"),
            (F.var_pop(x[c]) * F.count(x[c])).alias("products"), F.min(x[c]).alias("min"), F.max(x[c]).alias("max"),
            F.kll_sketch_agg_double(x[c], F.lit(size)).alias("sketch"),
        ).alias(f"s{i}")
        for i, c in enumerate(columns)
    ])
    return found.select(*by, F.explode(F.array(*[f"s{i}" for i in range(len(columns))])).alias("s")).select(*by, "s.*")


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The same rows with groups merged until only ``by`` tells them apart.

    Products about the merged mean are those about the groups' means and what
    the means themselves differ by.
    """
    filled = sketches.where("n > 0")
    keys = [*by, "feature"]
    whole = filled.groupBy(*keys).agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_double("sketch").alias("sketch"),
    )
    away = F.col("mean") - F.col("all_mean")
    products = (
        filled.join(whole.select(*keys, F.col("mean").alias("all_mean")), keys)
        .groupBy(*keys).agg(F.sum(F.col("products") + F.col("n") * away * away).alias("products"))
    )
    return whole.join(products, keys).select(*keys, "n", "mean", "products", "min", "max", "sketch")


def described(sketches: DataFrame) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of each row of sketches."""
    keep = [c for c in sketches.columns if c not in ("n", "mean", "products", "min", "max", "sketch")]
    quartile = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(q))
    return sketches.select(
        *keep, "n", "mean", F.sqrt(F.col("products") / F.nullif(F.col("n") - 1, F.lit(0))).alias("std"), "min", "max",
        quartile(0.25).alias("q25"), quartile(0.5).alias("q50"), quartile(0.75).alias("q75"),
    )
