"""Isotonic calibration of the blended rank.

Equal values are merged into one weighted point, points are range-partitioned
by value, and every partition pools its adjacent violators into blocks. The
blocks of neighbouring partitions are then joined, ``FAN`` partitions at a time,
and pooled again, until one list is left: only blocks near the seams still
change. A block is a sum of labels and a number of rows, so a curve over 0/1
labels is the same on any partitioning. A rising curve over n such rows has at
most some n^(2/3) blocks, as their means are different fractions whose
denominators add up to n or less.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, functions as F

from pdengine.staging import materialise

#: Partitions whose blocks are joined at a time.
FAN = 8
_BLOCK = "part long, low double, high double, total double, weight double"


def _push(blocks: list[list[float]], block: Iterable[float]) -> None:
    """Add a block at the upper end and pool while means don't rise.

    Means are compared across, not divided: sums of 0/1 labels stay exact.
    """
    blocks.append(list(block))
    while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
        _, high, total, weight = blocks.pop()
        last = blocks[-1]
        last[1], last[2], last[3] = high, last[2] + total, last[3] + weight


def _pool_parts(number: bool):
    """Pool each part of rows sorted by part and value; if asked, a task's rows are one part of its own."""

    def made(part: int, blocks: list[list[float]]) -> pa.RecordBatch:
        columns = zip(*blocks, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([part] * len(blocks)), *map(pa.array, columns)], names=["part", "low", "high", "total", "weight"])

    def task(batches):
        mine, part, blocks = TaskContext.get().partitionId(), None, []
        for batch in batches:
            parts = [mine] * batch.num_rows if number else batch.column("part").to_pylist()
            rows = zip(*[batch.column(c).to_pylist() for c in ("low", "high", "total", "weight")], strict=True)
            for p, row in zip(parts, rows, strict=True):
                if p != part and blocks:
                    yield made(part, blocks)
                    blocks = []
                part = p
                _push(blocks, row)
        if blocks:
            yield made(part, blocks)

    return task


def isotonic_blocks(train: DataFrame, value: str, label: str, parts: int | None = None) -> DataFrame:
    """``(low, high, total, weight)`` of the blocks of the rising least-squares curve of ``label`` over ``value``."""
    parts = parts or int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = (
        train.where(F.col(value).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(value).cast("double").alias("low"))
        .agg(F.sum(F.col(label).cast("double")).alias("total"), F.count(F.lit(1)).cast("double").alias("weight"))
        .select("low", F.col("low").alias("high"), "total", "weight")
    )
    blocks = points.withColumn("part", F.lit(0).cast("long")).repartitionByRange(parts, "low").sortWithinPartitions("low").mapInArrow(_pool_parts(True), _BLOCK)
    while parts > 1:
        parts = -(-parts // FAN)
        joined = blocks.withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
        blocks = joined.repartition(parts, "part").sortWithinPartitions("part", "low").mapInArrow(_pool_parts(False), _BLOCK)
    return blocks.drop("part")


def fit_isotonic(train: DataFrame, value: str, label: str, parts: int | None = None) -> IsotonicRegressionModel:
    """The rising curve as a model; rows without value or label take no part.

    What the built-in fit is given is the finished curve, the two ends of every
    block, so neither its tasks nor the driver see the points.
    """
    blocks = materialise(isotonic_blocks(train, value, label, parts))
    ends = F.explode(F.array_distinct(F.array("low", "high")))
    curve = blocks.select(ends.alias("features"), (F.col("total") / F.col("weight")).alias("label"), "weight")
    return IsotonicRegression(
        featuresCol="features", labelCol="label", weightCol="weight", predictionCol="calibrated"
    ).fit(curve.coalesce(1))


def apply_isotonic(rows: DataFrame, value: str, model: IsotonicRegressionModel) -> DataFrame:
    """Add ``calibrated``: linear between the fitted points, constant beyond them."""
    shaped = rows.withColumn("features", F.col(value))
    return model.transform(shaped).drop("features")
