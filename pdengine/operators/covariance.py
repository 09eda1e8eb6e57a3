"""Covariance of vector columns and principal components with fixed signs.

Tasks return counts, means and centred products of their rows; two of them
merge into those of the rows together, so any partitioning gives the same
matrix up to rounding, and nothing is subtracted that is not small. What is
merged on executors is as wide as a vector; the driver gets one matrix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Partial results that one task merges at a time.
FAN = 16


def _moments(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    mean = x.mean(axis=0)
    away = x - mean
    return float(len(x)), mean, away.T @ away


def merged(one: tuple, two: tuple) -> tuple:
    """Moments of two sets of rows together."""
    (n, a, p), (m, b, q) = one, two
    if not n:
        return two
    away = b - a
    return n + m, a + away * (m / (n + m)), p + q + np.outer(away, away) * (n * m / (n + m))


def _row(part: int, moments: tuple) -> pa.RecordBatch:
    n, mean, products = moments
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([n]), pa.array([mean.tolist()]), pa.array([products.ravel().tolist()])],
        names=["part", "n", "mean", "products"],
    )


_SCHEMA = "part long, n double, mean array<double>, products array<double>"


def _of_rows(batches):
    from pyspark import TaskContext

    total = (0.0, None, None)
    for batch in batches:
        if batch.num_rows:
            values = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(float)
            total = merged(total, _moments(values.reshape(batch.num_rows, -1)))
    if total[0]:
        yield _row(TaskContext.get().partitionId(), total)


def _of_parts(batches):
    part, total = None, (0.0, None, None)
    for batch in batches:
        for r in batch.to_pylist():
            if r["part"] != part:
                if total[0]:
                    yield _row(part, total)
                part, total = r["part"], (0.0, None, None)
            mean = np.array(r["mean"])
            total = merged(total, (r["n"], mean, np.array(r["products"]).reshape(len(mean), -1)))
    if total[0]:
        yield _row(part, total)


def covariance(rows: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance (divisor n) of an array column of one length; rows with null entries take no part."""
    # null where an entry is null and none is NaN; compiled, unlike a function of every entry
    full = ~F.array_contains("v", F.lit(float("nan")))
    source = rows.select(F.col(column).cast("array<double>").alias("v")).where(full)
    parts = source.mapInArrow(_of_rows, _SCHEMA)
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while count > 1:  # neighbours merge in rounds, so that no task holds more than FAN matrices' rows at a time
        count = -(-count // FAN)
        parts = parts.withColumn("part", F.pmod("part", F.lit(count))).repartition(count, "part").sortWithinPartitions("part").mapInArrow(_of_parts, _SCHEMA)
    found = parts.collect()
    if not found:
        return 0, np.zeros(0), np.zeros((0, 0))
    total = (0.0, None, None)
    for r in sorted(found, key=lambda r: r["part"]):
        mean = np.array(r["mean"])
        total = merged(total, (r["n"], mean, np.array(r["products"]).reshape(len(mean), -1)))
    n, mean, products = total
    return int(n), mean, products / n


def principal_components(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` leading directions as columns, and their shares of the variance.

    The entry of the largest size is positive in each, the first one on ties.
    """
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:k]
    axes = axes[:, order]
    size = np.abs(axes)
    largest = np.argmax(size >= size.max(axis=0) * (1 - 1e-9), axis=0)
    signs = np.sign(axes[largest, np.arange(axes.shape[1])])
    total = values.sum()
    return axes * np.where(signs == 0, 1, signs), np.maximum(values[order], 0) / total if total > 0 else np.zeros(len(order))
