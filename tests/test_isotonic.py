"""Pooled blocks against the built-in fit and the definition."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from pdengine.operators.calibration import apply_isotonic, fit_isotonic, isotonic_blocks


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    value = np.round(rng.random(5000), 3)
    label = (rng.random(5000) < value**2).astype(int)
    return spark.createDataFrame(pd.DataFrame({"value": value, "label": label}))


def slow(values, labels):
    """Mean over the best interval: max over starts of the least mean over ends."""
    table = pd.DataFrame({"v": values, "y": labels}).groupby("v").y.agg(["sum", "count"])
    s, w = np.concatenate([[0], table["sum"].cumsum()]), np.concatenate([[0], table["count"].cumsum()])
    n = len(table)
    mean = np.array([[(s[j + 1] - s[i]) / (w[j + 1] - w[i]) if j >= i else np.inf for j in range(n)] for i in range(n)])
    return dict(zip(table.index, [max(mean[i, k:].min() for i in range(k + 1)) for k in range(n)], strict=True))


@pytest.mark.parametrize("parts", [1, 7, 200])
def test_equals_the_built_in_fit(rows, parts):
    merged = rows.groupBy("value").agg(F.avg("label").alias("label"), F.count("label").cast("double").alias("w"))
    built_in = IsotonicRegression(featuresCol="value", labelCol="label", weightCol="w", predictionCol="p").fit(merged)
    probe = rows.sparkSession.range(-10, 1100).select((F.col("id") / 1000 + 0.0003).alias("value"))
    want = [r.p for r in built_in.transform(probe).orderBy("value").collect()]
    got = [r.calibrated for r in apply_isotonic(probe, "value", fit_isotonic(rows, "value", "label", parts)).orderBy("value").collect()]
    assert np.allclose(got, want, rtol=1e-12)


def test_equals_the_definition(spark):
    rng = np.random.default_rng(9)
    values, labels = rng.integers(0, 40, 300) / 40, rng.integers(0, 2, 300)
    rows = spark.createDataFrame(pd.DataFrame({"value": values, "label": labels}))
    want = slow(values, labels)
    for parts in (1, 5, 64):
        blocks = isotonic_blocks(rows, "value", "label", parts).orderBy("low").collect()
        for v, y in want.items():
            inside = [b for b in blocks if b.low <= v <= b.high]
            assert len(inside) == 1 and inside[0].total / inside[0].weight == pytest.approx(y, abs=1e-12)
        means = [b.total / b.weight for b in blocks]
        assert all(a < b for a, b in zip(means, means[1:]))


def test_only_blocks_reach_the_last_task(rows):
    assert isotonic_blocks(rows, "value", "label", 200).count() < rows.select("value").distinct().count() / 10


def test_falling_labels_and_missing_values(spark):
    rows = spark.createDataFrame([(float(i), int(i < 50)) for i in range(100)] + [(None, 1), (3.0, None)], "value double, label int")
    assert [tuple(r) for r in isotonic_blocks(rows, "value", "label", 9).collect()] == [(0.0, 99.0, 50.0, 100.0)]
    rising = spark.createDataFrame([(float(i), int(i >= 50)) for i in range(100)], "value double, label int")
    assert sorted(tuple(r) for r in isotonic_blocks(rising, "value", "label", 9).collect()) == [(0.0, 49.0, 0.0, 50.0), (50.0, 99.0, 50.0, 50.0)]
