import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pdengine.operators import cox as cox_module
from pdengine.operators.cox import CoxModel, Sums, fit_cox, tied_sums, _TAIL, _tie_terms


def brute_force_gradient(x, duration, event, beta, ridge):
    """Efron gradient, one term per tied event."""
    w = np.exp(x @ beta)
    gradient = -ridge * beta
    for t in np.unique(duration[event == 1]):
        risk, tied = duration >= t, (duration == t) & (event == 1)
        d = tied.sum()
        for step in range(d):
            a = step / d
            top = (x[risk] * w[risk, None]).sum(0) - a * (x[tied] * w[tied, None]).sum(0)
            gradient = gradient - top / (w[risk].sum() - a * w[tied].sum())
        gradient = gradient + x[tied].sum(0)
    return gradient


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    n = 4000
    x = rng.normal(size=(n, 3))
    time = rng.exponential(1 / (0.1 * np.exp(x @ np.array([0.7, -0.4, 0.2]))))
    censor = 15.0
    duration = np.ceil(np.minimum(time, censor) * 20) / 20
    return x, duration, (time <= censor).astype(int)


def frame(spark, sample):
    x, duration, event = sample
    data = pd.DataFrame(x, columns=["a", "b", "c"]).assign(duration=duration, event=event)
    return spark.createDataFrame(data)


def test_recovers_coefficients(spark, sample):
    model = fit_cox(frame(spark, sample), ["a", "b", "c"], penalizer=0.0)
    assert np.allclose(model.beta, [0.7, -0.4, 0.2], atol=0.07)


def test_gradient_vanishes_with_ties_and_penalty(spark, sample):
    x, _, event = sample
    coarse = np.ceil(sample[1] / 3)
    model = fit_cox(frame(spark, (x, coarse, event)), ["a", "b", "c"], penalizer=0.1)
    gradient = brute_force_gradient(x, coarse, event, np.array(model.beta), 0.1 * len(x))
    assert np.abs(gradient).max() < 1e-3


def test_baseline_and_risk(spark, sample):
    x, duration, event = sample
    coarse = np.ceil(duration / 3)
    rows = frame(spark, (x, coarse, event))
    model = fit_cox(rows, ["a", "b", "c"])
    w = np.exp(x @ np.array(model.beta))
    hazard = sum(
        event[coarse == t].sum() / w[coarse >= t].sum() for t in np.unique(coarse)
    )
    assert model.cumulative_hazard[-1] == pytest.approx(hazard)
    assert model.horizon == coarse.max()
    risks = np.array([r.r for r in rows.select(model.risk().alias("r")).collect()])
    assert np.allclose(np.sort(risks), np.sort(1 - np.exp(-hazard * w)))


def test_no_events(spark, sample):
    with pytest.raises(ValueError, match="no events"):
        fit_cox(frame(spark, sample).withColumn("event", F.lit(0)), ["a"])


@pytest.mark.parametrize("at_risk, tied", [(1e6, 9e5), (1e6, 1e6), (1e9, 3.0), (5.0, 4.9999)])
def test_many_ties_are_integrated(at_risk, tied):
    n = 10 * _TAIL
    exact = _tie_terms(np.arange(n) / n, at_risk, tied).sum(axis=1)
    assert np.allclose(tied_sums(at_risk, tied, n), exact, rtol=1e-9)


def test_hazard_lookup():
    model = CoxModel(["a"], [1.0], [1.0, 2.0, 4.0], [0.1, 0.3, 0.6])
    assert [model.hazard_at(t) for t in (0.5, 1, 3, 9)] == [0.0, 0.1, 0.3, 0.6]


def test_a_million_distinct_durations(spark):
    """No table of durations on the driver: its share of the work is one row per part."""
    from pdengine.operators import cox

    n = 1_000_000
    rows = spark.range(n, numPartitions=8).select(
        (F.col("id") % 7 / 7 - 0.43).alias("a"), ((F.col("id") * 31) % 11 / 11 - 0.45).alias("b"),
        (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) + F.col("id") / n).alias("duration"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) > 0).cast("int").alias("event"),
    )
    model = fit_cox(rows, ["a", "b"], max_steps=2)
    assert model.baseline.count() == n and len(model.durations) <= 2 * 8
    assert max(abs(b) for b in model.beta) < 0.02
    assert model.hazard_at(model.durations[3]) == pytest.approx(model.cumulative_hazard[3])
    few = cox.Sums.of(np.array([2.0, 2.0, 1.0]), np.array([1.0, 0, 1]), np.zeros((3, 1)), np.zeros(1))
    assert few.t.tolist() == [2.0, 1.0] and few.values[:, 0].tolist() == [2, 1]


@pytest.mark.parametrize("parts", [1, 3, 20])
def test_same_fit_on_any_number_of_parts(spark, sample, parts):
    x, duration, event = sample
    for rounded in (np.ceil(duration / 6), duration):
        rows = frame(spark, (x, rounded, event))
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            model = fit_cox(rows, ["a", "b", "c"], penalizer=0.01)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        gradient = brute_force_gradient(x, rounded, event, np.array(model.beta), 0.01 * len(x))
        assert np.abs(gradient).max() < 1e-3
        w = np.exp(x @ np.array(model.beta))
        table = {r.duration: r.hazard for r in model.baseline.collect()}
        assert sorted(table) == sorted(set(rounded))
        for t in list(table)[::97]:
            assert table[t] == pytest.approx(event[rounded == t].sum() / w[rounded >= t].sum())
        assert model.hazard_at(float(np.median(rounded))) == pytest.approx(sum(h for t, h in table.items() if t <= np.median(rounded)))


def test_rows_without_duration_or_covariate_take_no_part(spark, sample):
    rows = frame(spark, sample)
    holes = rows.limit(5).withColumn("a", F.lit(None).cast("double")).union(rows.limit(5).withColumn("duration", F.lit(None).cast("double")))
    assert np.allclose(fit_cox(rows.union(holes), ["a", "b"]).beta, fit_cox(rows, ["a", "b"]).beta)


def test_long_runs_of_one_duration_are_summed_up_together(monkeypatch):
    rng = np.random.default_rng(8)
    x, event, beta = rng.normal(size=(3000, 4)), (rng.random(3000) < 0.3).astype(float), np.array([0.3, -0.2, 0.1, 0.5])
    t = np.sort(rng.integers(1, 7, 3000))[::-1].astype(float)
    event[t == 3] = 0
    together, runs = Sums.of(t, event, x, beta), []
    monkeypatch.setattr(cox_module, "_LONG", 3001)  # as if no duration had rows enough
    of_runs = Sums.of_runs
    monkeypatch.setattr(Sums, "of_runs", lambda *given: runs.append(1) or of_runs(*given))
    alone = Sums.of(t, event, x, beta)
    assert not runs
    assert np.array_equal(together.t, alone.t) and np.allclose(together.values, alone.values, rtol=1e-11, atol=1e-9)
