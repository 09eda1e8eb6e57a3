"""Hand-made edge rows."""

import pytest
from pyspark.sql import functions as F

from pdengine import fixed_values as fv
from pdengine.functions.features import duration, exposure_at_risk, recode_categories, with_features
from pdengine.plans.stress import shock


def account(spark, limit=1000.0, pays=(0,) * 6, bills=(100.0,) * 6, paid=(50.0,) * 6, **extra):
    row = {"LIMIT_BAL": limit, "AGE": 30, "SEX": 1, "EDUCATION": 1, "MARRIAGE": 1, **extra}
    row |= dict(zip(fv.PAY_COLS, pays)) | dict(zip(fv.BILL_COLS, bills)) | dict(zip(fv.PAY_AMT_COLS, paid))
    return spark.createDataFrame([row])


def engineered(frame, mode="serve"):
    return with_features(frame, mode).withColumn("duration", duration()).first()


def test_zero_limit_gives_zero_utilization(spark):
    row = engineered(account(spark, limit=0.0))
    assert (row.util_ratio_1, row.avg_util_ratio) == (0.0, 0.0)


def test_no_bills(spark):
    row = engineered(account(spark, bills=(0.0,) * 6))
    assert (row.avg_pay_ratio, row.avg_util_ratio) == (0.0, 0.0)


def test_pay_ratio_is_a_mean_over_billed_cycles(spark):
    row = engineered(account(spark, bills=(0.0, 10.0, 10.0, 10.0, 10.0, 10.0), paid=(99.0, 1.0, 2.0, 3.0, 4.0, 5.0)))
    assert row.avg_pay_ratio == pytest.approx(0.3)


def test_pay_ratio_modes(spark):
    frame = account(spark, bills=(1.0,) * 6, paid=(40.0,) * 6)
    assert engineered(frame, "train").avg_pay_ratio == 40.0
    assert engineered(frame, "serve").avg_pay_ratio == 5.0
    with pytest.raises(ValueError):
        with_features(frame, "other")


def test_negative_bills_clip(spark):
    row = engineered(account(spark, bills=(-3000.0,) * 6))
    assert (row.util_ratio_1, row.avg_util_ratio) == (-2.0, -2.0)


def test_never_late(spark):
    row = engineered(account(spark, pays=(-1, 0, -2, 0, 0, -1)))
    assert (row.duration, row.months_delinquent, row.max_delinquency, row.delinquency_trend) == (6, 0, 0, 0)


def test_late_in_the_oldest_cycle_only(spark):
    row = engineered(account(spark, pays=(0, 0, 0, 0, 0, 1)))
    assert (row.duration, row.months_delinquent) == (6, 1)


def test_missing_bill_is_left_out_of_the_mean(spark):
    frame = account(spark).withColumn("BILL_AMT1", F.lit(None).cast("double"))
    assert with_features(frame).first().avg_util_ratio == pytest.approx(0.1)


def test_recode_and_exposure(spark):
    frame = account(spark, EDUCATION=5, MARRIAGE=0, bills=(5000.0,) * 6)
    row = with_features(recode_categories(frame)).withColumn("e", exposure_at_risk()).first()
    assert (row.EDUCATION, row.MARRIAGE, row.e) == (4, 3, 1800.0)


def test_delinquency_shock_stops_at_eight_and_counts_current_cycles(spark):
    row = shock(account(spark, pays=(8, 0, 0, 0, 0, 0)), "delinquency_shock", 2).first()
    assert (row.PAY_1, row.PAY_2, row.months_delinquent) == (8, 2, 6)
    assert shock(account(spark), "delinquency_shock", 1).first().months_delinquent == 6


def test_utilization_shock_moves_bills_only(spark):
    row = shock(account(spark), "utilization_shock", 50).first()
    assert row.BILL_AMT1 == pytest.approx(150.0)
    assert row.avg_pay_ratio == pytest.approx(1 / 3)
    assert (row.PAY_AMT1, row.LIMIT_BAL) == (50.0, 1000.0)


def test_unknown_scenario(spark):
    with pytest.raises(ValueError):
        shock(account(spark), "rate_shock", 1)
