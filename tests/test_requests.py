import pytest
from pyspark.sql import functions as F

from pdengine import fixed_values as fv
from pdengine.functions.finance import emi
from pdengine.operators.lookup import attach, missing
from pdengine.plans import explore, requests
from pdengine.plans.reports import filter_book, watchlist_page

APPLICATION = (
    "application_id long, loan_amount double, age int, tenure_months int, annual_income double, "
    "existing_emi double, credit_utilization_pct double, repayment_history string, segment string, rm_note string"
)


def test_emi(spark):
    row = spark.range(1).select(
        emi(F.lit(1200.0), F.lit(0.0), F.lit(12)).alias("free"),
        emi(F.lit(100000.0), F.lit(12.0), F.lit(12)).alias("usual"),
    ).first()
    assert row.free == 100.0
    assert row.usual == pytest.approx(8884.878867834166)


def test_emi_covers_the_principal(spark):
    rows = spark.range(1, 361).select(
        F.col("id"), (emi(F.lit(5000.0), F.col("id") % 61, F.col("id")) * F.col("id")).alias("paid")
    )
    assert rows.where(F.col("paid") < 5000 - 1e-6).count() == 0


def test_rejects_name_every_failed_rule(spark):
    rows = spark.createDataFrame([
        (1, 50000.0, 29, 24, None, 200.0, 130.0, "severe_delinquency", "Retail Personal", ""),
        (2, 0.0, 17, 361, None, -1.0, 301.0, "late", None, None),
        (3, None, None, 12, None, 0.0, 0.0, "clean", None, None),
    ], APPLICATION)
    bad = requests.rejects(rows, requests.application_reasons(), "application_id")
    got = {}
    for r in bad.collect():
        got.setdefault(r.application_id, set()).add(r.reason)
    assert got == {
        2: {"loan_amount", "age", "tenure_months", "existing_emi", "credit_utilization_pct", "repayment_history"},
        3: {"loan_amount"},
    }
    assert requests.accepted(rows, requests.application_reasons()).count() == 1


def test_fields_left_out_take_their_defaults(spark):
    rows = spark.createDataFrame([(1, 9000.0, None, None, None, 10.0, 20.0, None, None, None)], APPLICATION)
    assert requests.accepted(rows, requests.application_reasons()).count() == 1
    row = requests.new_loan_rows(rows).first()
    assert row.AGE == 35 and {row[c] for c in fv.PAY_COLS} == {-1.0}


def test_what_ifs_without_answer_are_named(spark, loans):
    asked = spark.createDataFrame([(1, 1, 10.0, 5, None, None), (2, 1, 61.0, 0, -1.0, -1.0), (3, 99, None, 10, None, None)], ASKED)
    got = sorted(tuple(r) for r in requests.what_if_rejects(asked, loans).collect())
    assert got == [(2, "new_emi"), (2, "new_principal"), (2, "new_rate_pct"), (2, "new_tenure_months"), (3, "borrower_id")]


def test_new_loan_rows(spark):
    rows = spark.createDataFrame(
        [(1, 50000.0, 29, 24, None, 200.0, 130.0, "severe_delinquency", "", None)], APPLICATION
    )
    row = requests.new_loan_rows(rows).first()
    assert {row[c] for c in fv.PAY_COLS} == {4.0}
    assert {row[c] for c in fv.BILL_COLS} == {65000.0}
    assert {row[c] for c in fv.PAY_AMT_COLS} == {200.0}
    assert (row.segment, row.rm_note) == (None, "")


def test_fill_defaults_and_modes(spark):
    book = spark.createDataFrame(
        [(1, 3, 2, "SME"), (1, 3, 1, "Agri"), (2, 1, 1, "Agri"), (2, 1, 2, "SME")],
        ["SEX", "EDUCATION", "MARRIAGE", "segment"],
    )
    modes = explore.category_modes(book)
    assert modes.first().asDict() == {"SEX": 1, "EDUCATION": 1, "MARRIAGE": 1, "segment": "Agri"}
    rows = spark.createDataFrame([(1, None, None), (2, 9, "Gold")], "id int, SEX int, segment string")
    got = {r.id: r for r in requests.fill_defaults(rows, modes).collect()}
    assert (got[1].SEX, got[1].segment, got[1].EDUCATION) == (None, "Agri", 1)
    assert (got[2].SEX, got[2].segment) == (9, "Gold")


@pytest.fixture(scope="module")
def loans(spark):
    row = {c: 0 for c in fv.PAY_COLS} | {c: 600.0 for c in fv.BILL_COLS} | {c: 60.0 for c in fv.PAY_AMT_COLS}
    return spark.createDataFrame([{"borrower_id": b, "LIMIT_BAL": 1000.0, **row} for b in (1, 2)])


ASKED = "request_id long, borrower_id long, new_rate_pct double, new_tenure_months int, new_principal double, new_emi double"


def test_what_if_terms(spark, loans):
    asked = spark.createDataFrame([
        (1, 1, 10.0, 5, None, 77.0),
        (2, 1, 0.0, None, None, None),
        (3, 2, None, None, 900.0, None),
        (4, 2, None, 10, 1000.0, None),
        (5, 99, None, 10, None, None),
    ], ASKED)
    got = {(r.request_id, r.stage): r for r in requests.what_if_rows(asked, loans).collect()}
    assert len(got) == 8
    assert got[1, "new"].PAY_AMT6 == 77.0 and got[1, "new"].BILL_AMT1 == 600.0
    assert got[2, "new"].applied_emi == 50.0
    assert got[3, "new"].BILL_AMT6 == 900.0 and got[3, "new"].applied_emi is None
    assert got[3, "new"].PAY_AMT1 == 60.0 and got[3, "new"].applied_principal == 900.0
    assert got[4, "new"].applied_emi == pytest.approx(105.58207655)
    assert all(got[i, "original"].PAY_AMT1 == 60.0 and got[i, "original"].BILL_AMT1 == 600.0 for i in (1, 2, 3, 4))


def test_attach_with_one_loan_named_by_most_requests(spark, loans):
    asked = spark.range(5000).select(
        F.col("id").alias("request_id"), F.when(F.col("id") % 3 == 0, 2).otherwise(1).cast("long").alias("borrower_id")
    )
    joined = attach(asked, loans, "request_id")
    assert joined.count() == 5000
    assert joined.where("LIMIT_BAL IS NULL").count() == 0


def test_missing(spark, loans):
    ids = spark.createDataFrame([(1,), (7,)], "borrower_id long")
    assert [r.borrower_id for r in missing(ids, loans).collect()] == [7]


def test_watchlist_arguments(spark):
    book = spark.createDataFrame(
        [(i, "SME" if i % 2 else "Agri", 50.0, "High", float(i % 3)) for i in range(10)],
        "borrower_id long, segment string, pd_score double, band string, exposure_at_risk double",
    )
    assert filter_book(book, "", "").count() == 10
    rows = watchlist_page(book, segment="SME", limit=2, offset=4).collect()
    assert [(r.total, r.row_from, r.row_to) for r in rows] == [(5, 5, 5)]
    for bad in ({"limit": 0}, {"limit": 501}, {"offset": -1}):
        with pytest.raises(ValueError):
            watchlist_page(book, **bad)


def test_applications_of_one_file_are_scored_by_many_tasks(spark, monkeypatch):
    from pdengine.plans import scoring

    seen = []
    answers = spark.createDataFrame([], "application_id long, pd_score double, band string, reason_codes array<string>")
    monkeypatch.setattr(scoring, "ROWS_PER_TASK", 2, raising=False)
    monkeypatch.setattr(scoring, "application_features", lambda model, rows: (seen.append(rows), rows)[1])
    monkeypatch.setattr(scoring, "score_rows", lambda *given, **more: answers)
    scoring.score_applications(None, spark.range(5).toDF("application_id").coalesce(1))
    assert seen[0].rdd.getNumPartitions() == 3 and sorted(r[0] for r in seen[0].collect()) == [0, 1, 2, 3, 4]
