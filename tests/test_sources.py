from datetime import date

from pyspark.sql import functions as F

from pdengine import fixed_values as fv
from pdengine.functions.hashing import hash_uniform
from pdengine.plans import reports
from pdengine.plans.explore import describe
from pdengine.sources import store
from pdengine.sources.accounts import RAW_SCHEMA, account_rejects, read_accounts
from pdengine.sources.loan_book import _latest_orders, loan_book, raw_accounts, table
from pdengine.staging import materialise, release, stage


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_csv_accounts(spark, tmp_path):
    header = ",".join(RAW_SCHEMA.names)
    (tmp_path / "a.csv").write_text(header + "\n" + ",".join(["7", "NaN", "1", "2", "0", "33"] + ["0"] * 6 + ["1.5"] * 12 + ["1"]))
    row = read_accounts(spark, str(tmp_path / "a.csv"), "csv").first()
    assert (row.borrower_id, row.LIMIT_BAL, row.PAY_1, row.default) == (7, None, 0, 1)


def test_malformed_cells_are_named(spark, tmp_path):
    lines = [
        ["7", "NaN", "1", "2", "0", "33", *["0"] * 6, *["1.5"] * 12, "1"],
        ["8", "n/a", "1", "2", "0", "33", "late", *["0"] * 5, *["1.5"] * 11, "1,5", "1"],
        ["9", "", " 2 ", "x"],
        ["ten", *["1"] * 24],
    ]
    quoted = [",".join(f'"{c}"' if "," in c else c for c in line) for line in lines]
    (tmp_path / "a.csv").write_text("\n".join([",".join(RAW_SCHEMA.names), *quoted]))
    got = sorted(tuple(r)[:3] for r in account_rejects(spark, str(tmp_path / "a.csv")).collect())
    assert got == [("8", "LIMIT_BAL", "n/a"), ("8", "PAY_0", "late"), ("8", "PAY_AMT6", "1,5"), ("9", "EDUCATION", "x"), ("ten", "ID", "ten")]
    rows = {r.borrower_id: r for r in read_accounts(spark, str(tmp_path / "a.csv"), "csv").collect()}
    assert (rows[8].LIMIT_BAL, rows[8].PAY_1, rows[8].PAY_2, rows[9].SEX, rows[9].default, rows[None].AGE) == (None, None, 0, 2, None, 1)


def test_accounts_round_trip_through_parquet(spark, folder, tmp_path):
    raw = raw_accounts(*[table(spark, folder, n) for n in ("customer", "orders", "lineitem")])
    raw.write.parquet(str(tmp_path / "raw"))
    assert read_accounts(spark, str(tmp_path / "raw")).count() == loan_book(spark, folder).count()


def test_only_six_orders_per_customer_are_shuffled(spark, folder):
    text = plan(_latest_orders(table(spark, folder, "orders")))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_scans_read_only_the_needed_columns(spark, folder):
    text = loan_book(spark, folder).where(F.col("segment") == "SME").select("borrower_id")
    text = text._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "EqualTo(segment,SME)" in text
    assert "BILL_AMT1" not in text


def test_reading_a_split_prunes_files(spark, folder, tmp_path):
    store.write_splits(loan_book(spark, folder), str(tmp_path / "book"))
    train = store.read_split(spark, str(tmp_path / "book"), "train")
    assert all("split=train" in f for f in train.select("borrower_id").inputFiles()) or "split=train" in plan(train) or train.select("split").distinct().count() == 1
    assert train.count() == loan_book(spark, folder).where("split = 'train'").count()


def test_large_keys_do_not_overflow(spark):
    row = spark.range(1).select(hash_uniform(F.lit(9_000_000_000_000_000_000), 7919).alias("u")).first()
    assert 0 <= row.u < 1


def test_approximate_description_is_close(spark, folder):
    book = loan_book(spark, folder)
    exact = {r.feature: r for r in describe(book, ["AGE"]).collect()}["AGE"]
    near = {r.feature: r for r in describe(book, ["AGE"], approximate=True).collect()}["AGE"]
    assert (exact.n, exact.mean, exact.min, exact.max) == (near.n, near.mean, near.min, near.max)
    assert abs(exact.q50 - near.q50) <= 2


def test_document_round_trip(spark, tmp_path):
    store.write_document(spark, {"a": [1, 2.5], "b": "x"}, str(tmp_path / "doc"))
    assert store.read_document(spark, str(tmp_path / "doc")) == {"a": [1, 2.5], "b": "x"}


def test_staged_tables_are_built_once(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert stage(spark, "test-once", build).count() == stage(spark, "test-once", build).count() == 3
    assert len(calls) == 1
    assert materialise(spark.range(5)).count() == 5


def test_rollup_totals(spark):
    book = spark.createDataFrame([("SME", "High", 1.5), ("SME", "Watch", 2.25)], "segment string, band string, exposure_at_risk double")
    rows = {(r.segment, r.band): (r.n_loans, r.exposure) for r in reports.segment_band_rollup(book).collect()}
    assert rows["ALL", "ALL"] == (2, 3.75) and rows["SME", "ALL"] == (2, 3.75)


def test_single_cycles_travel_narrow(spark):
    """Six rows of an account meet before they are summed up as wide as it is; the account is the same."""
    customer = spark.createDataFrame([(1, 3), (2, 4)], "c_custkey long, c_nationkey int")
    orders = spark.createDataFrame([(c * 10 + k, c, date(1995, 1, 1 + k)) for c, n in ((1, 7), (2, 5)) for k in range(n)], "o_orderkey long, o_custkey long, o_orderdate date")
    lines = spark.createDataFrame(
        [(10 + k, 100.0 * k, 0.0, "F" if k % 2 else "O", "R" if k == 6 else "N") for k in range(1, 7)],
        "l_orderkey long, l_extendedprice double, l_discount double, l_linestatus string, l_returnflag string",
    )
    found = raw_accounts(customer, orders, lines)
    steps = found._jdf.queryExecution().sparkPlan().toString().splitlines()
    summed = [i for i, line in enumerate(steps) if "max(CASE WHEN (cycle" in line]
    dealt = [i for i, line in enumerate(steps) if "REPARTITION_BY_COL" in line]
    assert summed and dealt and max(summed) < dealt[0]
    row = found.collect()
    assert len(row) == 1 and row[0].ID == 1 and row[0].PAY_0 == 0 and row[0].PAY_2 == -1
    assert [row[0][f"BILL_AMT{k}"] for k in range(1, 7)] == [600.0, 500.0, 400.0, 300.0, 200.0, 100.0]
    assert [row[0][f"PAY_AMT{k}"] for k in range(1, 7)] == [0.0, 500.0, 0.0, 300.0, 0.0, 100.0]
