"""Published versions, stored lists, kept sketches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pdengine.operators.list_index import list_page, write_list
from pdengine.operators.paging import page
from pdengine.plans import sketches
from pdengine.sources import published, store


def test_readers_see_one_version(spark, tmp_path):
    root = str(tmp_path / "book")
    assert published.current(spark, root) is None
    first = published.publish(spark.range(5), root, 10.0)
    assert (first.number, first.n_rows) == (1, 5) and published.current(spark, root) == first
    before = store.read_book(spark, root)
    second = published.publish(spark.range(7), root, 20.5)
    assert published.current(spark, root) == second and second.published_at == 20.5
    assert store.read_book(spark, root).count() == 7
    assert before.count() == 5  # whoever began before goes on reading the old version
    third = published.publish(spark.range(9), root, 30.0)
    assert [v.number for v in published.versions(spark, root)] == [2, 3] and third.number == 3


def test_a_failed_job_leaves_the_old_book(spark, tmp_path):
    root = str(tmp_path / "book")
    published.publish(spark.range(5), root, 1.0)

    def write(rows, folder):
        rows.write.parquet(folder)
        raise RuntimeError("lost on the way")

    with pytest.raises(RuntimeError):
        published.publish(spark.range(50), root, 2.0, write)
    broken = spark.range(10).select(F.raise_error(F.lit("no such score")).alias("id"))
    with pytest.raises(Exception, match="no such score"):
        published.publish(broken, root, 3.0)
    assert published.current(spark, root).published_at == 1.0 and store.read_book(spark, root).count() == 5
    assert published.publish(spark.range(6), root, 4.0).number == 2


def test_plain_folders_are_read_as_before(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "plain"))
    assert store.read_book(spark, str(tmp_path / "plain")).count() == 3


@pytest.fixture(scope="module")
def listed(spark, tmp_path_factory):
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 11 > 0, (F.col("id") * 37 % 500).cast("double")).alias("value"),
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("segment"),
        F.when(F.col("id") % 5 == 0, "High").otherwise("Watch").alias("band"),
    )
    path = str(tmp_path_factory.mktemp("list"))
    write_list(rows, path, "value", "id", ["segment", "band"], parts=12)
    return rows, path


@pytest.mark.parametrize("wanted", [{}, {"segment": "b"}, {"segment": "a", "band": "High"}, {"band": "none"}])
@pytest.mark.parametrize("offset", [0, 1, 130, 990, 2980, 5000])
def test_pages_of_a_stored_list(spark, listed, wanted, offset):
    rows, path = listed
    some = rows
    for name, only in wanted.items():
        some = some.where(F.col(name) == only)
    want = [tuple(r) for r in page(some, "value", "id", 25, offset).collect()]
    got = list_page(spark, path, "value", "id", 25, offset, **wanted)
    total = some.count()
    assert [tuple(r)[:-1] for r in got.collect()] == want and all(r.total == total for r in got.collect())


def test_a_deep_page_opens_few_parts(spark, listed):
    _, path = listed
    plan = list_page(spark, path, "value", "id", 25, 2200)
    files = plan.inputFiles()
    assert 1 <= len({f.split("part=")[1].split("/")[0] for f in files if "part=" in f}) <= 12
    read = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in read and read.count("part#") > 0
    parts = [r.part for r in spark.read.parquet(f"{path}/rows").where(F.col("id").isin([r.id for r in plan.collect()])).select("part").distinct().collect()]
    assert len(parts) <= 2


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(5)
    x, y = rng.lognormal(size=40_000), rng.integers(0, 9, 40_000) * 1.0
    return spark.createDataFrame(
        [(float(a), None if i % 50 == 0 else float(b), i % 7) for i, (a, b) in enumerate(zip(x, y, strict=True))], "x double, y double, day int"
    ).repartition(4)


def test_sketches_of_days_merge_into_those_of_all(values):
    by_day = sketches.sketched(values, ["x", "y"], ["day"])
    merged = {r.feature: r for r in sketches.described(sketches.merged(by_day, [])).collect()}
    pandas = values.toPandas()
    for c in ("x", "y"):
        row, column = merged[c], np.sort(pandas[c].dropna().to_numpy())
        assert row.n == len(column) and row.mean == pytest.approx(column.mean()) and row["std"] == pytest.approx(column.std(ddof=1))
        assert (row["min"], row["max"]) == (column[0], column[-1])
        for q, got in ((0.25, row.q25), (0.5, row.q50), (0.75, row.q75)):
            low, high = np.searchsorted(column, got, "left") / len(column), np.searchsorted(column, got, "right") / len(column)
            assert low - 2 / sketches.SKETCH_SIZE <= q <= high + 2 / sketches.SKETCH_SIZE
    some = sketches.merged(by_day.where("day < 3"), [])
    assert some.where("feature = 'x'").first().n == int((pandas.day < 3).sum())


def test_one_scan_feeds_all_columns(values):
    plan = sketches.sketched(values, ["x", "y"], ["day"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") + plan.count("RepartitionByExpression") + plan.count("Repartition ") == 2


def test_staged_tables_follow_their_sources(spark, tmp_path):
    from pdengine.staging import stage, stage_artifact

    folder = str(tmp_path / "tables")
    spark.range(3).write.parquet(f"{folder}/t.parquet")
    made = []

    def staged():
        return stage(spark, f"numbers:{folder}", lambda: made.append(1) or spark.read.parquet(f"{folder}/t.parquet")).count()

    assert (staged(), staged(), len(made)) == (3, 3, 1)
    one = stage_artifact(spark, f"copy:{folder}", lambda p: spark.range(1).write.parquet(p))
    spark.range(9).write.mode("overwrite").parquet(f"{folder}/t.parquet")
    assert (staged(), staged(), len(made)) == (9, 9, 2)
    assert stage_artifact(spark, f"copy:{folder}", lambda p: spark.range(1).write.parquet(p)) != one
    assert stage(spark, "no folder in this label", lambda: spark.range(2)).count() == 2
