"""The fitted pipeline on the smallest tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pdengine import fixed_values as fv
from pdengine.operators.metrics import ranking_metrics
from pdengine.plans import scoring
from pdengine.plans.jobs import rescore_job, training_job
from pdengine.plans.memos import memo_records, write_memos
from pdengine.plans.reports import newly_high, transition_counts
from pdengine.plans.training import RiskModel, TrainingConfig, evaluate, train
from pdengine.sources import store
from pdengine.sources.loan_book import loan_book
from pdengine.sources.samples import applications
from pdengine.staging import stage_path
from pdengine.streaming.applications import APPLICATION_SCHEMA, read_applications, score_stream
from test_requests import APPLICATION


@pytest.fixture(scope="module")
def fitted(spark, folder):
    book = loan_book(spark, folder)
    model, features, scores = train(book, TrainingConfig(n_trees=5, min_leaf=5))
    path = stage_path(spark, "saved-model")
    model.save(spark, path)
    return book, RiskModel.load(spark, path), features, scores, path


def test_saved_model_gives_the_same_scores(fitted):
    _, model, features, scores, _ = fitted
    again = scoring.score_rows(model, features, "borrower_id").select("borrower_id", F.col("pd_score").alias("again"))
    both = scores.join(again, "borrower_id")
    assert both.count() == features.count()
    assert both.where("pd_score <> again").count() == 0


def test_bands_partition_the_book(fitted):
    _, _, features, scores, _ = fitted
    assert {r.band for r in scores.select("band").distinct().collect()} <= set(fv.BANDS)
    assert scores.where("band IS NULL OR pd_score < 0 OR pd_score > 100").count() == 0


def test_scores_rise_with_the_blend(fitted):
    rows = fitted[3].orderBy("blend").select("pd_score").toPandas().pd_score.to_numpy()
    assert (np.diff(rows) >= -1e-9).all()


def test_report_of_quality(fitted):
    metrics = {(r.metric, r.detail): r.value for r in evaluate(fitted[3]).collect()}
    # The holdout has 33 rows here, so what the model learned is judged on the train rows.
    learned = ranking_metrics(fitted[3].where("split = 'train'"), "pd_score", "default").first()
    assert learned.auc > 0.7
    assert 0 <= metrics["auc", ""] <= 1
    assert metrics["gini", ""] == pytest.approx(2 * metrics["auc", ""] - 1)
    assert sum(v for (m, _), v in metrics.items() if m == "band_distribution_test") == pytest.approx(1)


def test_late_payer_scores_above_clean_one(spark, fitted):
    applications = spark.createDataFrame([
        (1, 50000.0, 29, 24, 400000.0, 200.0, 130.0, "severe_delinquency", "Retail Personal", ""),
        (2, 300000.0, 45, 24, 1800000.0, 15000.0, 15.0, "clean", "SME", ""),
        (3, 300000.0, 45, 24, None, 15000.0, 15.0, "clean", "Unseen segment", ""),
    ], APPLICATION)
    got = {r.application_id: r for r in scoring.score_applications(fitted[1], applications).collect()}
    assert got[1].pd_score > got[2].pd_score
    assert got[3].pd_score is not None


def test_zero_shock_changes_nothing(fitted):
    _, model, features, scores, _ = fitted
    for scenario in fv.STRESS_SCENARIOS:
        after = scoring.stressed_scores(model, features, scenario, 0.0)
        moved = scores.join(after.select("borrower_id", F.col("pd_score").alias("after")), "borrower_id")
        assert moved.where("abs(pd_score - after) > 1e-9").count() == 0


def test_newly_high_is_the_off_diagonal_sum(fitted):
    book, model, features, scores, _ = fitted
    before = scores.select("borrower_id", "band").join(book.select("borrower_id", "exposure_at_risk"), "borrower_id")
    after = scoring.stressed_scores(model, features, "delinquency_shock", 2)
    moves = transition_counts(before, after)
    expected = sum(r.n_loans for r in moves.collect() if r.band_after == "High" and r.band_before != "High")
    assert newly_high(moves).first().newly_high_count == expected
    assert sum(r.n_loans for r in moves.collect()) == features.count()


def test_contributions_add_up_to_the_margin(spark, fitted):
    _, model, features, _, _ = fitted
    rows = scoring.explain_rows(model, features)
    total = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x) + F.col("base_margin")
    assert rows.where(F.abs(total - F.col("gbm_margin")) > 1e-9).count() == 0
    assert rows.where(F.size("reason_codes") != fv.TOP_REASONS).count() == 0


def test_what_if_without_terms_keeps_the_score(spark, fitted):
    _, model, features, _, _ = fitted
    asked = features.select(
        F.col("borrower_id").alias("request_id"), "borrower_id",
        F.lit(None).cast("double").alias("new_rate_pct"), F.lit(None).cast("int").alias("new_tenure_months"),
        F.lit(None).cast("double").alias("new_principal"), F.lit(None).cast("double").alias("new_emi"),
    )
    got = scoring.what_if(model, asked, features)
    assert got.count() == features.count()
    assert got.where("abs(delta) > 1e-9 OR applied_emi IS NOT NULL OR applied_principal IS NOT NULL").count() == 0


def test_importance_is_a_ranked_share(spark, fitted):
    rows = fitted[1].importance(spark).collect()
    shares = [r.importance_pct for r in rows]
    assert shares == sorted(shares, reverse=True) and 0 < sum(shares) <= 100 + 1e-9
    assert len(rows) <= fv.TOP_IMPORTANCES


def test_feature_book_round_trip(spark, fitted, tmp_path):
    features = fitted[2]
    store.write_feature_book(features, str(tmp_path / "plain"))
    back = store.read_book(spark, str(tmp_path / "plain"))
    assert back.columns == [*fv.MODEL_FEATURES, "borrower_id", "rm_note"]
    assert back.count() == features.count()


def test_bucketed_feature_book_joins_without_a_shuffle(spark, fitted, tmp_path):
    store.write_feature_book(fitted[2], str(tmp_path / "bucketed"), table="bucketed_features", buckets=4)
    book = spark.table("bucketed_features")
    joined = book.join(book.select("borrower_id", F.col("AGE").alias("age_again")).hint("merge"), "borrower_id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert joined.count() == fitted[2].count()
    spark.sql("DROP TABLE bucketed_features")


def test_streamed_applications_get_the_same_scores(spark, folder, fitted, tmp_path):
    model = fitted[1]
    table = applications(spark, folder).select(*[f.name for f in APPLICATION_SCHEMA.fields])
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    query = score_stream(
        read_applications(spark, str(tmp_path / "in")), model, str(tmp_path / "out"), str(tmp_path / "state")
    )
    query.awaitTermination(120)
    assert query.exception() is None
    streamed = {r.application_id: r.pd_score for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    at_once = {r.application_id: r.pd_score for r in scoring.score_applications(model, table).collect()}
    assert streamed == at_once and streamed


def test_training_and_rescore_jobs(spark, folder, tmp_path):
    path = str(tmp_path / "job")
    training_job(loan_book(spark, folder), path, TrainingConfig(n_trees=2, min_leaf=5))
    assert store.read_book(spark, f"{path}/scored_book").columns != []
    metrics = {r.metric for r in spark.read.json(f"{path}/metrics_report").collect()}
    assert {"auc", "gini", "ks_statistic", "recall_at_top_20pct", "band_threshold", "feature_importance"} <= metrics
    row = rescore_job(spark, path, str(tmp_path / "again"), 1.5).first()
    assert (row.scored_at, row.n_scored) == (1.5, loan_book(spark, folder).count())
    before = store.read_book(spark, f"{path}/scored_book", ["borrower_id", "pd_score"])
    after = store.read_book(spark, str(tmp_path / "again"), ["borrower_id", "pd_score"])
    assert before.exceptAll(after).count() == 0


def test_memos_are_written_as_records(spark, folder, fitted, tmp_path):
    _, model, features, _, _ = fitted
    details = scoring.loan_details(model, features.where("borrower_id < 20"))
    write_memos(memo_records(details, 1_700_000_000), str(tmp_path / "memos"))
    memos = spark.read.json(str(tmp_path / "memos"))
    assert memos.count() == details.count() > 0
    first = memos.first()
    assert first.memo_id == f"{first.borrower_id}_1700000000"
    assert first.generated_at == "2023-11-14 22:13:20 UTC"
    assert len(first.reason_codes) == fv.TOP_REASONS


def test_unscored_loans_have_no_band(spark):
    from pdengine.functions.bands import band

    rows = spark.createDataFrame([(None,), (50.0,)], "s double").select(band(F.col("s"), F.lit(60.0), F.lit(40.0)).alias("b"))
    assert [r.b for r in rows.collect()] == [None, "Elevated"]


def test_shock_leaves_missing_status_missing(spark, fitted):
    from pdengine.plans.stress import shock

    rows = fitted[0].limit(3).withColumn("PAY_3", F.lit(None).cast("double"))
    for magnitude in (0.0, 2.0):
        assert shock(rows, "delinquency_shock", magnitude).where("PAY_3 IS NOT NULL").count() == 0


def test_applications_come_with_reasons(spark, folder, fitted):
    got = scoring.score_applications(fitted[1], applications(spark, folder))
    assert got.where(F.size("reason_codes") != fv.TOP_REASONS).count() == 0 and got.count() > 0
    assert got.where("round(pd_score, 1) <> pd_score").count() == 0


def test_details_of_requested_loans(spark, fitted):
    _, model, features, _, _ = fitted
    ids = features.select("borrower_id").orderBy("borrower_id").limit(3).unionByName(spark.createDataFrame([(-1,), (-1,)], "borrower_id long"))
    some = scoring.loan_details(model, features, ids)
    assert some.count() == 3
    assert some.exceptAll(scoring.loan_details(model, features)).count() == 0


def test_batches_leave_no_folder_behind(spark, folder, fitted):
    from pdengine.staging import checkpoint_root, scratch

    root = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_root(spark)}/pdengine/{spark.sparkContext.applicationId}")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    before = len(files.listStatus(root))
    for _ in range(2):
        with scratch(spark):
            assert scoring.score_applications(fitted[1], applications(spark, folder)).count() > 0
    assert len(files.listStatus(root)) == before


def test_small_tables_are_scored_in_one_map(spark, folder, fitted):
    model = fitted[1]
    assert model.references.packed() is not None
    scored = scoring.score_applications(model, applications(spark, folder))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "") and "Join" not in plan


def test_large_references_give_the_same_scores(spark, folder, fitted, monkeypatch):
    from pdengine.operators import placed_reference

    path = fitted[4]
    packed = {r.application_id: (r.pd_score, r.band) for r in scoring.score_applications(fitted[1], applications(spark, folder)).collect()}
    monkeypatch.setattr(placed_reference, "PACKED", 0)
    model = RiskModel.load(spark, path)
    assert model.references.packed() is None
    joined = {r.application_id: (r.pd_score, r.band) for r in scoring.score_applications(model, applications(spark, folder)).collect()}
    assert joined == packed and packed


def test_a_model_is_packed_once(spark, folder, fitted):
    model = fitted[1]
    assert model.explainer(spark) is model.explainer(spark)
    first = model.references.packed()
    scoring.score_applications(model, applications(spark, folder)).count()
    assert model.references.packed() is first


def test_rescores_are_published(spark, folder, tmp_path):
    from pdengine.sources import published

    path, target = str(tmp_path / "job"), str(tmp_path / "book")
    training_job(loan_book(spark, folder), path, TrainingConfig(n_trees=1, min_leaf=5))
    rescore_job(spark, path, target, 1.5)
    rescore_job(spark, path, target, 2.5)
    assert published.current(spark, target).published_at == 2.5
    assert store.read_book(spark, target).count() == loan_book(spark, folder).count()


def test_reports_of_a_model_that_learns_its_notes(spark, folder):
    model, features, scores = train(loan_book(spark, folder), TrainingConfig(n_trees=2, min_leaf=5, learned_notes=True))
    assert scores.where("pd_score is null").count() == 0 and features.where("nlp_emb_0 <> 0").count() > 0


def test_queries_use_the_whole_model():
    from pdengine.model_catalog import QUERY_CONFIG

    assert QUERY_CONFIG == TrainingConfig() and QUERY_CONFIG.n_trees == 300
