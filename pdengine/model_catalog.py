"""Registered queries that run the fitted models.

Training happens once per application and folder; the model, its feature book
and its scores are staged and shared by the queries below.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from pdengine import fixed_values as fv
from pdengine.catalog import DELINQUENCY_STEP, MEMO_EPOCH, UTILIZATION_STEP
from pdengine.operators.calibration import apply_isotonic, fit_isotonic
from pdengine.operators.boosting import with_probability
from pdengine.operators.covariance import covariance
from pdengine.operators.list_index import list_page, write_list
from pdengine.operators.lookup import attach
from pdengine.operators.note_vectors import as_vector, fit_notes, fit_vectors, with_components
from pdengine.operators.prefix import prefix_counts
from pdengine.operators.tree_contributions import with_contributions
from pdengine.plans import reports, scorecard, scoring, sketches
from pdengine.plans.fixed_model import fixed
from pdengine.plans.jobs import META_COLS, quality_report, read_feature_book, training_job, write_job
from pdengine.plans.memos import memo_records
from pdengine.plans.training import RiskModel, TrainingConfig
from pdengine.sources import samples, store
from pdengine.sources.loan_book import loan_book, table
from pdengine.staging import stage, stage_artifact, staged_object

QUERY_CONFIG = TrainingConfig()


def _folder(spark: SparkSession, d: str) -> str:
    return stage_artifact(
        spark, f"training:{d}", lambda path: training_job(loan_book(spark, d), path, QUERY_CONFIG)
    )


def _fixed_folder(spark: SparkSession, d: str) -> str:
    """The same for the model whose trees and hazards are given."""
    def build(path: str) -> None:
        book = loan_book(spark, d)
        write_job(book, path, *fixed(book))

    return stage_artifact(spark, f"fixed-model:{d}", build)


def model_of(spark: SparkSession, d: str, job=_folder) -> RiskModel:
    path = f"{job(spark, d)}/model"
    return staged_object(spark, path, lambda: RiskModel.load(spark, path))


def feature_book(spark: SparkSession, d: str, job=_folder) -> DataFrame:
    return read_feature_book(spark, job(spark, d))


def stored_feature_book(spark, d):
    """The feature book that training wrote, read back; SQL cannot repeat its note components."""
    return feature_book(spark, d).select("borrower_id", *fv.NUMERIC_FEATURES, *fv.CATEGORICAL_FEATURES)


def _meta(spark, d):
    return loan_book(spark, d).select(*META_COLS)


def model_scores(spark, d, job=_folder):
    return spark.read.parquet(f"{job(spark, d)}/scores")


def note_vectors(spark, d):
    """The components of each loan's note."""
    model = model_of(spark, d)
    return with_components(loan_book(spark, d).select("borrower_id", "rm_note"), model.text)


def learned_note_vectors(spark, d):
    """Components of notes whose words have vectors learnt from the train notes."""
    book = loan_book(spark, d).select("borrower_id", "split", "rm_note")
    path = stage_artifact(
        spark, f"learned-notes:{d}", lambda p: fit_notes(book.where(F.col("split") == "train"), learned=True).write().overwrite().save(p)
    )
    return with_components(book.select("borrower_id", "rm_note"), PipelineModel.load(path))


def _loan_vectors(spark, d):
    """Notes that come with a vector: each loan takes one of the given embeddings.

    Few vectors serve many loans, so the join spreads the loans of a common vector.
    """
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = vectors.agg(F.count(F.lit(1))).scalar()
    loans = loan_book(spark, d).select("borrower_id", "split").withColumn("vec_id", F.col("borrower_id") % n)
    return attach(loans, vectors, "borrower_id", key="vec_id")


def note_pca(spark, d):
    """Components of the loans' vectors, fitted on train."""
    rows = _loan_vectors(spark, d).withColumn("note_vector", as_vector("embedding"))
    model = fit_vectors(rows.where(F.col("split") == "train"))
    return with_components(rows, model).select("borrower_id", *fv.TEXT_FEATURES)


def note_covariance(spark, d):
    """Covariance of the train loans' vectors, from which their components are taken; the upper half."""
    _, _, cov = covariance(_loan_vectors(spark, d).where(F.col("split") == "train"), "embedding")
    rows = [(i, j, round(float(cov[i, j]), 9)) for i in range(len(cov)) for j in range(i, len(cov))]
    return spark.createDataFrame(rows, "i int, j int, covariance double")


def gbm_scores(spark, d):
    return model_scores(spark, d).select("borrower_id", "split", "gbm_proba")


def cox_fit(spark, d):
    """Coefficients, and the cumulative baseline hazard at every duration."""
    cox = model_of(spark, d).cox
    terms = spark.createDataFrame(list(zip(cox.covariates, cox.beta)), "term string, value double")
    placed = prefix_counts(cox.baseline, "duration", ["hazard"])
    name = F.regexp_replace(F.col("duration").cast("string"), r"\.0$", "")
    hazards = placed.select(
        F.concat(F.lit("hazard_at_"), name).alias("term"), (F.col("less_hazard") + F.col("hazard")).alias("value")
    )
    return terms.unionByName(hazards)


def isotonic_apply(spark, d):
    """Calibration of the scorecard's blend, fitted on train and applied to every loan."""
    blended = scorecard.scores(spark, d).select("borrower_id", "split", "default", "blend")
    model = fit_isotonic(blended.where(F.col("split") == "train"), "blend", "default")
    return apply_isotonic(blended, "blend", model).select(
        "borrower_id", F.round("calibrated", 8).alias("calibrated")
    )


def shap_contributions(spark, d, job=_folder):
    model = model_of(spark, d, job)
    rows = with_probability(feature_book(spark, d, job), model.trees).select(
        "borrower_id", "gbm_margin", "feature_values"
    )
    return with_contributions(rows, model.explainer(spark)).select(
        "borrower_id", "gbm_margin", "base_margin", F.posexplode("contributions").alias("position", "contribution")
    )


def feature_importance(spark, d):
    return model_of(spark, d).importance(spark)


def rescore_book(spark, d, job=_folder):
    return scoring.rescore_book(model_of(spark, d, job), feature_book(spark, d, job), _meta(spark, d))


def _worded(answers: DataFrame) -> DataFrame:
    return answers.withColumn("reason_codes", F.concat_ws(" | ", F.transform("reason_codes", lambda r: r["text"])))


def score_applications(spark, d, job=_folder):
    return _worded(scoring.score_applications(model_of(spark, d, job), samples.applications(spark, d)))


def loan_detail(spark, d, job=_folder):
    return _worded(scoring.loan_details(model_of(spark, d, job), feature_book(spark, d, job)))


def loan_detail_requested(spark, d, job=_folder):
    """Details of the loans asked for; only these go through the trees."""
    asked = samples.requested_ids(spark, d)
    return _worded(scoring.loan_details(model_of(spark, d, job), feature_book(spark, d, job), asked))


def what_if_scores(spark, d, job=_folder):
    return scoring.what_if(model_of(spark, d, job), samples.what_if_requests(spark, d), feature_book(spark, d, job))


def _model_stress(spark, d, scenario, magnitude, job=_folder):
    model = model_of(spark, d, job)
    after = scoring.stressed_scores(model, feature_book(spark, d, job), scenario, magnitude)
    before = model_scores(spark, d, job).select("borrower_id", "band", "exposure_at_risk")
    moved = stage(
        spark, f"model-transitions:{job.__name__}:{scenario}:{magnitude}:{d}", lambda: reports.transition_counts(before, after)
    )
    return reports.stress_report(moved, scenario, magnitude)


def model_stress_utilization(spark, d):
    return _model_stress(spark, d, "utilization_shock", UTILIZATION_STEP)


def model_stress_delinquency(spark, d):
    return _model_stress(spark, d, "delinquency_shock", DELINQUENCY_STEP)


def model_performance(spark, d, job=_folder):
    return quality_report(model_of(spark, d, job), model_scores(spark, d, job))


def memo_batch(spark, d, job=_folder):
    return _worded(memo_records(scoring.loan_details(model_of(spark, d, job), feature_book(spark, d, job)), MEMO_EPOCH))


def write_splits(spark, d):
    """Round trip of the book through its partitioned table."""
    path = stage_artifact(spark, f"splits:{d}", lambda p: store.write_splits(loan_book(spark, d), p))
    both = store.read_split(spark, path, "train").unionByName(store.read_split(spark, path, "test"))
    return both.select("borrower_id", "split", "default", "LIMIT_BAL", "rm_note")


def scored_book(spark, d):
    """Round trip of the scored book, nine columns, both splits."""
    path = stage_artifact(
        spark, f"scored:{d}", lambda p: store.write_scored_book(scorecard.scored_book(spark, d), p)
    )
    return store.read_book(spark, path, store.SCORED_BOOK_COLS)


def _rounded(rows: DataFrame, digits: int, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, digits) for c in columns})


def fixed_gbm_scores(spark, d):
    scored = with_probability(feature_book(spark, d, _fixed_folder), model_of(spark, d, _fixed_folder).trees)
    return _rounded(scored.select("borrower_id", "gbm_margin", "gbm_proba"), 10, "gbm_margin", "gbm_proba")


def fixed_contributions(spark, d):
    """Contributions that are not 0 of every feature of the model whose trees are given."""
    found = shap_contributions(spark, d, _fixed_folder).where("abs(contribution) > 1e-12")
    names = F.array(*[F.lit(n) for n in fv.MODEL_FEATURES])
    return _rounded(
        found.select("borrower_id", "base_margin", F.element_at(names, F.col("position") + 1).alias("feature"), "contribution"),
        9, "base_margin", "contribution",
    )


def fixed_rescore(spark, d):
    return _rounded(rescore_book(spark, d, _fixed_folder).select("borrower_id", "segment", "split", "pd_score", "band"), 8, "pd_score")


def fixed_applications(spark, d):
    return score_applications(spark, d, _fixed_folder).drop("reason_codes")


def fixed_loan_detail(spark, d):
    return loan_detail(spark, d, _fixed_folder)


def fixed_loan_requested(spark, d):
    return loan_detail_requested(spark, d, _fixed_folder)


def fixed_what_if(spark, d):
    return _rounded(what_if_scores(spark, d, _fixed_folder), 6, "applied_emi", "applied_principal")


def fixed_stress_utilization(spark, d):
    return _model_stress(spark, d, "utilization_shock", UTILIZATION_STEP, _fixed_folder)


def fixed_stress_delinquency(spark, d):
    return _model_stress(spark, d, "delinquency_shock", DELINQUENCY_STEP, _fixed_folder)


def fixed_performance(spark, d):
    return _rounded(reports.performance_report(model_scores(spark, d, _fixed_folder)), 8, "value")


def fixed_memo_batch(spark, d):
    return memo_batch(spark, d, _fixed_folder)


def _watchlist_list(spark, d) -> str:
    listed = reports.watchlist(scorecard.scored_book(spark, d))
    return stage_artifact(
        spark, f"watchlist-index:{d}", lambda p: write_list(listed, p, "exposure_at_risk", "borrower_id", ["segment", "band"])
    )


def watchlist_index_page(spark, d):
    """A page deep in one segment's watchlist, from the stored list: only the parts it reaches into are read."""
    path = _watchlist_list(spark, d)
    total = spark.read.parquet(f"{path}/counts").where("segment = 'Credit Card'").agg(F.sum("n")).first()[0] or 0
    return list_page(spark, path, "exposure_at_risk", "borrower_id", 40, max(total - 60, 0), segment="Credit Card")


def describe_sketched(spark, d):
    """The book described from stored sketches of its two splits, without reading the book again."""
    columns = fv.PAY_COLS + fv.ENGINEERED_COLS + ["duration", "event"]
    kept = stage(spark, f"sketches:{d}", lambda: sketches.sketched(loan_book(spark, d), columns, ["split"]))
    found = sketches.described(sketches.merged(kept, []))
    return _rounded(found, 4, *[c for c in found.columns if c not in ("feature", "n")])


MODELLED = {
    "write_splits": write_splits,
    "scored_book": scored_book,
    "isotonic_apply": isotonic_apply,
    "stored_feature_book": stored_feature_book,
    "note_vectors": note_vectors,
    "learned_note_vectors": learned_note_vectors,
    "note_pca": note_pca,
    "note_covariance": note_covariance,
    "gbm_scores": gbm_scores,
    "cox_fit": cox_fit,
    "shap_contributions": shap_contributions,
    "feature_importance": feature_importance,
    "rescore_book": rescore_book,
    "score_applications": score_applications,
    "loan_detail": loan_detail,
    "loan_detail_requested": loan_detail_requested,
    "what_if_scores": what_if_scores,
    "model_stress_utilization": model_stress_utilization,
    "model_stress_delinquency": model_stress_delinquency,
    "model_performance": model_performance,
    "memo_batch": memo_batch,
    "fixed_gbm_scores": fixed_gbm_scores,
    "fixed_contributions": fixed_contributions,
    "fixed_rescore": fixed_rescore,
    "fixed_applications": fixed_applications,
    "fixed_loan_detail": fixed_loan_detail,
    "fixed_loan_requested": fixed_loan_requested,
    "fixed_what_if": fixed_what_if,
    "fixed_stress_utilization": fixed_stress_utilization,
    "fixed_stress_delinquency": fixed_stress_delinquency,
    "fixed_performance": fixed_performance,
    "fixed_memo_batch": fixed_memo_batch,
    "watchlist_index_page": watchlist_index_page,
    "describe_sketched": describe_sketched,
}
