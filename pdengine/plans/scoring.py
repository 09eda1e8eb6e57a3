"""Scoring with a fitted model: the book, applications, shocks, what-ifs, details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pdengine import fixed_values as fv
from pdengine.functions.bands import action
from pdengine.functions.features import exposure_at_risk, round_to, with_features
from pdengine.operators.boosting import ROWS_PER_TASK, with_probability
from pdengine.operators.lookup import found
from pdengine.operators.note_vectors import with_components
from pdengine.operators.reasons import contribution, reason_codes, top_contributions
from pdengine.operators.tree_contributions import with_contributions
from pdengine.plans import requests
from pdengine.plans.stress import shock
from pdengine.plans.training import RiskModel, fuse
from pdengine.staging import materialise


def score_rows(
    model: RiskModel, features: DataFrame, key: str, keep: list[str] | None = None, reasons: bool = False
) -> DataFrame:
    """Score feature rows, with ``keep`` columns and, if asked, ``reason_codes``.

    The trees run once per row. Against a packed reference all of it is one
    map. Else raw scores are written once; only key and scores are ranked, what
    else was kept is joined to them on the key.
    """
    raw = model.raw_scores(features)
    wide = [*(keep or []), *(["reason_codes"] if reasons else [])]
    if reasons:
        raw = with_reasons(model, raw)
    raw = raw.select(key, *wide, "gbm_proba", "cox_risk")
    if model.references.packed() is not None:
        return fuse(model, raw, key)
    raw = materialise(raw)
    if not reasons:
        return fuse(model, raw, key)
    scored = fuse(model, raw.select(key, "gbm_proba", "cox_risk"), key)
    return raw.select(key, *wide).join(scored, key)


def rescore_book(model: RiskModel, feature_book: DataFrame, meta: DataFrame) -> DataFrame:
    """Fresh scores for every loan, joined to the book's metadata on the loan key."""
    fresh = score_rows(model, feature_book, "borrower_id").select("borrower_id", "pd_score", "band")
    return meta.join(fresh, "borrower_id", "left")


def application_features(model: RiskModel, applications: DataFrame) -> DataFrame:
    """Valid applications as model rows."""
    valid = requests.accepted(applications, requests.application_reasons())
    filled = requests.fill_defaults(requests.new_loan_rows(valid), model.modes)
    return with_components(with_features(filled), model.text)


def _dealt(asked: DataFrame) -> DataFrame:
    """Requests in as many partitions as they are worth, however few files they lie in; explaining costs far more."""
    parts = -(-asked.count() // ROWS_PER_TASK)
    return asked.repartition(parts) if parts > 1 else asked


def score_applications(model: RiskModel, applications: DataFrame) -> DataFrame:
    """Score, band, action and reasons of each valid application; ``requests.rejects`` names the others."""
    features = application_features(model, _dealt(applications))
    return score_rows(model, features, "application_id", reasons=True).select(
        "application_id", round_to(F.col("pd_score"), 1).alias("pd_score"), "band",
        action(F.col("band")).alias("recommended_action"), "reason_codes",
    )


def stressed_scores(model: RiskModel, feature_book: DataFrame, scenario: str, magnitude: float) -> DataFrame:
    """Scores after a shock; the note components of the feature book are used as they are."""
    return score_rows(model, shock(feature_book, scenario, magnitude), "borrower_id")


def what_if(model: RiskModel, asked: DataFrame, feature_book: DataFrame) -> DataFrame:
    """Score before and after new terms, both in one pass; ``requests.what_if_rejects`` names those without answer."""
    valid = requests.accepted(asked, requests.what_if_reasons())
    both = with_features(requests.what_if_rows(valid, feature_book))
    keep = ["borrower_id", "stage", "applied_emi", "applied_principal"]
    scored = score_rows(model, both, "request_id", keep)

    def at(stage: str, column: str) -> Column:
        return F.max(F.when(F.col("stage") == stage, F.col(column)))

    answers = scored.groupBy("request_id", "borrower_id").agg(
        at("original", "pd_score").alias("original_pd_score"),
        at("original", "band").alias("original_band"),
        at("new", "pd_score").alias("new_pd_score"),
        at("new", "band").alias("new_band"),
        at("new", "applied_emi").alias("applied_emi"),
        at("new", "applied_principal").alias("applied_principal"),
    ).withColumn("delta", F.col("new_pd_score") - F.col("original_pd_score"))
    return answers.withColumns({c: round_to(F.col(c), 1) for c in ("original_pd_score", "new_pd_score", "delta")})


def with_reasons(model: RiskModel, scored: DataFrame, k: int = fv.TOP_REASONS) -> DataFrame:
    """Add ``contributions``, ``base_margin`` and ``reason_codes`` to rows that hold ``feature_values``."""
    explained = with_contributions(scored, model.explainer(scored.sparkSession))
    terms = []
    for i, name in enumerate(fv.MODEL_FEATURES):
        amount = F.col("contributions")[i]
        if name in fv.CATEGORICAL_FEATURES:
            terms.append(contribution(name, None, F.col(name), amount))
        else:
            terms.append(contribution(name, F.col(name), None, amount))
    top = explained.withColumn("top", top_contributions(F.array(*terms), k))
    return top.withColumn("reason_codes", reason_codes(F.col("top"), F.col("rm_note")))


def explain_rows(model: RiskModel, features: DataFrame, k: int = fv.TOP_REASONS) -> DataFrame:
    """Reasons of model rows."""
    return with_reasons(model, with_probability(features, model.trees), k)


def loan_details(model: RiskModel, feature_book: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """PD, band, note, reasons and action of the loans in ``ids``, or of all; one pass over the trees."""
    rows = feature_book if ids is None else found(feature_book, ids)
    rows = rows.withColumn("exposure_at_risk", exposure_at_risk())
    scored = score_rows(model, rows, "borrower_id", ["segment", "exposure_at_risk", "rm_note"], reasons=True)
    return scored.select(
        "borrower_id", "segment", round_to(F.col("exposure_at_risk"), 2).alias("exposure_at_risk"),
        round_to(F.col("pd_score"), 1).alias("pd_score"), "band", "rm_note", "reason_codes",
        action(F.col("band")).alias("recommended_action"),
    )
