"""Registered queries: each takes a session and a folder of source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pdengine import fixed_values as fv
from pdengine.functions.bands import action
from pdengine.functions.features import (
    duration,
    exposure_at_risk,
    pay_ratio,
    recode_categories,
    round_to,
    with_features,
)
from pdengine.functions.finance import emi
from pdengine.functions.hashing import hash_uniform
from pdengine.functions.wording import escape_xml, memo_summary, reason_text
from pdengine.operators import lookup
from pdengine.operators.binning import with_quantile_bin
from pdengine.operators.cox import CoxModel
from pdengine.operators.metrics import ranking_metrics, recall_at_top
from pdengine.operators.paging import page
from pdengine.operators.prefix import exact_quantiles
from pdengine.operators.reasons import contribution, reason_codes
from pdengine.operators.scaling import column_stats, zscore
from pdengine.plans import explore, reports, requests, scorecard
from pdengine.plans.fusion import banded
from pdengine.plans.memos import memo_records
from pdengine.plans.stress import shock
from pdengine.sources import accounts, samples
from pdengine.sources.loan_book import accounts_of, derive_accounts, loan_book, raw_accounts, table
from pdengine.staging import stage, stage_artifact

MEMO_EPOCH = 1_700_000_000
UTILIZATION_STEP, DELINQUENCY_STEP = 20.0, 1.0
COX_NUMERIC = [c for c in fv.COX_COVARIATES if c not in fv.TEXT_FEATURES]


def src_accounts(spark: SparkSession, d: str) -> DataFrame:
    return derive_accounts(spark, d)


def account_rejects(spark, d):
    """Cells of a raw CSV that are no numbers; the file stands in for a delivery with some broken fields."""
    raw = raw_accounts(*[table(spark, d, n) for n in ("customer", "orders", "lineitem")])
    broken = raw.withColumns({
        "LIMIT_BAL": F.when(F.col("ID") % 50 == 7, "n/a").otherwise(F.col("LIMIT_BAL").cast("string")),
        "PAY_0": F.when(F.col("ID") % 60 == 3, "late").otherwise(F.col("PAY_0").cast("string")),
    })
    path = stage_artifact(spark, f"raw-csv:{d}", lambda p: broken.write.option("header", True).csv(p))
    return accounts.account_rejects(spark, path).drop("file")


def book_scan(spark, d):
    return loan_book(spark, d).select("borrower_id", *fv.NUMERIC_FEATURES, *fv.CATEGORICAL_FEATURES)


def clean_recode(spark, d):
    return recode_categories(accounts_of(spark, d)).select("borrower_id", "SEX", "EDUCATION", "MARRIAGE")


def feature_engineering(spark, d):
    return with_features(accounts_of(spark, d)).select("borrower_id", *fv.ENGINEERED_COLS)


def pay_ratio_train(spark, d):
    return accounts_of(spark, d).select("borrower_id", pay_ratio("train").alias("avg_pay_ratio"))


def pay_ratio_serve(spark, d):
    return accounts_of(spark, d).select("borrower_id", pay_ratio("serve").alias("avg_pay_ratio"))


def exposure(spark, d):
    return with_features(accounts_of(spark, d)).select(
        "borrower_id", exposure_at_risk().alias("exposure_at_risk")
    )


def survival_columns(spark, d):
    return accounts_of(spark, d).select(
        "borrower_id", duration().alias("duration"), F.col("default").alias("event")
    )


def zscores(spark, d):
    book = loan_book(spark, d)
    stats = column_stats(book.where(F.col("split") == "train"), COX_NUMERIC)
    return zscore(book, COX_NUMERIC, stats).select(
        "borrower_id", *[F.round(f"z_{c}", 6).alias(f"z_{c}") for c in COX_NUMERIC]
    )


def blend_query(spark, d):
    return scorecard.scores(spark, d).select(
        "borrower_id", *[F.round(c, 8).alias(c) for c in ("gbm_rank", "cox_rank", "blend")], "pd_score"
    )


def assign_band(spark, d):
    return scorecard.scored_book(spark, d).select("borrower_id", "pd_score", "band")


def recommended_action(spark, d):
    return scorecard.scored_book(spark, d).select(
        "borrower_id", "band", action(F.col("band")).alias("recommended_action")
    )


def emi_query(spark, d):
    b = F.col("borrower_id")
    terms = loan_book(spark, d).select(
        b,
        F.col("BILL_AMT1").alias("principal"),
        (b % 25).cast("double").alias("rate_pct"),
        (1 + b % 360).cast("int").alias("tenure_months"),
    )
    level = emi(F.col("principal"), F.col("rate_pct"), F.col("tenure_months"))
    return terms.withColumn("emi", round_to(level, 6))


def _valid_applications(spark, d):
    return requests.accepted(samples.applications(spark, d), requests.application_reasons())


def new_loan_rows(spark, d):
    return requests.new_loan_rows(_valid_applications(spark, d))


def fill_defaults(spark, d):
    rows = requests.new_loan_rows(_valid_applications(spark, d))
    filled = requests.fill_defaults(rows, explore.category_modes(loan_book(spark, d)))
    return filled.select("application_id", *fv.CATEGORICAL_FEATURES)


def request_rejects(spark, d):
    return requests.rejects(
        samples.applications(spark, d), requests.application_reasons(), "application_id"
    )


def reason_text_query(spark, d):
    """Every wording over every loan: 27 numbers, 4 categories, a note component, an unlisted column."""
    b = F.col("borrower_id")
    names = fv.NUMERIC_FEATURES + fv.CATEGORICAL_FEATURES + ["nlp_emb_0", "limit_bin"]
    entries = []
    for i, name in enumerate(names):
        amount = F.when((b + i) % 2 == 0, 1.0).otherwise(-1.0)
        if name in fv.CATEGORICAL_FEATURES:
            entries.append(contribution(name, None, F.col(name), amount))
        elif name == "nlp_emb_0":
            entries.append(contribution(name, None, None, amount))
        else:
            entries.append(contribution(name, F.col(name), None, amount))
    exploded = loan_book(spark, d).select(b, "rm_note", F.explode(F.array(*entries)).alias("c"))
    text = reason_text(
        F.col("c.feature"), F.col("c.value"), F.col("c.category"), F.col("c.amount"), F.col("rm_note")
    )
    return exploded.select("borrower_id", F.col("c.feature").alias("feature"), text.alias("reason"))


def _explained(spark, d):
    """Scored loans with the reason codes of the scorecard; joined on the unique loan key."""
    explained = scorecard.top_reasons(loan_book(spark, d)).select(
        "borrower_id", "top", reason_codes(F.col("top"), F.col("rm_note")).alias("reason_codes")
    )
    return scorecard.scored_book(spark, d).join(explained, "borrower_id")


def memo_summary_query(spark, d):
    summary = memo_summary(
        F.col("borrower_id"), F.col("segment"), F.round("exposure_at_risk", 2),
        F.round("pd_score", 1), F.col("band"), F.col("reason_codes"),
    )
    return _explained(spark, d).select("borrower_id", summary.alias("summary"))


def memo_records_query(spark, d):
    memos = memo_records(_explained(spark, d), MEMO_EPOCH)
    reasons = F.concat_ws(" | ", F.transform("reason_codes", lambda r: r["text"]))
    return memos.withColumn("reason_codes", reasons)


def escape_text(spark, d):
    return table(spark, d, "documents").select("doc_id", escape_xml(F.col("text")).alias("escaped"))


def watchlist(spark, d):
    return reports.watchlist(scorecard.scored_book(spark, d), "SME", "High")


def oot_split(spark, d):
    return loan_book(spark, d).select("borrower_id", "loan_vintage_month", "split")


def limit_qcut(spark, d):
    accounts = accounts_of(spark, d)
    edges = exact_quantiles(accounts, "LIMIT_BAL", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])
    return with_quantile_bin(accounts, "LIMIT_BAL", edges, "limit_bin").select(
        "borrower_id", "LIMIT_BAL", "limit_bin"
    )


def assign_segment(spark, d):
    return loan_book(spark, d).select("borrower_id", "segment")


def rm_note(spark, d):
    return loan_book(spark, d).select("borrower_id", "rm_note")


def union_splits(spark, d):
    columns = ["borrower_id", "split", "default", "pd_score"]
    scored = scorecard.scored_book(spark, d).select(*columns)
    return scored.where(F.col("split") == "train").unionByName(scored.where(F.col("split") == "test"))


def loan_lookup(spark, d):
    return lookup.found(scorecard.scored_book(spark, d), samples.requested_ids(spark, d)).select(
        "borrower_id", "segment", "pd_score", "band"
    )


def loan_missing(spark, d):
    return lookup.missing(samples.requested_ids(spark, d), scorecard.scored_book(spark, d))


def book_join_scores(spark, d):
    meta = loan_book(spark, d).select("borrower_id", "segment", "exposure_at_risk", "default", "split")
    return scorecard.join_scores(meta, scorecard.scores(spark, d).select("borrower_id", "pd_score"))


def rank_reference(spark, d):
    return scorecard.scores(spark, d).select(
        "borrower_id", "frozen_gbm", "frozen_cox",
        F.round("gbm_rank", 8).alias("gbm_rank"), F.round("cox_rank", 8).alias("cox_rank"),
    )


def cox_risk(spark, d):
    """Risk at the horizon of a hazard model with the scorecard's coefficients."""
    beta = scorecard.COX_BETA
    model = CoxModel(list(beta), list(beta.values()), [1.0, 6.0], [scorecard.BASE_HAZARD / 2, scorecard.BASE_HAZARD])
    return loan_book(spark, d).select("borrower_id", F.round(model.risk(), 6).alias("frozen_cox"))


def default_rate_by_split(spark, d):
    return explore.default_rate(loan_book(spark, d), "split").withColumn(
        "default_rate", F.round("default_rate", 8)
    )


def default_rate_overall(spark, d):
    return explore.default_rate(loan_book(spark, d)).withColumn("default_rate", F.round("default_rate", 8))


def default_rate_by_pay1(spark, d):
    return explore.default_rate(loan_book(spark, d), "PAY_1").withColumn(
        "default_rate", F.round("default_rate", 8)
    )


def describe_features(spark, d):
    columns = fv.PAY_COLS + fv.ENGINEERED_COLS + ["duration", "event"]
    described = explore.describe(loan_book(spark, d), columns)
    return described.select("feature", *[F.round(c, 4).alias(c) for c in described.columns if c != "feature"])


def corr_with_default(spark, d):
    return explore.correlation_with_default(loan_book(spark, d), fv.RAW_NUMERIC_COLS).withColumn(
        "corr", F.round("corr", 8)
    )


def value_shares(spark, d):
    shares = explore.value_shares(
        scorecard.scored_book(spark, d), ["default", "segment", "band"]
    )
    return shares.withColumn("share", F.round("share", 8))


def category_modes(spark, d):
    return explore.category_modes(loan_book(spark, d))


def book_summary(spark, d):
    book, scored_at = scorecard.published_book(spark, d, MEMO_EPOCH)
    summary = reports.book_summary(book, scorecard.cuts(spark, d), scored_at)
    return summary.withColumns({c: F.round(c, 4) for c in ("high_cut", "elevated_cut")})


def segment_band_rollup(spark, d):
    return reports.segment_band_rollup(scorecard.scored_book(spark, d))


def band_cuts(spark, d):
    return scorecard.cuts(spark, d).select(
        F.round("high", 6).alias("high"), F.round("elevated", 6).alias("elevated")
    )


def horizon(spark, d):
    return loan_book(spark, d).where(F.col("split") == "train").agg(F.max("duration").alias("horizon"))


def _test_rows(spark, d):
    return scorecard.scored_book(spark, d).where(F.col("split") == "test")


def auc_gini(spark, d):
    return ranking_metrics(_test_rows(spark, d), "pd_score", "default").select(
        F.round("auc", 10).alias("auc"), F.round("gini", 10).alias("gini"), "n_rows", "n_positive"
    )


def ks(spark, d):
    return ranking_metrics(_test_rows(spark, d), "pd_score", "default").select(
        F.round("ks_statistic", 10).alias("ks_statistic")
    )


def recall_top20(spark, d):
    return recall_at_top(_test_rows(spark, d), "pd_score", "default").withColumn(
        "recall", F.round("recall", 10)
    )


def reason_topk(spark, d):
    ranked = scorecard.top_reasons(loan_book(spark, d), 3)
    return ranked.select("borrower_id", F.posexplode("top").alias("place", "c")).select(
        "borrower_id",
        (F.col("place") + 1).alias("place"),
        F.col("c.feature").alias("feature"),
        F.round("c.amount", 8).alias("contribution"),
    )


def watchlist_page(spark, d):
    return reports.watchlist_page(scorecard.scored_book(spark, d), segment="SME", limit=50, offset=20)


def watchlist_deep_page(spark, d):
    """A page by counted positions, across the border to loans without a value."""
    rows = scorecard.scored_book(spark, d).select(
        "borrower_id", "segment", F.when(F.col("borrower_id") % 7 > 0, F.col("exposure_at_risk")).alias("exposure_at_risk")
    )
    valued = rows.agg(F.count("exposure_at_risk").alias("n")).first()["n"]
    return page(rows, "exposure_at_risk", "borrower_id", 60, max(valued - 30, 0), shallow=0)


def what_if_rejects(spark, d):
    return requests.what_if_rejects(samples.unchecked_what_ifs(spark, d), loan_book(spark, d))


def top_risk(spark, d):
    """The reasons are worked out for the n loans only."""
    top = reports.top_risk(scorecard.scored_book(spark, d), 10)
    loans = loan_book(spark, d).join(F.broadcast(top.select("borrower_id", "pd_score", "band")), "borrower_id")
    coded = scorecard.top_reasons(loans).withColumn("codes", reason_codes(F.col("top"), F.col("rm_note")))
    return coded.select(
        "borrower_id", "pd_score", "band",
        F.concat_ws(" | ", F.transform("codes", lambda r: r["text"])).alias("reasons"),
        action(F.col("band")).alias("recommended_action"),
    )


def note_sample(spark, d):
    book = loan_book(spark, d).select("borrower_id", "delinquency_trend", "months_delinquent", "rm_note")
    return reports.hash_sample(book, 5, hash_uniform(F.col("borrower_id"), 7919))


def _shocked(spark, d, scenario, magnitude):
    return shock(loan_book(spark, d), scenario, magnitude)


def _shocked_features(spark, d, scenario, magnitude):
    return _shocked(spark, d, scenario, magnitude).select(
        "borrower_id",
        *[F.round(F.col(c).cast("double"), 6).alias(c) for c in fv.ENGINEERED_COLS],
    )


def stress_utilization(spark, d):
    return _shocked_features(spark, d, "utilization_shock", UTILIZATION_STEP)


def stress_delinquency(spark, d):
    return _shocked_features(spark, d, "delinquency_shock", DELINQUENCY_STEP)


def _transitions(spark, d, scenario, magnitude):
    def build():
        shocked = scorecard.with_scores(_shocked(spark, d, scenario, magnitude)).select(
            "borrower_id", "frozen_gbm", "frozen_cox"
        )
        after = scorecard.fuse(shocked, scorecard.references(spark, d))
        after = after.withColumn("band", banded(F.col("pd_score"), scorecard.cuts(spark, d)))
        return reports.transition_counts(scorecard.scored_book(spark, d), after)

    return stage(spark, f"transitions:{scenario}:{magnitude}:{d}", build)


def stress_transition(spark, d):
    return _transitions(spark, d, "delinquency_shock", DELINQUENCY_STEP)


def stress_by_band(spark, d):
    return reports.by_stage(_transitions(spark, d, "delinquency_shock", DELINQUENCY_STEP))


def newly_high(spark, d):
    return reports.newly_high(_transitions(spark, d, "delinquency_shock", DELINQUENCY_STEP))


def band_compare(spark, d):
    return reports.band_compare(_transitions(spark, d, "delinquency_shock", DELINQUENCY_STEP))


def stress_report(spark, d):
    return reports.stress_report(
        _transitions(spark, d, "utilization_shock", UTILIZATION_STEP), "utilization_shock", UTILIZATION_STEP
    )


def what_if_terms(spark, d):
    asked = requests.accepted(samples.what_if_requests(spark, d), requests.what_if_reasons())
    versions = requests.what_if_rows(asked, loan_book(spark, d))
    return with_features(versions.where(F.col("stage") == "new")).select(
        "request_id", "borrower_id",
        *[round_to(F.col(c), 6).alias(c) for c in ("applied_emi", "applied_principal", "avg_util_ratio", "avg_pay_ratio")],
    )


def performance_report(spark, d):
    return reports.performance_report(scorecard.scored_book(spark, d)).withColumn("value", F.round("value", 8))


def settings_report(spark, d):
    horizon_value = horizon(spark, d).scalar()
    book, scored_at = scorecard.published_book(spark, d, MEMO_EPOCH)
    return reports.settings_report(book, scorecard.cuts(spark, d), horizon_value, "hashed tf-idf", scored_at)


CHECKED = {
    "src_accounts": src_accounts,
    "account_rejects": account_rejects,
    "book_scan": book_scan,
    "clean_recode": clean_recode,
    "feature_engineering": feature_engineering,
    "pay_ratio_train": pay_ratio_train,
    "pay_ratio_serve": pay_ratio_serve,
    "exposure": exposure,
    "survival_columns": survival_columns,
    "zscore": zscores,
    "blend": blend_query,
    "assign_band": assign_band,
    "recommended_action": recommended_action,
    "emi": emi_query,
    "new_loan_rows": new_loan_rows,
    "fill_defaults": fill_defaults,
    "request_rejects": request_rejects,
    "reason_text": reason_text_query,
    "memo_summary": memo_summary_query,
    "memo_records": memo_records_query,
    "escape_text": escape_text,
    "watchlist": watchlist,
    "oot_split": oot_split,
    "newly_high": newly_high,
    "loan_lookup": loan_lookup,
    "loan_missing": loan_missing,
    "book_join_scores": book_join_scores,
    "stress_transition": stress_transition,
    "rank_reference": rank_reference,
    "cox_risk": cox_risk,
    "default_rate_overall": default_rate_overall,
    "default_rate_by_split": default_rate_by_split,
    "default_rate_by_pay1": default_rate_by_pay1,
    "describe_features": describe_features,
    "corr_with_default": corr_with_default,
    "value_shares": value_shares,
    "category_modes": category_modes,
    "book_summary": book_summary,
    "segment_band_rollup": segment_band_rollup,
    "stress_by_band": stress_by_band,
    "band_compare": band_compare,
    "band_cuts": band_cuts,
    "horizon": horizon,
    "auc_gini": auc_gini,
    "ks": ks,
    "recall_top20": recall_top20,
    "limit_qcut": limit_qcut,
    "reason_topk": reason_topk,
    "watchlist_page": watchlist_page,
    "watchlist_deep_page": watchlist_deep_page,
    "what_if_rejects": what_if_rejects,
    "top_risk": top_risk,
    "note_sample": note_sample,
    "union_splits": union_splits,
    "assign_segment": assign_segment,
    "rm_note": rm_note,
    "stress_utilization": stress_utilization,
    "stress_delinquency": stress_delinquency,
    "stress_report": stress_report,
    "what_if_terms": what_if_terms,
    "performance_report": performance_report,
    "settings_report": settings_report,
}
