"""Time the headline queries and print one JSON line.

Each query is planned and run to a sink that keeps nothing. The steps that
write shared tables (book, scorecard, model) are timed as queries of their own.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pdengine import catalog, model_catalog  # noqa: E402
from pdengine.plans import scorecard  # noqa: E402
from pdengine.session import local_session  # noqa: E402
from pdengine.sources.loan_book import derive_accounts, loan_book  # noqa: E402

QUERIES = {
    "derive_accounts": derive_accounts,
    "build_book": loan_book,
    "score_and_band_book": scorecard.scored_book,
    "feature_engineering": catalog.feature_engineering,
    "describe_features": catalog.describe_features,
    "corr_with_default": catalog.corr_with_default,
    "limit_qcut": catalog.limit_qcut,
    "watchlist_page": catalog.watchlist_page,
    "book_summary": catalog.book_summary,
    "segment_band_rollup": catalog.segment_band_rollup,
    "stress_report": catalog.stress_report,
    "what_if_terms": catalog.what_if_terms,
    "performance_report": catalog.performance_report,
    "reason_text": catalog.reason_text_query,
    "memo_records": catalog.memo_records_query,
    "escape_text": catalog.escape_text,
    "train_model": model_catalog.model_scores,
    "rescore_book": model_catalog.rescore_book,
    "score_applications": model_catalog.score_applications,
    "what_if_scores": model_catalog.what_if_scores,
    "model_stress_delinquency": model_catalog.model_stress_delinquency,
    "shap_contributions": model_catalog.shap_contributions,
    "loan_detail": model_catalog.loan_detail,
    "model_performance": model_catalog.model_performance,
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name, query in QUERIES.items():
        start = time.perf_counter()
        query(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    quality = {r.metric: round(r.value, 4) for r in model_catalog.model_performance(spark, folder).where("detail = ''").collect()}
    print(json.dumps({
        "metric": "headline query total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"),
        "quality": quality,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
