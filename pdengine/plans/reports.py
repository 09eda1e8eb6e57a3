"""Portfolio reports over a scored book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pdengine import fixed_values as fv
from pdengine.operators.paging import page
from pdengine.operators.metrics import placed_scores, ranking_metrics, recall_at_top
from pdengine.staging import materialise


def money_sum(amount: Column) -> Column:
    """Exact sum of two-decimal amounts, whatever the order of addition."""
    return F.coalesce(F.sum(amount.cast("decimal(18,2)")).cast("double"), F.lit(0.0))


def filter_book(book: DataFrame, segment: str | None = None, band: str | None = None) -> DataFrame:
    """Optional filters; an empty string means no filter."""
    if segment:
        book = book.where(F.col("segment") == segment)
    if band:
        book = book.where(F.col("band") == band)
    return book


def watchlist(book: DataFrame, segment: str | None = None, band: str | None = None) -> DataFrame:
    return filter_book(book, segment, band).select(
        "borrower_id",
        "segment",
        F.round("pd_score", 1).alias("pd_score"),
        "band",
        F.round("exposure_at_risk", 2).alias("exposure_at_risk"),
    )


def watchlist_page(
    book: DataFrame, segment: str | None = None, band: str | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """One page by exposure with ``total``, ``row_from`` and ``row_to`` of the whole list."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must lie in 1..500 and offset must not be negative")
    rows = watchlist(book, segment, band)
    total = rows.agg(F.count(F.lit(1))).scalar()
    listed = page(rows, "exposure_at_risk", "borrower_id", limit, offset)
    return listed.withColumn("total", total).withColumns({
        "row_from": F.lit(offset + 1).cast("long"),
        "row_to": F.least(F.lit(offset + limit).cast("long"), F.col("total")),
    })


def top_risk(book: DataFrame, n: int) -> DataFrame:
    return book.orderBy(F.col("pd_score").desc(), "borrower_id").limit(n)


def hash_sample(book: DataFrame, n: int, draw: Column) -> DataFrame:
    """A repeatable peek at n rows: the n smallest draws."""
    return book.withColumn("_draw", draw).orderBy("_draw", "borrower_id").limit(n).drop("_draw")


def book_summary(book: DataFrame, cuts: DataFrame, last_scored_at: float | None = None) -> DataFrame:
    """Headline figures in one pass over the book, and when it was scored."""
    counts = [F.count(F.when(F.col("band") == b, 1)).alias(f"n_{b.lower()}") for b in fv.BANDS]
    totals = book.agg(
        money_sum(F.col("exposure_at_risk")).alias("total_exposure"),
        F.count(F.lit(1)).alias("total_borrowers"),
        *counts,
        F.sort_array(F.collect_set("segment")).alias("_segments"),
    )
    return totals.select(
        "total_exposure",
        F.round(F.col("total_exposure") / fv.CRORE, 1).alias("total_exposure_crore"),
        "total_borrowers",
        *[f"n_{b.lower()}" for b in fv.BANDS],
        F.concat_ws("|", "_segments").alias("segments"),
        cuts.select("high").scalar().alias("high_cut"),
        cuts.select("elevated").scalar().alias("elevated_cut"),
        F.lit(last_scored_at).cast("double").alias("last_scored_at"),
    )


def segment_band_rollup(book: DataFrame) -> DataFrame:
    """Loans and exposure per segment and band, with subtotals (``ALL``)."""
    rolled = book.rollup("segment", "band").agg(
        F.count(F.lit(1)).alias("n_loans"), money_sum(F.col("exposure_at_risk")).alias("exposure")
    )
    return rolled.withColumns({
        "segment": F.coalesce("segment", F.lit("ALL")),
        "band": F.coalesce("band", F.lit("ALL")),
    })


def transition_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Loans and exposure per (band before, band after): at most a handful of rows.

    ``before(borrower_id, band, exposure_at_risk)``, ``after(borrower_id, band)``.
    Every stress figure is a sum over this table.
    """
    moved = before.select(
        "borrower_id", F.col("band").alias("band_before"), "exposure_at_risk"
    ).join(after.select("borrower_id", F.col("band").alias("band_after")), "borrower_id", "left")
    return moved.groupBy("band_before", "band_after").agg(
        F.count(F.lit(1)).alias("n_loans"), money_sum(F.col("exposure_at_risk")).alias("exposure")
    )


def by_stage(transitions: DataFrame) -> DataFrame:
    """Loans and exposure per stage (before, after) and band."""
    return (
        transitions.unpivot(["n_loans", "exposure"], ["band_before", "band_after"], "stage", "band")
        .where(F.col("band").isNotNull())
        .groupBy(F.replace("stage", F.lit("band_"), F.lit("")).alias("stage"), "band")
        .agg(F.sum("n_loans").alias("n_loans"), F.round(F.sum("exposure"), 2).alias("exposure"))
    )


def _newly_high(column: str) -> Column:
    newly = (F.col("band_before") != "High") & (F.col("band_after") == "High")
    return F.coalesce(F.sum(F.when(newly, F.col(column))), F.lit(0))


def newly_high(transitions: DataFrame) -> DataFrame:
    return transitions.agg(
        _newly_high("n_loans").alias("newly_high_count"),
        F.round(_newly_high("exposure"), 2).alias("newly_high_exposure"),
        F.round(F.sum("exposure"), 2).alias("total_exposure"),
    ).withColumns({
        "newly_high_crore": F.round(F.col("newly_high_exposure") / fv.CRORE, 2),
        "total_crore": F.round(F.col("total_exposure") / fv.CRORE, 1),
    })


def band_compare(transitions: DataFrame) -> DataFrame:
    """The three bands in display order, before beside after, 0 where a band is empty."""
    spark = transitions.sparkSession
    bands = spark.createDataFrame(list(enumerate(fv.BANDS)), "position int, band string")
    wide = by_stage(transitions).groupBy("band").pivot("stage", ["before", "after"]).agg(
        F.sum("n_loans").alias("n"), F.sum("exposure").alias("exposure")
    )
    measures = ["before_n", "after_n", "before_exposure", "after_exposure"]
    return (
        bands.join(wide, "band", "left").select(
            "position", "band", *[F.coalesce(m, F.lit(0)).alias(m) for m in measures]
        )
    )


def stress_report(transitions: DataFrame, scenario: str, magnitude: float) -> DataFrame:
    """The whole stress answer as ``(scenario, magnitude, item, band, value)`` rows."""
    head = [F.lit(scenario).alias("scenario"), F.lit(float(magnitude)).alias("magnitude")]
    bands = by_stage(transitions).select(
        F.explode(
            F.array(
                F.struct(
                    F.concat(F.lit("band_count_"), "stage").alias("item"), "band",
                    F.col("n_loans").cast("double").alias("value"),
                ),
                F.struct(F.concat(F.lit("exposure_"), "stage").alias("item"), "band", F.col("exposure").alias("value")),
            )
        ).alias("r")
    ).select("r.*")
    names = ["newly_high_count", "newly_high_exposure", "total_exposure"]
    totals = newly_high(transitions).select(
        F.explode(
            F.array(*[
                F.struct(F.lit(n).alias("item"), F.lit("ALL").alias("band"), F.col(n).cast("double").alias("value"))
                for n in names
            ])
        ).alias("r")
    ).select("r.*")
    return bands.unionByName(totals).select(*head, "item", "band", "value")


def performance_report(book: DataFrame, score: str = "pd_score", label: str = "default") -> DataFrame:
    """Out-of-time quality of a scored book as ``(metric, detail, value)`` rows."""
    test = book.where(F.col("split") == "test")

    def rows(frame: DataFrame, entries: list[tuple[str, Column, Column]]) -> DataFrame:
        structs = [
            F.struct(F.lit(m).alias("metric"), d.alias("detail"), v.cast("double").alias("value"))
            for m, d, v in entries
        ]
        return frame.select(F.explode(F.array(*structs)).alias("r")).select("r.*")

    none = F.lit("")
    placed = placed_scores(test, score, label)
    quality = rows(
        ranking_metrics(test, score, label, placed=placed), [(m, none, F.col(m)) for m in ("auc", "gini", "ks_statistic")]
    )
    recall = rows(recall_at_top(test, score, label, placed=placed), [("recall_at_top_20pct", none, F.col("recall"))])
    # one pass over the book: a row per split and band
    counted = materialise(book.groupBy("split", "band").agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("positive"), F.count(label).alias("labelled")
    ))
    in_test = F.col("split") == "test"
    sizes = counted.agg(
        F.coalesce(F.sum(F.when(F.col("split") == "train", F.col("n"))), F.lit(0)).alias("n_train"),
        F.coalesce(F.sum(F.when(in_test, F.col("n"))), F.lit(0)).alias("n_test"),
        F.try_divide(F.sum(F.when(in_test, F.col("positive"))), F.sum(F.when(in_test, F.col("labelled")))).alias("test_default_rate"),
    )
    sizes = rows(sizes, [(m, none, F.col(m)) for m in ("n_train", "n_test", "test_default_rate")])
    shares = counted.where(in_test)
    shares = rows(
        shares.withColumn("_total", shares.agg(F.sum("n")).scalar()),
        [("band_distribution_test", F.col("band"), F.col("n") / F.col("_total"))],
    )
    return quality.unionByName(recall).unionByName(sizes).unionByName(shares)


def threshold_rows(spark: SparkSession, high: float, elevated: float) -> DataFrame:
    rows = [("band_threshold", "high", float(high)), ("band_threshold", "elevated", float(elevated))]
    return spark.createDataFrame(rows, "metric string, detail string, value double")


def settings_report(
    book: DataFrame, cuts: DataFrame, horizon: Column, text_model: str, last_scored_at: float | None = None
) -> DataFrame:
    """Configuration and book size as ``(setting, value)`` rows."""
    facts = book.agg(
        F.count(F.lit(1)).alias("_n"), F.concat_ws("|", F.sort_array(F.collect_set("segment"))).alias("_segments")
    )
    number = lambda c: F.round(c.cast("double"), 4).cast("string")
    entries = [
        ("high_cut", number(cuts.select("high").scalar())),
        ("elevated_cut", number(cuts.select("elevated").scalar())),
        ("gbm_blend_weight", number(F.lit(fv.GBM_WEIGHT))),
        ("cox_blend_weight", number(F.lit(fv.COX_WEIGHT))),
        ("cox_horizon_duration", number(horizon)),
        ("text_model", F.lit(text_model)),
        ("segments", F.col("_segments")),
        ("total_borrowers", F.col("_n").cast("string")),
        ("last_scored_at", F.lit(last_scored_at).cast("decimal(20,3)").cast("string")),
    ]
    structs = [F.struct(F.lit(n).alias("setting"), v.alias("value")) for n, v in entries]
    return facts.select(F.explode(F.array(*structs)).alias("r")).select("r.*")
