"""Order statistics against brute force, with ties and hot values, for several bucket counts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pdengine.operators.binning import with_quantile_bin
from pdengine.operators.metrics import ranking_metrics, recall_at_top
from pdengine.operators.paging import page
from pdengine.operators.placed_reference import PlacedReference, place, rank_against_placed, rank_against_reference, reached
from pdengine.operators.prefix import exact_quantiles, value_counts

BUCKETS = [2, 3, 16, 300]


@pytest.fixture(scope="module")
def skewed():
    """A third of all rows hold one value, another part a few values, the rest are distinct."""
    rng = np.random.default_rng(5)
    n = 3000
    values = np.where(rng.random(n) < 0.34, 0.5, np.where(rng.random(n) < 0.5, rng.integers(0, 4, n) / 4, rng.random(n)))
    return pd.DataFrame({
        "borrower_id": np.arange(n), "score": values, "other": np.round(rng.random(n), 1),
        "label": (rng.random(n) < 0.2 + 0.5 * values).astype(int), "train": rng.random(n) < 0.7,
    })


def naive_rank(values, reference):
    reference = np.sort(reference)
    below = np.searchsorted(reference, values)
    return np.clip(below, 0, len(reference) - 1) / (len(reference) - 1)


@pytest.mark.parametrize("buckets", BUCKETS)
def test_rank(spark, skewed, buckets):
    rows = spark.createDataFrame(skewed)
    kinds = {"a": "score", "b": "other"}
    references = value_counts(rows.where("train"), kinds)
    got = rank_against_reference(rows, kinds, references, buckets=buckets).toPandas().sort_values("borrower_id")
    train = skewed[skewed.train]
    assert len(got) == len(skewed)
    assert np.allclose(got.a_rank.to_numpy(), naive_rank(skewed.score, train.score), atol=0)
    assert np.allclose(got.b_rank.to_numpy(), naive_rank(skewed.other, train.other), atol=0)


def test_rank_keeps_rows_without_a_value(spark, skewed):
    rows = spark.createDataFrame(skewed).withColumn("score", F.when(F.col("borrower_id") > 9, F.col("score")))
    references = value_counts(rows, {"a": "score"})
    got = rank_against_reference(rows, {"a": "score"}, references)
    assert got.count() == len(skewed)
    assert got.where("a_rank IS NULL").count() == 10


def test_rank_against_one_row(spark):
    rows = spark.createDataFrame([(1, 0.2), (2, 0.9)], "borrower_id long, score double")
    references = value_counts(rows.limit(1), {"a": "score"})
    assert {r.a_rank for r in rank_against_reference(rows, {"a": "score"}, references).collect()} == {0.0}


@pytest.mark.parametrize("buckets", BUCKETS)
def test_quantiles(spark, skewed, buckets):
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.7, 0.9, 1.0]
    got = exact_quantiles(spark.createDataFrame(skewed), "score", probabilities, buckets=buckets).first().quantiles
    assert np.allclose(got, np.quantile(skewed.score, probabilities), atol=1e-12)


def test_quantiles_per_group(spark, skewed):
    rows = spark.createDataFrame(skewed).withColumn("g", F.col("label").cast("string"))
    for row in exact_quantiles(rows, "score", [0.3, 0.5], by="g").collect():
        part = skewed[skewed.label == int(row.g)].score
        assert np.allclose(row.quantiles, np.quantile(part, [0.3, 0.5]), atol=1e-12)


@pytest.mark.parametrize("values", [[1, 1, 1, 1, 2, 3], [5, 5, 5, 5, 5, 5], [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 10, 10]])
def test_quantile_bins_follow_qcut(spark, values):
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    edges = exact_quantiles(rows, "v", [0, 0.2, 0.4, 0.6, 0.8, 1.0])
    got = [r.b for r in with_quantile_bin(rows, "v", edges, "b").orderBy("i").collect()]
    cuts = np.unique(np.quantile(values, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))
    if len(cuts) > 1:
        expected = pd.cut(values, cuts, include_lowest=True, labels=False).tolist()
    else:
        expected = [0] * len(values)
    assert got == expected


@pytest.mark.parametrize("buckets", [2, 16])
@pytest.mark.parametrize("offset", [0, 5, 990, 2980])
def test_deep_pages_equal_sorted_slices(spark, skewed, buckets, offset):
    rows = spark.createDataFrame(skewed)
    ordered = skewed.sort_values(["score", "borrower_id"], ascending=[False, True]).borrower_id.tolist()
    got = [r.borrower_id for r in page(rows, "score", "borrower_id", 40, offset, shallow=0, buckets=buckets).collect()]
    assert got == ordered[offset : offset + 40]
    shallow = [r.borrower_id for r in page(rows, "score", "borrower_id", 40, offset).collect()]
    assert shallow == got


@pytest.mark.parametrize("buckets", [2, 16])
def test_metrics_against_brute_force(spark, skewed, buckets):
    row = ranking_metrics(spark.createDataFrame(skewed), "score", "label", buckets).first()
    pos, neg = (skewed[skewed.label == k].score.to_numpy() for k in (1, 0))
    pairs = pos[:, None] - neg[None, :]
    auc = ((pairs > 0) + 0.5 * (pairs == 0)).mean()
    cuts = np.unique(skewed.score)
    ks = max(abs((pos >= c).mean() - (neg >= c).mean()) for c in cuts)
    assert row.auc == pytest.approx(auc, abs=1e-12)
    assert row.gini == pytest.approx(2 * auc - 1, abs=1e-12)
    assert row.ks_statistic == pytest.approx(ks, abs=1e-12)
    assert (row.n_rows, row.n_positive) == (len(skewed), len(pos))


@pytest.mark.parametrize("share", [0.0001, 0.2, 0.5, 1.0])
def test_recall_with_a_large_tie_at_the_boundary(spark, skewed, share):
    row = recall_at_top(spark.createDataFrame(skewed), "score", "label", share=share).first()
    ordered = skewed.sort_values(["score", "borrower_id"], ascending=[False, True])
    k = max(1, int(len(skewed) * share))
    assert row.n_top == k
    assert row.recall == pytest.approx(ordered.label[:k].sum() / skewed.label.sum(), abs=1e-12)


def test_recall_without_positives(spark, skewed):
    assert recall_at_top(spark.createDataFrame(skewed.assign(label=0)), "score", "label").first().recall == 0.0


def test_metrics_leave_unscored_rows_out(spark):
    rows = [(1, 0.9, 1), (2, 0.8, 0), (3, 0.7, 1), (4, 0.1, 0)]
    scored = spark.createDataFrame(rows, "borrower_id long, score double, label int")
    more = spark.createDataFrame([*rows, (5, None, 1), (6, None, 0)], scored.schema)
    one, two = ranking_metrics(scored, "score", "label").first(), ranking_metrics(more, "score", "label").first()
    assert one[:-1] == two[:-1] and (one.auc, one.ks_statistic, two.n_unscored) == (0.75, 0.5, 2)
    assert recall_at_top(scored, "score", "label").first() == recall_at_top(more, "score", "label").first()


@pytest.mark.parametrize("offset", [0, 9, 14, 18])
def test_pages_across_rows_without_a_value(spark, offset):
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else float(i % 6)) for i in range(20)], "k long, v double")
    pages = [[r.k for r in page(rows, "v", "k", 5, offset, shallow=s, buckets=3).collect()] for s in (0, 100)]
    ordered = sorted(range(20), key=lambda i: (i % 4 == 0, 0 if i % 4 == 0 else -(i % 6), i))
    assert pages == [ordered[offset : offset + 5]] * 2


def test_placed_reference_survives_its_folder(spark, skewed, tmp_path):
    rows = spark.createDataFrame(skewed)
    placed = place(value_counts(rows.where("train"), {"a": "score"}), 40)
    placed.save(str(tmp_path / "placed"))
    back = PlacedReference.load(spark, str(tmp_path / "placed"))
    got = rank_against_placed(rows, {"a": "score"}, back).toPandas().sort_values("borrower_id")
    assert np.allclose(got.a_rank.to_numpy(), naive_rank(skewed.score, skewed[skewed.train].score), atol=0)
    few = rank_against_placed(rows.where("borrower_id < 3"), {"a": "score"}, back)
    assert few.count() == 3


def test_few_requests_read_few_buckets(spark, skewed, tmp_path):
    """Scoring reads only the folders its values fall into, and sorts nothing else."""
    rows = spark.createDataFrame(skewed)
    place(value_counts(rows, {"a": "score"}), 40).save(str(tmp_path / "placed"))
    back = PlacedReference.load(spark, str(tmp_path / "placed"))
    asked = spark.createDataFrame([("a", back.values.first()["bucket"])], "kind string, bucket int")
    hit = reached(back, asked)
    scan = hit._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in scan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert 0 < hit.count() < back.values.count() and reached(back, asked.limit(0)).count() == 0
