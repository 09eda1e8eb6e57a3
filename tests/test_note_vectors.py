"""Covariance, components with fixed signs, and word vectors learnt from neighbours."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pdengine.operators import cooccurrence as co
from pdengine.operators.covariance import covariance, merged, principal_components
from pdengine.operators.note_vectors import fit_notes, fit_vectors, as_vector, with_components


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_covariance_on_any_partitioning(spark, parts):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 6)) @ rng.standard_normal((6, 6)) + 1e6
    rows = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,), ([1.0, None, 0.0, 0.0, 0.0, 0.0],)], "v array<double>")
    n, mean, cov = covariance(rows.repartition(parts), "v")
    assert n == 500 and np.allclose(mean, x.mean(axis=0), rtol=1e-13)
    assert np.allclose(cov, np.cov(x.T, bias=True), rtol=1e-9, atol=1e-9)


def test_rows_with_null_or_nan_entries_take_no_part_and_are_told_without_a_function_per_entry(spark):
    nan = float("nan")
    given = [([1.0, 2.0],), ([3.0, 5.0],), ([nan, 1.0],), ([None, 1.0],), ([None, nan],), ([None],), (None,), ([0.0, 4.0],)]
    plans, select = [], type(spark.range(1)).mapInArrow

    def seen(self, *args, **more):
        plans.append(self._jdf.queryExecution().optimizedPlan().toString())
        return select(self, *args, **more)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(spark.range(1)), "mapInArrow", seen)
        n, mean, cov = covariance(spark.createDataFrame(given, "v array<float>").coalesce(1), "v")
    x = np.array([[1, 2], [3, 5], [0, 4]], float)
    assert n == 3 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T, bias=True))
    assert not any("lambda" in p for p in plans)


def test_moments_merge_in_any_order():
    rng = np.random.default_rng(3)
    parts = [rng.standard_normal((k, 3)) + 100 for k in (1, 5, 40, 2)]
    each = [(float(len(p)), p.mean(axis=0), (p - p.mean(axis=0)).T @ (p - p.mean(axis=0))) for p in parts]
    for order in ([0, 1, 2, 3], [3, 1, 0, 2]):
        total = (0.0, None, None)
        for i in order:
            total = merged(total, each[i])
        whole = np.concatenate(parts)
        assert np.allclose(total[2] / total[0], np.cov(whole.T, bias=True))


def test_components_are_orthonormal_with_fixed_signs(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 8)) * np.arange(1, 9)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, e array<double>").withColumn("note_vector", as_vector("e"))
    axes, shares = principal_components(np.cov(x.T, bias=True), 4)
    assert np.allclose(axes.T @ axes, np.eye(4)) and (axes[np.abs(axes).argmax(axis=0), range(4)] > 0).all()
    assert (np.diff(shares) <= 0).all()
    got = []
    for parts in (1, 9):
        done = with_components(rows.repartition(parts), fit_vectors(rows.repartition(parts), 4)).orderBy("i")
        got.append(np.array([[r[f"nlp_emb_{k}"] for k in range(4)] for r in done.collect()]))
    assert np.allclose(got[0], got[1], atol=1e-9) and np.allclose(got[0], (x - x.mean(axis=0)) @ axes, atol=1e-9)


NOTES = [
    "borrower pays late every month", "client pays late every month", "borrower pays early every month", "client pays early every month",
    "borrower calls about harvest loan", "client calls about harvest loan", "the shop sells tools", "the store sells tools", "the shop sells seeds",
    "the store sells seeds", None, "",
] * 3


def test_near_counts_equal_a_plain_count(spark):
    texts = spark.createDataFrame([((n or "").split() or None,) for n in NOTES], "w array<string>").repartition(3)
    names = co.frequent_words(texts, "w", 12)
    place = {w: i for i, w in enumerate(names)}
    want = defaultdict(float)
    for note in NOTES:
        words = (note or "").split()
        for i, a in enumerate(words):
            for step in range(1, 4):
                if i + step < len(words) and a in place and words[i + step] in place:
                    one, two = place[a], place[words[i + step]]
                    want[one, two] += 1 / step
                    want[two, one] += 1 / step
    got = {(r.a, r.b): r.n for r in co.near_counts(texts, "w", names, 3).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    total = sum(want.values())
    rows = defaultdict(float)
    for (a, _), n in want.items():
        rows[a] += n
    info = {(r.a, r.b): r.v for r in co.information(co.near_counts(texts, "w", names, 3)).collect()}
    plain = {k: np.log(n * total / rows[k[0]] / rows[k[1]]) for k, n in want.items()}
    assert info.keys() == {k for k, v in plain.items() if v > 1e-15} and all(info[k] == pytest.approx(plain[k]) for k in info)


def test_leading_part_is_as_good_as_the_dense_one(spark):
    rng = np.random.default_rng(7)
    a = rng.random((120, 120)) * (rng.random((120, 120)) < 0.15)
    a = a + a.T
    table = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "a long, b long, v double").repartition(5, "a")
    for rank in (3, 10):
        values, axes = co.leading(table, 120, rank)
        s = np.linalg.svd(a, compute_uv=False)
        best = np.sqrt((s[rank:] ** 2).sum())
        assert np.allclose(axes.T @ axes, np.eye(rank), atol=1e-10)
        assert np.linalg.norm(a - (axes * values) @ axes.T) <= 1.03 * best


def test_words_used_alike_get_vectors_alike(spark):
    texts = spark.createDataFrame([((n or "").split(),) for n in NOTES], "w array<string>")
    names, vectors = co.word_vectors(texts, "w", 6)
    at = lambda w: vectors[names.index(w)] / np.linalg.norm(vectors[names.index(w)])
    assert at("shop") @ at("store") > 0.9 > at("shop") @ at("late") + 0.5
    assert co.word_vectors(texts.limit(0), "w", 6)[0] == []


def test_learned_notes_as_components(spark, tmp_path):
    notes = spark.createDataFrame([(i, n) for i, n in enumerate(NOTES)], "i int, rm_note string")
    model = fit_notes(notes, components=3, learned=True, word_dims=5)
    rows = with_components(notes, model).orderBy("i").collect()
    part = np.array([[r[f"nlp_emb_{k}"] for k in range(3)] for r in rows])
    assert np.isfinite(part).all() and np.allclose(part[:12], part[12:24])
    assert np.linalg.norm(part[6] - part[7]) < 0.3 * np.linalg.norm(part[6] - part[0])
    from pyspark.ml import PipelineModel

    model.write().overwrite().save(str(tmp_path / "notes"))
    again = with_components(notes, PipelineModel.load(str(tmp_path / "notes"))).orderBy("i").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in rows]
    assert fit_notes(notes.limit(0).union(notes.limit(1)), components=2, learned=True) is not None
    assert with_components(notes.select("i", F.lit(None).cast("string").alias("rm_note")), model).count() == len(NOTES)
