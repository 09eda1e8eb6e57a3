"""Whitening against dense linear algebra and whole numbers."""

import math

import numpy as np
import pytest

from pdengine.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, v string, n string, component string"


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_components_of_random_matrices(n):
    rng = np.random.default_rng(n)
    a = rng.standard_normal((3 * n, n))
    v = a.T @ a / n
    values, x = whitening.components(v)
    want, axes = np.linalg.eigh(v)
    assert np.allclose(values, want[::-1], rtol=1e-12) and np.allclose(x.T @ x, np.eye(n), atol=1e-13)
    assert np.allclose(np.abs(np.einsum("ij,ij->j", x, axes[:, ::-1])), 1, atol=1e-10)


def test_components_of_special_matrices():
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((30, 30)))
    for spectrum in (np.ones(30), np.logspace(0, -14, 30), np.r_[np.ones(15), np.zeros(15)], np.r_[np.ones(15), 1 + 1e-12 * np.arange(15)], np.zeros(30)):
        v = (q * spectrum) @ q.T
        v = (v + v.T) / 2
        values, x = whitening.components(v)
        assert np.allclose(values, np.sort(spectrum)[::-1], atol=1e-13) and np.allclose(x.T @ x, np.eye(30), atol=1e-13)
        assert np.abs(v @ x - x * values).max() < 1e-13


def test_polar_factor_is_a_reflection():
    a = np.random.default_rng(2).standard_normal((20, 20))
    a = a + a.T
    u = whitening.polar(a)
    values, x = np.linalg.eigh(a)
    assert np.allclose(u, (x * np.sign(values)) @ x.T, atol=1e-12)


def test_equals_dense_whitening(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    got = whitening.whiten(table.repartition(3)).toPandas()
    ids, e = zip(*[(r.vec_id, r.embedding) for r in table.collect()], strict=True)
    x = np.floor(64 * np.array(e, np.float64)).astype(np.int64) + 10**6
    n, total = len(x), x.sum(axis=0)
    c = x - total / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:32], axes[:, ::-1][:, :32]
    want = c @ axes / np.sqrt(values)
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[list(ids)].to_numpy()
    sign = np.sign((wide * want).sum(axis=0))
    assert np.allclose(wide * sign, want, atol=1e-8) and got.identity_error.max() < 1e-9
    deviation = got.drop_duplicates("vec_id").set_index("vec_id").deviation.loc[list(ids)]
    assert deviation.tolist() == [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, total, strict=True)) for r in x]
    share = got.drop_duplicates("component").sort_values("component").explained
    assert np.allclose(share, values / np.trace(c.T @ c / n), rtol=1e-10)


def test_rows_that_take_no_part_and_flat_components(spark):
    good = [(1, [0.5, 1.0, 2.0]), (2, [0.0, 0.0, 2.0]), (2, [1.0, -1.0, 2.0]), (None, [0.25, 0.0, 2.0])]
    bad = [(3, None), (4, []), (5, [1.0, None, 2.0]), (6, [math.nan, 0.0, 0.0]), (7, [math.inf, 0.0, 0.0]), (8, [1.0, 2.0]), (9, [1e300, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in good + bad], SCHEMA)
    rows = whitening.whiten(table.repartition(2)).collect()
    assert sorted(str(r.vec_id) for r in rows) == sorted(3 * ["1", "2", "2", "None"])
    assert {r.n for r in rows} == {4} and all(r.identity_error < 1e-9 for r in rows)
    assert all((r.whitened is None) == (r.component == 3) for r in rows)
    one = whitening.whiten(table.where("vec_id = 1")).collect()
    assert [(r.whitened, r.explained, r.deviation) for r in one] == [(None, 0.0, 0)] * 3
    out = whitening.whiten(table.limit(0))
    assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_entries_beyond_doubles_whole_numbers(spark):
    rows = [(1, [1e15, 1.0]), (2, [-1e15, 1.0]), (3, [0.0, 5.0])]
    table = spark.createDataFrame([(i, v, "", "", "") for i, v in rows], SCHEMA)
    got = {r.vec_id: r for r in whitening.whiten(table).collect()}
    assert got[1].deviation is None and got[3].deviation is not None and got[1].identity_error < 1e-9
