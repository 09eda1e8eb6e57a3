"""Tree contributions against their definition, by enumerating coalitions."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd

from pdengine.operators import tree_contributions
from pdengine.operators.tree_contributions import contributions_of, explained_trees


def node(tree, number, prediction, count, left=-1, right=-1, feature=-1, split=(), categories=-1, weight=1.0):
    return {
        "treeID": tree, "id": number, "prediction": prediction, "rawCount": count, "leftChild": left,
        "rightChild": right, "weight": weight,
        "split": {"featureIndex": feature, "leftCategoriesOrThreshold": list(split), "numCategories": categories},
    }


NODES = pd.DataFrame([
    node(0, 0, 0.1, 100, 1, 2, 0, [0.5]),
    node(0, 1, 0.2, 60, 3, 4, 1, [0.0, 2.0], 3),
    node(0, 2, -0.5, 40, 5, 6, 0, [0.8]),
    node(0, 3, 1.0, 25), node(0, 4, -0.3, 35), node(0, 5, 0.7, 10), node(0, 6, -0.9, 30),
    node(1, 0, 0.0, 100, 1, 2, 2, [3.0], weight=0.05),
    node(1, 1, 2.0, 20, weight=0.05),
    node(1, 2, -1.0, 80, 3, 4, 1, [1.0], 3, weight=0.05),
    node(1, 3, 4.0, 50, weight=0.05), node(1, 4, -6.0, 30, weight=0.05),
])


def expectation(tree, number, x, known):
    row = tree[number]
    if row["leftChild"] < 0:
        return row["prediction"] * row["weight"]
    split, children = row["split"], (row["leftChild"], row["rightChild"])
    f, values = split["featureIndex"], split["leftCategoriesOrThreshold"]
    if f in known:
        left = x[f] in values if split["numCategories"] >= 0 else x[f] <= values[0]
        return expectation(tree, children[0 if left else 1], x, known)
    return sum(tree[c]["rawCount"] / row["rawCount"] * expectation(tree, c, x, known) for c in children)


def margin(x, known):
    trees = {}
    for r in NODES.to_dict("records"):
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    return sum(expectation(t, 0, x, known) for t in trees.values())


def test_equals_shapley_values_and_sums_to_the_margin():
    rng = np.random.default_rng(1)
    values = np.column_stack([rng.random(30), rng.integers(0, 3, 30), rng.random(30) * 6])
    trees = explained_trees(NODES)
    got = contributions_of(values, trees)
    assert np.isclose(trees.base, margin(values[0], set()))
    for x, phi in zip(values, got):
        for i in range(3):
            others = [j for j in range(3) if j != i]
            expected = 0.0
            for size in range(3):
                for chosen in combinations(others, size):
                    share = factorial(size) * factorial(2 - size) / factorial(3)
                    expected += share * (margin(x, {*chosen, i}) - margin(x, set(chosen)))
            assert np.isclose(phi[i], expected)
        assert np.isclose(phi.sum() + trees.base, margin(x, {0, 1, 2}))


def test_long_paths_equal_coalitions():
    """A path over nine features, by the definition; no table of its 2^9 patterns is made."""
    m = 9
    rows, share = [], []
    for i in range(m):
        left = 2 * i + 1
        rows.append(node(0, 2 * i, 0.0, 1000 - 100 * i, left, left + 1, i, [0.5]))
        rows.append(node(0, left, float(i), 100))
        share.append(1 - 100 / (1000 - 100 * i))
    rows.append(node(0, 2 * m, 5.0, 100))
    trees = explained_trees(pd.DataFrame(rows))
    table = {r["id"]: r for r in rows}
    for x in (np.ones(m), np.zeros(m), np.arange(m) % 2 * 1.0):
        got = contributions_of(x[None, :], trees)[0]
        assert np.isclose(got.sum() + trees.base, expectation(table, 0, x, set(range(m))))
        want = np.zeros(m)
        known = {frozenset(c): expectation(table, 0, x, set(c)) for size in range(m + 1) for c in combinations(range(m), size)}
        for i in (0, 4, 8):
            for c, value in known.items():
                if i not in c:
                    want[i] += factorial(len(c)) * factorial(m - len(c) - 1) / factorial(m) * (known[c | {i}] - value)
            assert np.isclose(got[i], want[i])


def test_groups_of_trees_add_up(spark, monkeypatch):
    from pdengine.operators import tree_contributions as tc

    nodes = spark.createDataFrame(
        [tuple(r.values()) for r in NODES.to_dict("records")],
        "treeID int, id int, prediction double, rawCount long, leftChild int, rightChild int, weight double, "
        "split struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>",
    )
    rows = spark.createDataFrame([([0.3, 1.0, 2.0],), ([0.9, 2.0, 5.0],)], "feature_values array<double>")
    one = tc.Explainer.of(nodes)
    monkeypatch.setattr(tc, "GROUP_LEAVES", 1)
    two = tc.Explainer.of(nodes)
    assert (len(one.groups), len(two.groups)) == (1, 2) and np.isclose(one.base, two.base)
    got = [[r.contributions for r in tc.with_contributions(rows, e).collect()] for e in (one, two)]
    assert np.allclose(got[0], got[1])


def test_integrals_are_taken_per_pattern_where_loans_outnumber_them(monkeypatch):
    rng = np.random.default_rng(5)
    values = np.column_stack([rng.random(3000), rng.integers(0, 3, 3000), rng.random(3000) * 6])
    trees = explained_trees(NODES)
    alone = np.concatenate([contributions_of(values[i : i + 1], trees) for i in range(len(values))])
    taken, integrals = [], tree_contributions._integrals

    def counted(*given):
        taken.append(given[-1].shape[-1])
        return integrals(*given)

    monkeypatch.setattr(tree_contributions, "_integrals", counted)
    assert np.allclose(contributions_of(values, trees), alone, rtol=0, atol=1e-12)
    assert max(taken) <= 4  # paths of two features have four patterns
