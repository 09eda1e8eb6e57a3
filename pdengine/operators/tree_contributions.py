"""Shapley values of a boosted-tree margin, per loan.

With features outside a coalition averaged by how the training rows split, the
value of a leaf factors over the distinct features of its path: a feature in
the coalition gives 1 or 0 (does the loan follow the path?), one outside gives
the share of rows that did. A coalition of k of the other m - 1 features weighs
k! (m - 1 - k)! / m!, which is the integral of t^k (1 - t)^(m - 1 - k) over [0, 1].
So the sum over all coalitions is the integral of one product,

    share of i = (follows_i - share_i) * integral of prod over j /= i of (follows_j t + share_j (1 - t)),

a polynomial of degree m - 1, for which ceil(m / 2) Gauss points are exact. Paths
of any length take as many products as they have points.

What a path gives its features depends only on which of them follow it. So where
a path has fewer such patterns than there are loans at hand, the integral is
taken once per pattern and looked up; for longer paths it is taken per loan.

A model is packed into arrays, in groups of trees of bounded size, once; a task
works through the groups and adds them up.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Leaves of a group of trees.
GROUP_LEAVES = 50_000
#: Loans times steps of paths that are held at a time.
CELLS = 1 << 17
#: Loans that are worked through together, and the answers to tests held for them.
LOANS = 5000
ANSWERS = 1 << 26


@dataclass
class Paths:
    """Paths of the leaves with m distinct features: per leaf and feature the tests, the share, and the value."""

    features: np.ndarray  # leaves x m
    first: np.ndarray  # a test that the feature passes on the path: its number, doubled, plus 1 if it must go right
    rest: list[tuple[int, int, int]]  # further tests of the same feature: leaf, place, test
    shares: np.ndarray
    values: np.ndarray


@dataclass
class ExplainedTrees:
    """Split tests of some trees and their leaves' paths by length."""

    tests: list[tuple[int, float | list[float]]] = field(default_factory=list)
    paths: dict[int, Paths] = field(default_factory=dict)
    base: float = 0.0


def _tree_paths(tree: pd.DataFrame, tests: list) -> tuple[list[tuple], float]:
    """Leaves of a tree: path by feature, shares, value; tests are added to the list."""
    rows = {r.id: r for r in tree.itertuples(index=False)}
    out, base, stack = [], 0.0, [(0, [], 1.0)]
    while stack:
        number, path, reached = stack.pop()
        node = rows[number]
        if node.leftChild < 0:
            value = node.prediction * node.weight
            base += value * reached
            by: dict[int, list] = {}
            for f, test, share in path:
                by.setdefault(f, []).append((test, share))
            if by:
                out.append((by, value))
            continue
        split = node.split
        values = [float(v) for v in split["leftCategoriesOrThreshold"]]
        tests.append((split["featureIndex"], values if split["numCategories"] >= 0 else values[0]))
        for child, right in ((node.leftChild, 0), (node.rightChild, 1)):
            share = rows[child].rawCount / node.rawCount
            stack.append((child, path + [(split["featureIndex"], 2 * (len(tests) - 1) + right, share)], reached * share))
    return out, base


def explained_trees(nodes: pd.DataFrame) -> ExplainedTrees:
    """Pack trees, given as a table of nodes."""
    out = ExplainedTrees()
    by_length: dict[int, list] = {}
    for _, tree in nodes.groupby("treeID"):
        leaves, base = _tree_paths(tree, out.tests)
        out.base += base
        for by, value in leaves:
            by_length.setdefault(len(by), []).append((by, value))
    for m, leaves in by_length.items():
        order = [sorted(by) for by, _ in leaves]
        out.paths[m] = Paths(
            np.array(order, np.int32),
            np.array([[by[f][0][0] for f in fs] for (by, _), fs in zip(leaves, order, strict=True)], np.int32),
            [(i, j, test) for i, ((by, _), fs) in enumerate(zip(leaves, order, strict=True)) for j, f in enumerate(fs) for test, _ in by[f][1:]],
            np.array([[float(np.prod([s for _, s in by[f]])) for f in fs] for (by, _), fs in zip(leaves, order, strict=True)]),
            np.array([value for _, value in leaves]),
        )
    return out


def _answers(values: np.ndarray, tests: list) -> np.ndarray:
    """Rows: whether each test sends the loans left."""
    out = np.empty((len(tests), len(values)), bool)
    for k, (f, split) in enumerate(tests):
        out[k] = np.isin(values[:, f], split) if isinstance(split, list) else values[:, f] <= split
    return out


def _passed(answers: np.ndarray, test) -> np.ndarray:
    """Outcome of tests numbered as on paths: doubled, plus 1 if they must go right."""
    return answers[test >> 1] ^ ((np.asarray(test) & 1) == 1)[..., None]


def _points(m: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss points and weights on [0, 1] that are exact for paths of m features."""
    points, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
    return (points + 1) / 2, weights / 2


def _integrals(gauss: tuple[np.ndarray, np.ndarray], shares: np.ndarray, values: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """What leaves (first axis) give the m features of their paths (second axis), for patterns or loans that follow them."""
    points, weights = gauss
    share = np.maximum(shares[:, :, None], 1e-12)  # leaves x m x points below
    yes, no = points + share * (1 - points), share * (1 - points)
    # the product over a path at each point, then each feature's own factor taken out of it
    lost = np.log(no).sum(axis=1)[:, :, None] + np.log(yes / no).transpose(0, 2, 1) @ follows.astype(np.float64)
    product = np.exp(lost) * weights[:, None]
    total = np.where(follows, ((1 - share) / yes) @ product, (-share / no) @ product)
    total *= values[:, None, None]
    return total


def contributions_of(values: np.ndarray, trees: ExplainedTrees) -> np.ndarray:
    """One row of contributions per row of feature values."""
    n = len(values)
    out = np.zeros((values.shape[1], n))
    if not trees.tests or not n:
        return out.T
    answers = _answers(values, trees.tests)
    for m, paths in trees.paths.items():
        step, gauss = max(1, CELLS // (m * n)), _points(m)
        tabulated = 2 ** (m + 1) <= n
        patterns = (np.arange(2**m) >> np.arange(m)[:, None] & 1).astype(bool) if tabulated else None
        further = {}
        for i, j, test in paths.rest:
            further.setdefault(i // step, []).append((i % step, j, test))
        for part, at in enumerate(range(0, len(paths.values), step)):
            here = slice(at, at + step)
            follows = _passed(answers, paths.first[here])  # leaves x m x loans
            for i, j, test in further.get(part, ()):
                follows[i, j] &= _passed(answers, test)
            of = paths.features[here]
            if tabulated:
                table = _integrals(gauss, paths.shares[here], paths.values[here], patterns)
                pattern = follows[:, 0].astype(np.uint16)  # tabulated paths are far shorter than 16
                for j in range(1, m):
                    pattern |= follows[:, j].astype(np.uint16) << np.uint16(j)
                for i, features in enumerate(of.tolist()):
                    which = pattern[i].astype(np.intp)
                    for j, f in enumerate(features):
                        out[f] += table[i, j].take(which)
                continue
            total = _integrals(gauss, paths.shares[here], paths.values[here], follows)
            where = np.zeros((len(out), of.size))
            where[of.ravel(), np.arange(of.size)] = 1.0
            out += where @ total.reshape(-1, n)
    return out.T


def loans_together(tests: int) -> int:
    """Loans whose answers to so many tests are held at a time."""
    return max(1, min(LOANS, ANSWERS // max(tests, 1)))


@dataclass
class Explainer:
    """A packed model on its way to tasks; make one per model and keep it."""

    groups: list  # broadcast groups of trees
    base: float

    @classmethod
    def of(cls, nodes: DataFrame) -> "Explainer":
        """Pack the trees of a table of nodes group by group, so that the driver holds one group's nodes at a time."""
        spark: SparkSession = nodes.sparkSession
        sizes = nodes.where(F.col("leftChild") < 0).groupBy("treeID").count().orderBy("treeID").collect()  # a row per tree
        groups, base, lot, held = [], 0.0, [], 0
        for i, (tree, leaves) in enumerate(sizes):
            lot.append(tree)
            held += leaves
            if held >= GROUP_LEAVES or i == len(sizes) - 1:
                packed = explained_trees(nodes.where(F.col("treeID").between(lot[0], lot[-1])).toPandas())
                base += packed.base
                groups.append(spark.sparkContext.broadcast(packed))
                lot, held = [], 0
        return cls(groups, base)


def with_contributions(rows: DataFrame, explainer: Explainer, values_col: str = "feature_values") -> DataFrame:
    """Add ``contributions`` (one per feature) and ``base_margin``; their sum is the margin.

    Only the feature array goes to Python; the other columns stay in the JVM.
    """
    groups = explainer.groups

    @F.pandas_udf("array<double>")
    def explain(values: pd.Series) -> pd.Series:
        if values.empty:
            return pd.Series([], dtype=object)
        matrix = np.stack(values.to_list()).astype(float)
        parts = -(-len(matrix) // loans_together(max((len(g.value.tests) for g in groups), default=0)))
        done = [sum(contributions_of(part, g.value) for g in groups) for part in np.array_split(matrix, parts)]
        return pd.Series(list(np.concatenate(done)))

    return rows.withColumns({"contributions": explain(F.col(values_col)), "base_margin": F.lit(explainer.base)})
