"""Leaf-wise trees: splits against brute force, and one tree whichever way it is grown."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from pdengine.operators import leafwise as lw
from pdengine.staging import stage_path


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(0)
    n = 2000
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n), rng.random(n).round(2)])
    x[::97, 2] = np.nan
    logit = x[:, 0] - (x[:, 1] == 2) + np.nan_to_num(x[:, 2])
    return x, (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(int)


@pytest.fixture(scope="module")
def rows(spark, sample):
    x, y = sample
    return spark.createDataFrame([(v.tolist(), int(l)) for v, l in zip(x, y, strict=True)], "features array<double>, label int").repartition(3)


RULES = lw.Growth(leaves=8, min_rows=20, categories={1: 6})


def gain(g, h, left):
    part = lambda m: g[m].sum() ** 2 / h[m].sum()
    return part(left) + part(~left) - part(np.ones(len(g), bool))


def test_first_split_is_the_best_of_all(sample):
    x, y = sample
    bins = np.stack([np.searchsorted(np.unique(np.nanquantile(c, np.linspace(0, 1, 40))), c) for c in x.T]).astype(np.uint8)
    bins[1] = x[:, 1]
    g, h = lw.gradients(np.zeros(len(y)), y.astype(float))
    tree = lw.grow_here(bins, g, h, np.arange(3), RULES)
    allowed = lambda m: min(m.sum(), (~m).sum()) >= RULES.min_rows
    found = [gain(g, h, bins[f] <= b) for f in (0, 2) for b in np.unique(bins[f])[:-1] if allowed(bins[f] <= b)]
    for size in range(1, 5):  # every subset of the categories, not only those that the order allows
        found += [gain(g, h, m) for c in combinations(range(5), size) if allowed(m := np.isin(bins[1], c))]
    assert tree.nodes[0].gain == pytest.approx(max(found), rel=1e-9)
    assert sum(not n.left for n in tree.nodes) == RULES.leaves and min(n.sums[2] for n in tree.nodes) >= RULES.min_rows


def test_leaves_are_split_in_the_order_of_their_gain(sample):
    x, y = sample
    bins = np.stack([np.clip(np.nan_to_num(c, nan=3) * 30 + 100, 0, 255) for c in x.T]).astype(np.uint8)
    g, h = lw.gradients(np.zeros(len(y)), y.astype(float))
    rules = lw.Growth(leaves=12, min_rows=10)
    whole = lw.grow_here(bins, g, h, np.arange(3), rules)
    order = whole.best_first(12)
    # one after the other, from the definition
    leaves, splits = {0: np.ones(len(y), bool)}, []
    for _ in range(11):
        best = {n: lw.best_of(lw.best_splits(lw.histogram(bins[:, m], np.arange(3), g[m], h[m]), np.arange(3), rules)) for n, m in leaves.items()}
        n = max((k for k in best if best[k]), key=lambda k: best[k][0])
        m = leaves.pop(n)
        node = whole.nodes[n]
        splits.append(n)
        assert node.feature == best[n][1] and node.gain == pytest.approx(best[n][0], rel=1e-6)
        goes = node.bins[bins[node.feature]]
        leaves[node.left], leaves[node.right] = m & goes, m & ~goes
    assert splits == order


@pytest.mark.parametrize("local", [0, 600])
def test_one_tree_whichever_way_it_is_grown(rows, local):
    shape = lambda t: [(n.feature, n.left, n.right, round(n.sums[2]), n.bins.tobytes() if n.left else b"") for n in t.nodes]
    here, spread = (lw.boost(rows, 3, RULES, 3, 0.1, 1.0, 1, local=k) for k in (lw.LOCAL_ROWS, local))
    for (a, x), (b, y) in zip(here.trees, spread.trees, strict=True):
        assert shape(a) == shape(b) and np.allclose(x, y)


def test_stored_model_scores_as_the_trees_do(spark, rows, monkeypatch):
    monkeypatch.setattr(lw, "REFRESH", 2)
    fitted = lw.boost(rows, 3, RULES, 5, 0.2, 0.7, 3)
    model = lw.stored_model(spark, fitted, 3, stage_path(spark, "leafwise-test"))
    shaped = rows.select(F.col("features").alias("x"), array_to_vector("features").alias("features"))
    out = model.transform(shaped).select("x", vector_to_array("probability")[1].alias("p")).collect()
    x = np.array([r.x for r in out], float)
    bins = np.stack([np.searchsorted(e, c) for e, c in zip(fitted.ends, x.T, strict=True)])
    margin = fitted.start + sum(v[t.place(bins)] for t, v in fitted.trees)
    assert np.allclose([r.p for r in out], 1 / (1 + np.exp(-margin)), atol=1e-12)


def test_loss_falls_and_odd_data_is_fitted(spark, rows):
    fitted = lw.boost(rows, 3, RULES, 1, 0.1, 1.0, 1)
    assert len(fitted.trees[0][0].nodes) == 15
    same = spark.createDataFrame([([1.0, 0.0], i % 2) for i in range(100)], "features array<double>, label int")
    assert all(len(t.nodes) == 1 for t, _ in lw.boost(same, 2, lw.Growth(min_rows=5), 3, 0.1, 1.0, 1).trees)
    one_sided = spark.createDataFrame([([float(i), 0.0], 1) for i in range(100)], "features array<double>, label int")
    assert lw.boost(one_sided, 2, lw.Growth(min_rows=5), 2, 0.1, 1.0, 1).start > 10
    with pytest.raises(ValueError, match="no rows"):
        lw.boost(same.limit(0), 2, lw.Growth(), 1, 0.1, 1.0, 1)


def test_a_round_over_large_leaves_is_one_job(spark, rows, monkeypatch):
    """Also where executors add the histograms up first; nothing is written between rounds."""
    shape = lambda t: [(n.feature, n.left, n.right, round(n.sums[2])) for n in t.nodes]
    monkeypatch.setattr(lw, "BLOCK_ROWS", 500)
    found, rounds, here = [], [], spark.sparkContext
    search = lw._Grower.search_large
    monkeypatch.setattr(lw._Grower, "search_large", lambda self, *given: (rounds.append(1), search(self, *given))[1])
    for direct in (lw.DIRECT, 0):
        monkeypatch.setattr(lw, "DIRECT", direct)
        here.setJobGroup(f"fit-{direct}-3", "")
        few = len(lw.boost(rows, 3, RULES, 3, 0.1, 1.0, 1, local=0).trees)
        jobs, done = len(here.statusTracker().getJobIdsForGroup(f"fit-{direct}-3")), len(rounds)
        rounds.clear()
        here.setJobGroup(f"fit-{direct}-6", "")
        fitted = lw.boost(rows, 3, RULES, 6, 0.1, 1.0, 1, local=0)
        more = len(here.statusTracker().getJobIdsForGroup(f"fit-{direct}-6"))
        assert few == 3 and more - jobs == len(rounds) - done
        rounds.clear()
        found.append([shape(t) for t, _ in fitted.trees])
    here.setLocalProperty("spark.jobGroup.id", None)
    assert found[0] == found[1]


def test_best_split_is_the_best_of_all_features(sample):
    x, y = sample
    bins = np.stack([np.clip(np.nan_to_num(c, nan=3) * 30 + 100, 0, 255) for c in x.T]).astype(np.uint8)
    bins[1] = x[:, 1]
    bins = np.concatenate([bins, bins[:1]])  # a feature that ties with another
    g, h = lw.gradients(np.zeros(len(y)), y.astype(float))
    features = np.arange(4)
    for rows in (np.arange(0, 2000, 3), np.flatnonzero(x[:, 1] == 2), np.arange(1900), np.arange(10)):
        hist = lw.histogram(bins, features, g, h, rows)
        for few in (0, len(rows)):  # both ways of adding up
            with pytest.MonkeyPatch.context() as patch:
                patch.setattr(lw, "TOGETHER", few)
                assert np.array_equal(hist, lw.histogram(bins[:, rows], features, g[rows], h[rows]))
                assert np.array_equal(hist, lw.histogram(bins, features, g, h, rows))
        expected, found = lw.best_of(lw.best_splits(hist, features, RULES)), lw.best_split(hist, features, RULES)
        assert (expected is None) == (found is None)
        if found:
            assert found[:2] == expected[:2] and np.array_equal(found[2], expected[2])


def test_splits_of_earlier_trees_save_rounds(rows, monkeypatch):
    """The nodes below an expected split are counted in the round of the node itself; a wrong guess changes no tree."""
    shape = lambda t: [(n.feature, n.left, n.right, n.sums, n.bins.tobytes() if n.left else b"") for n in t.nodes]
    rounds, search, likely = [], lw._Grower.search_large, lw.Memory.likely
    monkeypatch.setattr(lw._Grower, "search_large", lambda self, *given: (rounds.append(1), search(self, *given))[1])

    def fit(guess, share):
        monkeypatch.setattr(lw.Memory, "likely", guess)
        rounds.clear()
        fitted = lw.boost(rows, 3, RULES, 7, 0.02, share, 1, local=150)
        return [shape(t) for t, _ in fitted.trees], len(rounds)

    def wrong(self, path, features):
        found = likely(self, path, features)
        return found and (found[0], ~found[1], found[2])

    for share in (1.0, 0.7):
        plain, many = fit(lambda *_: None, share)
        assert fit(wrong, share) == (plain, many)
        assert fit(likely, share) == (plain, few := fit(likely, share)[1]) and few < many


def test_quantiles_are_merged_feature_by_feature(spark, monkeypatch):
    """One summary for each group, not one task that merges those of all features; missing values take no part."""
    calls, plain = [], F.percentile_approx
    monkeypatch.setattr(lw.F, "percentile_approx", lambda *given: (calls.append(1), plain(*given))[1])
    given = [([float(i % 7), float("nan") if i % 3 else float(i), 1.0, None], 0) for i in range(900)]
    ends = lw.cuts(spark.createDataFrame(given, "features array<double>, label int").repartition(4), 4, {2: 3})
    assert len(calls) == 1
    assert ends[0].tolist() == [0, 1, 2, 3, 4, 5, 6] and ends[2].tolist() == [0, 1] and ends[3].tolist() == []
    assert len(ends[1]) == 254 and np.abs(ends[1] - np.quantile(np.arange(0, 900, 3), np.arange(1, 255) / 255)).max() <= 6


def test_tasks_are_as_many_as_the_rows_are_worth(rows, monkeypatch):
    """A start of a task costs as much as counting some rows; the trees are the same over any number of tasks."""
    assert [lw.task_count(n, 12) for n in (1, 100_000, 628_289, 1_300_000, 40_000_000)] == [1, 1, 6, 12, 305]
    shape = lambda t: [(n.feature, n.left, n.right, round(n.sums[2])) for n in t.nodes]
    monkeypatch.setattr(lw, "BLOCK_ROWS", 300)
    found, held, parts = [], lw._held, []
    monkeypatch.setattr(lw, "_held", lambda blocks, n: (parts.append(n), held(blocks, n))[1])
    for least in (300, 1000, 1 << 20):
        monkeypatch.setattr(lw, "LEAST_TASK_ROWS", least)
        found.append([shape(t) for t, _ in lw.boost(rows, 3, RULES, 3, 0.1, 1.0, 1, local=400).trees])
    assert parts == [6, 2, 1] and found[0] == found[1] == found[2]


@pytest.mark.parametrize("splits", [0, 1, 30, 300])
def test_rows_reach_the_leaf_that_their_bins_lead_to(splits):
    rng = np.random.default_rng(splits)
    bins = rng.integers(0, lw.BINS, (4, 500)).astype(np.uint8)
    tree = lw.Tree((0.0, 0.0, 500.0))
    for _ in range(splits):
        leaf = int(rng.choice([i for i, n in enumerate(tree.nodes) if not n.left]))
        node = tree.nodes[leaf]
        node.feature = int(rng.integers(4))
        node.bins = np.arange(lw.BINS) < rng.integers(0, 257) if rng.random() < 0.7 else rng.random(lw.BINS) < 0.5
        tree.split(leaf, (0.0, 0.0, 0.0), (0.0, 0.0, 0.0))
    placed, expected = tree.place(bins), []
    for row in bins.T:
        at = 0
        while tree.nodes[at].left:
            at = tree.nodes[at].left if tree.nodes[at].bins[row[tree.nodes[at].feature]] else tree.nodes[at].right
        expected.append(at)
    assert placed.tolist() == expected


def test_placing_rows_gathers_no_row_for_a_cut_of_a_number():
    tree = lw.Tree((0.0, 0.0, 3.0))
    tree.nodes[0].feature, tree.nodes[0].bins = 0, np.arange(lw.BINS) <= 7
    tree.split(0, (0.0, 0.0, 2.0), (0.0, 0.0, 1.0))

    class Row(np.ndarray):
        def __getitem__(self, key):
            assert not isinstance(key, tuple)  # one feature at a time, all its rows
            return super().__getitem__(key)

    assert tree.place(np.array([[3, 8, 7]], np.uint8).view(Row)).tolist() == [1, 2, 1]


def test_leaves_are_counted_in_one_pass_over_their_rows(sample):
    """All histograms of a round come from one look at each row, which is in one of them."""
    x, y = sample
    bins = np.stack([np.clip(np.nan_to_num(c, nan=3) * 30 + 100, 0, 255) for c in x.T]).astype(np.uint8)
    margin, label = np.zeros(len(y)), y.astype(float)
    unit = lw.exact_unit(len(y))
    g, h = lw.gradients(margin, label, unit)
    tree = lw.grow_here(bins, g, h, np.arange(3), RULES)
    leaves = tree.leaves_below(0)
    wanted = leaves[1:]  # the first is what they leave
    blocks = [lw._pack(bins[:, i : i + 300], label[i : i + 300], margin[i : i + 300]) for i in range(0, len(y), 300)]
    joined = list(lw._joined(blocks))
    assert len(joined) == 1 and all(np.array_equal(a, b) for a, b in zip(lw._unpack(joined[0]), (bins, label, margin), strict=True))
    at, features = tree.place(bins), np.array([0, 2])
    for given in (blocks, joined):
        found = dict(lw._count(tree, wanted, features, [], unit)(5, given))
        assert sorted(n for n, _ in found) == sorted(wanted)
        for (n, _), (part, hist) in found.items():
            m = at == n
            assert part == 5 and np.array_equal(hist, lw.histogram(bins[:, m], features, g[m], h[m]))
        whole = lw.histogram(bins, features, g, h) - sum(hist for _, hist in found.values())
        assert np.array_equal(whole, lw.histogram(bins, features, g, h, np.flatnonzero(at == leaves[0])))  # sums are exact


def test_trees_do_not_depend_on_the_order_of_adding_up(rows, monkeypatch):
    found = []
    monkeypatch.setattr(lw, "BLOCK_ROWS", 300)
    for least in (300, 1 << 20):
        monkeypatch.setattr(lw, "LEAST_TASK_ROWS", least)
        fitted = lw.boost(rows, 3, RULES, 6, 0.1, 0.7, 1, local=300)
        found.append([([(n.feature, n.left, n.right, n.sums, n.gain) for n in t.nodes], v.tolist()) for t, v in fitted.trees])
    assert found[0] == found[1]


def test_a_leaf_is_not_split_beyond_what_the_tree_can_take(sample):
    x, y = sample
    bins = np.stack([np.clip(np.nan_to_num(c, nan=3) * 30 + 100, 0, 255) for c in x.T]).astype(np.uint8)
    g, h = lw.gradients(np.zeros(len(y)), y.astype(float))
    rules = lw.Growth(leaves=12, min_rows=10)
    whole = lw.grow_here(bins, g, h, np.arange(3), rules)
    reach = whole.reach()
    order = whole.best_first(12)
    assert [reach[n] for n in order] == sorted(reach.values(), reverse=True)
    rivals = np.sort([reach[order[0]] + 1] * 4 + [reach[order[6]] * 1.0000001] * 3 + [0.0] * 9)
    part = lw.grow_here(bins, g, h, np.arange(3), rules, np.inf, rivals)
    assert len(part.best_first(12)) == 6  # four and three are ahead of the seventh, and so eleven are full
    assert [part.nodes[n].gain for n in part.best_first(12)] == [whole.nodes[n].gain for n in order[:6]]


def test_a_core_works_through_its_share_in_one_task():
    assert [lw.task_count(3_769_625, cores) for cores in (8, 12)] == [8, 12]
    assert lw.task_count(13 << 20, 12) == 13 << 3
