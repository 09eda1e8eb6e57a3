"""Boosted trees grown leaf by leaf, the leaf of the largest gain first.

Features are put into at most 256 bins once and kept in blocks of rows. A leaf's
histogram holds, per feature and bin, the sums of gradients and curvatures and
the number of rows; the best split of a leaf is read off it. Below a parent whose
histogram is known all parts but the largest are counted, that one is what they
leave. Categories are ordered by their mean gradient and cut like numbers.

Leaves are counted over all blocks, one job per round, and added up, where
many tasks counted, slice by slice on executors; the driver gets one histogram per counted part, whose
size does not depend on the rows, and reads the splits off it. Trees that follow one another mostly
agree near the root, so a round parts the rows as earlier trees would have split them in the same place,
each row in one part, and adds the parts up to their parents; where the split turns out to be another,
its parts are only added up. Gradients are rounded to a unit in which sums over all rows are exact, so
it does not matter in which order and from which parts they were added up.
Once the leaves to be split have few rows (``LOCAL_ROWS``, ``LATE``), these go to tasks by leaf;
a task splits a leaf and its descendants on, best first, until the splits known elsewhere fill the tree.
The driver keeps the queue: it plays best-first over all splits known so far
and asks for what is below those that would be split. The tree is the one that
splitting strictly one leaf after the other gives, but a tree of 31 leaves over
small data takes one job, and over large data as many as it has levels.
"""

from __future__ import annotations

import heapq
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from pdengine.operators.stored_models import metadata, write_metadata
from pdengine.staging import materialise

BINS = 256
BLOCK_ROWS = 32_768
#: Leaves of so many rows or fewer may be finished by one task.
LOCAL_ROWS = 1 << 18
#: Where a task reads more rows than that, leaves are finished so once they have one in so many of these
#: together: moving more rows than that takes longer than another round.
LATE = 4
#: Trees after which the blocks take over their margins; until then each pass places its rows in them.
FOLLOW = 4
#: Trees after which the blocks are written and read back, which cuts their lineage.
REFRESH = 25
#: Trees for which a split is remembered.
REMEMBERED = 50
#: Rows of a leaf up to which the sums of all its features are taken at once.
TOGETHER = 2048
#: Rows up to which a task works through its core's whole share, as starting another costs some 0.1 s.
SHARE_ROWS = 1 << 20
#: Rows that a task works through, once the shares are larger than that.
TASK_ROWS = 1 << 17
#: Rows that a task is worth starting for: with fewer, not all cores are used.
LEAST_TASK_ROWS = 98_304
#: Features whose bins are added up together.
SLICE = 8
#: Histograms of single tasks that the driver adds up itself; more are added up by executors first.
DIRECT = 128
#: Leaves are expected to be split as before where they have one in so many of all rows.
GUESSED_SHARE = 1000
#: Rows that smooth a category's mean gradient before categories are ordered.
CATEGORY_SMOOTHING = 10.0
_LEAST_GAIN = 1e-10


@dataclass
class Growth:
    """What a tree may be."""

    leaves: int = 31
    min_rows: int = 30
    min_curvature: float = 1e-3
    categories: dict[int, int] = field(default_factory=dict)  # feature -> number of categories


@dataclass
class Node:
    """A node of a growing tree and its best split, if one is known; ``left`` and ``right`` are 0 without one."""

    sums: tuple[float, float, float]
    gain: float = -1.0
    feature: int = -1
    bins: np.ndarray | None = None  # whether each bin goes left
    left: int = 0
    right: int = 0


def gradients(margin: np.ndarray, label: np.ndarray, unit: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the log loss, whole numbers of a unit if one is given."""
    p = 1 / (1 + np.exp(-margin))
    g, h = p - label, p * (1 - p)
    return (np.rint(g / unit) * unit, np.rint(h / unit) * unit) if unit else (g, h)


def exact_unit(n: int) -> float:
    """The power of two of which sums over ``n`` rows, none above 1, are exact: float32 has no finer one near 1 up to 2^29 rows."""
    return 2.0 ** (max(n, 1).bit_length() - 53)


def histogram(bins: np.ndarray, features: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """Sums per feature and bin (g, h, rows); ``bins`` has a row per feature. With ``rows`` of these columns only."""
    if rows is not None:
        g, h = g[rows], h[rows]
    width, n = len(features), len(g)
    out = np.empty((width, BINS, 3))
    if n <= TOGETHER:
        seen = bins[features] if rows is None else bins[features[:, None], rows]
        index = (seen + BINS * np.arange(width, dtype=np.intp)[:, None]).ravel()
        for k, weights in enumerate((g, h, None)):
            spread = None if weights is None else np.broadcast_to(weights, (width, n)).ravel()
            out[:, :, k] = np.bincount(index, spread, width * BINS).reshape(width, BINS)
        return out
    for i, f in enumerate(features):
        index = (bins[f] if rows is None else bins[f].take(rows)).astype(np.intp)
        out[i, :, 0] = np.bincount(index, g, BINS)
        out[i, :, 1] = np.bincount(index, h, BINS)
        out[i, :, 2] = np.bincount(index, minlength=BINS)
    return out


def _scan(sums: np.ndarray, rules: Growth) -> np.ndarray:
    """Gain of cutting behind each bin of every feature (rows), -inf where the rules forbid it."""
    left = [np.cumsum(sums[..., k], axis=1) for k in range(3)]
    whole = [s[:, -1:] for s in left]
    right = [w - s for w, s in zip(whole, left, strict=True)]
    fine = (left[2] >= rules.min_rows - 0.5) & (right[2] >= rules.min_rows - 0.5)
    fine &= (left[1] >= rules.min_curvature) & (right[1] >= rules.min_curvature)
    part = lambda s: s[0] ** 2 / np.maximum(s[1], 1e-300)
    return np.where(fine, part(left) + part(right) - part(whole), -np.inf)


def _cut_features(hist: np.ndarray, features: np.ndarray, rules: Growth) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Per feature the best gain and its bin, and the order of the categories of those that have some."""
    orders = {}
    for i in np.flatnonzero(np.isin(features, list(rules.categories))).tolist():
        mean = hist[i, :, 0] / (hist[i, :, 1] + CATEGORY_SMOOTHING)
        orders[i] = np.lexsort((np.arange(BINS), np.where(hist[i, :, 2] > 0, mean, np.inf)))
    if orders:
        hist = hist.copy()
        for i, order in orders.items():
            hist[i] = hist[i, order]
    gain = _scan(hist, rules)
    at = np.argmax(gain, axis=1)
    return gain[np.arange(len(at)), at], at, orders


def _goes_left(i: int, at: np.ndarray, orders: dict[int, np.ndarray]) -> np.ndarray:
    left = np.zeros(BINS, bool)
    left[orders[i][: at[i] + 1] if i in orders else slice(at[i] + 1)] = True
    return left


def best_splits(hist: np.ndarray, features: np.ndarray, rules: Growth) -> list[tuple[float, int, np.ndarray]]:
    """Per feature: gain, feature, which bins go left."""
    gain, at, orders = _cut_features(hist, features, rules)
    return [(float(gain[i]), f, _goes_left(i, at, orders)) for i, f in enumerate(features.tolist())]


def best_split(hist: np.ndarray, features: np.ndarray, rules: Growth, cut: tuple | None = None) -> tuple[float, int, np.ndarray] | None:
    """``best_of`` all ``best_splits``; ``cut`` is what ``_cut_features`` finds, if that is known."""
    gain, at, orders = cut or _cut_features(hist, features, rules)
    top = gain.max()
    if not top > _LEAST_GAIN:
        return None
    f = int(features[gain == top].min())
    return float(top), f, _goes_left(int(np.flatnonzero(features == f)[0]), at, orders)


def best_of(candidates: list[tuple[float, int, np.ndarray]]) -> tuple[float, int, np.ndarray] | None:
    """The largest gain, the smaller feature on ties."""
    good = [c for c in candidates if c[0] > _LEAST_GAIN]
    return min(good, key=lambda c: (-c[0], c[1])) if good else None


def _sent_left(seen: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Whether rows whose bins are ``seen`` go left; one comparison where the bins up to some end do."""
    n = int(np.count_nonzero(left))
    return seen < n if n < BINS and left[:n].all() else left.take(seen)


class Tree:
    """Nodes by number; node 0 is the root."""

    def __init__(self, sums: tuple[float, float, float]):
        self.nodes = [Node(sums)]

    def split(self, number: int, left: tuple, right: tuple) -> tuple[int, int]:
        node = self.nodes[number]
        node.left, node.right = len(self.nodes), len(self.nodes) + 1
        self.nodes += [Node(left), Node(right)]
        return node.left, node.right

    def place(self, bins: np.ndarray) -> np.ndarray:
        """Leaf of each row of binned features; every split is compared for all rows at once, children before parents."""
        kind = np.min_scalar_type(len(self.nodes))
        reached: dict[int, np.ndarray] = {}
        for number in self.from_leaves():
            node = self.nodes[number]
            left, right = (reached.pop(c) if self.nodes[c].left else kind.type(c) for c in (node.left, node.right))
            goes = np.negative(_sent_left(bins[node.feature], node.bins).astype(kind))  # all bits set where a row goes left
            reached[number] = right ^ ((left ^ right) & goes)
        return reached.get(0, np.zeros(bins.shape[1], kind))

    def from_leaves(self) -> list[int]:
        """Nodes with a split, children before parents."""
        out, stack = [], [0]
        while stack:
            node = self.nodes[number := stack.pop()]
            if node.left:
                out.append(number)
                stack += [node.left, node.right]
        return out[::-1]

    def leaves_below(self, number: int) -> list[int]:
        """Leaves that this node's rows end in."""
        out, stack = [], [number]
        while stack:
            node = self.nodes[at := stack.pop()]
            if node.left:
                stack += [node.right, node.left]
            else:
                out.append(at)
        return out

    def reach(self) -> dict[int, float]:
        """Of each node with a split the least gain on the way to it: the tree takes the nodes of the largest."""
        out, stack = {}, [(0, np.inf)]
        while stack:
            at, least = stack.pop()
            if self.nodes[at].left:
                out[at] = min(least, self.nodes[at].gain)
                stack += [(c, out[at]) for c in (self.nodes[at].left, self.nodes[at].right)]
        return out

    def best_first(self, leaves: int) -> list[int]:
        """Nodes that a tree of so many leaves splits, as far as splits are known."""
        queue = [(-self.nodes[0].gain, 0)] if self.nodes[0].left else []
        taken = []
        while queue and len(taken) < leaves - 1:
            _, number = heapq.heappop(queue)
            taken.append(number)
            for child in (self.nodes[number].left, self.nodes[number].right):
                if self.nodes[child].left:
                    heapq.heappush(queue, (-self.nodes[child].gain, child))
        return taken

    def pruned(self, leaves: int) -> "Tree":
        """The best-first tree itself, numbered from the root, left before right."""
        taken = set(self.best_first(leaves))
        out = Tree(self.nodes[0].sums)
        out.nodes = []

        def copy(number: int) -> int:
            node, mine = self.nodes[number], len(out.nodes)
            out.nodes.append(Node(node.sums))
            if number in taken:
                new = out.nodes[mine]
                new.gain, new.feature, new.bins = node.gain, node.feature, node.bins
                new.left = copy(node.left)
                new.right = copy(node.right)
            return mine

        copy(0)
        return out


def grow_here(
    bins: np.ndarray, g: np.ndarray, h: np.ndarray, features: np.ndarray, rules: Growth,
    least: float = np.inf, rivals: np.ndarray | None = None,
) -> Tree:
    """A tree over rows that one task holds, split best first until it has all its leaves.

    Of a leaf of a larger tree ``least`` is the least gain on the way to it, and ``rivals`` are those
    of all splits known elsewhere, ascending: once they fill the tree, nothing more of the leaf is taken.
    """
    rivals = np.zeros(0) if rivals is None else rivals
    whole = histogram(bins, features, g, h)
    tree = Tree(tuple(whole[0].sum(axis=0).tolist()))
    queue: list[tuple[float, int]] = []
    reached = {0: least}

    def consider(number: int, hist: np.ndarray) -> None:
        found = best_split(hist, features, rules) if tree.nodes[number].sums[2] >= 2 * rules.min_rows - 0.5 else None
        if found:
            node = tree.nodes[number]
            node.gain, node.feature, node.bins = found
            heapq.heappush(queue, (-node.gain, number))

    held = {0: (np.arange(bins.shape[1]), whole)}
    consider(0, whole)
    for done in range(rules.leaves - 1):
        if not queue:
            break
        _, number = heapq.heappop(queue)
        node = tree.nodes[number]
        reach = min(reached[number], node.gain)
        if done + len(rivals) - np.searchsorted(rivals, reach, "right") >= rules.leaves - 1:
            break
        rows, hist = held.pop(number)
        goes = node.bins[bins[node.feature, rows]]
        sides = rows[goes], rows[~goes]
        small = 0 if len(sides[0]) <= len(sides[1]) else 1
        counted = histogram(bins, features, g, h, sides[small])
        both = (counted, hist - counted) if small == 0 else (hist - counted, counted)
        numbers = tree.split(number, *(tuple(b[0].sum(axis=0).tolist()) for b in both))
        for child, side, b in zip(numbers, sides, both, strict=True):
            held[child], reached[child] = (side, b), reach
            consider(child, b)
    return tree


# --- blocks


def cuts(rows: DataFrame, width: int, categories: dict[int, int]) -> list[np.ndarray]:
    """Upper ends of the bins of every numeric feature: its quantiles, a bin for each value where they are few."""
    shares = [i / (BINS - 1) for i in range(1, BINS - 1)]
    numeric = [i for i in range(width) if i not in categories]
    entries = rows.select(F.posexplode("features").alias("feature", "value")).where(
        F.col("feature").isin(numeric) & F.col("value").isNotNull() & ~F.isnan("value")
    )
    # a group for each feature, so that not one task merges the summaries of all
    found = dict(entries.groupBy("feature").agg(F.percentile_approx("value", shares, 20_000)).collect())
    return [np.unique(np.array(found.get(i, []), float)) if i in numeric else np.arange(min(categories[i], BINS) - 1.0) for i in range(width)]


def _pack(bins: np.ndarray, label: np.ndarray, margin: np.ndarray) -> bytes:
    return struct.pack("<2q", *bins.shape) + bins.tobytes() + label.astype(np.uint8).tobytes() + margin.tobytes()


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width, n = struct.unpack_from("<2q", block)
    bins = np.frombuffer(block, np.uint8, width * n, 16).reshape(width, n)
    label = np.frombuffer(block, np.uint8, n, 16 + width * n).astype(float)
    return bins, label, np.frombuffer(block, np.float64, n, 16 + (width + 1) * n)


def _binned(ends: list[np.ndarray], start: float):
    def task(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                values = part.column("features").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
                # missing values come behind the last bin's end and so always go right
                bins = np.stack([np.searchsorted(e, v, "left") for v, e in zip(values.T, ends, strict=True)])
                label = part.column("label").to_numpy(zero_copy_only=False).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([_pack(bins.astype(np.uint8), label, np.full(len(label), start))], pa.binary())], names=["block"])

    return task


Scored = tuple[Tree, np.ndarray]  # a finished tree and the value of each of its nodes


def _margin(bins: np.ndarray, margin: np.ndarray, trees: list[Scored]) -> np.ndarray:
    for tree, values in trees:
        margin = margin + values[tree.place(bins)]
    return margin


def _refreshed(trees: list[Scored]):
    def task(block: bytes) -> bytes:
        bins, label, margin = _unpack(block)
        return _pack(bins, label, _margin(bins, margin, trees))

    return task


# --- growing over blocks


def _read(blocks: Iterable[bytes], tree: Tree, number: np.ndarray, fresh: list[Scored], unit: float) -> Iterator[tuple]:
    """Of each block the bins, the rows that end in a leaf with a number, these leaves' numbers, gradients and curvatures."""
    for block in blocks:
        bins, label, margin = _unpack(block)
        leaf = number[tree.place(bins)]
        rows = np.flatnonzero(leaf >= 0)
        if len(rows):
            yield bins, rows, leaf[rows], *gradients(_margin(bins, margin, fresh)[rows], label[rows], unit)


def _numbered(tree: Tree, wanted: list[int]) -> tuple[Tree, np.ndarray]:
    """The tree without splits that no wanted leaf lies below, and by node the place of the wanted ones, -1 of others."""
    number = np.full(len(tree.nodes), -1, np.intp)
    number[wanted] = np.arange(len(wanted))
    out, leads = Tree(tree.nodes[0].sums), number >= 0
    out.nodes = [replace(node) for node in tree.nodes]
    for n in tree.from_leaves():
        node = out.nodes[n]
        if not leads[n] and not leads[node.left] and not leads[node.right]:
            node.left = node.right = 0
        leads[n] |= leads[node.left] | leads[node.right] if node.left else False
    return out, number


def _count(tree: Tree, wanted: list[int], features: np.ndarray, fresh: list[Scored], unit: float):
    """Histograms of leaves over a task's blocks, all in one pass: by leaf and slice of the features, the task's number and the sums."""
    many = len(wanted)
    tree, number = _numbered(tree, wanted)

    def task(part: int, blocks: Iterable[bytes]) -> Iterator[tuple]:
        held = np.zeros((len(features), 3, many * BINS))
        for bins, rows, leaf, g, h in _read(blocks, tree, number, fresh, unit):
            first, some = leaf * BINS, len(rows) < bins.shape[1]
            for sums, f in zip(held, features, strict=True):
                index = first + (bins[f].take(rows) if some else bins[f])
                sums[0] += np.bincount(index, g, many * BINS)
                sums[1] += np.bincount(index, h, many * BINS)
                sums[2] += np.bincount(index, minlength=many * BINS)
        by_leaf = held.reshape(len(features), 3, many, BINS).transpose(2, 0, 3, 1)
        for n, hist in zip(wanted, by_leaf, strict=True):
            for at in range(0, len(features), SLICE):
                yield (n, at), (part, np.ascontiguousarray(hist[at : at + SLICE]))

    return task


def _summed(parts: Iterable[tuple[int, np.ndarray]]) -> np.ndarray:
    """One sum, added up in the order of the tasks, so that reruns agree."""
    return sum(hist for _, hist in sorted(parts, key=lambda p: p[0]))


def _send(tree: Tree, wanted: list[int], features: np.ndarray, fresh: list[Scored], unit: float):
    """Rows of small leaves by leaf: the features that the tree sees, gradients and curvatures."""
    tree, number = _numbered(tree, wanted)

    def task(part: int, blocks: Iterable[bytes]) -> Iterator[tuple]:
        for i, (bins, rows, leaf, g, h) in enumerate(_read(blocks, tree, number, fresh, unit)):
            seen = bins[features].take(rows, axis=1)
            for k in np.unique(leaf).tolist():
                mine = np.flatnonzero(leaf == k)  # take keeps the bins of a feature together, which indexing would not
                yield wanted[k], ((part, i), seen.take(mine, axis=1), np.stack([g[mine], h[mine]]))

    return task


def _finish(features: np.ndarray, rules: Growth, least: dict[int, float], rivals: np.ndarray):
    """Grow below each leaf of a task from its rows, one leaf after the other, as far as its ``least`` gain and ``rivals`` allow."""
    places = {int(f): i for i, f in enumerate(features)}
    here = Growth(rules.leaves, rules.min_rows, rules.min_curvature, {places[f]: c for f, c in rules.categories.items() if f in places})

    def task(sent: Iterable[tuple]) -> Iterator[tuple[int, Tree]]:
        held: dict[int, list] = {}
        for leaf, part in sent:
            held.setdefault(leaf, []).append(part)
        while held:
            leaf, parts = held.popitem()
            parts.sort(key=lambda p: p[0])
            bins, (g, h) = np.concatenate([p[1] for p in parts], axis=1), np.concatenate([p[2] for p in parts], axis=1)
            tree = grow_here(bins, g, h, np.arange(len(features)), here, least[leaf], rivals)
            for node in tree.nodes:
                if node.left:
                    node.feature = int(features[node.feature])
            yield leaf, tree

    return task


def _features_of(path: tuple) -> tuple:
    return tuple((feature, goes) for feature, _, goes in path)


class Memory:
    """The best split of every feature that large nodes had in earlier trees, by the splits above the node.

    Held are gain, bins that go left, rows on both sides, and the tree. Nodes below splits of the same
    features are alike wherever these cut, so what the last of them had serves all of them.
    """

    def __init__(self):
        self.trees = 0
        self.held: dict[tuple, dict[int, tuple]] = {}

    def known(self, path: tuple) -> dict[int, tuple]:
        return self.held.get(_features_of(path), {})

    def note(self, path: tuple, hist: np.ndarray, features: np.ndarray, cut: tuple) -> None:
        """What a node's histogram says of each feature; ``cut`` is what ``_cut_features`` finds in it."""
        gain, at, orders = cut
        n, held = hist[0, :, 2].sum(), self.held.setdefault(_features_of(path), {})
        for i in np.flatnonzero(gain > _LEAST_GAIN).tolist():
            bins = _goes_left(i, at, orders)
            left = float(hist[i, bins, 2].sum())
            held[int(features[i])] = (float(gain[i]), bins, (left, float(n - left)), self.trees)

    def next_tree(self) -> None:
        self.trees += 1
        if self.trees % REMEMBERED == 0:
            kept = {p: {f: v for f, v in found.items() if v[3] >= self.trees - REMEMBERED} for p, found in self.held.items()}
            self.held = {p: found for p, found in kept.items() if found}

    def likely(self, path: tuple, features: np.ndarray) -> tuple[int, np.ndarray, tuple[float, float]] | None:
        """The split of the largest gain that is open to a tree with these features."""
        known = self.known(path)
        here = [f for f in features.tolist() if f in known]
        if not here:
            return None
        f = max(here, key=lambda f: known[f][0])
        return f, *known[f][1:3]


class _Grower:
    """One tree over the blocks: the nodes found so far, and the histograms of those whose children were not searched.

    A histogram has a fixed size, whatever the rows; the driver holds one for each such node.
    """

    def __init__(
        self, blocks: RDD, n: int, features: np.ndarray, rules: Growth, local: int,
        fresh: list[Scored] | None = None, memory: Memory | None = None,
    ):
        self.blocks, self.features, self.rules, self.local = blocks, features, rules, local
        self.fresh, self.memory = fresh or [], memory or Memory()
        self.here = n if n <= local * blocks.getNumPartitions() else local // LATE  # rows that go to tasks by leaf
        self.unit = exact_unit(n) if n > local else 0.0  # rows of one task are added up in one order
        self.tree = Tree((0.0, 0.0, float(n)))
        self.paths: dict[int, tuple] = {0: ()}
        self.counted: dict[int, np.ndarray] = {}

    def run(self) -> Tree:
        nodes, searched, wanted = self.tree.nodes, set(), [0]
        parent = {}
        while wanted:
            rows = [nodes[c].sums[2] for c in wanted]
            if max(rows) <= self.local and sum(rows) <= self.here:
                searched |= self.finish_small(wanted, parent) | set(wanted)
            else:
                searched |= self.search_large(wanted, parent)
            taken = self.tree.best_first(self.rules.leaves)
            parent = {c: t for t in taken for c in (nodes[t].left, nodes[t].right)}
            wanted = [c for c in parent if c not in searched and nodes[c].sums[2] >= 2 * self.rules.min_rows]
        self.memory.next_tree()
        return self.tree.pruned(self.rules.leaves)

    def finish_small(self, wanted: list[int], parent: dict[int, int]) -> set[int]:
        """Subtrees of small leaves, each by one task; the numbers of all their nodes."""
        reach = self.tree.reach()
        least = {n: reach[parent[n]] if n in parent else np.inf for n in wanted}
        finish = _finish(self.features, self.rules, least, np.sort(np.array(list(reach.values()))))
        send = self.blocks.mapPartitionsWithIndex(_send(self.tree, wanted, self.features, self.fresh, self.unit))
        parts = min(len(wanted), self.blocks.getNumPartitions())
        if parts == 1:
            sent = send.coalesce(1) if self.blocks.getNumPartitions() > 1 else send
        else:
            place, load = {}, [0.0] * parts
            for n in sorted(wanted, key=lambda n: -self.tree.nodes[n].sums[2]):
                place[n] = min(range(parts), key=load.__getitem__)
                load[place[n]] += self.tree.nodes[n].sums[2]
            sent = send.partitionBy(parts, place.__getitem__)
        out: set[int] = set()
        for leaf, grown in sorted(sent.mapPartitions(finish).collect(), key=lambda found: found[0]):  # below 2 * leaves nodes a leaf
            numbers = [leaf, *range(len(self.tree.nodes), len(self.tree.nodes) + len(grown.nodes) - 1)]
            for node in grown.nodes:
                if node.left:
                    node.left, node.right = numbers[node.left], numbers[node.right]
            self.tree.nodes[leaf] = grown.nodes[0]
            self.tree.nodes += grown.nodes[1:]
            out |= set(numbers)
        return out

    def guess(self, wanted: list[int]) -> Tree:
        """The tree with what earlier trees split below the wanted leaves, as far as it would be taken."""
        guessed = Tree(self.tree.nodes[0].sums)
        guessed.nodes = [replace(node) for node in self.tree.nodes]
        paths = {n: self.paths[n] for n in wanted}
        queue: list[tuple[float, int]] = []

        def consider(n: int) -> None:
            if n in paths:
                likely = self.memory.likely(paths[n], self.features)
                if likely and sum(likely[2]) * GUESSED_SHARE >= self.tree.nodes[0].sums[2]:
                    node, (feature, bins, rows) = guessed.nodes[n], likely
                    node.gain, node.feature, node.bins = self.memory.known(paths[n])[feature][0], feature, bins
                    heapq.heappush(queue, (-node.gain, n))
            elif guessed.nodes[n].left:
                heapq.heappush(queue, (-guessed.nodes[n].gain, n))

        consider(0)
        splits = 0
        while queue and splits < self.rules.leaves - 1:
            _, n = heapq.heappop(queue)
            splits += 1
            node = guessed.nodes[n]
            if n in paths:
                path, rows = paths[n], self.memory.known(paths[n])[node.feature][2]
                for c, goes in zip(guessed.split(n, *((0.0, 0.0, r) for r in rows)), (True, False), strict=True):
                    paths[c] = (*path, (node.feature, node.bins.tobytes(), goes))
            for c in (node.left, node.right):
                consider(c)
        return guessed

    def search_large(self, wanted: list[int], parent: dict[int, int]) -> set[int]:
        """Best splits of leaves, and of those below them as far as these were guessed; the leaves that were searched.

        Counted are the guessed tree's leaves; below a parent whose histogram is known the largest is what the others leave.
        """
        nodes = self.tree.nodes
        guessed = self.guess(wanted)
        tops = list(dict.fromkeys(parent[c] for c in wanted if c)) or [0]
        below = {p: guessed.leaves_below(p) for p in tops}
        largest = {p: max(below[p], key=lambda c: guessed.nodes[c].sums[2]) for p in tops if p in self.counted}
        count = [c for p in tops for c in below[p] if c != largest.get(p)]
        parts, slices = self.blocks.getNumPartitions(), len(count) * -(-len(self.features) // SLICE)
        sums = self.blocks.mapPartitionsWithIndex(_count(guessed, count, self.features, self.fresh, self.unit))
        if parts * len(count) > DIRECT:
            sums = sums.groupByKey(min(slices, parts)).mapValues(lambda held: (0, _summed(held)))
        now: dict[tuple, list] = {}
        for key, part in sums.collect():
            now.setdefault(key, []).append(part)
        hists = {n: np.concatenate([_summed(now[n, at]) for at in range(0, len(self.features), SLICE)]) for n in count}
        for p, c in largest.items():
            hists[c] = self.counted.pop(p) - sum(hists[k] for k in below[p] if k != c)
        for n in guessed.from_leaves():
            node = guessed.nodes[n]
            if node.left in hists and node.right in hists:
                hists[n] = hists[node.left] + hists[node.right]
        searched: set[int] = set()
        queue = [(number, number) for number in wanted]
        while queue:
            number, at = queue.pop()
            searched.add(number)
            self.settle(number, hists[at])
            node, plan = nodes[number], guessed.nodes[at]
            if not node.left:
                continue
            if not plan.left or plan.feature != node.feature or not np.array_equal(plan.bins, node.bins):
                self.counted[number] = hists[at]
                continue
            for child, c in ((node.left, plan.left), (node.right, plan.right)):
                if nodes[child].sums[2] >= 2 * self.rules.min_rows:
                    queue.append((child, c))
        return searched

    def settle(self, number: int, hist: np.ndarray) -> None:
        """Read a node's best split off its histogram."""
        node = self.tree.nodes[number]
        node.sums = tuple(hist[0].sum(axis=0).tolist())
        cut = _cut_features(hist, self.features, self.rules)
        self.memory.note(self.paths[number], hist, self.features, cut)
        best = best_split(hist, self.features, self.rules, cut)
        if best:
            node.gain, node.feature, node.bins = best
            part = hist[int(np.searchsorted(self.features, best[1]))][best[2]].sum(axis=0)
            children = self.tree.split(number, tuple(part.tolist()), tuple((np.array(node.sums) - part).tolist()))
            for child, goes in zip(children, (True, False), strict=True):
                self.paths[child] = (*self.paths[number], (node.feature, node.bins.tobytes(), goes))


def grow(
    blocks: RDD, n: int, features: np.ndarray, rules: Growth, local: int = LOCAL_ROWS,
    fresh: list[Scored] | None = None, memory: Memory | None = None,
) -> Tree:
    """The next tree over the blocks, whose margins have all trees before it but the ``fresh`` ones."""
    return _Grower(blocks, n, features, rules, local, fresh, memory).run()


@dataclass
class Boosted:
    """A fitted sum of trees: its start, the trees with their nodes' values, and the bins' upper ends."""

    start: float
    trees: list[Scored]
    ends: list[np.ndarray]
    categories: dict[int, int]


def _joined(blocks: Iterable[bytes]) -> Iterator[bytes]:
    """Small blocks, such as batches leave them, put together up to the size of a block."""

    def one(found: list[tuple]) -> bytes:
        return _pack(np.concatenate([f[0] for f in found], axis=1), *(np.concatenate([f[k] for f in found]) for k in (1, 2)))

    held, n = [], 0
    for block in blocks:
        found = _unpack(block)
        if held and n + len(found[1]) > BLOCK_ROWS:
            yield one(held)
            held, n = [], 0
        held.append(found)
        n += len(found[1])
    if held:
        yield one(held)


def _held(blocks: DataFrame, parts: int) -> RDD:
    """Blocks dealt out evenly and kept between jobs."""
    numbered = blocks.rdd.map(lambda row: bytes(row[0])).zipWithIndex().map(lambda found: (found[1], found[0]))
    return numbered.partitionBy(parts, lambda i: i % parts).values().mapPartitions(_joined).persist(StorageLevel.MEMORY_AND_DISK)


def task_count(n: int, cores: int) -> int:
    """Tasks that a pass over so many rows is dealt to."""
    more = n // TASK_ROWS if n > cores * SHARE_ROWS else 0
    return max(1, min(-(-n // BLOCK_ROWS), max(min(cores, n // LEAST_TASK_ROWS), more)))


def boost(
    rows: DataFrame, width: int, rules: Growth, n_trees: int, rate: float, share: float, seed: int, local: int = LOCAL_ROWS,
) -> Boosted:
    """Fit on ``rows(features array<double>, label)``; each tree sees a share of the features, drawn for it."""
    spark = rows.sparkSession
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n:
        raise ValueError("no rows to fit trees on")
    mean = min(max(positive / n, 1e-6), 1 - 1e-6)
    start = float(np.log(mean / (1 - mean)))
    ends = cuts(rows, width, rules.categories)
    binned = materialise(rows.select("features", "label").mapInArrow(_binned(ends, start), "block binary"))
    parts = task_count(n, spark.sparkContext.defaultParallelism)
    blocks = _held(binned, parts)
    draw, out, old = np.random.default_rng(seed), [], None
    memory, placed = Memory(), 0  # trees that the blocks' margins have
    try:
        for i in range(n_trees):
            features = np.sort(draw.choice(width, max(1, int(share * width)), replace=False))
            tree = grow(blocks, n, features, rules, local, out[placed:], memory)
            if old:
                old.unpersist()  # what follows it has been read, and so is kept, by now
                old = None
            values = np.array([-rate * node.sums[0] / max(node.sums[1], 1e-300) for node in tree.nodes])
            out.append((tree, values))
            if i + 1 == n_trees or i + 1 - placed < FOLLOW and i % REFRESH != REFRESH - 1:
                continue
            old, blocks = blocks, blocks.map(_refreshed(out[placed:])).persist(StorageLevel.MEMORY_AND_DISK)
            placed = i + 1
            if i % REFRESH == REFRESH - 1:
                written = materialise(spark.createDataFrame(blocks.map(lambda block: (block,)), "block binary"))
                old.unpersist()
                old, blocks = blocks, _held(written, parts)
    finally:
        blocks.unpersist()
        if old:
            old.unpersist()
    return Boosted(start, out, ends, rules.categories)


# --- as a stored model


def node_rows(fitted: Boosted) -> Iterator[tuple]:
    """Nodes in the layout of a stored gradient-boosted model, whose margin is half the log odds."""
    for t, (tree, values) in enumerate(fitted.trees):
        for number, (node, value) in enumerate(zip(tree.nodes, values.tolist(), strict=True)):
            n, value = int(round(node.sums[2])), (value + (fitted.start if t == 0 else 0.0)) / 2
            split = (-1, [], -1)
            if node.left:
                left = np.flatnonzero(node.bins)
                if node.feature in fitted.categories:
                    size = fitted.categories[node.feature]
                    split = (node.feature, [float(c) for c in range(size) if node.bins[min(c, BINS - 1)]], size)
                else:
                    split = (node.feature, [float(fitted.ends[node.feature][left[-1]])], -1)
            gain = node.gain / max(n, 1) if node.left else -1.0
            yield t, (number, value, 0.0, [float(n), 0.0, 0.0], n, gain, node.left or -1, node.right or -1, split)


_STORED = (
    "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, "
    "leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"
)


def stored_model(spark: SparkSession, fitted: Boosted, width: int, path: str) -> GBTClassificationModel:
    """Write the trees as a model that Spark reads, so that scoring stays in the JVM, and read it."""
    return stored_nodes(spark, list(node_rows(fitted)), width, path)


def stored_nodes(spark: SparkSession, nodes: list[tuple], width: int, path: str) -> GBTClassificationModel:
    """The same from rows of nodes: tree, and the node's fields in the order of ``_STORED``."""

    about = lambda kind, uid, **more: metadata(spark, kind, uid, {}, {"impurity": "variance"}, **more)
    name = uuid.uuid4().hex[:12]
    n = 1 + max(t for t, _ in nodes)
    write_metadata(spark, about("classification.GBTClassificationModel", f"GBTClassifier_{name}", numFeatures=width, numTrees=n), path)
    trees = [(t, about("regression.DecisionTreeRegressionModel", f"dtr_{name}_{t}"), 1.0) for t in range(n)]
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.mode("overwrite").parquet(f"{path}/treesMetadata")
    spark.createDataFrame(nodes, _STORED, verifySchema=False).coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
    return GBTClassificationModel.load(path)
