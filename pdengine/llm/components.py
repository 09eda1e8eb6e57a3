"""Connected components of a link table by repeated star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pdengine.llm.tables import spread, staged

_ROUNDS = 60


def _forest(batches):
    """Union-find over the links of one task: each node that isn't a root, with its root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    pairs = [(x, root(x)) for x in parent]
    pairs = np.array([p for p in pairs if p[0] != p[1]], np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    return (
        e.join(least, "a")
        .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        .select("e.*")
        .where("a > b")
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """``(node, component_id)`` of every linked node that isn't the smallest of its component.

    ``links`` has two long columns ``a`` and ``b`` in any order; loops and
    repeats do no harm. Each task first runs union-find over its own links;
    stars are then contracted until each node points at the smallest node it
    can reach, which takes a few rounds. Every round is written to the shared
    folder, so a lost executor costs a task and not the history.
    """
    e = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = staged(spread(e.mapInArrow(_forest, "a long, b long").distinct(), "a"))
    seen = None
    for _ in range(_ROUNDS):
        now = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if now == seen or not now["n"]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component_id"))
        seen = now
        e = staged(_small_star(_large_star(e)))
    raise RuntimeError(f"components did not settle in {_ROUNDS} rounds")
