"""Near-duplicate embeddings by an epsilon grid order join (operator 8).

Vectors of one label are linked when their cosine reaches a threshold, that is
when their unit vectors lie within eps of each other. They are turned to their
leading principal dimensions, put in the order of the grid cells of width eps
there, and cut into blocks, intervals of that order. Two blocks are joined only
if their boxes in the leading dimensions come within eps; the join halves the
longer interval again and again, skips pairs of intervals whose boxes are
farther apart, and compares the short ones that remain. Equal vectors of a
label are merged before and stand in the join once, with their number.

The principal dimensions are fitted on a bounded sample (``SAMPLE`` vectors
with the smallest hash of the id). Any rotation gives the same links, a good
one only skips more. Pairs are counted where they are found and never leave
the task; what leaves it is one row per vector and one link to the smallest id
of its group within the task.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows without label or id, link with nothing. Vectors of
different lengths never link; equal ones of a label always do. Rows that repeat
an id are vectors of their own in ``n_links`` and one node in ``component_id``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pdengine.llm.components import components
from pdengine.llm.tables import attach, staged
from pdengine.llm.vectors import cosines, matrix, unit

SAMPLE = 8192
#: Leading dimensions of the grid, vectors of a block, and of an interval that isn't halved further.
LEADING, BLOCK, LEAF = 6, 512, 64
_SLACK = 1e-9
#: 128 bits of a label and vector.
KEY = ["h1", "h2"]


def _basis(batches):
    rows: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        _, found = matrix(batch.column("embedding"))
        for v in found:
            if v is not None:
                rows.setdefault(len(v), []).append(v)
    if rows:
        dim = max(rows, key=lambda d: (len(rows[d]), d))
        u = unit(np.stack(rows[dim]))
        u = u - u.mean(axis=0)
        _, axes = np.linalg.eigh(u.T @ u)
        yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "axes": [axes[:, ::-1][:, :LEADING].astype(np.float64).tobytes()]})


def _cells(eps: float, fitted: tuple[int, np.ndarray] | None):
    def task(batches):
        for batch in batches:
            good, rows = matrix(batch.column("embedding"))
            place = np.zeros((len(rows), LEADING))
            for dim in {len(r) for r in rows if r is not None}:
                at = [i for i, r in enumerate(rows) if r is not None and len(r) == dim]
                axes = fitted[1] if fitted and fitted[0] == dim else np.eye(dim)[:, :LEADING]
                place[at, : axes.shape[1]] = unit(np.stack([rows[i] for i in at])) @ axes
            cells = pa.FixedSizeListArray.from_arrays(pa.array(np.floor(place / eps).astype(np.int32).reshape(-1)), LEADING)
            spots = pa.FixedSizeListArray.from_arrays(pa.array(place.reshape(-1)), LEADING)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(good), pa.array([0 if r is None else len(r) for r in rows], pa.int32()),
                 pa.array([None if r is None else r.tobytes() for r in rows], pa.binary()),
                 cells.cast(pa.list_(pa.int32())), spots.cast(pa.list_(pa.float64()))],
                names=["vec_id", "label", "good", "dim", "vector", "cells", "spot"],
            )

    return task


def _cut(eps: float):
    """Blocks of consecutive rows of one label and length."""

    def task(batches):
        waiting, key = [], None

        def block() -> pa.RecordBatch:
            spots = np.array([r["spot"] for r in waiting])
            lo, hi = spots.min(axis=0), spots.max(axis=0)
            return pa.RecordBatch.from_pydict({
                "label": pa.array([key[0]], pa.string()), "dim": pa.array([key[1]], pa.int32()),
                "ids": [np.array([r["vec_id"] for r in waiting], np.int64).tobytes()],
                "copies": [np.array([r["copies"] for r in waiting], np.int64).tobytes()],
                "keys": [np.array([(r["h1"], r["h2"]) for r in waiting], np.int64).tobytes()],
                "vectors": [b"".join(r["vector"] for r in waiting)], "spots": [spots.tobytes()],
                "lo": pa.array([lo.tolist()], pa.list_(pa.float64())), "hi": pa.array([hi.tolist()], pa.list_(pa.float64())),
                "first": pa.array([int(np.floor(lo[0] / eps))], pa.int32()), "last": pa.array([int(np.floor(hi[0] / eps))], pa.int32()),
            })

        for batch in batches:
            for r in batch.to_pylist():
                if waiting and (key != (r["label"], r["dim"]) or len(waiting) >= BLOCK):
                    yield block()
                    waiting = []
                key = (r["label"], r["dim"])
                waiting.append(r)
        if waiting:
            yield block()

    return task


def interval_join(va: np.ndarray, sa: np.ndarray, vb: np.ndarray, sb: np.ndarray, eps: float, least: float, same: bool):
    """Yield ``(i, j, linked)`` for the pairs of short intervals of two sequences that may hold links.

    ``va, sa`` are the vectors and their leading coordinates, both in grid
    order. With ``same`` both sequences are one; every pair then comes once.
    """
    stack = [(0, len(va), 0, len(vb), same)]
    while stack:
        a0, a1, b0, b1, own = stack.pop()
        if not own:
            gap = np.maximum(0, np.maximum(sb[b0:b1].min(axis=0) - sa[a0:a1].max(axis=0), sa[a0:a1].min(axis=0) - sb[b0:b1].max(axis=0)))
            if gap @ gap > eps * eps + _SLACK:
                continue
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            linked = cosines(va[a0:a1], vb[b0:b1]) >= least
            if own:
                np.fill_diagonal(linked, False)
            if linked.any():
                yield slice(a0, a1), slice(b0, b1), linked, own
        elif own:
            mid = (a0 + a1) // 2
            stack += [(a0, mid, a0, mid, True), (mid, a1, mid, a1, True), (a0, mid, mid, a1, False)]
        elif a1 - a0 >= b1 - b0:
            mid = (a0 + a1) // 2
            stack += [(a0, mid, b0, b1, False), (mid, a1, b0, b1, False)]
        else:
            mid = (b0 + b1) // 2
            stack += [(a0, a1, b0, mid, False), (a0, a1, mid, b1, False)]


def links_of(va, sa, ia, ca, vb, sb, ib, cb, eps: float, least: float, same: bool):
    """Links per vector on both sides, each counting the copies of what it leads to, and the smallest id each is tied to."""
    na, nb = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
    found = []
    for a, b, linked, own in interval_join(va, sa, vb, sb, eps, least, same):
        na[a] += linked @ cb[b]
        if not own:
            (na if same else nb)[b] += ca[a] @ linked
        found.append((a, b, linked))
    ta, tb = ia.copy(), (ib.copy() if not same else None)
    if same:
        tb = ta
    top, moved = np.iinfo(np.int64).max, True
    while moved:  # smallest ids spread along the links until nothing changes
        moved = False
        for a, b, linked in found:
            new_a = np.minimum(ta[a], np.where(linked, tb[b][None, :], top).min(axis=1))
            moved |= bool((new_a < ta[a]).any())
            ta[a] = new_a
            new_b = np.minimum(tb[b], np.where(linked, ta[a][:, None], top).min(axis=0))
            moved |= bool((new_b < tb[b]).any())
            tb[b] = new_b
    return na, nb, ta, tb


def _join(eps: float, least: float):
    def task(batches):
        for batch in batches:
            for r in batch.to_pylist():
                dim, same = r["dim"], r["a"] == r["b"]
                side = lambda n: (
                    np.frombuffer(r[f"vectors{n}"], np.float64).reshape(-1, dim),
                    np.frombuffer(r[f"spots{n}"], np.float64).reshape(-1, LEADING),
                    np.frombuffer(r[f"ids{n}"], np.int64),
                    np.frombuffer(r[f"copies{n}"], np.int64),
                )
                one = side("1")
                two = one if same else side("2")
                na, nb, ta, tb = links_of(*one, *two, eps, least, same)
                for block, ids, n, tied in ((r["a"], one[2], na, ta), (r["b"], two[2], nb, tb))[: 1 if same else 2]:
                    hit = np.flatnonzero(n)
                    if len(hit):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(hit), block)), pa.array(hit), pa.array(ids[hit]), pa.array(n[hit]), pa.array(tied[hit])],
                            names=["block", "at", "vec_id", "n", "tied"],
                        )

    return task


def _rows(batches):
    for batch in batches:
        for r in batch.to_pylist():
            ids, copies = (np.frombuffer(r[c], np.int64) for c in ("ids", "copies"))
            keys = np.frombuffer(r["keys"], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), r["block"])), *[pa.array(x) for x in (np.arange(len(ids)), ids, copies, keys[:, 0], keys[:, 1])]],
                names=["block", "at", "rep", "m", "h1", "h2"],
            )


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors`` (``vec_id``, ``embedding``, ``label``)."""
    eps = math.sqrt(2 - 2 * least) + _SLACK
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    sample = rows.where("vec_id is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding")
    fitted = sample.repartition(1).mapInArrow(_basis, "dim int, axes binary").collect()
    axes = (fitted[0]["dim"], np.frombuffer(fitted[0]["axes"], np.float64).reshape(fitted[0]["dim"], -1)) if fitted else None

    usable = F.col("good") & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    same = ["label", "dim", "vector"]
    placed = staged(rows.mapInArrow(
        _cells(eps, axes), "vec_id long, label string, good boolean, dim int, vector binary, cells array<int>, spot array<double>"
    ).withColumns({"h1": F.when(usable, F.xxhash64(*same)), "h2": F.when(usable, F.xxhash64(F.lit("second"), *same))}))
    # one row per different vector of a label
    groups = staged(placed.where(usable).groupBy(*KEY).agg(
        F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"),
        *[F.first(c).alias(c) for c in ("label", "dim", "vector", "cells", "spot")],
    ))
    order = ["label", "dim", *[F.col("cells")[i] for i in range(LEADING)], "vec_id"]
    blocks = staged(
        groups.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
        .select("vec_id", "copies", *KEY, "label", "dim", "vector", "spot")
        .mapInArrow(_cut(eps), "label string, dim int, ids binary, copies binary, keys binary, vectors binary, spots binary, lo array<double>, hi array<double>, first int, last int")
        .withColumn("block", F.monotonically_increasing_id())
    )
    boxes = blocks.select("block", "label", "dim", "lo", "hi", "first", "last")
    one, two = (boxes.select("label", "dim", *[F.col(c).alias(f"{c}{i}") for c in ("block", "lo", "hi", "first", "last")]) for i in "12")
    one = one.withColumn("cell", F.explode(F.sequence("first1", "last1")))
    two = two.withColumn("cell", F.explode(F.sequence(F.col("first2") - 1, F.col("last2") + 1)))
    gap = sum(
        (F.pow(F.greatest(F.lit(0.0), F.col("lo2")[i] - F.col("hi1")[i], F.col("lo1")[i] - F.col("hi2")[i]), 2) for i in range(LEADING)),
        F.lit(0.0),
    )
    pairs = one.join(two, ["label", "dim", "cell"]).where(
        (F.col("block1") <= F.col("block2")) & (gap <= eps * eps + _SLACK)
        & (F.col("cell") == F.greatest(F.col("first1"), F.col("first2") - 1))  # a pair comes in its first common cell only
    ).select(F.col("block1").alias("a"), F.col("block2").alias("b"))
    side = lambda i, key: blocks.select(F.col("block").alias(key), *[F.col(c).alias(f"{c}{i}") for c in ("vectors", "spots", "ids", "copies")])
    met = (
        pairs.join(side("1", "a").join(blocks.select(F.col("block").alias("a"), "dim"), "a"), "a").join(side("2", "b"), "b")
        .repartition(tasks, F.xxhash64("a", "b"))
        .select("a", "b", "dim", *[f"{c}{i}" for i in "12" for c in ("vectors", "spots", "ids", "copies")])
    )
    found = staged(met.mapInArrow(_join(eps, least), "block long, at long, vec_id long, n long, tied long"))

    # an id with several vectors is one node: it is tied to the smallest id of each
    shared = placed.where(usable).groupBy("vec_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("vec_id")
    ties = placed.join(shared, "vec_id", "left_semi").where(usable).select("vec_id", *KEY).join(groups.select(*KEY, F.col("vec_id").alias("b")), KEY)
    labels = components(found.select(F.col("vec_id").alias("a"), F.col("tied").alias("b")).union(ties.select(F.col("vec_id").alias("a"), "b")))
    counts = found.groupBy("block", "at").agg(F.sum("n").alias("n"))
    inside = blocks.select("block", "ids", "copies", "keys").mapInArrow(_rows, "block long, at long, rep long, m long, h1 long, h2 long")
    whole = staged(
        inside.join(counts, ["block", "at"], "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
            *KEY, "m", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")
        )
    )
    linked = attach(placed.where(usable).select("vec_id", *KEY), whole, KEY, "m", ["n_links", "component_id"])
    alone = placed.where(~usable | usable.isNull()).select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    return linked.select("vec_id", "n_links", "component_id").unionByName(alone).select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
