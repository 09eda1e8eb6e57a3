"""Approximate nearest neighbours by randomly rotated one-bit codes (operator 4).

Every vector is scaled to length 1, rotated by a fixed random rotation and kept
as the signs of its components, packed to bits, with one correction scalar: the
inner product of the vector with its own code. The inner product of a query
with a vector is estimated from the bits by table lookup and divided by that
scalar; the scalar also bounds the error of the estimate. A query reranks only
vectors whose estimate plus bound reaches its k-th best exact cosine so far.

The index holds every vector, in blocks of bounded size. Queries travel to all
blocks in groups of bounded size, a block only once for ``VISITS`` groups; every
task returns k rows per query and block, which are merged per query.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components are neither queries nor candidates; vectors of different lengths
never meet. Ties go to the smaller id. Rows that repeat an id are separate
candidates; queries that share an id share one list, the nearest to any of
them. A row without an id takes no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pdengine.llm.tables import staged
from pdengine.llm.vectors import cosines, matrix, unit

#: Vectors of an index block and queries of a group: a task holds one of each.
BLOCK, GROUP = 4096, 256
#: Groups that visit a block before it is sent again.
VISITS = 64
#: Partial results that are merged per query before the last step.
SHARDS = 1024
#: Standard deviations of the estimate's error that the bound allows for.
BOUND = 3.0


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random rotation, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of rotated vectors, and the inner product of each vector with its code."""
    dim = vectors.shape[1]
    turned = unit(vectors) @ rotation(dim).T
    bits = turned >= 0
    return np.packbits(bits, axis=1, bitorder="little"), np.abs(turned).sum(axis=1) / math.sqrt(dim)


def estimate(codes: np.ndarray, scalars: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of queries (rows) with coded vectors (columns), and the bound of each vector's error.

    ``queries`` are scaled and rotated. Each byte of a code picks one of 256
    partial sums per query.
    """
    dim = queries.shape[1]
    padded = np.zeros((len(queries), codes.shape[1] * 8))
    padded[:, :dim] = queries
    signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little") * 2.0 - 1.0
    raw = np.zeros((len(queries), len(codes)))
    for byte in range(codes.shape[1]):
        table = padded[:, byte * 8 : byte * 8 + 8] @ signs.T
        raw += table[:, codes[:, byte]]
    bound = BOUND * np.sqrt(np.maximum(1 - scalars**2, 0)) / scalars / math.sqrt(max(dim - 1, 1))
    return raw / math.sqrt(dim) / scalars, bound


def nearest(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray,
    codes: np.ndarray, scalars: np.ndarray, k: int,
) -> list[tuple[int, int, float]]:
    """Query, candidate and cosine of the k best of one block for each query."""
    if not len(ids):
        return []
    about, bound = estimate(codes, scalars, unit(queries) @ rotation(queries.shape[1]).T)
    own = query_ids[:, None] == ids[None, :]
    about = np.where(own, -np.inf, about)
    out = []
    first = np.argpartition(-about, min(k, len(ids)) - 1, axis=1)[:, :k]
    for i in range(len(queries)):
        seed = cosines(queries[i : i + 1], vectors[first[i]])[0]
        seed[own[i, first[i]]] = -np.inf
        worst = seed.min() if len(seed) >= k else -np.inf
        pick = np.flatnonzero((about[i] + bound >= worst) & ~own[i])
        exact = cosines(queries[i : i + 1], vectors[pick])[0]
        best = np.lexsort((ids[pick], -exact))[:k]
        out += [(int(query_ids[i]), int(ids[pick[j]]), float(exact[j])) for j in best]
    return out


def _packed(batches, size: int, coded: bool):
    """Blocks of at most ``size`` usable vectors of one length."""
    waiting: dict[int, list[tuple[int, np.ndarray]]] = {}

    def block(dim: int) -> pa.RecordBatch:
        rows = waiting.pop(dim)
        v = np.stack([r for _, r in rows])
        codes, scalars = encode(v) if coded else (np.zeros(0, np.uint8), np.zeros(0))
        return pa.RecordBatch.from_pydict({
            "dim": pa.array([dim], pa.int32()),
            "ids": [np.array([i for i, _ in rows], np.int64).tobytes()],
            "vectors": [v.tobytes()], "codes": [codes.tobytes()], "scalars": [scalars.tobytes()],
        })

    for batch in batches:
        good, rows = matrix(batch.column("embedding"))
        ids = batch.column("vec_id").to_pylist()
        for i in np.flatnonzero(good):
            if ids[i] is None:
                continue
            kept = waiting.setdefault(len(rows[i]), [])
            kept.append((ids[i], rows[i]))
            if len(kept) >= size:
                yield block(len(rows[i]))
    for dim in list(waiting):
        yield block(dim)


_BLOCK_SCHEMA = "dim int, ids binary, vectors binary, codes binary, scalars binary"


def _search(k: int):
    """Rows sorted by block and slice, the block itself first, then the groups of queries that visit it."""

    def task(batches):
        as_array = lambda raw, kind: np.frombuffer(raw, kind)
        held = None
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                dim = r["dim"]
                if r["queries"] is None:
                    ids = as_array(r["ids"], np.int64)
                    held = (
                        ids, as_array(r["vectors"], np.float64).reshape(-1, dim),
                        as_array(r["codes"], np.uint8).reshape(len(ids), -1), as_array(r["scalars"], np.float64),
                    )
                else:
                    query_ids, queries = as_array(r["ids"], np.int64), as_array(r["queries"], np.float64).reshape(-1, dim)
                    found += [(r["block"] % SHARDS, *f) for f in nearest(query_ids, queries, *held, k)]
            columns = list(zip(*found, strict=True)) or [(), (), (), ()]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["shard", "query_id", "vec_id", "score"]
            )

    return task


def search(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k vectors of largest cosine for each query, itself left out.

    Both tables have ``vec_id`` and ``embedding``.
    """
    narrow = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    n = narrow(vectors).select("vec_id").count()
    # vectors are dealt evenly, so that blocks are full wherever the rows came from
    deal = lambda df, parts: df.repartition(parts, F.xxhash64("vec_id"))
    parts = max(1, -(-n // (2 * BLOCK)))
    index = staged(
        deal(narrow(vectors), parts).mapInArrow(lambda b: _packed(b, BLOCK, True), _BLOCK_SCHEMA)
        .withColumn("block", F.monotonically_increasing_id())
    )
    groups = staged(
        narrow(queries).repartition(max(1, parts // 16), F.xxhash64("vec_id"))
        .mapInArrow(lambda b: _packed(b, GROUP, False), _BLOCK_SCHEMA)
        .select("dim", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
        .withColumn("group", F.monotonically_increasing_id())
    )
    # Every group visits every block of its length: a stated query set against all rows, in blocks. A block travels
    # once for so many visits, its groups travel to it.
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, -(-groups.count() // VISITS), min(-(-tasks // parts), groups.count()))
    null = lambda *names: [F.lit(None).cast("binary").alias(n) for n in names]
    cut = groups.withColumn("slice", F.pmod(F.xxhash64("group"), F.lit(slices)).cast("int"))
    visits = cut.join(index.select("dim", "block"), "dim").select(
        "block", "slice", "dim", F.col("query_ids").alias("ids"), "queries", *null("vectors", "codes", "scalars")
    )
    blocks = index.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select(
        "block", "slice", "dim", "ids", *null("queries"), "vectors", "codes", "scalars"
    )
    met = blocks.unionByName(visits).repartition(tasks, "block", "slice")
    met = met.sortWithinPartitions("block", "slice", F.col("queries").isNotNull())
    found = met.mapInArrow(_search(k), "shard int, query_id long, vec_id long, score double")
    # merged in two steps, so that no list grows with the number of blocks
    first = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k)
    some = found.groupBy("query_id", "shard").agg(first.alias("some"))
    best = some.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("some"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("i", "b")).select(
        "query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.far")).alias("score")
    )
