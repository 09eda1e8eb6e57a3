"""Merkle manifest of documents with retained SHA-256 midstates (operator 12).

Every document is a leaf, every language a binary tree over its leaves in the
order of ``doc_id``, and the languages' roots, ordered by language, are the
leaves of a last tree, whose root stands for the data set.

A digest as hex text fills one 64-byte block of SHA-256. A parent therefore
retains the hash state before each child slot: the initial one before the
first, the state after the left digest before the second, 32 bytes each.
Replacing a leaf folds up to the root by resuming, at every parent, the state
before the replaced child's slot with the replacement and the siblings right of
it; siblings on the left are never hashed again. ``hashlib`` can copy a state
but not store it, so states are advanced by a numpy SHA-256 that takes whole
columns of them (``compress``); the tests hold it against ``hashlib``.

Leaves are numbered by a range sort and cut into aligned blocks of 4,096,
twelve levels of the tree. A block is one row of the retained table: its leaves
and all its parents with their states. The blocks' own digests are the leaves
of the next twelve levels, and so on; what a block needs of the levels above is
one path of 65 bytes a level. Tasks hold one block at a time, and no key,
however frequent, is one task's work, because a language is cut by position.

Defined results: null fields count as ``-``; a null ``doc_id`` comes first and
is never tampered with; rows that share an id are ordered by their leaf, so
equal rows are leaves of their own; a null language is a tree of its own, the
first. Missing columns count as null, other columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pdengine.llm.tables import attach, numbered, staged

#: Levels of the tree in one row of the retained table, which has 2**LEVELS leaves.
LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A leaf is tampered with where this divides the checksum of its id.
TAMPERED = 7
W = np.uint32

# Fixed values of SHA-256: fractional parts of roots of the first primes.
_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, int(p**0.5) + 1))]


def _fraction(value: int, root: int) -> int:
    """First 32 bits of the fractional part of the square or cube root of a whole number."""
    big = value << (32 * root)
    low, high = 0, 1 << 40
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if mid**root <= big else (low, mid)
    return low & 0xFFFFFFFF


_START = np.array([_fraction(p, 2) for p in _PRIMES[:8]], W)
_ROUND = np.array([_fraction(p, 3) for p in _PRIMES[:64]], W)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> W(by)) | (x << W(32 - by))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """SHA-256 states (8 rows, one column each) advanced by blocks (16 rows of 32-bit words)."""
    w = np.empty((64, block.shape[1]), W)
    w[:16] = block
    for i in range(16, 64):
        x, y = w[i - 15], w[i - 2]
        w[i] = w[i - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> W(3))) + w[i - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> W(10)))
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        t = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[i] + w[i]
        s = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = t + s, a, b, c, d + t, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def hexed(digests: np.ndarray) -> np.ndarray:
    """Hex text of digests, one row of 64 bytes each."""
    out = np.empty((len(digests), 64), np.uint8)
    out[:, 0::2], out[:, 1::2] = _HEX[digests >> 4], _HEX[digests & 15]
    return out


def _words(digests: np.ndarray) -> np.ndarray:
    """The hash block that each digest's hex text fills."""
    return np.ascontiguousarray(hexed(digests).view(">u4").astype(W).T)


def _closing(n: int, children: np.ndarray | int) -> np.ndarray:
    """The last block of messages made of ``children`` digests."""
    out = np.zeros((16, n), W)
    out[0], out[15] = 0x80000000, np.asarray(children) * 512
    return out


def _bytes(state: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(state.T.astype(">u4")).view(np.uint8).reshape(-1, 32)


def _states(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(-1, 32).view(">u4").astype(W).T)


def before_slots(n: int) -> np.ndarray:
    """The state before the first slot, ``n`` times."""
    return np.repeat(_START[:, None], n, axis=1)


def levels_above(count: int, most: int = LEVELS) -> int:
    """Levels over ``count`` nodes until one remains, no more than a block has."""
    return min(most, max(count - 1, 0).bit_length())


def grow(leaves: np.ndarray, levels: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Digests of every level, the leaves' first, and per level of parents the states before their second slot."""
    digests, states = [leaves], []
    for _ in range(levels):
        now = digests[-1]
        pairs, parents = len(now) // 2, (len(now) + 1) // 2
        left = compress(before_slots(parents), _words(now[0::2]))
        whole = left.copy()
        if pairs:
            whole[:, :pairs] = compress(left[:, :pairs], _words(now[1::2]))
        children = np.full(parents, 2)
        children[pairs:] = 1
        states.append(_bytes(left))
        digests.append(_bytes(compress(whole, _closing(parents, children))))
    return digests, states


def fold_step(now: np.ndarray, second: np.ndarray, state: np.ndarray, right: np.ndarray, has_right: np.ndarray) -> np.ndarray:
    """Parents' digests after their child became ``now``.

    ``state`` holds each parent's retained state before the child's slot;
    ``second`` says which slot that is, ``right`` the sibling right of it.
    """
    s = compress(state, _words(now))
    some = np.flatnonzero(has_right)
    if len(some):
        s[:, some] = compress(s[:, some], _words(right[some]))
    return _bytes(compress(s, _closing(len(now), 1 + (second | has_right).astype(np.int64))))


# A path is a run of steps: kind (0 first of two, 1 second of two, 2 only child), state before the slot, the sibling.
_STEP = 65


def steps_within(digests: list[np.ndarray], states: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For every level of a block: each leaf's kind, state before its slot, sibling."""
    at = np.arange(len(digests[0]))
    start = _bytes(before_slots(1))
    for now, kept in zip(digests, states, strict=False):
        second = at & 1 == 1
        sibling = at ^ 1
        paired = sibling < len(now)
        kind = np.where(second, 1, np.where(paired, 0, 2)).astype(np.uint8)
        state = np.where(second[:, None], kept[at >> 1], start)
        yield kind, state, np.where(paired[:, None], now[np.minimum(sibling, len(now) - 1)], 0).astype(np.uint8)
        at = at >> 1


def read_path(path: bytes) -> np.ndarray:
    return np.frombuffer(path, np.uint8).reshape(-1, _STEP)


def fold(replacements: np.ndarray, digests: list[np.ndarray], states: list[np.ndarray], path: bytes) -> np.ndarray:
    """Roots that the replacements of a block's leaves give, one by one."""
    now = replacements
    for kind, state, sibling in steps_within(digests, states):
        now = fold_step(now, kind == 1, _states(state), sibling, kind == 0)
    n = len(now)
    for step in read_path(path):
        first = np.full(n, step[0] == 0)
        now = fold_step(now, np.full(n, step[0] == 1), np.repeat(_states(step[1:33]), n, axis=1), np.repeat(step[None, 33:], n, axis=0), first)
    return now


def proofs(digests: list[np.ndarray], states: list[np.ndarray], path: bytes) -> list[str]:
    """Hash of each leaf's siblings, level by level, as hex text."""
    n = len(digests[0])
    inside = [(kind != 2, hexed(sibling)) for kind, _, sibling in steps_within(digests, states)]
    above = b"".join(hexed(s[None, 33:]).tobytes() for s in read_path(path) if s[0] != 2)
    if not inside:
        return [hashlib.sha256(above).hexdigest()] * n
    real, text = np.stack([r for r, _ in inside], axis=1), np.stack([t for _, t in inside], axis=1)
    return [hashlib.sha256(text[i][real[i]].tobytes() + above).hexdigest() for i in range(n)]


def _fixed(column: pa.Array) -> np.ndarray:
    """A binary column of 32 bytes a row as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _blocks(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.Table]:
    """Sorted rows, one table per block of a group."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column("grp").to_numpy(), batch.column("pos").to_numpy() >> levels], axis=1)
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            here = tuple(key[a].tolist())
            if held and here != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = here
    if held:
        yield pa.Table.from_batches(held)


def _pack(carried: list[str], levels: int):
    def task(batches):
        for block in _blocks(batches, levels):
            leaves, n = _fixed(block.column("digest")), block.column("n")[0].as_py()
            digests, states = grow(leaves, levels_above(n, levels))
            row = {
                "grp": block.column("grp")[0].as_py(), "block": block.column("pos")[0].as_py() >> levels,
                "n_blocks": (n + (1 << levels) - 1) >> levels, "digest": digests[-1][0].tobytes(),
                "size": len(leaves), "levels": len(states),
                "nodes": b"".join(d.tobytes() for d in digests), "states": b"".join(s.tobytes() for s in states),
            }
            arrays = [pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in row.values()]
            for c in carried:
                values = block.column(c).combine_chunks()
                arrays.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
            yield pa.RecordBatch.from_arrays(arrays, names=[*row, *carried])

    return task


def packed(nodes: DataFrame, levels: int, *carried: str) -> DataFrame:
    """Retained blocks of ``nodes`` (``grp, pos, n, digest``), a row each; ``carried`` columns become lists."""
    types = dict(nodes.dtypes)
    lists = "".join(f", {c} array<{types[c]}>" for c in carried)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        nodes.select("grp", "pos", "n", "digest", *carried)
        .repartition(parts, "grp", F.shiftright("pos", levels))
        .sortWithinPartitions("grp", "pos")
    )
    return staged(ordered.mapInArrow(
        _pack(list(carried), levels),
        f"grp long, block long, n_blocks long, digest binary, size long, levels long, nodes binary, states binary{lists}",
    ))


def _levels(row: dict) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Digests and states by level of a retained block."""
    nodes, states = (np.frombuffer(row[k], np.uint8).reshape(-1, 32) for k in ("nodes", "states"))
    digests, kept, size, at, from_state = [], [], row["size"], 0, 0
    for level in range(row["levels"] + 1):
        digests.append(nodes[at : at + size])
        at += size
        size = (size + 1) // 2
        if level < row["levels"]:
            kept.append(states[from_state : from_state + size])
            from_state += size
    return digests, kept


def _child_paths(levels: int):
    def task(batches):
        for batch in batches:
            for row in batch.to_pylist():
                digests, states = _levels(row)
                n = row["size"]
                steps = [np.concatenate([k[:, None], s, b], axis=1) for k, s, b in steps_within(digests, states)]
                raw = np.concatenate(steps, axis=1) if steps else np.zeros((n, 0), np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["grp"]] * n, pa.int64()), pa.array(np.arange(n) + (row["block"] << levels)),
                     pa.array([row["block"]] * n, pa.int64()), pa.array([r.tobytes() for r in raw], pa.binary())],
                    names=["grp", "pos", "block", "inner"],
                )

    return task


def child_paths(blocks: DataFrame, levels: int) -> DataFrame:
    """``(grp, pos, block, inner)``: each child of retained blocks with its path to the block's digest."""
    return blocks.select("grp", "block", "size", "levels", "nodes", "states").mapInArrow(
        _child_paths(levels), "grp long, pos long, block long, inner binary"
    )


def paths(blocks: DataFrame, levels: int) -> DataFrame:
    """``(grp, block, path, root)``: each block's way to the root of its group, and that root."""
    if blocks.where("n_blocks > 1").isEmpty():
        return blocks.select("grp", "block", F.lit(b"").alias("path"), F.col("digest").alias("root"))
    upper = packed(blocks.select("grp", F.col("block").alias("pos"), F.col("n_blocks").alias("n"), "digest"), levels)
    return staged(
        child_paths(upper, levels).join(paths(upper, levels), ["grp", "block"]).select("grp", F.col("pos").alias("block"), F.concat("inner", "path").alias("path"), "root")
    )


def leaf(fields: dict[str, Column]) -> Column:
    """Digest of a document: every field with its length in bytes before it, ``-`` where it is null."""
    return F.sha2(F.concat(*[
        F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in fields.values()
    ]).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, leaf, other``: each document's digest and the one that tampering leaves, the same where none does."""
    have = {c.lower() for c in docs.columns}
    fields = {f: F.col(f).cast("string") if f in have else F.lit(None).cast("string") for f in FIELDS}
    more = F.col("n_chars").cast("decimal(38,0)") + 1 if "n_chars" in have else F.lit(None)
    changed = F.coalesce(F.crc32(fields["doc_id"].cast("binary")) % TAMPERED == 0, F.lit(False))
    made = docs.select(
        (F.col("doc_id").cast("long") if "doc_id" in have else F.lit(None).cast("long")).alias("doc_id"),
        fields["lang"].alias("lang"), F.unhex(leaf(fields)).alias("leaf"),
        F.when(changed, F.unhex(leaf(fields | {"n_chars": more.cast("string")}))).alias("other"),
    )
    return staged(made.withColumn("other", F.coalesce("other", "leaf")))


def trees(found: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """Retained blocks of all languages' trees, and ``(grp, block, path, subroot, root)`` of each."""
    placed = numbered(found, "lang", "doc_id", "leaf").withColumn("_k", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")))
    langs = staged(placed.groupBy("_k").agg(F.min("_place").alias("_from"), F.count(F.lit(1)).alias("n"), F.min("lang").alias("lang")))
    langs = staged(numbered(langs, "lang").withColumnRenamed("_place", "grp"))
    nodes = attach(placed.drop("lang"), langs, ["_k"], "n", ["_from", "n", "grp"]).select(
        "grp", (F.col("_place") - F.col("_from")).alias("pos"), "n", F.col("leaf").alias("digest"), "doc_id", "other",
    )
    blocks = packed(nodes, levels, "doc_id", "other")
    below = staged(paths(blocks, levels).withColumnRenamed("root", "subroot"))
    subroots = below.where("block = 0").select(
        F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"), F.lit(langs.count()).cast("long").alias("n"), F.col("subroot").alias("digest")
    )
    top = packed(subroots, levels)
    over = child_paths(top, levels).join(paths(top, levels), ["grp", "block"]).select(F.col("pos").alias("grp"), F.concat("inner", "path").alias("over"), "root")
    return blocks, below.join(over, "grp").select("grp", "block", F.concat("path", "over").alias("path"), "subroot", "root")


def _folded(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            row = {c: one.column(c)[0].as_py() for c in ("size", "levels", "nodes", "states", "path", "subroot", "root")}
            digests, states = _levels(row)
            others = _fixed(one.column("other").flatten())
            roots, n = fold(others, digests, states, row["path"]), row["size"]
            text = lambda d: [bytes(r).decode() for r in hexed(d)]
            root = row["root"].hex()
            folded = text(roots)
            yield pa.RecordBatch.from_arrays(
                [one.column("doc_id").flatten(), pa.array(text(digests[0])), pa.array([row["subroot"].hex()] * n), pa.array([root] * n),
                 pa.array(proofs(digests, states, row["path"])), pa.array(folded), pa.array([f == root for f in folded])],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Each document's leaf, roots, hashed proof, and the root that folding its leaf as it now is gives.

    Where ``TAMPERED`` divides the checksum of the id the leaf folded is that
    of the document with one more in ``n_chars``; ``verified`` tells whether the
    folded root is still the manifest's.
    """
    blocks, ways = trees(leaves(docs), levels)
    return blocks.join(ways, ["grp", "block"]).select(
        "size", "levels", "nodes", "states", "path", "subroot", "root", "doc_id", "other"
    ).mapInArrow(
        _folded, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
