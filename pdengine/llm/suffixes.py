"""Repeated byte strings by blockwise suffix sorting with a difference cover (operator 3).

Only equality to a depth of ``window`` bytes matters, so a suffix is known by
its first ``window`` bytes. A difference cover D modulo v holds two residues for
every difference, so any two positions reach sample positions (those in D
modulo v, counted from the start of the document) by one common step below v.
Two equal windows therefore hold an equal sample string of window - v + 1
bytes at that step.

1. Cover: sample strings of all documents are ranked, blockwise. A rank is held
   by one suffix only, or by several.
2. A window without any sample of a repeated rank cannot be repeated; all others
   are candidates. This is where long ties are settled: unique text, the bulk
   of a corpus, never reaches the suffix sort.
3. Candidate suffixes are sorted one bucket at a time; buckets are taken in
   passes, so that a pass moves a bounded share of the input, and a task holds
   one bucket. Neighbours with equal keys are repeated.

Ranks and sort keys are fingerprints of the strings, sums modulo 2**64 (of
which stage 1 moves 32 bits and the bucket), so buckets are in fingerprint
order, which serves equality as well as lexicographic order does. Equal strings
always have equal keys; that different ones have different keys is not relied
on: what is removed has to agree in a second fingerprint too, two sums modulo a
prime of 31 bits. Bytes are not compared. Two different windows of 200 bytes
agree in it for at most one choice of bases in 2^46, whatever they are, and by
chance about n^2 / 2^127 pairs among n windows agree in all (6e-19 at n = 1e10). Documents travel in chunks
of about a megabyte; within a chunk equal strings are merged before the
shuffle, so a string that fills a third of the corpus costs a row per chunk.

Defined results: null and empty texts, and those shorter than the window, keep
all bytes. Repeated rows are documents of their own, so their windows repeat.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pdengine.llm.tables import slices, staged
from pdengine.llm.words import U, buffers, mix

#: Bytes of a chunk, and strings of a bucket, about.
CHUNK, BUCKET = 1 << 20, 1 << 20
#: A pass sorts at most one candidate for so many bytes of text.
PASS_SHARE = 16
#: 128 bits of a document's id and text.
ROW = ["row", "row2"]
#: Perfect difference sets, which hold every difference once.
_PERFECT = {133: (1, 2, 4, 13, 21, 35, 39, 82, 89, 95, 105, 110), 13: (0, 1, 3, 9)}


def difference_cover(v: int) -> np.ndarray:
    """Residues modulo ``v`` such that every difference is one of two of them."""
    if v in _PERFECT:
        return np.array(_PERFECT[v])
    r = max(1, math.isqrt(v))
    return np.array(sorted({i % v for i in range(r + 1)} | {k * r % v for k in range(v // r + 2)}))


#: Modulus of the deciding sums, a prime: modulo 2**64 texts that differ in a regular way can agree for any base.
_PRIME = (1 << 31) - 1
_P, _31 = U(_PRIME), U(31)
#: Bases and byte values: of the sort key, one sum modulo 2**64; of the second fingerprint, two modulo the prime.
_DRAWN = np.random.default_rng(20_250_101)
_KEY_BASE, _KEY_VALUES = 0x9E3779B97F4A7C15, _DRAWN.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASES = _DRAWN.integers(1 << 20, _PRIME, 2).tolist()
_VALUES = _DRAWN.integers(1, _PRIME, (2, 256), dtype=np.uint64)


def _folded(x: np.ndarray) -> np.ndarray:
    """Smaller numbers that are equal modulo the prime: below 2**33 from 64 bits, at most 2**31 + 3 from 33."""
    return (x & _P) + (x >> _31)


def _powers(base: int, n: int, prime: bool) -> np.ndarray:
    out = np.ones(n, U)
    filled = 1
    while filled < n:
        more = min(filled, n - filled)
        new = out[:more] * U(pow(base, filled, _PRIME if prime else 1 << 64))
        out[filled : filled + more] = new % _P if prime else new
        filled += more
    return out


class Sums:
    """Fingerprints of substrings of fixed length from prefix sums.

    Kind 0 is one sum modulo 2**64, quick and good enough for sorting; kind 1
    decides: two sums modulo the prime side by side. Two different strings of
    length n agree in each of these for at most n of all bases.
    """

    powers: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def __init__(self, data: np.ndarray, kind: int = 0):
        n, bases = len(data), _BASES if kind else [_KEY_BASE]
        if kind not in Sums.powers or n >= len(Sums.powers[kind][0][0]):
            room, modulus = max(CHUNK + 1, 2 * n), _PRIME if kind else 1 << 64
            Sums.powers[kind] = [tuple(_powers(b, room, kind == 1) for b in (base, pow(base, -1, modulus))) for base in bases]
        self.kind, self.sums = kind, []
        with np.errstate(over="ignore"):
            for (up, _), values in zip(Sums.powers[kind], _VALUES if kind else [_KEY_VALUES], strict=True):
                terms = values[data] * up[:n]
                sums = np.zeros(n + 1, U)
                np.cumsum(_folded(terms) if kind else terms, out=sums[1:])  # folded ones stay below 2**64 for 2 GB of text
                self.sums.append(sums)

    def at(self, position: np.ndarray, length: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            if not self.kind:
                sums = self.sums[0]
                return mix((sums[position + length] - sums[position]) * Sums.powers[0][0][1][position])
            out = np.zeros(len(position), U)
            for (_, down), sums in zip(Sums.powers[1], self.sums, strict=True):
                rest = _folded(_folded(sums[position + length] - sums[position]))
                found = _folded(_folded(rest * down[position]))
                out = (out << _31) | np.where(found >= _P, found - _P, found)
            return mix(out)


def sample_positions(lengths: np.ndarray, window: int, v: int) -> np.ndarray:
    """Sample positions of a chunk whose documents have these lengths, in order."""
    inside = np.zeros(v, bool)
    inside[difference_cover(v)] = True
    size = window - v + 1
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    local = np.arange(int(lengths.sum())) - np.repeat(starts, lengths)
    room = np.repeat(np.where(lengths >= window, lengths - size, -1), lengths)
    return np.flatnonzero(inside[local % v] & (local <= room))


def merged(lo: np.ndarray, hi: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ranges ``[lo, hi]`` that touch, per document; both ends must ascend within a document."""
    if not len(lo):
        return lo, hi, doc
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(lo) - 1]])
    return lo[first], hi[last], doc[first]


def _packed(*arrays: np.ndarray) -> bytes:
    return np.concatenate([[len(arrays)], [len(a) for a in arrays], *arrays]).astype(np.int64).tobytes()


def _unpacked(raw: bytes) -> list[np.ndarray]:
    whole = np.frombuffer(raw, np.int64)
    n = int(whole[0])
    return np.split(whole[1 + n :], np.cumsum(whole[1 : 1 + n])[:-1])


_ENTRIES = "bucket long, chunk long, keys binary, places binary, about binary"
_SCHEMA = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("places", pa.binary()), ("about", pa.binary())])


def _ranked(keys: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys, then of their second fingerprints, and which equal the one before in both."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if second is not None:
        other = second[order]
        if (same & (other[1:] != other[:-1])).any():  # rare: different strings share a key
            order = np.lexsort((second, keys))
            ranked, other = keys[order], second[order]
        same = (ranked[1:] == ranked[:-1]) & (other[1:] == other[:-1])
    return order, same


def _entries(chunk: int, keys: np.ndarray, second: np.ndarray | None, places: np.ndarray, bits: int, kind, about: bytes) -> pa.RecordBatch:
    """Rows of one chunk: its distinct keys by bucket, and one row about it with the places of keys it holds twice.

    A bucket's keys are followed by their second fingerprints, if there are any.
    """
    order, same = _ranked(keys, second)
    keys, places = keys[order], places[order].astype(np.uint32)
    new = np.ones(len(keys), bool)
    new[1:] = ~same
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(keys)]]))
    twice = places[np.repeat(count > 1, count)]
    keys, places = keys[first], places[first]
    bucket = (keys >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.concatenate([edges[1:], [len(bucket)]]).astype(np.int64) if len(bucket) else edges
    low = (keys if kind is np.uint64 else (keys >> U(32 - bits)) & U(0xFFFFFFFF)).astype(kind)
    more = second[order][first] if second is not None else np.zeros(0, U)
    rows = [(int(bucket[a]), low[a:b].tobytes() + more[a:b].tobytes(), places[a:b].tobytes(), None) for a, b in zip(edges, ends, strict=True)]
    rows.append((chunk % (1 << bits), None, twice.tobytes(), about))
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int64()), pa.array([chunk] * len(rows), pa.int64()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
        schema=_SCHEMA,
    )


def _chunks(batches):
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    number = 0
    for whole in batches:
        for batch in slices(whole, "text", CHUNK):
            yield (part << 32) | number, batch
            number += 1


def _cover_task(window: int, v: int, bits: int):
    def task(batches):
        for chunk, batch in _chunks(batches):
            data, offsets = buffers(batch.column("text"))
            lengths = np.diff(offsets)
            at = sample_positions(lengths, window, v)
            keys = Sums(data).at(at, window - v + 1)
            about = _packed(batch.column("row").to_numpy(), batch.column("row2").to_numpy(), lengths)
            yield _entries(chunk, keys, None, np.arange(len(at)), bits, np.uint32, about)

    return task


def _candidates(ranges: list[np.ndarray], offsets: np.ndarray) -> np.ndarray:
    """Places of all candidates of a chunk; ``ranges`` holds first and last (inclusive) per document."""
    spans = [r.reshape(-1, 2) + o for r, o in zip(ranges, offsets, strict=False)]
    both = np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)
    size = both[:, 1] - both[:, 0] + 1
    return np.repeat(both[:, 0] - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size, size) + np.arange(size.sum())


def _suffix_task(window: int, bits: int, passes: int, turn: int):
    def task(batches):
        for chunk, batch in _chunks(batches):
            data, offsets = buffers(batch.column("text"))
            ranges = [np.frombuffer(r, np.int64) for r in batch.column("ranges").to_pylist()]
            at = _candidates(ranges, offsets[:-1])
            keys = Sums(data).at(at, window)
            mine = np.flatnonzero(keys % U(passes) == turn) if passes > 1 else np.arange(len(at))
            sizes = np.array([len(r) for r in ranges], np.int64)
            about = _packed(batch.column("row").to_numpy(), batch.column("row2").to_numpy(), np.diff(offsets), sizes, np.concatenate(ranges))
            second = Sums(data, 1).at(at[mine], window)
            yield _entries(chunk, keys[mine], second, mine, bits, np.uint64, about)

    return task


def _sort_bucket(kind):
    """Sort the keys of one bucket; give back, per chunk, the places of keys that have an equal neighbour.

    Keys of 64 bits come with a second fingerprint, which has to agree as well.
    """

    def group(table: pa.Table) -> pa.Table:
        rows = table.select(["chunk", "keys", "places", "about"]).to_pylist()
        held = [r for r in rows if r["keys"] is not None]
        out = [(r["chunk"], r["places"], r["about"]) for r in rows if r["keys"] is None]
        if held:
            sizes = [len(r["places"]) // 4 for r in held]
            keys = np.concatenate([np.frombuffer(r["keys"], kind, n) for r, n in zip(held, sizes, strict=True)])
            second = None
            if kind is np.uint64:
                second = np.concatenate([np.frombuffer(r["keys"], U, n, 8 * n) for r, n in zip(held, sizes, strict=True)])
            order, same = _ranked(keys, second)
            hit = np.zeros(len(keys), bool)
            hit[order[1:][same]] = True
            hit[order[:-1][same]] = True
            for r, mine in zip(held, np.split(hit, np.cumsum(sizes)[:-1]), strict=True):
                if mine.any():
                    out.append((r["chunk"], np.frombuffer(r["places"], np.uint32)[mine].tobytes(), None))
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.Table.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())],
            names=["chunk", "places", "about"],
        )

    return group


def _gathered(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    rows = table.select(["places", "about"]).to_pylist()
    about = next(r["about"] for r in rows if r["about"] is not None)
    return _unpacked(about), np.unique(np.concatenate([np.frombuffer(r["places"], np.uint32) for r in rows])).astype(np.int64)


def _ranges_table(rows: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, offsets: np.ndarray) -> pa.Table:
    edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    ends = np.concatenate([edges[1:], [len(doc)]]) if len(doc) else edges
    each = np.stack([lo - offsets[doc], hi - offsets[doc]], axis=1) if len(doc) else np.zeros((0, 2), np.int64)
    return pa.Table.from_arrays(
        [*[pa.array(r[doc[edges]], pa.int64()) for r in rows], pa.array([each[a:b].astype(np.int64).tobytes() for a, b in zip(edges, ends, strict=True)], pa.binary())],
        names=["row", "row2", "ranges"],
    )


def _candidate_ranges(window: int, v: int):
    """First and last candidate windows per document of a chunk, from the samples whose rank is repeated."""

    def group(table: pa.Table) -> pa.Table:
        (*rows, lengths), hit = _gathered(table)
        at = sample_positions(lengths, window, v)[hit]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        doc = np.searchsorted(offsets, at, "right") - 1
        lo, hi = np.maximum(offsets[doc], at - (v - 1)), np.minimum(at, offsets[doc + 1] - window)
        some = lo <= hi
        return _ranges_table(rows, *merged(lo[some], hi[some], doc[some]), offsets)

    return group


def packed_places(places: np.ndarray) -> bytes:
    """Ascending places as steps of one byte each; 255 stands for a step that goes on.

    A pass finds every so-many-th window of a repeated passage, so ranges would cost 16 bytes each.
    """
    steps = np.diff(places, prepend=0)
    more = steps // 255
    out = np.full(int((more + 1).sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = steps % 255
    return out.tobytes()


def unpacked_places(raw: bytes) -> np.ndarray:
    steps = np.frombuffer(raw, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def _repeated_starts(table: pa.Table) -> pa.Table:
    """Places of the repeated windows per document of a chunk."""
    (*rows, lengths, sizes, flat), hit = _gathered(table)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    at = _candidates(np.split(flat, np.cumsum(sizes)[:-1]), offsets[:-1])[hit]
    doc = np.searchsorted(offsets, at, "right") - 1
    edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    ends = np.concatenate([edges[1:], [len(doc)]]) if len(doc) else edges
    starts = [packed_places(at[a:b] - offsets[doc[a]]) for a, b in zip(edges, ends, strict=True)]
    return pa.Table.from_arrays([*[pa.array(r[doc[edges]], pa.int64()) for r in rows], pa.array(starts, pa.binary())], names=["row", "row2", "starts"])


def _cut(window: int):
    def task(batches):
        for whole in batches:
            for batch in slices(whole, "text", CHUNK):
                out = []
                for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                    raw = (text or "").encode()
                    at = np.sort(np.concatenate([unpacked_places(s) for s in starts or []] or [np.zeros(0, np.int64)]))
                    lo, hi, _ = merged(at, at + window - 1, np.zeros(len(at), np.int64))
                    kept, at = [], 0
                    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                        kept.append(raw[at:a])
                        at = b + 1
                    kept = b"".join([*kept, raw[at:]])
                    out.append((len(raw), len(raw) - len(kept), len(lo), kept, hashlib.sha256(kept).hexdigest()))
                columns = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
                names = ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", *names]
                )

    return task


def _bits(strings: float) -> int:
    """Buckets, as a power of two, for so many strings."""
    return min(31, max(0, math.ceil(math.log2(max(1.0, strings / BUCKET)))))


def remove_repeats(docs: DataFrame, window: int = 200) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256`` for each row of ``docs``.

    Each byte that a repeated string of ``window`` bytes covers is removed;
    ``kept`` holds the remaining bytes and ``n_spans`` counts removed runs.
    """
    v = max(1, window * 2 // 3)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(
        "doc_id", text.alias("text"), F.xxhash64(F.col("doc_id"), text).alias("row"),
        F.xxhash64(F.lit("second"), F.col("doc_id"), text).alias("row2"),
    )
    total = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0

    long_enough = texts.where(F.octet_length("text") >= window).select("row", "row2", "text")
    density = len(difference_cover(v)) / v
    bits = _bits(total * density)
    cover = long_enough.mapInArrow(_cover_task(window, v, bits), _ENTRIES)
    places = "chunk long, places binary, about binary"
    ranges = staged(
        cover.groupBy("bucket").applyInArrow(_sort_bucket(np.uint32), places)
        .groupBy("chunk").applyInArrow(_candidate_ranges(window, v), "row long, row2 long, ranges binary")
    )
    # rows that agree in id and text have equal ranges
    candidates = staged(long_enough.join(ranges.groupBy(*ROW).agg(F.first("ranges").alias("ranges")), ROW).select(*ROW, "text", "ranges"))
    counted = candidates.mapInArrow(_count, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0
    passes = max(1, math.ceil(counted * PASS_SHARE / max(total, 1)))
    bits = _bits(counted / passes)
    found = None
    for turn in range(passes):
        suffixes = candidates.mapInArrow(_suffix_task(window, bits, passes, turn), _ENTRIES)
        part = staged(
            suffixes.groupBy("bucket").applyInArrow(_sort_bucket(np.uint64), places)
            .groupBy("chunk").applyInArrow(_repeated_starts, "row long, row2 long, starts binary")
        )
        found = part if found is None else found.unionByName(part)
    # at most one entry per pass: rows that agree in id and text have equal places
    starts = found.groupBy(*ROW).agg(F.collect_set("starts").alias("starts"))
    return texts.join(starts, ROW, "left").select("doc_id", "text", "starts").mapInArrow(
        _cut(window), f"doc_id {dict(texts.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    )


def _count(batches):
    for batch in batches:
        n = sum(int((r.reshape(-1, 2) @ [-1, 1] + 1).sum()) for r in (np.frombuffer(x, np.int64) for x in batch.column("ranges").to_pylist()))
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})
