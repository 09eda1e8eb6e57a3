"""Words and shingles of Arrow text columns, hashed whole batches at a time.

A word is a run of bytes other than 0x20 and 0x09-0x0D; since these are ASCII,
bytes of UTF-8 give the same words as characters do. Words get 64-bit
hashes, whole batches at a time, so no Python object is made per word.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: Bytes of a span up to which it is hashed together with others.
_CHAINED = 256
#: Masks of the lowest 0 to 8 bytes.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACES = np.random.default_rng(20_250_102).integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a hash: every bit of the result depends on every bit of the input."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each begins (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans.

    Eight bytes at a time are mixed into the hash, all spans together. Sums of
    powers would be quicker for long spans, but modulo 2**64 they are equal for
    texts that differ in a regular way. Spans of more than ``_CHAINED`` bytes are
    few and get a digest each.
    """
    size = end - start
    out = mix(size.astype(U) * U(_BASE))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    left = np.flatnonzero((size > 0) & (size <= _CHAINED))
    at = 0
    while len(left):
        rest = size[left] - at
        block = eight[start[left] + at] & _LOW[np.minimum(rest, 8)]
        out[left] = mix((out[left] ^ block) * U(_STEP) + U(at + 1))
        at += 8
        left = left[rest > 8]
    for i in np.flatnonzero(size > _CHAINED).tolist():
        out[i] = U(int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little"))
    return out


@dataclass
class Words:
    """Words of a batch in order: byte spans, number of the text, hash."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    texts: int

    @property
    def per_text(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.texts)


def words(column: pa.Array, lower: bool = True) -> Words:
    with np.errstate(over="ignore"):
        data, offsets = buffers(column)
        if lower:
            data = _LOWER[data]
        inside = ~_SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        start = np.flatnonzero(inside & (~before | cut[:-1]))
        end = np.flatnonzero(inside & (~after | cut[1:])) + 1
        text = np.searchsorted(offsets, start, "right") - 1
        return Words(data, start, end, text, span_hashes(data, start, end), len(offsets) - 1)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of runs of ``size`` words, sorted within each text, and where each text's begin.

    A text with fewer words has its whole sequence as the only one; a text
    without words has none.
    """
    with np.errstate(over="ignore"):
        n = w.per_text
        first = np.concatenate([[0], np.cumsum(n)])
        rolled = np.zeros(max(0, len(w.hash) - size + 1), U)
        for j in range(size):
            rolled += w.hash[j : j + len(rolled)] * _PLACES[j % 64] + U(j // 64)
        rolled = mix(rolled + U(size))
        sets = []
        for t in range(w.texts):
            a, b = int(first[t]), int(first[t + 1])
            if b - a >= size:
                s = np.sort(rolled[a : b - size + 1])
                sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif b > a:
                places = _PLACES[np.arange(b - a) % 64]
                sets.append(mix(np.array([np.sum(w.hash[a:b] * places, dtype=U) + U(b - a)], U)))
            else:
                sets.append(np.zeros(0, U))
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
        return (np.concatenate(sets) if sets else np.zeros(0, U)), offsets
