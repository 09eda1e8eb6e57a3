"""Monotone sequences in Elias-Fano form, and tries made of them, read in place.

A sequence keeps the low bits of its values packed and their high parts in
unary; two directories, of the ones up to each byte and up to each high part,
are counted when a sequence is opened. All operations take whole arrays of positions or values.
Nothing is decoded on opening: the words are views of the buffer, which may be
a memory-mapped file.

A trie holds runs of whole numbers. The children of a node are stored relative
to it, as sums over the nodes before: that makes a level one rising sequence,
and the children of a node are searched by what they are past its base.
"""

from __future__ import annotations

import mmap
from pathlib import Path

import numpy as np

U = np.uint64
_ONE = U(1)
#: Place of the r-th one of a byte, lowest bit first.
_BIT = np.argsort(1 - ((np.arange(256)[:, None] >> np.arange(8)) & 1), axis=1, kind="stable").astype(np.int8)


class Sequence:
    """A rising sequence of whole numbers."""

    def __init__(self, buffer, at: int = 0):
        head = np.frombuffer(buffer, np.int64, 3, at)
        self.n, self.most, self.bits = (int(x) for x in head)
        lows = (self.n * self.bits >> 6) + 2
        highs = (self.n + (self.most >> self.bits) + 1 >> 6) + 1
        self.low = np.frombuffer(buffer, U, lows, at + 24)
        self.high = np.frombuffer(buffer, U, highs, at + 24 + 8 * lows)
        self.end = at + 24 + 8 * (lows + highs)
        self._bytes = np.frombuffer(self.high, np.uint8)
        small = np.int32 if 8 * len(self._bytes) < 1 << 31 else np.int64
        self._ones = np.zeros(len(self._bytes) + 1, small)
        np.cumsum(np.bitwise_count(self._bytes), dtype=small, out=self._ones[1:])
        zeros = np.flatnonzero(np.unpackbits(self._bytes, count=self.n + (self.most >> self.bits) + 1, bitorder="little") == 0)
        self._upto = (zeros - np.arange(len(zeros))).astype(small)
        self._mask = U((1 << self.bits) - 1)
        self._asked, self._values = 0, None

    @staticmethod
    def build(values: np.ndarray) -> bytes:
        n, most = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (most // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * bits >> 6) + 2, U)
        high = np.zeros((n + (most >> bits) + 1 >> 6) + 1, U)
        if n:
            v, at = values.astype(U), np.arange(n)
            if bits:
                part, place = v & U((1 << bits) - 1), at * bits
                word, shift = place >> 6, (place & 63).astype(U)
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                low[word[first]] = np.bitwise_or.reduceat(part << shift, first)
                over = np.flatnonzero((place & 63) + bits > 64)
                low[word[over] + 1] |= part[over] >> (U(64) - shift[over])
            place = (v >> U(bits)).astype(np.int64) + at
            word = place >> 6
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            high[word[first]] = np.bitwise_or.reduceat(_ONE << (place & 63).astype(U), first)
        return np.array([n, most, bits], np.int64).tobytes() + low.tobytes() + high.tobytes()

    def _select(self, k: np.ndarray) -> np.ndarray:
        """Places of the k-th ones of the high parts: a byte by the directory, a bit in it by a table."""
        byte = np.searchsorted(self._ones, k.astype(self._ones.dtype), "right") - 1
        return byte * 8 + _BIT[self._bytes[byte], k - self._ones[byte]]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U)
        place = i * self.bits
        word, shift = place >> 6, (place & 63).astype(U)
        return ((self.low[word] >> shift) | ((self.low[word + 1] << (U(63) - shift)) << _ONE)) & self._mask

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values at places. Once a good share of them has been asked for, all are decoded and kept while this is open."""
        self._asked += len(i)
        if self._values is None and 4 * self._asked > self.n:
            bits = np.flatnonzero(np.unpackbits(self._bytes, bitorder="little"))
            every = np.arange(self.n)
            self._values = (((bits - every).astype(U) << U(self.bits)) | self._low(every)).astype(np.int64)
        if self._values is not None:
            return self._values[i]
        high = (self._select(i) - i).astype(U)
        return ((high << U(self.bits)) | self._low(i)).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Places of values, -1 for those not in the sequence; for sequences without repeats."""
        out = np.full(len(x), -1, np.int64)
        some = np.flatnonzero((x >= 0) & (x <= self.most)) if self.n else np.zeros(0, np.int64)
        if not len(some):
            return out
        v = x[some]
        high, want = v >> self.bits, v.astype(U) & self._mask
        first, last = np.where(high > 0, self._upto[np.maximum(high - 1, 0)], 0).astype(np.int64), self._upto[high]
        low, end = first, last.astype(np.int64)
        open_ = np.flatnonzero(low < end)
        while len(open_):  # binary search among the values of equal high part
            mid = (low[open_] + end[open_]) >> 1
            less = self._low(mid) < want[open_]
            low[open_], end[open_] = np.where(less, mid + 1, low[open_]), np.where(less, end[open_], mid)
            open_ = open_[low[open_] < end[open_]]
        hit = low < last
        hit[hit] = self._low(low[hit]) == want[hit]
        out[some[hit]] = low[hit]
        return out


class Trie:
    """Nodes of one or more levels below a list of roots, with numbers on the last two levels."""

    def __init__(self, buffer):
        self.depth = int(np.frombuffer(buffer, np.int64, 1)[0])
        at, self.keys, self.pointers = 8, [], []
        for level in range(self.depth):
            self.keys.append(Sequence(buffer, at))
            at = self.keys[-1].end
            if level < self.depth - 1:
                self.pointers.append(Sequence(buffer, at))
                at = self.pointers[-1].end
        self.numbers = []
        for _ in range(2):
            n, width = (int(x) for x in np.frombuffer(buffer, np.int64, 2, at))
            self.numbers.append(np.frombuffer(buffer, f"<u{width}", n, at + 16))
            at += 16 + -(-n * width // 8) * 8

    @staticmethod
    def build(columns: list[np.ndarray], above: np.ndarray, last: np.ndarray) -> bytes:
        """Trie of distinct rows in order, with numbers for the prefixes of all but one column and for the rows."""
        rows = len(columns[0])
        out, new = [np.array([len(columns)], np.int64).tobytes()], np.zeros(rows, bool)
        parents = None
        for level, column in enumerate(columns):
            new[1:] |= column[1:] != column[:-1]
            if rows:
                new[0] = True
            nodes = np.flatnonzero(new)
            keys = column[nodes].astype(np.int64)
            if level:
                firsts = np.searchsorted(nodes, parents)
                out.append(Sequence.build(np.concatenate([firsts, [len(nodes)]])))
                ends = np.concatenate([firsts[1:], [len(nodes)]]) - 1 if len(firsts) else firsts
                base = np.concatenate([[0], np.cumsum(keys[ends] + 1)])[: len(firsts)]
                keys = keys + np.repeat(base, np.diff(np.concatenate([firsts, [len(nodes)]])))
            out.append(Sequence.build(keys))
            parents = nodes
        for numbers in (above, last):
            width = numbers.dtype.itemsize
            raw = numbers.tobytes()
            out.append(np.array([len(numbers), width], np.int64).tobytes() + raw + bytes(-len(raw) % 8))
        return b"".join(out)

    def children(self, level: int, nodes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Nodes of ``level`` that are successors ``keys`` of ``nodes`` one level up, -1 for none."""
        out = np.full(len(nodes), -1, np.int64)
        real = np.flatnonzero(nodes >= 0)
        if not len(real):
            return out
        asked = nodes[real]
        new = np.ones(len(asked), bool)
        new[1:] = asked[1:] != asked[:-1]  # successors of a node mostly stand together
        parent, inverse = asked[new], np.cumsum(new) - 1
        pointers, sequence = self.pointers[level - 1], self.keys[level]
        first, end = pointers.at(parent), pointers.at(parent + 1)
        base = np.where(first > 0, sequence.at(np.maximum(first - 1, 0)) + 1, 0)
        place = sequence.find(base[inverse] + keys[real])
        out[real] = np.where((place >= first[inverse]) & (place < end[inverse]), place, -1)
        return out

    def roots(self, keys: np.ndarray) -> np.ndarray:
        return self.keys[0].find(keys)


def mapped(raw: bytes) -> mmap.mmap:
    """Memory that holds a trie for as long as its task reads it, and is given back as a whole."""
    out = mmap.mmap(-1, max(len(raw), 1))
    out.write(raw)
    return out


def opened(path: str | Path) -> Trie:
    """A trie of a local file, mapped and read in place."""
    with open(path, "rb") as f:
        return Trie(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
