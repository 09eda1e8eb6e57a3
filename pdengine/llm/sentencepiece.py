"""SentencePiece encoding and decoding by a batched numpy Viterbi pass (operator 6).

Texts are cut where no piece of the vocabulary can cross, which leaves words.
The distinct words of a batch advance together, one character at a time, the
longer ones staying on: at each end every substring up to the longest piece is
looked up by its hash among the sorted hashes of the pieces, and the best way
to reach that end is stored as a backpointer.

What is best depends on the model. For unigram models it is the largest sum of
scores. Scores of BPE models are merge ranks, and their sum does not give the
library's result, so there a step is allowed only if the piece can follow the
previous one: merging the characters of the two must give just those two. Of
all ways to reach an end exactly one passes this test at each step, and it is
the result of merging. The test's outcome is remembered for pairs met before.

Defined results: null and empty texts have no ids and decode to empty text.
Characters outside the vocabulary become bytes, or the unknown piece where the
model has no bytes. ``round_trip`` says whether decoding gives the text back;
it is false for texts that hold the model's own mark for blanks, U+2581.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pdengine.llm.tables import slices
from pdengine.llm.words import U, mix

SPACE = "▁"
_BASE = 0xD1342543DE82EF95
_TEXT = 1 << 20
#: Bytes that a worker's memory of words, and that of pairs of pieces, may take before they are forgotten.
REMEMBERED, PAIRS = 48 << 20, 16 << 20
#: Code points up to which sums of powers tell words apart; longer ones get a digest.
_SHORT = 64
_START, _UNKNOWN = -1, -2


def _fields(raw: bytes):
    """Number and value of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, raw[at : at + size]
            at += size


class Model:
    """Pieces, scores and settings of a model file."""

    def __init__(self, raw: bytes):
        names, scores, kinds = [], [], []
        self.bpe, self.prefix, fallback = False, True, False
        for field, value in _fields(raw):
            if field == 1:
                piece = dict(_fields(value))
                names.append(piece.get(1, b"").decode())
                scores.append(float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0]))
                kinds.append(piece.get(3, 1))
            elif field == 2:
                spec = dict(_fields(value))
                self.bpe, fallback = spec.get(3, 1) == 2, bool(spec.get(35, 0))
            elif field == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("models with a character map are not supported")
                if spec.get(4, 1):
                    raise ValueError("models that drop blanks are not supported")
                self.prefix = bool(spec.get(3, 1))
        self.names, self.scores = names, np.array(scores)
        kinds = np.array(kinds)
        self.normal = np.flatnonzero(kinds == 1)
        self.unknown = int(np.flatnonzero(kinds == 2)[0])
        self.bytes_at = None
        if fallback:
            place = {names[i]: i for i in np.flatnonzero(kinds == 6)}
            self.bytes_at = np.array([place[f"<0x{b:02X}>"] for b in range(256)])
        self._index()
        self._plain(kinds)

    def _index(self) -> None:
        texts = [self.names[i] for i in self.normal]
        self.longest = max(map(len, texts))
        codes = Codes("".join(texts))
        ends = np.cumsum([len(t) for t in texts])
        keys = codes.hashes(ends - [len(t) for t in texts], ends)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], self.normal[order]
        self.maybe = np.zeros(1 << 20, bool)  # most substrings are no pieces; this tells so without a search
        self.maybe[keys >> U(44)] = True
        inside = {c for t in texts if len(t) > 1 for c in t}
        self.lone = np.array([ord(c) for c in "\n\t\r" if c not in inside], np.uint32)
        self.words_apart = not any(SPACE in t.lstrip(SPACE) for t in texts)
        if not self.bpe:
            return
        # every way to merge two pieces into a third
        place = {t: i for t, i in zip(texts, self.normal.tolist(), strict=True)}
        n = len(self.names)
        pairs = [
            (place[t[:k]] * n + place[t[k:]], i)
            for t, i in place.items() for k in range(1, len(t)) if t[:k] in place and t[k:] in place
        ]
        pairs.sort()
        self.pair_keys, self.pair_ids = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.chars = np.full((n, self.longest), -1, np.int64)
        for t, i in place.items():
            self.chars[i, : len(t)] = [place.get(c, _UNKNOWN) for c in t]
        self.known, self.allowed = np.zeros(0, np.int64), np.zeros(0, bool)

    def _plain(self, kinds: np.ndarray) -> None:
        """Bytes that each piece decodes to."""
        raw = []
        for i, (name, kind) in enumerate(zip(self.names, kinds, strict=True)):
            if kind == 6:
                raw.append(bytes([int(name[3:5], 16)]))
            elif kind == 2:
                raw.append(" ⁇ ".encode())
            elif kind == 3:
                raw.append(b"")
            else:
                raw.append(name.replace(SPACE, " ").encode())
        self.piece_size = np.array([len(r) for r in raw])
        self.piece_from = np.concatenate([[0], np.cumsum(self.piece_size)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Piece of each hash, -1 for none."""
        out = np.full(len(hashes), -1, np.int64)
        some = np.flatnonzero(self.maybe[hashes >> U(44)])
        at = np.searchsorted(self.keys, hashes[some])
        at[at == len(self.keys)] = 0
        out[some] = np.where(self.keys[at] == hashes[some], self.ids[at], -1)
        return out

    def may_follow(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """For BPE models: whether merging the characters of both gives just those two pieces."""
        n = len(self.names)
        asked = (before + 2) * (n + 2) + piece + 2
        at = np.searchsorted(self.known, asked)
        new = np.ones(len(asked), bool) if not len(self.known) else self.known[np.minimum(at, len(self.known) - 1)] != asked
        if new.any():
            if 9 * len(self.known) > PAIRS:
                self.known, self.allowed = np.zeros(0, np.int64), np.zeros(0, bool)
                new = np.ones(len(asked), bool)
            keys = np.unique(asked[new])
            place = np.searchsorted(self.known, keys)
            self.known = np.insert(self.known, place, keys)
            step = 1 << 14  # pairs whose characters are held side by side at a time
            allowed = [self._merges_to(k // (n + 2) - 2, k % (n + 2) - 2) for k in np.array_split(keys, -(-len(keys) // step))]
            self.allowed = np.insert(self.allowed, place, np.concatenate(allowed))
            at = np.searchsorted(self.known, asked)
        return self.allowed[at]

    def _merges_to(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Merge the characters of pairs of pieces, best score first and leftmost on ties, all pairs at once."""
        n, wide = len(self.names), self.longest
        empty = np.full((len(one), wide), -1, np.int64)
        lone = np.full(wide, -1, np.int64)
        lone[0] = _UNKNOWN
        left = np.where((one >= 0)[:, None], self.chars[np.maximum(one, 0)], empty)
        left[one == _UNKNOWN] = lone
        right = np.where((two >= 0)[:, None], self.chars[np.maximum(two, 0)], empty)
        right[two == _UNKNOWN] = lone
        sym = np.concatenate([left, right], axis=1)
        order = np.argsort(sym == -1, axis=1, kind="stable")
        sym = np.take_along_axis(sym, order, axis=1)
        live = np.arange(len(sym))
        while len(live):
            s = sym[live]
            a, b = s[:, :-1], s[:, 1:]
            real = (a >= 0) & (b >= 0)
            key = np.where(real, a * n + b, 0)
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            hit = real & (self.pair_keys[at] == key)
            score = np.where(hit, self.scores[self.pair_ids[at]], -np.inf)
            best = np.argmax(score, axis=1)
            rows = np.arange(len(live))
            go = hit[rows, best]
            live, rows, best = live[go], rows[go], best[go]
            if not len(live):
                break
            s = s[rows]
            merged = self.pair_ids[at[rows, best]]
            place = np.arange(s.shape[1])[None, :]
            moved = np.concatenate([s[:, 1:], np.full((len(s), 1), -1)], axis=1)
            s = np.where(place > best[:, None], moved, s)
            s[np.arange(len(s)), best] = merged
            sym[live] = s
        first = np.where(one == _START, two, one)
        second = np.where(one == _START, -1, two)
        return (sym[:, 0] == first) & (sym[:, 1] == second) & (sym[:, 2] == -1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U)
    filled = 1
    while filled < n:
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * U(pow(base, filled, 1 << 64))
        filled += more
    return out


class Codes:
    """Code points of a text and hashes of its short substrings from prefix sums.

    Sums of powers modulo 2**64 can be equal for long strings that differ in a
    regular way, whatever the base; ``words`` therefore digests long ones.
    """

    up = _powers(_BASE, _TEXT)
    down = _powers(pow(_BASE, -1, 1 << 64), _TEXT)

    def __init__(self, text: str):
        self.code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n = len(self.code)
        if n >= len(Codes.up):
            Codes.up, Codes.down = _powers(_BASE, 2 * n), _powers(pow(_BASE, -1, 1 << 64), 2 * n)
        self.sums = np.zeros(n + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum(mix(self.code.astype(U) + U(1)) * Codes.up[:n], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * Codes.down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


    def words(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of words of any length."""
        out = self.hashes(start, end)
        for i in np.flatnonzero(end - start > _SHORT).tolist():
            raw = self.code[start[i] : end[i]].tobytes()
            out[i] = U(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little"))
        return out


class Codec:
    """Encodes and decodes batches of texts; remembers the ids of words met before."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.seen, self.at, self.size, self.flat = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin."""
        m = self.model
        full = [(SPACE if m.prefix else "") + t.replace(" ", SPACE) if t else "" for t in texts]
        ends = np.cumsum([len(t) for t in full]) if full else np.zeros(0, np.int64)
        codes = Codes("".join(full))
        n = len(codes.code)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        cut = np.zeros(n + 1, bool)
        cut[0] = True
        cut[ends] = True
        if m.words_apart:
            blank = codes.code == ord(SPACE)
            cut[1:n] |= blank[1:] & ~blank[:-1]
        lone = np.isin(codes.code, m.lone)
        cut[:n] |= lone
        cut[1:] |= lone
        border = np.flatnonzero(cut)
        start, end = border[:-1], border[1:]
        key, first, word = np.unique(codes.words(start, end), return_index=True, return_inverse=True)
        self._learn(codes, key, start[first], end[first])
        at = np.searchsorted(self.seen, key)[word]
        sizes = self.size[at]
        first_id = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.at[at] - first_id[:-1], sizes) + np.arange(first_id[-1])]
        words_before = np.searchsorted(start, np.concatenate([[0], ends]))
        return ids, first_id[words_before]

    def _learn(self, codes: Codes, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        if 24 * len(self.seen) + 4 * len(self.flat) > REMEMBERED:
            self._forget()
        if len(self.seen):
            at = np.minimum(np.searchsorted(self.seen, key), len(self.seen) - 1)
            new = self.seen[at] != key
            key, start, end = key[new], start[new], end[new]
        if not len(key):
            return
        ids, sizes = self._viterbi(codes, start, end)
        at = len(self.flat) + np.concatenate([[0], np.cumsum(sizes)[:-1]])
        place = np.searchsorted(self.seen, key)  # keys ascend, so they are put in where they belong
        self.seen = np.insert(self.seen, place, key)
        self.at, self.size = np.insert(self.at, place, at), np.insert(self.size, place, sizes)
        self.flat = np.concatenate([self.flat, ids])

    def _viterbi(self, codes: Codes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one word after the other, and how many each has."""
        m = self.model
        order = np.argsort(start - end, kind="stable")  # the longest first: those still running are always in front
        start, size = start[order], (end - start)[order]
        base = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        piece = np.full(int(np.sum(size + 1)), _START, np.int64)  # last piece of the best way to each end
        back = np.zeros(len(piece), np.int64)
        score = None if m.bpe else np.zeros(len(piece))
        worst = None if m.bpe else m.scores[m.normal].min() - 10
        running = len(size) - np.searchsorted(size[::-1], np.arange(1, int(size[0]) + 1))
        for i in range(1, int(size[0]) + 1):
            r = int(running[i - 1])
            s, b = start[:r], base[:r]
            rows, found, length = [], [], []
            for k in range(1, min(i, m.longest) + 1):
                ids = m.lookup(codes.hashes(s + (i - k), s + i))
                if k == 1:
                    ids = np.where(ids < 0, _UNKNOWN, ids)
                    hit = np.arange(r)
                else:
                    hit = np.flatnonzero(ids >= 0)
                rows.append(hit)
                found.append(ids[hit])
                length.append(np.full(len(hit), k))
            rows, found, length = map(np.concatenate, (rows, found, length))
            before = b[rows] + i - length
            if m.bpe:
                good = m.may_follow(piece[before], found)
                rows, found, length = rows[good], found[good], length[good]
            else:
                total = score[before] + np.where(found >= 0, m.scores[np.maximum(found, 0)], worst)
                best = np.lexsort((total, rows))
                last = np.concatenate([rows[best][1:] != rows[best][:-1], [True]])
                best = best[last]
                rows, found, length = rows[best], found[best], length[best]
                score[b[rows] + i] = total[best]
            piece[b[rows] + i] = found
            back[b[rows] + i] = length
        return self._trace(codes, order, start, size, base, piece, back)

    def _trace(self, codes, order, start, size, base, piece, back) -> tuple[np.ndarray, np.ndarray]:
        """Follow the backpointers of all words together, from their ends."""
        word, place, got = [], [], []
        live, at = np.arange(len(size)), size.copy()
        while len(live):
            here = base[live] + at
            word.append(live)
            place.append(at - back[here])
            got.append(piece[here])
            at = at - back[here]
            live, at = live[at > 0], at[at > 0]
        word, place, got = map(np.concatenate, (word, place, got))
        by = np.lexsort((place, order[word]))
        word, place, got = word[by], place[by], got[by]
        m, count = self.model, np.ones(len(got), np.int64)
        odd = np.flatnonzero(got == _UNKNOWN)
        if len(odd) and m.bytes_at is not None:
            code = codes.code[start[word[odd]] + place[odd]]
            count[odd] = 1 + (code > 0x7F).astype(int) + (code > 0x7FF) + (code > 0xFFFF)
            first = np.concatenate([[0], np.cumsum(count)[:-1]])
            got = np.repeat(got, count)
            spots = np.repeat(first[odd], count[odd]) + np.arange(count[odd].sum()) - np.repeat(np.cumsum(count[odd]) - count[odd], count[odd])
            raw = np.frombuffer(code.tobytes().decode("utf-32-le").encode(), np.uint8)
            got[spots] = m.bytes_at[raw]
        elif len(odd):
            got[odd] = m.unknown
        sizes = np.bincount(order[word], weights=count, minlength=len(size)).astype(np.int64)
        return got.astype(np.int32), sizes

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of lists of ids, given one after the other."""
        m = self.model
        sizes = m.piece_size[ids]
        first = np.concatenate([[0], np.cumsum(sizes)])
        raw = m.piece_bytes[np.repeat(m.piece_from[ids] - first[:-1], sizes) + np.arange(first[-1])].tobytes()
        edges = first[offsets]
        out = [raw[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return [t[1:] if m.prefix and t.startswith(" ") else t for t in out]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        with open(path, "rb") as f:
            _codecs[path] = Codec(Model(f.read()))
    return _codecs[path]


def _task(path: str):
    def task(batches):
        c = codec(path)
        for whole in batches:
            for batch in slices(whole, "text", _TEXT // 2):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids, offsets = c.encode(texts)
                again = c.decode(ids, offsets)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(n) for n in batch.schema.names if n != "text"], pa.array(np.diff(offsets)), lists,
                     pa.array([a == b for a, b in zip(texts, again, strict=True)])],
                    names=[*[n for n in batch.schema.names if n != "text"], "n_tokens", "ids", "round_trip"],
                )

    return task


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Each row of ``docs`` with ``n_tokens``, ``ids`` and ``round_trip`` instead of its text, by the model at ``path``.

    Other columns of those names are replaced.
    """
    rows = docs.drop("n_tokens", "ids", "round_trip").withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_task(path), f"{schema}, n_tokens long, ids array<int>, round_trip boolean")


def _untask(path: str):
    def task(batches):
        c = codec(path)
        for batch in batches:
            lists = batch.column("ids")
            lists = lists.fill_null([]) if lists.null_count else lists
            offsets = np.asarray(lists.offsets, np.int64)
            ids = np.asarray(lists.values, np.int64)[offsets[0] : offsets[-1]]
            texts = c.decode(ids, offsets - offsets[0])
            keep = [n for n in batch.schema.names if n != "ids"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(texts, pa.string())], names=[*keep, "text"])

    return task


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """Rows of ``tokens`` with ``text`` instead of their ``ids``; null ids give an empty text."""
    rows = tokens.drop("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "ids")
    return rows.mapInArrow(_untask(path), f"{schema}, text string")
