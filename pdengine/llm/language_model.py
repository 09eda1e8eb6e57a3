"""Scores of texts under a trigram model kept as Elias-Fano tries (operator 11).

Texts are cut into chunks of bounded size. What a chunk needs from the corpus
it asks for once per distinct thing, packed in blocks by destination, so no
word or word pair is asked for more than once a chunk however frequent it is:

1. words: buckets of a hash's range count each word and number it;
2. pairs: shards by the preceding word hold its successors;
3. triples: shards by the two preceding words hold theirs.

Within a chunk words are told apart by 64-bit hashes (of n different words about
n^2 / 2^65 pairs agree, 2e-10 for a whole chunk), beyond it by their bytes.

Each shard merges the training counts of all chunks, builds its trie and
answers every block from it. Probabilities are smoothed by Witten and Bell: a
context seen ``C`` times with ``T`` different successors gives ``c / (C + T)`` to a
successor seen ``c`` times and leaves ``T / (C + T)`` to the shorter context; the
shortest one leaves it to all V words and one unknown evenly. The trie's levels
are rising sequences (``elias_fano``): pointers, and successors relative to
their context, by which they are searched. Both numbers of a context and its
successors are kept as logarithms in steps of 1/4096 decade.

A context that holds more than a thousandth of the tokens and more than one
shard's share is split by its successors over as many shards as its share asks
for; there are fewer than a thousand. Their shards answer counts and how many
different successors they hold, and the chunk adds these up and rounds the same
way, so splitting changes no score. Frequent words are known from step 1,
frequent pairs exactly from step 2.

A training text's own counts are part of the model that scores it; hold texts
out to measure the model.

Defined results: null and empty texts consist of the end alone. A row without
id is not held out. Rows that share an id are scored each for itself. Without
training texts every base score is 0 and every score is 0. An empty table gives
an empty result. Other columns are ignored. Words may be of any length.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pdengine.llm.elias_fano import Trie, mapped
from pdengine.llm.tables import staged
from pdengine.llm.words import mix, span_hashes, words as words_of
from pdengine.staging import discard, stage_path

#: A chunk is closed at so many words; texts are read in runs of so many characters. Both keep a chunk below 2**21
#: words, so that three ranks fit a key, and its columns within a core's cache.
CHUNK_WORDS, RUN_CHARS = 1 << 19, 1 << 20
#: Words per bucket and tokens per shard that tasks are sized for.
BUCKET_WORDS, SHARD_TOKENS = 1 << 20, 1 << 21
#: Successors that are searched at a time.
LOT = 1 << 17
#: A context is split if it holds more than this share of the tokens, and more than a shard.
HOT_SHARE = 1e-3
STEPS = 4096
#: Text ids whose checksum leaves this remainder are held out.
FOLDS, HELD = 5, 1
#: The end of a text, which no word equals because it holds a blank.
END = "\n"
U = np.uint64
_BLANK = re.compile(r"[\x20\x09-\x0D]")
NORMAL, SPLIT = 0, 1


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in few bytes."""
    head, parts = [], []
    for a in arrays:
        most = int(a.max()) if len(a) else 0
        width = next(w for w in (1, 2, 4, 8) if w == 8 or most < 1 << 8 * w)
        head += [len(a), width]
        parts.append(np.ascontiguousarray(a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes())
    raw = struct.pack(f"<{1 + len(head)}q", len(arrays), *head) + b"".join(parts)
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(packed: bytes) -> list[np.ndarray]:
    raw = pa.decompress(packed[8:], struct.unpack_from("<q", packed)[0], codec="zstd", asbytes=True)
    n = struct.unpack_from("<q", raw)[0]
    head, at, out = struct.unpack_from(f"<{2 * n}q", raw, 8), 8 + 16 * n, []
    for size, width in zip(head[::2], head[1::2], strict=True):
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64))
        at += size * width
    return out


def coded(share: np.ndarray) -> np.ndarray:
    """Probabilities as steps of their logarithm, from 1 on."""
    return (1 + np.minimum(np.rint(-np.log10(share) * STEPS), 65_000)).astype(np.uint16)


_PLAIN = 10.0 ** ((1 - np.arange(65_002)) / STEPS)


def plain(code: np.ndarray, absent: float) -> np.ndarray:
    out = _PLAIN[code]
    out[code == 0] = absent
    return out


def _order(keys: np.ndarray) -> np.ndarray:
    """Order of small numbers, ties as they stand: places ride along in the low bits, which sorts faster than indirectly."""
    bits = max(1, len(keys).bit_length())
    return np.sort((keys << bits) | np.arange(len(keys))) & ((1 << bits) - 1)


# --- chunks


@dataclass
class _Run:
    """Words of some texts, one after the other: their bytes and hashes."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> tuple["_Run", np.ndarray]:
        """A run, and how many words each text has."""
        w = words_of(pa.array(texts, pa.large_string()))
        return cls(w.data, w.start, w.end, w.hash), w.per_text

    @classmethod
    def end_mark(cls) -> "_Run":
        data, edge = np.frombuffer(END.encode(), np.uint8), np.array([0, 1])
        return cls(data, edge[:1], edge[1:], span_hashes(data, edge[:1], edge[1:]))


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[int], list[bool], _Run]]:
    """Runs of a batch's texts of bounded size: row of each text, words in it, whether it ends here, all its words.

    A text longer than a run comes in several, cut at a blank.
    """
    rows, parts, ends, size = [], [], [], 0
    for row, text in enumerate(batch.column("text")):
        raw, at = text.as_py() or "", 0
        while True:
            cut = _BLANK.search(raw, at + RUN_CHARS) if len(raw) - at > RUN_CHARS else None
            end = cut.start() if cut else len(raw)
            rows.append(row)
            parts.append(raw[at:end] if at or cut else raw)
            ends.append(cut is None)
            size += end - at
            at = end
            if size >= RUN_CHARS:
                run, counts = _Run.of(parts)
                yield rows, counts.tolist(), ends, run
                rows, parts, ends, size = [], [], [], 0
            if cut is None:
                break
    if rows:
        run, counts = _Run.of(parts)
        yield rows, counts.tolist(), ends, run


_Slice = tuple[_Run, int, int]


class _Chunk:
    """Pieces of texts until they fill a chunk."""

    def __init__(self):
        self.words: list[_Slice] = []
        self.pieces: list[tuple] = []  # row, id, held out, words before (two at most), words
        self.size = 0

    def add(self, row: int, doc, held: bool, before: list[_Slice], words: list[_Slice]) -> None:
        count = lambda some: sum(b - a for _, a, b in some)
        self.pieces.append((row, doc, held, count(before), count(words)))
        self.words += before + words
        self.size += count(before) + count(words)

    def rows(self, number: int, doc_type: pa.DataType) -> pa.RecordBatch:
        """Two rows: the distinct words with their training counts, and the texts as places among them."""
        hashes = np.concatenate([r.hash[a:b] for r, a, b in self.words])
        order = np.argsort(hashes)
        key = hashes[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        code = np.empty(len(key), np.int32)
        code[order] = np.cumsum(new, dtype=np.int32) - 1
        key, first = key[new], order[new]
        runs = {id(r): r for r, _, _ in self.words}
        bases = dict(zip(runs, np.cumsum([0, *[len(r.data) for r in runs.values()]]).tolist(), strict=False))
        data = np.concatenate([r.data for r in runs.values()])
        start, end = (np.concatenate([getattr(r, n)[a:b] + bases[id(r)] for r, a, b in self.words])[first] for n in ("start", "end"))
        lengths = end - start
        raw = data[np.repeat(start - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
        rows, docs, held, before, sizes = zip(*self.pieces, strict=True)
        held, before, sizes = np.array(held), np.array(before), np.array(sizes)
        counted = np.repeat(~held, before + sizes) & (_within(before, sizes) >= 0)
        asked = pack((key >> U(32)).astype(np.int64), lengths, np.bincount(code[counted], minlength=len(key)), raw)
        list_of = lambda values, kind: pa.array([None, list(values)], pa.list_(kind))
        return pa.RecordBatch.from_arrays(
            [pa.array([1, 0], pa.int32()), pa.array([number] * 2), pa.array([len(key), 0]), pa.array([0, int(sizes.sum())]),
             pa.array([asked, pack(code, held, before, sizes)], pa.binary()), list_of(rows, pa.int64()), list_of(docs, doc_type)],
            names=["words", "chunk", "n_words", "n_tokens", "codes", "rows", "docs"],
        )


def _within(before: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Place of each stored word in its piece, negative for those of the piece before."""
    whole = before + sizes
    return np.arange(whole.sum(), dtype=np.int32) - np.repeat(np.cumsum(whole) - whole + before, whole).astype(np.int32)


def _last_two(words: list[_Slice]) -> list[_Slice]:
    out, left = [], 2
    for run, a, b in reversed(words):
        n = min(left, b - a)
        if n:
            out.insert(0, (run, b - n, b))
            left -= n
    return out


def _cut(batches):
    part = TaskContext.get().partitionId() << 40
    end = (_Run.end_mark(), 0, 1)
    chunk, made, seen, before = _Chunk(), 0, 0, []
    for batch in batches:
        docs, held = batch.column("doc_id"), batch.column("held_out").to_pylist()
        ids = docs.to_pylist()
        for rows, counts, ends, run in _pieces(batch):
            at = 0
            for row, n, last in zip(rows, counts, ends, strict=True):
                mine = [(run, at, at + n)] if n else []
                at += n
                if last or mine:
                    chunk.add(part + seen + row, ids[row], held[row], before, [*mine, end] if last else mine)
                before = [] if last else _last_two(before + mine)
                if chunk.size >= CHUNK_WORDS:
                    yield chunk.rows(part + made, docs.type)
                    chunk, made = _Chunk(), made + 1
        seen += batch.num_rows
    if chunk.pieces:
        yield chunk.rows(part + made, docs.type)


class Chunks:
    """The texts as chunks, and what they ask of the vocabulary, which is deleted once it is answered."""

    def __init__(self, docs: DataFrame, held_out: Column):
        rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
        kind = rows.schema["doc_id"].dataType.simpleString()
        self.spark, self.path = docs.sparkSession, stage_path(docs.sparkSession, uuid.uuid4().hex)
        self.schema = f"chunk long, n_words long, n_tokens long, codes binary, rows array<long>, docs array<{kind}>"
        cut = rows.mapInArrow(_cut, f"words int, {self.schema}")
        cut.write.partitionBy("words").parquet(self.path)

    def read(self, words: int) -> DataFrame:
        """What is asked of the vocabulary (1) or the texts (0)."""
        table = self.spark.read.schema(f"{self.schema}, words int").parquet(self.path)
        return table.where(F.col("words") == words).drop("words")


# --- exchange


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *order[:-1]).sortWithinPartitions(*order)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of sorted rows with equal keys; a run's rows are read one by one, before the next run."""

    def rows():
        for batch in batches:
            for i in range(batch.num_rows):
                yield {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}

    source = rows()
    row = next(source, None)
    while row is not None:
        key = tuple(row[k] for k in keys)

        def run():
            nonlocal row
            while row is not None and tuple(row[k] for k in keys) == key:
                yield row
                row = next(source, None)

        yield key, run()


def _batch(names: str, columns: list, types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names.split())


# --- words


def _ask_words(buckets: int):
    def task(batches):
        for batch in batches:
            for chunk, packed in zip(batch.column("chunk").to_pylist(), batch.column("codes").to_pylist(), strict=True):
                sums, lengths, counts, raw = unpack(packed)
                bucket, raw = sums * buckets >> 32, raw.astype(np.uint8)
                edges = np.searchsorted(bucket, np.arange(buckets + 1))
                ends = np.concatenate([[0], np.cumsum(lengths)])
                real = np.flatnonzero(np.diff(edges)).tolist()
                blocks = [
                    pack(lengths[a:b], counts[a:b], raw[ends[a] : ends[b]]) for a, b in ((edges[k], edges[k + 1]) for k in real)
                ]
                yield _batch("bucket chunk block", [real, [chunk] * len(real), blocks], [pa.int64(), pa.int64(), pa.binary()])

    return task


def _strings(lengths: np.ndarray, raw: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.astype(np.uint8).tobytes())])


def _number_words(buckets: int):
    names = "chunk bucket answer seen tokens ends end_word"

    def task(batches):
        for (bucket,), run in _groups(batches, ["bucket"]):
            chunks, parts, counts = [], [], []
            for row in run:
                lengths, n, raw = unpack(row["block"])
                chunks.append(row["chunk"])
                parts.append(_strings(lengths, raw))
                counts.append(n)
            sizes = np.array([len(p) for p in parts])
            found = pa.concat_arrays(parts).dictionary_encode()
            del parts
            at = found.indices.to_numpy()
            total = np.bincount(at, np.concatenate(counts), len(found.dictionary)).astype(np.int64)
            order = pc.sort_indices(pa.table({"n": total, "w": found.dictionary}), [("n", "descending"), ("w", "ascending")]).to_numpy()
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order)) * buckets + bucket + 1
            end = pc.index(found.dictionary, pa.scalar(END, pa.large_string())).as_py()
            yield _batch(names, [[None], [bucket], [None], [int((total > 0).sum())], [int(total.sum())],
                                 [None if end < 0 else int(total[end])], [None if end < 0 else int(number[end])]], _WORD_TYPES)
            hot = order[total[order] > HOT_SHARE * total.sum()]  # what is hot in all is hot in its bucket
            none = [None] * len(hot)
            yield _batch(names, [none, [-1] * len(hot), none, none, total[hot], none, number[hot]], _WORD_TYPES)
            none = [None] * len(chunks)
            edges = np.cumsum(sizes)[:-1]
            answers = [pack(number[x], total[x]) for x in np.split(at, edges)]
            yield _batch(names, [chunks, [bucket] * len(chunks), answers, none, none, none, none], _WORD_TYPES)

    return task


_WORD_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


class Corpus:
    """Totals of the training texts: tokens, different ones, texts, and the words that are contexts of many tokens."""

    def __init__(self, tokens: int, seen: int, texts: int, frequent: dict[int, int]):
        self.tokens, self.seen, self.texts = tokens, seen, texts
        self.hot = {w: c for w, c in frequent.items() if c > HOT_SHARE * tokens}
        if texts > HOT_SHARE * tokens:
            self.hot[0] = texts  # the beginning of a text, a context like a word

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.seen + 1)))

    def alone(self, counts: np.ndarray) -> np.ndarray:
        """Probability of words without their context, those never seen included."""
        whole, even = self.tokens + self.seen, 1 / (self.seen + 1)
        if not whole:
            return np.full(len(counts), even)
        own = plain(np.where(counts > 0, coded(np.maximum(counts, 1) / whole), 0), 0.0)
        return own + float(plain(coded(np.array([self.seen / whole])), 0.0)[0]) * even


def words(chunks: Chunks) -> tuple[DataFrame, Corpus]:
    """Numbers and counts of each chunk's words, and the corpus's totals."""
    cut = chunks.read(1)
    asked = cut.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, -(-asked // BUCKET_WORDS), min(asked // 10_000, int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    blocks = cut.select("chunk", "codes").mapInArrow(_ask_words(buckets), "bucket long, chunk long, block binary")
    answers = staged(_dealt(blocks, "bucket", "chunk").mapInArrow(
        _number_words(buckets), "chunk long, bucket long, answer binary, seen long, tokens long, ends long, end_word long"
    ))
    discard(chunks.spark, f"{chunks.path}/words=1")
    totals = answers.where("chunk is null and bucket >= 0").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "seen", "ends")], F.max("end_word").alias("end_word")
    ).first()
    frequent = answers.where("bucket < 0").where(F.col("tokens") > HOT_SHARE * totals["tokens"]).select("end_word", "tokens").collect()  # below 1/HOT_SHARE rows
    hot = {r["end_word"]: r["tokens"] for r in frequent if r["end_word"] != totals["end_word"]}  # nothing follows an end
    return answers.where("chunk is not null").select("chunk", "bucket", "answer"), Corpus(totals["tokens"], totals["seen"], totals["ends"], hot)


# --- n-grams


class Grams:
    """Distinct pairs (size 2) or triples (size 3) of a chunk and where its tokens find theirs.

    Words are dealt with by rank, the order of their numbers; rank 0 is the
    beginning of a text.
    """

    def __init__(self, size: int, codes: bytes, number: np.ndarray, counts: np.ndarray, shards: int, hot: dict, tokens: int):
        code, held, before, sizes = unpack(codes)
        order = np.argsort(number)
        rank = np.empty(len(number), np.int32)
        rank[order] = np.arange(1, len(number) + 1, dtype=np.int32)
        self.number = np.concatenate([[0], number[order]])
        known = np.concatenate([[True], counts[order] > 0])
        token, place = rank[code], _within(before, sizes)
        begun = place + np.repeat(before, before + sizes).astype(np.int32)  # words of the piece stored before each
        real = slice(None) if not before.any() else place >= 0

        def back(k: int) -> np.ndarray:
            out = np.zeros_like(token)
            out[k:] = token[:-k]
            out[begun < k] = 0
            return out[real]

        w, v, u = token[real], back(1), back(2) if size == 3 else None
        self.words, self.word_counts = w, np.concatenate([[0], counts[order]])
        self.bits = bits = len(self.number).bit_length()
        context = v.astype(np.int64) if u is None else (v.astype(np.int64) << bits) | u
        usable = known[v] if u is None else known[v] & known[u]
        whole = (context << bits) | w
        if not usable.all():
            whole[~usable] = -1
        order = np.argsort(whole)
        keys = whole[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        self.token_entry = np.empty(len(keys), np.int32)
        self.token_entry[order] = np.cumsum(new, dtype=np.int32) - 1
        keys = keys[new]
        unknown = len(keys) > 0 and keys[0] < 0  # all grams with unknown contexts, which stand first
        above = keys >> bits
        first = np.ones(len(keys), bool)
        first[1:] = above[1:] != above[:-1]
        self.contexts = above[first]
        self.entry_context, self.entry_word = np.cumsum(first) - 1, (keys & ((1 << bits) - 1)).astype(np.int32)
        low = self.contexts & ((1 << bits) - 1)
        if unknown:
            self.entry_word[0] = low[0] = 0
        self.entry_known = known[self.entry_word]
        if unknown:
            self.entry_known[0] = False
        training = np.repeat(held == 0, sizes)
        self.entry_count = np.bincount(self.token_entry if training.all() else self.token_entry[training], minlength=len(keys))
        self.v = self.number[low if u is None else np.maximum(self.contexts >> bits, 0)]
        self.u = None if u is None else self.number[low]
        self._deal(shards, hot, tokens)

    def _deal(self, shards: int, hot: dict, tokens: int) -> None:
        """Destinations: (kind, shard) of each context, several of each split context."""
        n = len(self.contexts)
        with np.errstate(over="ignore"):
            own = mix(self.v.astype(U) + U(1)) if self.u is None else mix(mix(self.v.astype(U) + U(1)) + self.u.astype(U))
        ways = np.ones(n, np.int64)
        if hot and shards > 1 and n:
            self._split(ways, hot, shards, tokens)
        if n and self.contexts[0] < 0:  # contexts with unknown words are asked for nowhere
            ways[0] = 0
        self.ways = ways
        self.from_way = np.cumsum(ways) - ways
        way_context = np.repeat(np.arange(n), ways)
        shard = (((own >> U(32)) * U(shards)) >> U(32)).astype(np.int64)[way_context]
        split = ways[way_context] > 1
        if split.any():
            turn = np.arange(len(way_context)) - self.from_way[way_context]
            shard = np.where(split, (shard + turn) % shards, shard)
        self.way_context = way_context
        self.way_to = np.where(split, SPLIT, NORMAL) * shards + shard
        self.way_order = _order(self.way_to)
        self.entries = np.flatnonzero(self.entry_known)
        c = self.entry_context[self.entries]
        way = self.from_way[c]
        several = np.flatnonzero(ways[c] > 1)
        if len(several):
            w = self.number[self.entry_word[self.entries[several]]].astype(U)
            way[several] += (mix(w ^ U(0x5851F42D4C957F2D)) % ways[c[several]].astype(U)).astype(np.int64)
        self.entry_way = way
        place = np.empty(len(way_context), np.int64)
        place[self.way_order] = np.arange(len(way_context))
        self.entry_order = _order(place[way])
        self.shards = shards

    def _split(self, ways: np.ndarray, hot: dict, shards: int, tokens: int) -> None:
        """How many shards each of the hot contexts among these is split over."""
        many = [(p if isinstance(p, tuple) else (p,), -(-c * shards // tokens)) for p, c in hot.items() if c * shards > tokens]
        if not many:
            return
        ids, over = np.array([p for p, _ in many], np.int64), np.array([w for _, w in many])
        rank = np.minimum(np.searchsorted(self.number, ids), len(self.number) - 1)
        here = (self.number[rank] == ids).all(axis=1)
        key = rank[:, 0] if self.u is None else (rank[:, 0] << self.bits) | rank[:, 1]
        at = np.minimum(np.searchsorted(self.contexts, key), len(self.contexts) - 1)
        here &= self.contexts[at] == key
        ways[at[here]] = np.minimum(shards, over[here])

    def blocks(self) -> Iterator[tuple[int, int, bytes]]:
        """``(kind, shard, block)`` of every destination."""
        to = self.way_to[self.way_order]
        which = np.unique(to)
        edges = np.searchsorted(to, np.concatenate([which, which[-1:] + 1]))
        entries = self.entries[self.entry_order]
        way = self.entry_way[self.entry_order]
        entry_edges = np.searchsorted(self.way_to[way], np.concatenate([which, which[-1:] + 1]))
        sizes = np.bincount(self.entry_way, minlength=len(self.way_to))
        for i, d in enumerate(which.tolist()):
            ways, e = self.way_order[edges[i] : edges[i + 1]], entries[entry_edges[i] : entry_edges[i + 1]]
            c = self.way_context[ways]
            u = np.zeros(0, np.int64) if self.u is None else self.u[c]
            yield d // self.shards, d % self.shards, pack(
                np.diff(self.v[c], prepend=0), u, sizes[ways], self.number[self.entry_word[e]], self.entry_count[e]
            )

    def probabilities(self, answers: dict[tuple[int, int], bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each token: the probability its context gives it, and what the context leaves to the shorter one."""
        rest, own = np.zeros(len(self.way_to), np.int64), np.zeros(len(self.entries), np.int64)
        if len(self.way_to):
            got = [unpack(answers[d // self.shards, d % self.shards]) for d in np.unique(self.way_to).tolist()]
            rest[self.way_order] = np.concatenate([g[0] for g in got])
            own[self.entry_order] = np.concatenate([g[1] for g in got])
            seen = np.zeros(len(self.way_to), np.int64)
            seen[self.way_order] = np.concatenate([g[2] for g in got])
        n = len(self.contexts)
        left, code = np.zeros(n, np.uint16), np.zeros(len(self.entry_word), np.uint16)
        one = self.ways == 1
        left[one] = rest[self.from_way[one]]
        code[self.entries] = np.where(one[self.entry_context[self.entries]], own, 0)
        if (self.ways > 1).any():  # split contexts: add up what their shards hold
            many = np.flatnonzero(self.ways > 1)
            of = self.way_context
            kinds = np.bincount(of, weights=rest, minlength=n).astype(np.int64)
            times = np.bincount(of, weights=seen, minlength=n).astype(np.int64)
            whole = kinds + times
            real = many[whole[many] > 0]
            left[real] = coded(kinds[real] / whole[real])
            e = self.entry_context[self.entries]
            split = np.flatnonzero((self.ways[e] > 1) & (own > 0))
            code[self.entries[split]] = coded(own[split] / whole[e[split]])
        entry = self.token_entry
        return plain(code[entry], 0.0), plain(left[self.entry_context[entry]], 1.0)


def _chunk_run(run) -> tuple[dict, np.ndarray, np.ndarray, list[dict]]:
    """A chunk, its words' numbers and counts, and other rows sent to it."""
    chunk, numbers, others = None, [], []
    for row in run:
        if row["what"] == 0:
            chunk = row
        elif row["what"] == 1:
            numbers.append(unpack(row["block"]))
        else:
            others.append(row)
    return chunk, np.concatenate([x[0] for x in numbers]), np.concatenate([x[1] for x in numbers]), others


def _ask_grams(size: int, shards: int, hot: dict, tokens: int):
    def task(batches):
        for (chunk,), run in _groups(batches, ["chunk"]):
            row, number, counts, _ = _chunk_run(run)
            grams = Grams(size, row["codes"], number, counts, shards, hot, tokens)
            found = list(grams.blocks())
            yield _batch("kind shard chunk block", [[f[0] for f in found], [f[1] for f in found], [chunk] * len(found), [f[2] for f in found]],
                         [pa.int64(), pa.int64(), pa.int64(), pa.binary()])

    return task


def _merged(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Distinct rows in order, their counts added up; the counts are the last column."""
    columns = [np.concatenate([h[i] for h in held]) for i in range(len(held[0]))]
    *keys, counts = columns
    if not len(counts):
        return columns
    order, new = None, np.zeros(len(counts), bool)
    whole, limit = keys[0], int(keys[0].max())
    for k in keys[1:]:
        most = int(k.max()) + 1
        if (limit + 1) * most >= 1 << 62:  # too wide for one number: go on with ranks
            _, whole = np.unique(whole, return_inverse=True)
            limit = int(whole.max())
        if (limit + 1) * most >= 1 << 62:
            order = np.lexsort(keys[::-1])
            break
        whole, limit = whole * most + k, (limit + 1) * most
    if order is None:
        order = np.argsort(whole)
    keys = [k[order] for k in keys]
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return [*[k[first] for k in keys], np.add.reduceat(counts[order], first)]


def _spread(block: bytes) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Columns of a block's contexts, sizes of their runs of successors, successors, counts."""
    v, u, sizes, w, counts = unpack(block)
    return [np.cumsum(v), *([u] if len(u) else [])], sizes, w, counts


def trie_of(rows: list[np.ndarray], kind: int) -> bytes:
    """Trie of merged rows: smoothed probabilities, or the counts of split contexts."""
    *keys, counts = rows
    n = len(counts)
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for k in keys[:-1]:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    kinds = np.diff(np.concatenate([first, [n]]))
    times = np.add.reduceat(counts, first) if n else np.zeros(0, np.int64)
    if kind == SPLIT:
        return Trie.build(keys, np.stack([kinds, times], axis=1).astype(np.uint64).ravel(), counts.astype(np.uint64))
    whole = kinds + times
    return Trie.build(keys, coded(kinds / whole), coded(counts / np.repeat(whole, kinds)))


def answers(trie: Trie, kind: int, blocks: list[bytes]) -> list[bytes]:
    """What a trie says of the contexts and successors of some blocks, which are searched together."""
    parts = [_spread(block) for block in blocks]
    contexts = [np.concatenate(c) for c in zip(*[p[0] for p in parts], strict=True)]
    sizes, w = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
    runs, of = np.unique(contexts[0], return_inverse=True)
    node = trie.roots(runs)[of]
    if len(contexts) > 1:
        node = trie.children(1, node, contexts[1])
    place = trie.children(trie.depth - 1, np.repeat(node, sizes), w)
    above, last = trie.numbers
    here = np.maximum(node, 0)
    own = np.where(place >= 0, last[np.maximum(place, 0)], 0) if len(last) else np.zeros(len(w), np.int64)
    if kind == SPLIT:
        pairs = above.reshape(-1, 2) if len(above) else np.zeros((1, 2), np.uint64)
        rest, seen = (np.where(node >= 0, pairs[here, k], 0) for k in (0, 1))
    else:
        rest = np.where(node >= 0, above[here], 0) if len(above) else np.zeros(len(node), np.int64)
        seen = np.zeros(len(rest), np.int64)
    each = np.cumsum([len(p[1]) for p in parts])[:-1], np.cumsum([len(p[2]) for p in parts])[:-1]
    return [pack(*found) for found in zip(np.split(rest, each[0]), np.split(own, each[1]), np.split(seen, each[0]), strict=True)]


def _shard(size: int, want: str, least: float):
    """Merge a shard's blocks, build its trie, and answer each block or give the trie away."""

    def task(batches):
        for (kind, shard), run in _groups(batches, ["kind", "shard"]):
            held: list[list[np.ndarray]] = []
            asked, waiting = [], 0
            for row in run:
                contexts, sizes, w, counts = _spread(row["block"])
                some = counts > 0
                held.append([np.repeat(c, sizes)[some] for c in contexts] + [w[some], counts[some]])
                waiting += int(some.sum())
                if want == "answers":
                    asked.append((row["chunk"], row["block"], len(w)))
                if waiting > SHARD_TOKENS:
                    held = [_merged(held)]
                    waiting = 0
            rows = _merged(held)
            held = []
            if size == 2 and want == "answers":  # pairs that are contexts of many triples
                hot = np.flatnonzero(rows[-1] > least)
                yield _batch("chunk kind shard block v w n", [[None] * len(hot), [kind] * len(hot), [shard] * len(hot), [None] * len(hot), rows[0][hot], rows[1][hot], rows[2][hot]], _GRAM_TYPES)
            raw = trie_of(rows, kind)
            del rows
            if want == "tries":
                yield _batch("chunk kind shard block v w n", [[None], [kind], [shard], [raw], [None], [None], [None]], _GRAM_TYPES)
                continue
            trie = Trie(mapped(raw))
            del raw
            for lot in _lots(asked):
                n, none = len(lot), [None] * len(lot)
                found = answers(trie, kind, [block for _, block, _ in lot])
                yield _batch("chunk kind shard block v w n", [[c for c, _, _ in lot], [kind] * n, [shard] * n, found, none, none, none], _GRAM_TYPES)

    return task


def _lots(asked: list[tuple]) -> Iterator[list[tuple]]:
    """Blocks in groups that hold some LOT successors each."""
    lot, held = [], 0
    for block in asked:
        lot.append(block)
        held += block[2]
        if held >= LOT:
            yield lot
            lot, held = [], 0
    if lot:
        yield lot


_GRAM_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
_GRAM_SCHEMA = "chunk long, kind long, shard long, block binary, v long, w long, n long"


def _to_chunks(cut: DataFrame, numbers: DataFrame, *answers: DataFrame) -> DataFrame:
    """Chunks, their words' numbers in the order of the words, and answers, together by chunk."""
    kind = dict(cut.dtypes)["docs"]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("codes", "binary"), ("rows", "array<long>"), ("docs", kind))]
    out = cut.select("chunk", F.lit(0).alias("what"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("shard"), F.lit(None).cast("binary").alias("block"), "codes", "rows", "docs")
    out = out.union(numbers.select("chunk", F.lit(1), F.col("bucket"), F.lit(0).cast("long"), F.col("answer"), *none))
    for i, a in enumerate(answers, 2):
        out = out.union(a.select("chunk", F.lit(i), F.col("kind"), F.col("shard"), F.col("block"), *none))
    parts = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(parts, "chunk").sortWithinPartitions("chunk", "what", "at")


def _shards(cut: DataFrame) -> int:
    """Shards that hold some SHARD_TOKENS distinct requests each; more for small tables, so that all tasks work."""
    asked = cut.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    return max(1, -(-asked // SHARD_TOKENS), min(asked // 50_000, int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def grams(cut: DataFrame, numbers: DataFrame, size: int, shards: int, hot: dict, corpus: Corpus, want: str = "answers") -> DataFrame:
    """Answers to all chunks' pairs or triples, or the tries themselves."""
    blocks = _to_chunks(cut, numbers).mapInArrow(
        _ask_grams(size, shards, hot, corpus.tokens), "kind long, shard long, chunk long, block binary"
    )
    return _dealt(blocks, "kind", "shard", "chunk").mapInArrow(_shard(size, want, HOT_SHARE * corpus.tokens), _GRAM_SCHEMA)


def _hot_pairs(pairs: DataFrame, corpus: Corpus) -> dict[tuple[int, int], int]:
    """Contexts of two words that hold many tokens; fewer than 1/HOT_SHARE, since every token has one."""
    found = {(r["w"], r["v"]): r["n"] for r in pairs.where("chunk is null").select("v", "w", "n").collect()}
    if corpus.texts > HOT_SHARE * corpus.tokens:
        found[0, 0] = corpus.texts
    return found


def _score(shards: int, hot_words: dict, hot_pairs: dict, corpus: Corpus, doc_type: str):
    def task(batches):
        for (_,), run in _groups(batches, ["chunk"]):
            row, number, counts, others = _chunk_run(run)
            parts = []
            for what, size, hot in ((2, 2, hot_words), (3, 3, hot_pairs)):
                answers = {(o["at"], o["shard"]): o["block"] for o in others if o["what"] == what}
                g = Grams(size, row["codes"], number, counts, shards, hot, corpus.tokens)
                parts.append(g.probabilities(answers))
            (two, two_rest), (three, three_rest) = parts
            p = three + three_rest * (two + two_rest * corpus.alone(g.word_counts)[g.words])
            _, held, _, sizes = unpack(row["codes"])
            ends = np.cumsum(sizes)

            def total(x: np.ndarray, kind=np.longdouble) -> np.ndarray:
                upto = np.concatenate([[0], np.cumsum(x, dtype=kind)])
                return upto[ends] - upto[ends - sizes]

            yield pa.RecordBatch.from_arrays(
                [pa.array(row["rows"], pa.int64()), pa.array(row["docs"], doc_type), pa.array(held == 1), pa.array(sizes),
                 pa.array(total((g.word_counts > 0)[g.words], np.int64)), pa.array(total(corpus.base(g.word_counts)[g.words]).astype(np.float64)),
                 pa.array(total(np.log10(np.minimum(p, 1.0))).astype(np.float64))],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    return task


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a text is held out by the checksum of its id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD


def tries(docs: DataFrame, out: Column | None = None, shards: int | None = None) -> DataFrame:
    """``(size, kind, shard, block)``: the model's tries, one a row, to be stored or mapped (``elias_fano.opened``)."""
    chunks = Chunks(docs, held_out() if out is None else out)
    numbers, corpus = words(chunks)
    cut = chunks.read(0)
    shards = shards or _shards(cut)
    pairs = staged(grams(cut, numbers, 2, shards, corpus.hot, corpus))
    made = [grams(cut, numbers, 2, shards, corpus.hot, corpus, "tries"), grams(cut, numbers, 3, shards, _hot_pairs(pairs, corpus), corpus, "tries")]
    two, three = [m.select(F.lit(i).alias("size"), "kind", "shard", "block") for i, m in enumerate(made, 2)]
    return two.union(three)


def scores(docs: DataFrame, out: Column | None = None, shards: int | None = None) -> DataFrame:
    """Each text's log10 probability under the model of the texts that are not held out, and under word counts alone.

    ``out`` says which texts are held out; by default that is decided from their ids.
    """
    chunks = Chunks(docs, held_out() if out is None else out)
    numbers, corpus = words(chunks)
    cut = chunks.read(0)
    shards = shards or _shards(cut)
    pairs = staged(grams(cut, numbers, 2, shards, corpus.hot, corpus))
    hot_pairs = _hot_pairs(pairs, corpus)
    triples = staged(grams(cut, numbers, 3, shards, hot_pairs, corpus))
    kind = dict(docs.dtypes)["doc_id"]
    arrow = to_arrow_type(docs.schema["doc_id"].dataType)
    rows = _to_chunks(cut, numbers, pairs.where("chunk is not null"), triples).mapInArrow(
        _score(shards, corpus.hot, hot_pairs, corpus, arrow),
        f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double",
    )
    one = rows.groupBy("row", "doc_id", "held_out").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return one.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(corpus.tokens).cast("long").alias("train_tokens"), "base_score", "score")
