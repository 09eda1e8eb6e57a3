"""Windows whose first fingerprints agree by chance are not repeated."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute

from pdengine.llm import suffixes


def test_colliding_keys_are_told_apart(monkeypatch):
    strong = suffixes.Sums.at

    def weak(self, position, length):
        keys = strong(self, position, length)
        return keys if getattr(self, "kind", 0) else keys & np.uint64(7)

    monkeypatch.setattr(suffixes.Sums, "at", weak)
    rnd, window = random.Random(2), 12
    passage = "".join(rnd.choices("abcdef", k=30))
    texts = ["".join(rnd.choices("abcdef", k=60)) for _ in range(20)]
    texts[3], texts[11] = texts[3] + passage, passage + texts[11]
    ranges = [np.array([0, len(t) - window], np.int64).tobytes() for t in texts]
    parts = [
        pa.RecordBatch.from_pydict({"row": list(range(a, a + 10)), "row2": [0] * 10, "text": texts[a : a + 10], "ranges": ranges[a : a + 10]})
        for a in (0, 10)
    ]
    entries = pa.Table.from_batches(list(suffixes._suffix_task(window, 0, 1, 0)(iter(parts))))
    found = suffixes._sort_bucket(np.uint64)(entries)
    got = {}
    for chunk in set(found["chunk"].to_pylist()):
        starts = suffixes._repeated_starts(found.filter(pa.compute.equal(found["chunk"], chunk)))
        got |= {r["row"]: suffixes.unpacked_places(r["starts"]).tolist() for r in starts.to_pylist()}

    windows = [(t[i : i + window], d, i) for d, t in enumerate(texts) for i in range(len(t) - window + 1)]
    count = {}
    for w, _, _ in windows:
        count[w] = count.get(w, 0) + 1
    want = {}
    for w, d, i in windows:
        if count[w] > 1:
            want.setdefault(d, []).append(i)
    assert want.keys() >= {3, 11} and got == want


def thue_morse(n):
    """Two texts whose sums of powers modulo 2**64 agree for every odd base, from 1,024 letters on."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_regular_texts_are_told_apart(spark):
    from pdengine.llm import minhash, sentencepiece
    from pdengine.llm.registry import PIECE_BPE

    import sentencepiece as library

    for n in (1024, 4096):
        a, b = thue_morse(n)
        docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
        assert [r.kept for r in minhash.near_duplicates(docs).collect()] == [True, True]
        pieces = sorted(sentencepiece.encoded(docs, PIECE_BPE).collect())
        assert [list(r.ids) for r in pieces] == library.SentencePieceProcessor(model_file=PIECE_BPE).encode([a, b])
        assert all(r.round_trip for r in pieces)
    a, b = thue_morse(1024)
    rows = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert [r.n_removed for r in suffixes.remove_repeats(rows, 1024).collect()] == [0, 0]
    one, two = suffixes.Sums(np.frombuffer((a + b).encode(), np.uint8), 1).at(np.array([0, 1024]), 1024)
    assert one != two


def test_fingerprints_follow_the_bytes_alone():
    rnd = np.random.default_rng(3)
    text = rnd.integers(0, 256, 400, dtype=np.uint8)
    data = np.concatenate([rnd.integers(0, 256, 1_200_000, dtype=np.uint8), text, rnd.integers(0, 256, 77, dtype=np.uint8), text])
    for kind in (0, 1):
        sums = suffixes.Sums(data, kind)
        at = np.arange(1_200_000, 1_200_201)
        assert (sums.at(at, 200) == sums.at(at + 477, 200)).all()
        assert len(np.unique(sums.at(np.arange(100_000), 200))) == 100_000
