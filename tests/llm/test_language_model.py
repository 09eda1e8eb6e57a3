"""Elias-Fano tries and trigram scores against plain dictionaries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pdengine.llm import elias_fano, language_model as lm

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def rounded(p):
    return 10 ** (-round(-math.log10(p) * lm.STEPS) / lm.STEPS)


def brute(rows):
    texts, one, two, three = [], Counter(), defaultdict(Counter), defaultdict(Counter)
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UPPER, UPPER.lower()))) + ["\n"]
        texts.append((doc, doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1, [None, None, *words]))
    for _, held, w in texts:
        for i in range(2, 0 if held else len(w)):
            one[w[i]] += 1
            two[w[i - 1]][w[i]] += 1
            three[w[i - 2], w[i - 1]][w[i]] += 1
    n, v = sum(one.values()), len(one)

    def part(found, word):
        if not found:
            return 0.0, 1.0
        whole = sum(found.values()) + len(found)
        return (rounded(found[word] / whole) if found[word] else 0.0), rounded(len(found) / whole)

    out = []
    for doc, held, w in texts:
        base = score = 0.0
        for i in range(2, len(w)):
            c = one[w[i]]
            base += math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
            p = (rounded(c / (n + v)) if c else 0.0) + rounded(v / (n + v)) / (v + 1) if n else 1.0
            for a, rest in (part(two.get(w[i - 1]), w[i]), part(three.get((w[i - 2], w[i - 1])), w[i])):
                p = a + rest * p
            score += math.log10(min(p, 1.0))
        out.append((doc, held, len(w) - 2, sum(one[x] > 0 for x in w[2:]), n, base, score))
    return out


def same(got, want):
    key = lambda r: (repr(r[0]), *r[1:5], round(r[5], 6), round(r[6], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-11, atol=1e-11)


@pytest.mark.parametrize("n, most", [(0, 9), (1, 1), (1, 1 << 40), (50, 60), (3000, 10**6), (5000, 1 << 61)])
def test_sequences(n, most):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, most, n))
    s = elias_fano.Sequence(elias_fano.Sequence.build(values))
    asked = np.concatenate([values, rng.integers(0, most, 200), [-1, most + 1]])
    place = {v: i for i, v in enumerate(values.tolist())}
    assert (s.at(np.arange(len(values))) == values).all()
    assert s.find(asked).tolist() == [place.get(v, -1) for v in asked.tolist()]
    assert 8 * (s.end - 24) <= len(values) * (2 + max(0, math.ceil(math.log2(max(most, 2) / max(len(values), 1))) + 1)) + 256


def test_tries_from_a_mapped_file(tmp_path):
    rows = np.unique(np.random.default_rng(5).integers(0, [9, 50, 80], (4000, 3)), axis=0)
    pairs = np.unique(rows[:, :2], axis=0)
    (tmp_path / "t").write_bytes(elias_fano.Trie.build(list(rows.T), np.arange(len(pairs), dtype=np.uint16), np.arange(len(rows), dtype=np.uint32)))
    trie = elias_fano.opened(tmp_path / "t")
    every = np.stack(np.meshgrid(np.arange(10), np.arange(52), np.arange(82), indexing="ij"), -1).reshape(-1, 3)
    node = trie.children(1, trie.roots(every[:, 0]), every[:, 1])
    place = trie.children(2, node, every[:, 2])
    have = {tuple(r): i for i, r in enumerate(rows.tolist())}
    assert place.tolist() == [have.get(tuple(r), -1) for r in every.tolist()]


def test_wide_numbers_merge_like_narrow_ones():
    rng = np.random.default_rng(6)
    for scale in (1, 1 << 40, 1 << 58):
        rows = rng.integers(0, 6, (500, 3)) * scale
        merged = lm._merged([[*rows[:200].T, np.ones(200, np.int64)], [*rows[200:].T, np.ones(300, np.int64)]])
        want = Counter(map(tuple, rows.tolist()))
        assert list(zip(*[m.tolist() for m in merged], strict=True)) == [(*k, want[k]) for k in sorted(want)]


def test_scores_equal_dictionaries_also_with_split_contexts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    same(lm.scores(docs).collect(), want)
    same(lm.scores(docs.repartition(3), shards=150).collect(), want)


def test_held_out_texts_are_likelier_than_by_counts_alone(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    row = lm.scores(docs).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert row.s > row.b


def test_one_word_pair_holds_most_of_the_tokens(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(f"x y w{rnd.randint(0, 300)}" for _ in range(200))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(lm.scores(docs.repartition(5), shards=16).collect(), brute(rows))
    kinds = {r.kind for r in lm.tries(docs, shards=16).collect()}
    assert kinds == {lm.NORMAL, lm.SPLIT}


def test_odd_texts(spark):
    long = "ab" * 200_000
    rows = [(1, "A b c a b d"), (2, None), (2, ""), (None, "zz A b"), (3, "a b"), (4, "é x\ty\x0b b  c\n"), (6, "b c"), (9, long), (10, long + " b"), (11, "\x85 \xa0a")] * 2
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, score string, row int")
    same(lm.scores(docs.repartition(4)).collect(), brute(rows))
    assert lm.scores(docs.limit(0)).collect() == []
    held = lm.scores(docs.where(lm.held_out())).collect()
    assert held and {(r.train_tokens, r.n_known, r.base_score, r.score) for r in held} == {(0, 0, 0.0, 0.0)}


def test_long_texts_are_cut_without_a_seam(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(n))) for i, n in ((0, 700_000), (2, 900_000), (3, 10))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert lm.Chunks(docs.repartition(1), lm.held_out()).read(0).count() > 1
    same(lm.scores(docs).collect(), brute(rows))
