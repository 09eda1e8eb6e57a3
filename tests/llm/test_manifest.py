"""Merkle manifests against hashlib, tree by tree."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np

from pdengine.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, _k string"


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def brute(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, more=0):
        chars = None if r["n_chars"] is None else r["n_chars"] + more
        return h(*map(field, (r["doc_id"], r["source"], r["lang"], chars, r["text"])))

    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        by[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {lang: tree([leaf(r) for r in by[lang]]) for lang in langs}
    top = tree([trees[lang][-1][0] for lang in langs])
    out = []
    for i, lang in enumerate(langs):
        for j, r in enumerate(by[lang]):
            now = leaf(r, int(r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0))
            siblings = []
            for levels, at in ((trees[lang], j), (top, i)):
                for level in levels[:-1]:
                    run = level[at & ~1 : (at & ~1) + 2]
                    siblings += [x for k, x in enumerate(run) if k != at & 1]
                    now = h(*[now if k == at & 1 else x for k, x in enumerate(run)])
                    at >>= 1
            out.append((r["doc_id"], trees[lang][0][j], trees[lang][-1][0], top[-1][0], h(*siblings), now, now == top[-1][0]))
    return sorted(out, key=repr)


def test_states_are_those_of_sha256():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 13):
        leaves = rng.integers(0, 256, (n, 32), dtype=np.uint8)
        digests, states = merkle.grow(leaves, merkle.levels_above(n))
        assert [[bytes(d).hex() for d in level] for level in digests] == tree([bytes(x).hex() for x in leaves])
        assert {bytes(r) for r in merkle.fold(leaves, digests, states, b"")} == {bytes(digests[-1][0])}
    # a retained state, resumed with the right digest, gives the parent without the left one
    pair = rng.integers(0, 256, (2, 32), dtype=np.uint8)
    digests, states = merkle.grow(pair, 1)
    resumed = merkle.fold_step(pair[1:], np.array([True]), merkle._states(states[0]), pair[:1], np.array([False]))
    assert bytes(resumed[0]).hex() == h(bytes(pair[0]).hex(), bytes(pair[1]).hex())


def test_equals_brute_force_over_several_levels_of_blocks(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    for levels, parts in ((2, 3), (merkle.LEVELS, 1)):
        got = sorted(map(tuple, merkle.manifest(docs.repartition(parts), levels).collect()), key=repr)
        assert got == brute(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_odd_rows(spark):
    rows = [(1, "a", "en", "s", None, "x", "k")] * 3 + [
        (None, None, None, None, 3, "y", None), (2, "", "", "s", 2**63 - 1, None, "="), (14, "x" * 300_000, None, "é", 1, "z", "-"),
        (-7, "t", "-", "s", 0, "", ""), (13, "u", "=", "s", 5, "", ""), (13, "v", "=", "s", 5, "", ""),
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    want = brute([r.asDict() for r in table.collect()])
    assert sorted(map(tuple, merkle.manifest(table.repartition(4), 1).collect()), key=repr) == want
    out = merkle.manifest(table.limit(0))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and out.collect() == []
    assert len(merkle.manifest(table.select("text")).collect()) == len(rows)
