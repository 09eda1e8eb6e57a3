"""Operators on documents: brute force on small tables with every odd case."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pdengine.llm import components, licenses, line_dedup, minhash, mixing, suffixes
from pdengine.llm.words import shingles, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, n_lines string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    some = [f"w{i}" for i in range(400)]
    base = [rnd.choice(some) for _ in range(90)]
    out = []
    for i in range(60):
        text = list(base) if i % 3 == 0 else [rnd.choice(some) for _ in range(rnd.randint(3, 80))]
        for _ in range(i % 7):
            text[rnd.randrange(len(text))] = rnd.choice(some)
        lines = " ".join(text).replace(" w7 ", "\n W7\x0b").replace(" w9 ", " w9\t\r\nCommon Line \n")
        out.append((i, lines, f"s{i % 4}" if i % 5 else None, "x"))
    out += [(70, None, "s1", None), (71, "", None, None), (72, " \n\t ", "s2", "y"), (73, "one", "s1", "y"), (74, "one", "s1", "y")]
    out += [out[4], (75, "É é " * 3000, "s9", "z"), (None, "lost id " * 9, "s1", "z"), (76, "one two", "s0", "")]
    out += [(100 + i, "Common Line\nmine %d" % i, "s3", "") for i in range(12)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text, k):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_copies(rows, k, percent):
    sets = [(d, shingle_set(t, k)) for d, t, *_ in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return sorted(((d, len(s), None if d is None else root(d), d is not None and root(d) == d) for d, s in sets), key=repr)


@pytest.mark.parametrize("k,percent,bands,size", [(3, 85, 25, 5), (5, 80, 40, 5)])
def test_near_duplicates(docs, rows, k, percent, bands, size):
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs, k, percent, bands, size).collect()), key=repr)
    assert got == brute_copies(rows, k, percent)


def test_near_duplicates_of_nothing(empty):
    assert minhash.near_duplicates(empty).collect() == []


def test_signatures_estimate_similarity():
    rnd = np.random.default_rng(1)
    errors = []
    for _ in range(150):
        a = rnd.integers(0, 2**63, 150, dtype=np.uint64)
        b = np.concatenate([a[:120], rnd.integers(0, 2**63, 30, dtype=np.uint64)])
        s = minhash.signatures(np.concatenate([a, b]), np.array([0, 150, 300]), 128)
        errors.append((s[0] == s[1]).mean() - 120 / 180)
    plain = np.sqrt(120 / 180 * 60 / 180 / 128)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.9 * plain


def test_signatures_of_each_set_alone_and_together():
    sets, offsets = shingles(words(pa.array(["a b c d e", "", None, "a b", "x " * 500])), 3)
    both = minhash.signatures(sets, offsets, 40)
    for i in range(5):
        alone = minhash.signatures(sets[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]), 40)
        assert (both[i] == alone[0]).all()
    assert np.isinf(both[1]).all() and np.isfinite(both[[0, 3, 4]]).all()


def test_words_match_the_pattern():
    texts = ["A  b\x0bc\nÉ", None, "", " ", "x" * 50 + "\t" + "Y", "中文 text"]
    w = words(pa.array(texts))
    got = [[] for _ in texts]
    for s, e, t in zip(w.start, w.end, w.text):
        got[t].append(bytes(w.data[s:e]).decode())
    assert got == [WORD.findall(lower(t or "")) for t in texts]


def test_long_words_hash_alike():
    from pdengine.llm import words as module

    for n in (1, 7, 8, 9, 63, 64, 65, module._CHAINED - 1, module._CHAINED, module._CHAINED + 1, 5000):
        one, two = "é" * (n // 2) + "a" * (n % 2), "a" * n
        h = module.words(pa.array([f"{two} b", f"c {two}", one, f" {one}", two[1:] + "b", two + "\x00"])).hash
        assert h[0] == h[3] and h[4] == h[5] and len(set(h.tolist())) == len({two, "b", "c", one, two[1:] + "b", two + "\x00"})


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    want = {x: root(x) for x in parent if root(x) != x}
    got = components.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()
    assert {r.node: r.component_id for r in got} == want and len(got) == len(want)
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_lines(rows, least):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add((d, t))
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and len(held[key(x)]) >= least)]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches,fan", [(1, 3), (5, 2)])
def test_line_dedup(docs, rows, batches, fan):
    out = line_dedup.drop_common_lines(docs, 10, 1, batches, fan)
    assert out.columns == ["doc_id", "text", "source", "n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=repr)
    assert got == brute_lines(rows, 10)
    assert any(r[3] for r in got)


def test_line_dedup_plan_is_native(docs):
    plan = line_dedup.drop_common_lines(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


def test_line_dedup_of_nothing(empty):
    assert line_dedup.drop_common_lines(empty).collect() == []


def brute_repeats(rows, w):
    seen = Counter()
    for _, t, *_ in rows:
        b = (t or "").encode()
        seen.update(b[i : i + w] for i in range(len(b) - w + 1))
    out = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - w + 1):
            if seen[b[i : i + w]] > 1:
                gone[i : i + w] = b"\1" * w
        kept = bytes(x for x, y in zip(b, gone) if not y)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, kept, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,share", [(20, 16), (31, 200)])
def test_repeats(docs, rows, window, share, monkeypatch):
    monkeypatch.setattr(suffixes, "PASS_SHARE", share)
    monkeypatch.setattr(suffixes, "BUCKET", 500)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.kept_sha256) for r in suffixes.remove_repeats(docs, window).collect()), key=repr)
    assert got == brute_repeats(rows, window)


def test_places_survive_packing():
    rnd = random.Random(3)
    for places in ([], [0], [254], [255], [256, 510, 511], sorted(rnd.sample(range(100_000), 500))):
        assert suffixes.unpacked_places(suffixes.packed_places(np.array(places, np.int64))).tolist() == places


def test_repeats_of_nothing(empty):
    assert suffixes.remove_repeats(empty).collect() == []


@pytest.mark.parametrize("v", [1, 2, 7, 13, 20, 133, 200])
def test_difference_cover(v):
    d = suffixes.difference_cover(v)
    assert {int((a - b) % v) for a in d for b in d} == set(range(v))


def test_registered_repeats(spark, folder):
    from pdengine.llm.registry import op3_suffix_dedup

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    want = [r[:4] + r[5:] for r in brute_repeats([tuple(r) for r in docs.collect()], 200)]
    assert sorted(tuple(r) for r in op3_suffix_dedup(spark, folder).collect()) == sorted(want)


def test_mix_meets_targets(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, s, _ in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(size.values()), list(names)
    while True:  # share, stop those above, share again
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] >= 2 * size[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: level * weight[s] for s in open_}
    by = {s: t for s, t in target.items()}
    sizes = {(d, s): len(WORD.findall(t or "")) for d, t, s, _ in rows}
    source = {d: s for d, _, s, _ in rows}
    taken = Counter()
    for r in got:
        assert r["size"] == sizes[r.doc_id, source[r.doc_id]] and 0 <= r.taken <= 2 * r["size"]
        assert r.target == pytest.approx(by[source[r.doc_id]]) and r.source_size == size[source[r.doc_id]]
        assert (r.position is not None) == (r.taken > 0) and (r.again is not None) == (r.taken > r["size"])
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - by[s]) < 1 for s in by)
    at = [r.position for r in got if r.position is not None]
    assert at == sorted(at) and all(0 <= a <= 1 for a in at)


@pytest.mark.parametrize("knots", mixing.SCHEDULES + (((0.0, 0.0), (0.3, 2.0), (1.0, 0.5)),))
def test_training_time_inverts_the_integral(spark, knots):
    from pyspark.sql import functions as F

    shares = [i / 20 for i in range(21)]
    got = [r.t for r in spark.createDataFrame([(s,) for s in shares], "s double").select(mixing.training_time(F.col("s"), knots).alias("t")).collect()]
    grid = np.linspace(0, 1, 200_001)
    weight = np.interp(grid, *zip(*knots))
    area = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
    assert np.allclose(np.interp(got, grid, area / area[-1]), shares, atol=1e-4)


def test_mix_with_few_rows_per_bucket(docs, monkeypatch):
    want = sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 2)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=repr) == want


def test_mixed_documents(docs, empty):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() > 0
    assert mixing.mix(empty).collect() == [] and mixing.mixed(empty).collect() == []


def test_licences_in_odd_texts(spark):
    s = licenses.SENTENCES
    texts = {
        1: "Foo bar\nReleased under the MIT License.\nmore", 2: "see Released under the MIT License.",
        3: "MIT License\n\n" + s["mit-grant"].replace(" the ", "\nthe ") + "\n\n" + s["mit-notice-kept"],
        4: s["apache-file"] + " " + s["apache-use"] + "\n" + s["apache-copy"], 5: None, 6: "", 7: "A! Licensed under CC BY-NC 4.0. B",
        8: "LICENSED UNDER\nTHE APACHE LICENSE, VERSION 2.0. " * 2, 9: "This work is dedicated to the public\ndomain.",
        10: "x " * 50_000 + ". Released under the MIT License.",
    }
    table = spark.createDataFrame([(k, t, "a") for k, t in texts.items()], "doc_id long, text string, matches string")
    got = {r.doc_id: [m.licence for m in r.matches] for r in licenses.scan(table).collect()}
    assert got == {1: ["MIT"], 2: [], 3: ["MIT"], 4: ["Apache-2.0"], 5: [], 6: [], 7: ["CC-BY-NC-4.0"], 8: ["Apache-2.0"] * 2, 9: ["CC0-1.0"], 10: ["MIT"]}
    spans = {r.doc_id: [(m.start, m.stop) for m in r.matches] for r in licenses.scan(table).collect()}
    assert texts[1][spans[1][0][0] : spans[1][0][1]] == "Released under the MIT License"


def test_licence_query_finds_all_lines(spark, folder):
    """Brute force: every line that is one of the notices, by plain comparison."""
    from pdengine.llm.registry import op10_license_scan

    notice = {s: n for n, (sequence,) in [r for r in licenses.RULES if len(r[1]) == 1] for s in [licenses.SENTENCES[sequence]]}
    for r in op10_license_scan(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        whole = Counter(notice[x.strip()] for x in r.text.split("\n") if x.strip() in notice)
        got = Counter(m.licence for m in r.matches)
        assert r.n_matches == len(r.matches) and all(got[k] >= n for k, n in whole.items())
        assert r.licences == ",".join(sorted(got))
        assert all(any(n == m.licence and s.lower().rstrip(".") in " ".join(r.text[m.start : m.stop].lower().split()) for s, n in notice.items()) for m in r.matches)
