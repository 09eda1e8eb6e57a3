"""Tokens, classifier, vectors and the pipeline."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from pdengine.llm import embedding_dedup, neighbours, quality, sentencepiece as pieces, token_counts
from pdengine.llm.registry import PIECE_BPE, WORD_BPE
from pdengine.llm.vectors import cosines, matrix

ODD = ["", " ", "  a", "Hello  world\n\tx é 中", "\x00a", "ﬁ Ａ 😀", "a" * 3000, "they'll 've ΣΣ İı ß²½ _x_", "<|endoftext|> <s>", "é" * 40 + "\x85\xa0 \x1c.", "́é"]


def strings(n, seed=1):
    rnd = random.Random(seed)
    alphabet = "abcdeéÀthe   ingtion\n\t中文😀aaaa..,!!--0123'sÉß<|>"
    return ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_pieces_equal_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    codec, texts = pieces.codec(PIECE_BPE), strings(1500)
    ids, offsets = codec.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == library.encode(texts)
    assert codec.decode(ids, offsets) == texts
    assert codec.encode([])[0].tolist() == [] and codec.decode(ids[:0], np.zeros(2, np.int64)) == [""]


def test_unigram_scores_give_the_best_path():
    """A small unigram model, against all ways to cut a word."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    field = lambda k, raw: bytes([k << 3 | 2]) + varint(len(raw)) + raw
    rnd = random.Random(4)
    names = sorted({"".join(rnd.choice("ab▁") for _ in range(rnd.randint(1, 4))) for _ in range(40)} | {"a", "b", "▁"})
    score = {n: -rnd.random() * 9 for n in names}
    piece = lambda n, s, kind: field(1, field(1, n.encode()) + b"\x15" + np.float32(s).tobytes() + b"\x18" + bytes([kind]))
    raw = piece("<unk>", 0, 2) + b"".join(piece(n, score[n], 1) for n in names) + field(2, b"\x18\x01") + field(3, b"\x18\x01\x20\x00")
    codec = pieces.Codec(pieces.Model(raw))

    def best(text):
        table = [(0.0, [])] + [None] * len(text)
        for i in range(1, len(text) + 1):
            table[i] = max((table[j][0] + np.float64(np.float32(score[text[j:i]])), table[j][1] + [text[j:i]]) for j in range(i) if text[j:i] in score)
        return table[-1]

    for _ in range(60):
        text = "".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 12)))
        ids, offsets = codec.encode([text, text])
        got = [codec.model.names[i] for i in ids[: offsets[1]]]
        want, _ = best("▁" + text.replace(" ", "▁"))
        assert "".join(got) == "▁" + text.replace(" ", "▁") and sum(np.float32(score[g]) for g in got) == pytest.approx(want, abs=1e-4)
        assert codec.decode(ids, offsets) == [text, text]


def test_encoded_and_decoded_tables(spark):
    rows = [(i, t, "x") for i, t in enumerate(strings(40))] + [(99, None, "y"), (None, "z", None), (1, " ", "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.encoded(table, PIECE_BPE)
    assert out.columns == ["doc_id", "n_tokens", "ids", "round_trip"] and all(r.round_trip and r.n_tokens == len(r.ids) for r in out.collect())
    back = pieces.decoded(out, PIECE_BPE).select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in back), key=repr) == sorted(((i, t or "") for i, t, _ in rows), key=repr)
    assert pieces.encoded(table.limit(0), PIECE_BPE).collect() == []


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library, texts = Tokenizer.from_file(WORD_BPE), strings(1500, 2)
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    counter = token_counts.Counter(WORD_BPE)
    assert counter(texts) == want
    for code in range(0x250):
        some = [f"{p}{chr(code)}{q}" for p, q in (("", ""), ("a", "b"), ("1", "!"))]
        assert counter(some) == [len(library.encode(t, add_special_tokens=False).ids) for t in some]
    rows = [(i, t, 1) for i, t in enumerate(texts[:30])] + [(98, None, 1), (None, "a b", 2), (1, " ", 1)]
    out = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), WORD_BPE, 3).collect()
    assert sorted((tuple(r) for r in out), key=repr) == sorted(
        ((d, len((t or "").encode()), n, n > 3) for d, t, _ in rows for n in [len(library.encode(t or "", add_special_tokens=False).ids)]), key=repr
    )


def test_token_count_query(spark, folder):
    from tokenizers import Tokenizer

    from pdengine.llm.registry import op9_token_counts

    library = Tokenizer.from_file(WORD_BPE)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d, len(t.encode()), n, n > 2048) for d, t in docs for n in [len(library.encode(t, add_special_tokens=False).ids)])
    assert sorted(tuple(r) for r in op9_token_counts(spark, folder).collect()) == want


def test_piece_query(spark, folder):
    import sentencepiece

    from pdengine.llm.registry import op6_sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = op6_sentencepiece(spark, folder).collect()
    assert {r.doc_id: r.ids for r in got} == {d: library.encode(t) for d, t in texts.items()} and all(r.round_trip for r in got)


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 4 <> 0"), 4000)
    rated = docs.join(labels.where("doc_id % 4 = 0"), "doc_id").select("doc_id", "text", "quality", "toxic")
    out = quality.graded(rated, model).toPandas()
    clean, poor, toxic = out[(out.quality == 1) & (out.toxic == 0)], out[out.quality == 0], out[(out.quality == 1) & (out.toxic == 1)]
    assert clean.kept.mean() > 0.97 and poor.kept.mean() < 0.15
    assert clean.expected_grade.mean() > toxic.expected_grade.mean() > poor.expected_grade.mean()


def test_thresholds_are_ordered_and_probabilities_fit():
    rnd = np.random.default_rng(0)
    x = rnd.standard_normal(6000)
    grade = (2 * x[:, None] + rnd.logistic(size=(6000, 1)) > np.array([[-1.0, 0.5, 2.0]])).sum(axis=1)
    weights, cuts = quality.fit_ordinal(np.arange(6000), np.zeros(6000, np.int64), x, grade, 4, steps=400, rate=0.05)
    assert abs(weights[0] - 2) < 0.2 and np.allclose(cuts, [-1, 0.5, 2], atol=0.25) and (np.diff(cuts) > 0).all()


def test_quality_edges(spark):
    rows = [(1, None, "p"), (2, "", "q"), (3, " \n", None), (None, "some words", "r"), (4, "good text " * 9, "s"), (4, "good text " * 9, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (none, spark.createDataFrame([(4, 1, 0), (9, 0, 0), (None, 1, 1), (2, None, 1)], none.schema)):
        assert quality.fit(docs, labels) is None
    assert [r.kept for r in quality.graded(docs, None).collect()] == [True] * 6
    model = quality.fit(docs, spark.createDataFrame([(4, 1, 0), (4, 0, 1), (2, 1, None), (3, 1, 1)], none.schema))
    out = quality.graded(docs, model, keep_text=False)
    assert out.columns == ["doc_id", "expected_grade", "p_good", "kept"] and out.count() == 6
    assert quality.graded(docs.limit(0), model).collect() == []


def vectors(n=260, dim=16, seed=3):
    rnd = np.random.default_rng(seed)
    v = rnd.standard_normal((n, dim))
    v[40:80] = v[:40] + 0.05 * rnd.standard_normal((40, dim))
    v[80:140] = v[0] * rnd.uniform(0.5, 9, 60)[:, None] + 0.02 * rnd.standard_normal((60, dim))
    rows = [(i, v[i].tolist(), i % 3 if i >= 140 else 1, "x") for i in range(n)]
    rows += [(900, None, 1, ""), (901, [], 1, ""), (902, [0.0] * dim, 1, ""), (903, [float("nan")] + [1.0] * (dim - 1), 1, "")]
    rows += [(904, [None] + [1.0] * (dim - 1), 1, ""), (905, [float("inf")] * dim, 1, ""), (906, v[0].tolist(), None, ""), (None, v[0].tolist(), 1, "")]
    rows += [(907, v[0][:5].tolist(), 1, ""), (908, (v[0] * 1e200).tolist(), 1, ""), (0, v[0].tolist(), 1, "x"), (50, v[0].tolist(), 1, "x")]
    return rows


def usable(rows):
    out = []
    for i, e, label, _ in rows:
        if i is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e):
            e = np.array(e) / np.abs(e).max()
            out.append((i, e / np.linalg.norm(e), label))
    return out


def test_search_finds_the_nearest(spark, monkeypatch):
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score string").repartition(4)
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    got = neighbours.search(table.where("vec_id % 50 = 0"), table, 5).collect()
    good = usable(rows)
    want = set()
    for q in {i for i, _, _ in good if i % 50 == 0}:
        near = sorted((-float(e @ o), j) for i, e, _ in good if i == q for j, o, _ in good if j != q and len(o) == len(e))
        want |= {(q, j) for _, j in near[:5]}
    hits = {(r.query_id, r.vec_id) for r in got}
    assert len(hits & want) >= 0.9 * len(want)
    assert all(1 <= r["rank"] <= 5 for r in got) and all(-1.0001 <= r.score <= 1.0001 for r in got)
    nothing = table.limit(0)
    assert neighbours.search(nothing, table).collect() == [] and neighbours.search(table, nothing).collect() == []


def test_few_candidates_are_all_returned(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in neighbours.search(table.where("vec_id % 50 = 0"), table).collect())
    assert got == [(0, 1, 3, 0.707107), (0, 2, 50, 0.0), (50, 1, 3, 0.707107), (50, 2, 0, 0.0)]


def test_estimates_keep_their_bounds():
    v = np.random.default_rng(2).standard_normal((800, 64))
    codes, scalars = neighbours.encode(v)
    q = v[:40] / np.linalg.norm(v[:40], axis=1)[:, None]
    about, bound = neighbours.estimate(codes, scalars, q @ neighbours.rotation(64).T)
    error = np.abs(about - cosines(v[:40], v))
    assert codes.shape == (800, 8) and (error <= bound[None, :]).mean() > 0.99


def test_embedding_links(spark, monkeypatch):
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, kept string").repartition(5)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(table).collect()), key=repr)
    good = [(at, i, e, label) for at, row in enumerate(rows) for i, e, label in usable([row]) if label is not None]
    n, parent = {at: 0 for at in range(len(rows))}, {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, (at, i, e, label) in enumerate(good):
        for bt, j, o, other in good[:p]:
            if label == other and len(e) == len(o) and float(e @ o) >= 0.98:
                n[at] += 1
                n[bt] += 1
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    want = sorted(((r[0], n[at], None if r[0] is None else root(r[0]), r[0] is not None and root(r[0]) == r[0]) for at, r in enumerate(rows)), key=repr)
    assert got == want
    assert embedding_dedup.near_duplicates(table.limit(0)).collect() == []


def test_usable_vectors():
    good, rows = matrix(pa.array([[1.0, 2.0], None, [], [0.0], [None], [float("nan")]], pa.list_(pa.float64())).slice(0, 6))
    assert good.tolist() == [True, False, False, False, False, False] and rows[0].tolist() == [1.0, 2.0]


def test_pipeline_stages_keep_their_promises(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    before = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, folder)
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert out.columns == docs.columns
        assert out.select("doc_id").join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        if i == 2:
            again = corpus_pipeline.near_duplicate_stage(spark, out, folder)
            assert out.count() == out.select("doc_id").distinct().count() == again.count()
        before = out
    assert before.where("not round_trip").count() == 0 and before.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "round_trip"]


def test_pipeline_of_odd_rows(spark, folder):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c", "en", None, 5), (3, "w " * 9000, None, "s", 1)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").schema)
    for table in (docs, docs.limit(0)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, folder)
            assert i == 4 or out.columns == docs.columns
            out.collect()


def test_one_odd_character_does_not_turn_the_shortcut_off():
    counter = token_counts.Counter(WORD_BPE)
    text = "it’s a plain text — with “quotes” and one 😀 among many ordinary words <|endoftext|> here"
    words, odd = counter.pretokens(text)
    assert odd == ["it’s", "—", "“quotes”", "😀", "<|endoftext|>"] and len(words) == 11
    want = [len(counter.library.encode(t, add_special_tokens=False).ids) for t in (text, "á ́b ç\td", "Σ ΑΣ. İx\ny\x1cz\x85w")]
    assert counter([text, "á ́b ç\td", "Σ ΑΣ. İx\ny\x1cz\x85w"]) == want
    asked = []
    encode = counter.library.encode_batch
    counter.odd.clear()
    counter.library = type("L", (), {"encode_batch": staticmethod(lambda t, **k: asked.extend(t) or encode(t, **k)), "encode": counter.library.encode})
    counter([text] * 50)
    assert sorted(asked) == sorted(odd)
