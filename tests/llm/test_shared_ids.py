"""Rows with a null or shared id go through mixing and near-dedup as documents of their own."""

from collections import Counter

import numpy as np

import corpus_pipeline
from pdengine.llm import mixing

SCHEMA = "doc_id long, text string, source string, n string"


def test_mixed_decides_each_row(spark):
    rows = [(None if i % 2 else 7, f"w{i} " * 10, f"s{i % 3}", "x") for i in range(60)] + [(5, "same " * 10, "s1", "y")] * 6
    table = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in mixing.mixed(table.repartition(3)).collect()]
    words = Counter()
    for _, text, source, _ in got:
        words[source] += len(text.split())
    sizes = table.select("source", mixing._size().alias("size"))
    target = {r.source: r.target for r in mixing.sources_with_targets(sizes).collect()}
    assert all(abs(words[s] - target[s]) <= 10 for s in target)
    assert set(got) <= set(rows) and max(Counter(got).values()) <= 12
    assert got == [tuple(r) for r in mixing.mixed(table.repartition(5)).collect()]


def test_near_dedup_keeps_texts_that_share_an_id(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(1, text("a"), "s", "x"), (1, text("b"), "s", "x"), (2, text("b"), "s", "x"), (3, text("c"), "s", "x"),
            (3, text("c"), "s", "x"), (None, text("a"), "s", "x")]
    out = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert out.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted({rows[0], rows[1], rows[3], rows[5]}, key=repr)


def test_near_duplicates_of_shared_ids(spark):
    """Each text of an id is linked; the id is one node."""
    from pdengine.llm import minhash

    words = lambda k, n: [f"{k}{i}" for i in range(n)]
    near = lambda w: " ".join([*w[:-1], "other"])
    a, b = words("a", 1000), words("b", 60)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, "x y z"), (None, " ".join(a)), (5, None), (5, ""), (7, " ".join(b))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 4):
        got = sorted(((r.doc_id, r.component_id, r.kept, r.n_shingles) for r in minhash.near_duplicates(table.repartition(parts)).collect()), key=repr)
        want = [(1, 1, True, 996), (1, 1, True, 56), (2, 1, False, 996), (3, 1, False, 56), (4, 4, True, 1), (5, 5, True, 0), (5, 5, True, 0), (7, 1, False, 56), (None, None, False, 996)]
        assert got == sorted(want, key=repr)


def test_columns_may_be_named_like_those_of_the_stages(spark):
    schema = "doc_id long, text string, source string, _at long, _key long, _row long, _doc string, _place long, _graded string, kept string"
    rows = [(i, f"t{i} " * (i + 3), "s", 77, 78, 79, "d", 80, "g", "k") for i in range(12)]
    table = spark.createDataFrame(rows, schema)
    assert {tuple(r) for r in mixing.mixed(table).collect()} <= set(rows)
    assert {tuple(r) for r in corpus_pipeline.near_duplicate_stage(spark, table, "").collect()} == set(rows)
    twice = table.union(table.where("doc_id = 3")).union(table.where("doc_id = 4").withColumn("text", mixing.F.lit("new words here now")))
    assert twice.count() == 14 and corpus_pipeline.near_duplicate_stage(spark, twice, "").count() == 13
    from pdengine.llm import quality

    model = (np.zeros(quality.WIDTH, np.float32).tobytes(), [0.0, 1.0])
    out = quality.graded(table, model)
    assert out.columns == [c for c in table.columns if c != "kept"] + ["expected_grade", "p_good", "kept"]
    assert {r._graded for r in out.collect()} == {"g"}


def test_rows_without_id_spread_over_the_mix(spark):
    rows = [(None, f"w{i} " * 10, f"s{i % 3}") for i in range(90)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted(((r.position, r.again, r.taken) for r in mixing.mix(table.repartition(k)).collect()), key=repr) for k in (1, 5))
    assert one == two and len({r[0] for r in one}) > 60


def test_targets_equal_filling_one_by_one(spark):
    import random

    rnd = random.Random(3)
    for n in (1, 2, 7, 40):
        sizes = {f"s{i:02}": rnd.randint(0, 1000) for i in range(n)} | {None: 50}
        table = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.sources_with_targets(table).collect()}
        order = sorted(sizes, key=lambda s: (s is None, s))
        weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
        full, left = {}, 1.5 * sum(sizes.values())
        while True:
            rest = [s for s in order if s not in full]
            level = (left - sum(full.values())) / sum(weight[s] for s in rest) if rest else 0
            new = {s: 2.0 * sizes[s] for s in rest if level * weight[s] >= 2 * sizes[s]}
            if not new:
                break
            full |= new
        assert all(abs(got[s] - full.get(s, level * weight[s])) < 1e-6 for s in order)
