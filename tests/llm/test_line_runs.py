"""Runs of lines: merged without shuffling or sorting them, counted before they are joined."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from pdengine.llm.line_dedup import KEY, LineRuns, drop_common_lines


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lines(spark, rows):
    return spark.createDataFrame(rows, "row long, row2 long, h1 long, h2 long")


def test_runs_are_neither_shuffled_nor_sorted(spark):
    rnd = random.Random(1)
    runs = LineRuns(spark, min_docs=3, buckets=4)
    seen = defaultdict(set)
    for batch in range(5):
        rows = [(batch * 1000 + rnd.randrange(40), 0, rnd.randrange(60), 7) for _ in range(400)]
        if batch in (1, 2):
            counted = lines(spark, rows).groupBy(*KEY).agg(F.count_distinct("row").alias("n"))
            text = plan(runs.unknown(counted))
            known = text[text.index("FileScan") - 200 :] if "FileScan" in text else text
            assert text.count("Bucketed: true") == sum(map(len, runs.levels))
            for part in text.split("SortMergeJoin")[1:]:
                below = part.split("FileScan")[0]
                side = below.split(":")[-1] if "FileScan" in part else ""
                assert "Exchange" not in side and "Sort" not in side, known
            merged = plan(runs.merged(runs.levels[0]))
            assert "Exchange" not in merged and "Sort " not in merged
        runs.add(lines(spark, rows))
        for row, _, h1, _ in rows:
            seen[h1].add(row)
    got = {r.h1: r.n for r in runs.common().collect()}
    assert set(got) == {h for h, r in seen.items() if len(r) >= 3} and runs.levels == []
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_any_number_of_batches_drops_the_same_lines(spark):
    rnd = random.Random(2)
    texts = ["\n".join(rnd.choice(["common one", " Common TWO\t", f"own {i} {j}", ""]) for j in range(rnd.randint(0, 6))) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    keys = [{x.strip(" \t\n\x0b\x0c\r").lower() for x in t.split("\n")} for t in texts]
    count = Counter(k for ks in keys for k in ks)
    want = {i: "\n".join(x for x in t.split("\n") if not (k := x.strip(" \t\n\x0b\x0c\r").lower()) or count[k] < 10) for i, t in enumerate(texts)}
    for batches in (1, 4, 9):
        got = {r.doc_id: r.text for r in drop_common_lines(docs, 10, 1, batches=batches, fan=2).collect()}
        assert got == want
