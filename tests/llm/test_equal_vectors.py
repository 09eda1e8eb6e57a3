"""Equal vectors stand in the join once."""

import time

from pyspark.sql import functions as F

from pdengine.llm import embedding_dedup


def test_a_hundred_thousand_equal_vectors(spark):
    same = F.array(*[F.lit(float(i % 3) + 0.5) for i in range(16)])
    near = F.array(*[F.lit(float(i % 3) + 0.5 + 0.01 * (i == 2)) for i in range(16)])
    far = F.array(*[F.lit(float(-i)) for i in range(16)])
    rows = spark.range(100_000).select("id", same.alias("e"), F.lit(1).alias("label"))
    rows = rows.union(spark.range(200_000, 200_003).select("id", near, F.lit(1))).union(spark.range(300_000, 300_002).select("id", far, F.lit(1)))
    rows = rows.union(spark.range(400_000, 400_001).select("id", same, F.lit(2))).toDF("vec_id", "embedding", "label")
    began = time.monotonic()
    out = embedding_dedup.near_duplicates(rows.repartition(8)).groupBy("component_id", "n_links", "kept").count().collect()
    assert time.monotonic() - began < 90
    got = {tuple(r) for r in out}
    assert got == {
        (0, 100_002, True, 1), (0, 100_002, False, 100_002), (300_000, 1, True, 1), (300_000, 1, False, 1), (400_000, 0, True, 1),
    }


def test_an_id_with_several_vectors_is_one_node(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(5, a, 1), (7, a, 1), (7, b, 1), (9, b, 1), (9, b, 1), (11, c, 1), (12, c, 2), (13, c, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(table).collect())
    assert got == [
        (5, 1, 5, True), (7, 1, 5, False), (7, 2, 5, False), (9, 2, 5, False), (9, 2, 5, False), (11, 0, 11, True), (12, 0, 12, True), (13, 0, 13, True),
    ]
