"""Word vectors learnt from which words stand near each other.

Words that occur within a window of one another are counted, nearer ones more.
Counts become positive pointwise mutual information, and the leading part of
that symmetric matrix, found by randomised subspace iteration, gives every word
a vector. Words used in the same surroundings get similar vectors, also where
they never occur together. The matrix is a table that stays on executors; a
product with it sends out and brings back a block as tall as the vocabulary,
whose size is a parameter, and as wide as the vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pdengine.staging import materialise

#: Words that get a vector, and steps between words that count as near.
VOCABULARY, WINDOW = 4096, 5
#: Additional directions and rounds of the randomised iteration.
OVERSAMPLING, ROUNDS = 10, 4


def frequent_words(texts: DataFrame, words: str, most: int = VOCABULARY) -> list[str]:
    """The ``most`` frequent words of an array column, ties in order."""
    counted = texts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()]


def _near(place: dict[str, int], window: int):
    size = len(place)

    def task(batches):
        for batch in batches:
            column = batch.column("words")
            lists = column.fill_null([]) if column.null_count else column
            offsets = np.asarray(lists.offsets)
            ids = np.array([place.get(w, -1) for w in lists.values.to_pylist()[offsets[0] : offsets[-1]]], np.int64)
            text = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            keys, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
            for step in range(1, window + 1):
                a, b = ids[:-step], ids[step:]
                near = (text[:-step] == text[step:]) & (a >= 0) & (b >= 0)
                a, b = a[near], b[near]
                keys.append(np.minimum(a, b) * size + np.maximum(a, b))
                weights.append(np.full(len(a), 1.0 / step))
            key, which = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(which, np.concatenate(weights), len(key))
            yield pa.RecordBatch.from_arrays([pa.array(key // size), pa.array(key % size), pa.array(total)], names=["a", "b", "n"])

    return task


def near_counts(texts: DataFrame, words: str, vocabulary: list[str], window: int = WINDOW) -> DataFrame:
    """``(a, b, n)``: how near the words of numbers a and b stand, summed over all texts, both ways round."""
    place = {w: i for i, w in enumerate(vocabulary)}
    half = texts.select(F.col(words).alias("words")).mapInArrow(_near(place, window), "a long, b long, n double")
    half = half.groupBy("a", "b").agg(F.sum("n").alias("n"))
    other = half.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "n")
    return half.withColumn("n", F.when(F.col("a") == F.col("b"), 2 * F.col("n")).otherwise(F.col("n"))).union(other)


def information(counts: DataFrame) -> DataFrame:
    """``(a, b, v)``: positive pointwise mutual information."""
    counts = materialise(counts)
    rows = counts.groupBy("a").agg(F.sum("n").alias("ra"))  # a row per word
    total = counts.agg(F.sum("n")).scalar()
    v = F.log(F.col("n") * total / (F.col("ra") * F.col("rb")))
    both = counts.join(F.broadcast(rows), "a").join(F.broadcast(rows.select(F.col("a").alias("b"), F.col("ra").alias("rb"))), "b")
    return both.select("a", "b", v.alias("v")).where("v > 0")


def _product(block: np.ndarray):
    def task(batches):
        out = np.zeros_like(block)
        seen = np.zeros(len(block), bool)
        for batch in batches:
            a, b, v = (batch.column(c).to_numpy() for c in "abv")
            order = np.argsort(a, kind="stable")
            a, b, v = a[order], b[order], v[order]
            if len(a):
                first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                out[a[first]] += np.add.reduceat(block[b] * v[:, None], first, axis=0)
                seen[a[first]] = True
        rows = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(list(out[rows]), pa.list_(pa.float64()))], names=["a", "y"])

    return task


def times(matrix: DataFrame, block: np.ndarray) -> np.ndarray:
    """Product of the table ``(a, b, v)`` with a block of columns; equal rows of parts are added up as they come in."""
    out = np.zeros_like(block)
    for r in matrix.mapInArrow(_product(block), "a long, y array<double>").toLocalIterator():
        out[r["a"]] += r["y"]
    return out


def leading(matrix: DataFrame, size: int, rank: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The ``rank`` eigenvalues largest in size of a symmetric table, and their eigenvectors as columns."""
    wide = min(size, rank + OVERSAMPLING)
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, wide)))
    for _ in range(ROUNDS):
        q, _ = np.linalg.qr(times(matrix, q))
    small = q.T @ times(matrix, q)
    values, turned = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")[:rank]
    return values[order], q @ turned[:, order]


def word_vectors(texts: DataFrame, words: str, rank: int, vocabulary: int = VOCABULARY, window: int = WINDOW) -> tuple[list[str], np.ndarray]:
    """Frequent words and their vectors, a row each."""
    names = frequent_words(texts, words, vocabulary)
    if not names:
        return [], np.zeros((0, rank))
    matrix = materialise(information(near_counts(texts, words, names, window)).repartition("a"))
    values, axes = leading(matrix, len(names), min(rank, len(names)))
    axes = axes * np.where(axes[np.argmax(np.abs(axes), axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    out = np.zeros((len(names), rank))
    out[:, : axes.shape[1]] = axes * np.sqrt(np.abs(values))
    return names, out
