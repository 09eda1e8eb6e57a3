"""Quality of documents by ordinal regression on graded ratings (operator 7).

A cumulative-link model: one weight vector over hashed features of the text
gives a score s, ordered thresholds t1 < t2 < ... cut it into grades, and
P(grade >= k) is the logistic function of s - tk. All thresholds share the
weights, so grades with few ratings learn from the others. Selection uses the
tail probability of a grade; the expected grade ranks documents.

The model is fitted on a bounded sample of rated documents (``sample`` rows,
those with the smallest hash of the id), in one task, in the order of ids.
Scoring reads every text whole.

Defined results: null, empty and blank texts have no features and score 0, so
the thresholds alone decide. A document with contradicting ratings counts with
its lowest; ratings of unknown documents and null ratings are ignored. Without
any rated document, or with one grade only, every document is kept.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pdengine.llm.tables import slices, staged
from pdengine.llm.words import U, mix, words

#: Rated documents that a fit reads at most.
SAMPLE = 8192
#: Hashed features.
WIDTH = 1 << 18
#: Grades: 0 poor, 1 fair text that is toxic, 2 good.
GRADES = 3

_KIND = np.arange(256, dtype=np.uint64) + U(16)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 1


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, feature number and value of each feature of each text; values have unit length per text.

    Features are the words as they are, their shapes (kinds of the first and last
    two characters), and one class of length and share of distinct words; the
    value of the former grows with the logarithm of the count.
    """
    w = words(column, lower=False)
    with np.errstate(over="ignore"):
        if not len(w.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at = lambda i: _KIND[w.data[np.clip(i, w.start, w.end - 1)]]
        shape = ((at(w.start) * U(512) + at(w.start + 1)) * U(512) + at(w.end - 2)) * U(512) + at(w.end - 1)
        each = [
            np.unique(w.text * WIDTH + (h % U(WIDTH)).astype(np.int64), return_counts=True) for h in (w.hash, mix(shape + U(7)))
        ]
    keys, counts = (np.concatenate(x) for x in zip(*each, strict=True))
    text, feature = keys // WIDTH, keys % WIDTH
    value = 1 + np.log(counts)
    # one more feature per text: how much of it is repetition, and how long it is
    total = np.maximum(w.per_text, 1)
    distinct = np.bincount(each[0][0] // WIDTH, minlength=w.texts)
    level = np.round(12 * distinct / total).astype(np.int64) * 32 + np.log2(total).astype(np.int64)
    some = np.flatnonzero(w.per_text)
    text, feature = np.concatenate([text, some]), np.concatenate([feature, level[some]])
    value = np.concatenate([value, np.full(len(some), 3.0)])
    length = np.sqrt(np.bincount(text, value * value, minlength=w.texts))
    return text, feature, value / length[text]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_ordinal(
    text: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int,
    steps: int = 120, rate: float = 0.3, ridge: float = 1e-6,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch Adam on the likelihood of the grades."""
    n = len(grade)
    used, column = np.unique(feature, return_inverse=True)
    share = np.clip([np.mean(grade >= k) for k in range(1, grades)], 1e-3, 1 - 1e-3)
    cuts = -np.log(share / (1 - share))
    # thresholds as a first one and logarithms of gaps, so that they stay in order
    gaps = np.log(np.maximum(np.diff(cuts), 1e-2))
    par = np.concatenate([np.zeros(len(used)), cuts[:1], gaps])
    m, v = np.zeros_like(par), np.zeros_like(par)
    for step in range(1, steps + 1):
        w = par[: len(used)]
        cuts = par[len(used)] + np.concatenate([[0.0], np.cumsum(np.exp(par[len(used) + 1 :]))])
        s = np.bincount(text, value * w[column], minlength=n)
        tail = np.concatenate([np.ones((n, 1)), _logistic(s[:, None] - cuts[None, :]), np.zeros((n, 1))], axis=1)
        each = np.arange(n)
        upper, lower = tail[each, grade], tail[each, grade + 1]
        p = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / p, lower * (1 - lower) / p
        d_s = (d_upper - d_lower) / n
        d_w = np.bincount(column, value * d_s[text], minlength=len(used)) - ridge * w
        d_cut = np.array([(np.sum(d_lower[grade == k - 1]) - np.sum(d_upper[grade == k])) / n for k in range(1, grades)])
        d_gap = np.array([np.sum(d_cut[k:]) * np.exp(par[len(used) + k]) for k in range(1, grades - 1)])
        g = np.concatenate([d_w, [np.sum(d_cut)], d_gap])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        par += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    weights = np.zeros(WIDTH, np.float32)
    weights[used] = par[: len(used)]
    cuts = par[len(used)] + np.concatenate([[0.0], np.cumsum(np.exp(par[len(used) + 1 :]))])
    return weights, cuts


def _fit(batches):
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return
    table = table.sort_by([("doc_id", "ascending"), ("grade", "ascending")]).combine_chunks()
    grade = table["grade"].to_numpy().astype(np.int64)
    if len(np.unique(grade)) < 2:
        return
    parts, seen = [], 0
    for batch in (b for whole in table.select(["text"]).to_batches() for b in slices(whole, "text")):
        text, feature, value = features(batch.column("text"))
        parts.append(((text + seen).astype(np.int32), feature.astype(np.int32), value))
        seen += batch.num_rows
    weights, cuts = fit_ordinal(*map(np.concatenate, zip(*parts, strict=True)), grade, GRADES)
    yield pa.RecordBatch.from_pydict({"weights": [weights.tobytes()], "cuts": [json.dumps(cuts.tolist())]})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[bytes, list[float]] | None:
    """Weights and thresholds fitted on at most ``sample`` rated documents; None where nothing can be learnt."""
    poor = F.col("quality") == 0
    grade = F.when(poor, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    rated = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id").agg(F.min(grade).cast("long").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(rated), "doc_id")
    found = found.dropDuplicates(["doc_id"]).select("doc_id", "text", "grade")
    models = staged(found.repartition(1).mapInArrow(_fit, "weights binary, cuts string")).collect()
    return (bytes(models[0]["weights"]), json.loads(models[0]["cuts"])) if models else None


def _scorer(weights: np.ndarray, cuts: np.ndarray):
    """Grades of texts; only the texts go to Python, and only grades come back."""

    @F.arrow_udf("struct<expected_grade: double, p_good: double>")
    def score(texts: pa.Array) -> pa.Array:
        grades, good = [np.zeros(0)], [np.zeros(0)]
        for batch in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
            text, feature, value = features(batch.column("text"))
            s = np.bincount(text, value * weights[feature], minlength=batch.num_rows)
            tail = _logistic(s[:, None] - cuts[None, :])
            grades.append(tail.sum(axis=1))
            good.append(tail[:, -1])
        return pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (grades, good)], names=["expected_grade", "p_good"])

    return score


def graded(docs: DataFrame, model: tuple[bytes, list[float]] | None, cut: float = 0.5, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``expected_grade``, ``p_good`` (probability of the top grade) and ``kept`` (p_good >= cut).

    Columns of those names in ``docs`` are replaced.
    """
    names = [c for c in docs.columns if c not in ("expected_grade", "p_good", "kept")]
    if model is None:
        score = F.struct(F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("p_good"))
        kept = F.lit(True)
    else:
        score = _scorer(np.frombuffer(model[0], np.float32), np.array(model[1]))(F.col("text").cast("string"))
        kept = F.col("_graded.p_good") >= cut
    out = docs.select(F.struct("*").alias("_doc"), score.alias("_graded"))  # so no column can clash with ours
    return out.select(
        *[F.col(f"_doc.`{c}`") for c in names if keep_text or c != "text"],
        "_graded.expected_grade", "_graded.p_good", kept.alias("kept"),
    )
