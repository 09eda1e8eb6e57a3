"""The ordinal fit against its definition, and grades of texts worked out one by one."""

import math

import numpy as np
import pyarrow as pa

from pdengine.llm import quality


def likelihood(weights, cuts, x, grade, ridge):
    """Mean log-probability of the grades, less the penalty, from the definition."""
    total = 0.0
    for row, g in zip(x, grade, strict=True):
        tail = [1.0, *[1 / (1 + math.exp(-(row @ weights - c))) for c in cuts], 0.0]
        total += math.log(max(tail[g] - tail[g + 1], 1e-300))
    return total / len(grade) - ridge / 2 * float(weights @ weights)


def test_no_neighbour_is_likelier():
    rng = np.random.default_rng(3)
    n, width, ridge = 150, 4, 1e-2
    x = rng.standard_normal((n, width))
    grade = np.digitize(x @ np.array([1.0, -0.5, 0.0, 0.7]) + rng.logistic(size=n), [-0.7, 0.9])
    text, feature = np.divmod(np.arange(n * width), width)
    weights, cuts = quality.fit_ordinal(text, feature * 7, x.ravel(), grade, 3, steps=4000, rate=0.03, ridge=ridge)
    own = weights[np.arange(width) * 7].astype(float)
    best = likelihood(own, cuts, x, grade, ridge)
    assert cuts[0] < cuts[1] and np.count_nonzero(weights) == width
    for i in range(width + 2):
        for step in (-0.02, 0.02):
            w, c = own.copy(), np.array(cuts)
            if i < width:
                w[i] += step
            else:
                c[i - width] += step
            assert likelihood(w, c, x, grade, ridge) <= best + 1e-6


def test_grades_of_texts_one_by_one(spark):
    rng = np.random.default_rng(4)
    weights, cuts = rng.standard_normal(quality.WIDTH).astype(np.float32), [-0.3, 0.8]
    texts = ["", None, "one two three two", "a\tb\nc", "word " * 400, "é 中文 x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in quality.graded(rows, (weights.tobytes(), cuts)).collect()}
    for i, t in enumerate(texts):
        _, feature, value = quality.features(pa.array([t], pa.string()))
        s = sum(v * float(weights[f]) for f, v in zip(feature.tolist(), value.tolist(), strict=True))
        tail = [1 / (1 + math.exp(-(s - c))) for c in cuts]
        assert math.isclose(got[i].expected_grade, sum(tail), rel_tol=1e-9) and math.isclose(got[i].p_good, tail[-1], rel_tol=1e-9)
        assert got[i].kept == (tail[-1] >= 0.5) and got[i].text == t
