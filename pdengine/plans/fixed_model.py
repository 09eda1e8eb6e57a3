"""A model whose trees and hazards are given, not fitted.

It goes through the same code as a fitted one: stored trees, hazards, train
ranks, isotonic calibration, cuts, explanations. Since any SQL engine can
repeat it, scoring, reasons, what-ifs, stress tests and reports over models are
checked to the last digit. How many train loans reach each node is counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pdengine import fixed_values as fv
from pdengine.operators.boosting import INDEX_COLS, VECTOR_COLS
from pdengine.operators.cox import CoxModel
from pdengine.operators.leafwise import stored_nodes
from pdengine.operators.note_vectors import fit_notes, with_components
from pdengine.plans.training import RiskModel, calibrate
from pdengine.staging import materialise, stage_path

#: Trees as (feature, threshold or categories that go left, left, right); a leaf is half its log odds. Leaves and
#: hazard weights are sums of powers of two, so that scores which are equal on paper are equal in every engine.
TREES = (
    ("months_delinquent", 0.5, ("avg_util_ratio", 0.5, -0.875, -0.375), ("max_delinquency", 2.5, 0.1875, 0.8125)),
    ("segment", ("Agri", "Credit Card", "SME"), ("avg_pay_ratio", 0.25, 0.15625, -0.25), 0.0625),
    ("avg_pay_ratio", 0.5, ("months_delinquent", 1.5, 0.109375, 0.34375), -0.296875),
)
HAZARD = {"months_delinquent": 0.25, "delinquency_trend": 0.125}
BASE_HAZARD = 0.3
#: Values of the categorical features, in the order of their indexes.
LABELS = {"SEX": ["1", "2"], "EDUCATION": ["1", "2", "3", "4"], "MARRIAGE": ["1", "2", "3"], "segment": sorted(fv.SEGMENTS)}


@dataclass
class FixedNode:
    """A node in the order left before right; ``path`` holds (feature, split, goes left) from the root."""

    tree: int
    number: int
    path: tuple
    value: float | None = None
    feature: str | None = None
    split: float | tuple | None = None
    left: int = -1
    right: int = -1


def nodes() -> list[FixedNode]:
    out: list[FixedNode] = []

    def walk(tree: int, spec, path: tuple, count: Iterator[int]) -> int:
        node = FixedNode(tree, next(count), path)
        out.append(node)
        if isinstance(spec, tuple):
            node.feature, node.split, left, right = spec
            node.left = walk(tree, left, (*path, (node.feature, node.split, True)), count)
            node.right = walk(tree, right, (*path, (node.feature, node.split, False)), count)
        else:
            node.value = spec
        return node.number

    for tree, spec in enumerate(TREES):
        walk(tree, spec, (), iter(range(100)))
    return out


def _passes(feature: str, split: float | tuple, left: bool) -> Column:
    goes = F.col(feature).isin(*split) if isinstance(split, tuple) else F.col(feature) <= split
    return goes if left else ~goes


def stored_trees(spark: SparkSession, train: DataFrame) -> PipelineModel:
    """The trees as a scoring pipeline. A leaf counts the train loans that reach it and one more, so none is empty."""
    all_nodes = nodes()
    leaves = [n for n in all_nodes if n.value is not None]
    reached = []
    for n in leaves:
        here = F.lit(True)
        for step in n.path:
            here = here & _passes(*step)
        reached.append(F.count(F.when(here, 1)).alias(f"n{n.tree}_{n.number}"))
    found = train.agg(*reached).first()
    counts = {(n.tree, n.number): found[f"n{n.tree}_{n.number}"] + 1 for n in leaves}
    rows = []
    for n in reversed(all_nodes):  # children before parents
        split = (-1, [], -1)
        if n.value is None:
            counts[n.tree, n.number] = counts[n.tree, n.left] + counts[n.tree, n.right]
            if isinstance(n.split, tuple):
                labels = LABELS[n.feature]
                place = VECTOR_COLS.index(f"{n.feature}_index")
                split = (place, [float(labels.index(v)) for v in sorted(n.split)], len(labels) + 1)
            else:
                split = (VECTOR_COLS.index(n.feature), [float(n.split)], -1)
        size = counts[n.tree, n.number]
        rows.append((n.tree, (n.number, n.value or 0.0, 0.0, [float(size), 0.0, 0.0], size, 1.0 if n.value is None else -1.0, n.left, n.right, split)))
    trees = stored_nodes(spark, rows[::-1], len(VECTOR_COLS), stage_path(spark, f"fixed-trees-{id(rows)}"))
    indexing = StringIndexerModel.from_arrays_of_labels(
        [LABELS[c] for c in fv.CATEGORICAL_FEATURES], inputCols=fv.CATEGORICAL_FEATURES, outputCols=INDEX_COLS, handleInvalid="keep"
    )
    return PipelineModel([indexing, VectorAssembler(inputCols=VECTOR_COLS, outputCol="features", handleInvalid="keep"), trees])


def fixed(book: DataFrame) -> tuple[RiskModel, DataFrame, DataFrame]:
    """The model, the feature book and its scores, as training returns them."""
    spark, in_train = book.sparkSession, F.col("split") == "train"
    text = fit_notes(book.where(in_train))
    features = materialise(with_components(book, text))
    trees = stored_trees(spark, features.where(in_train))
    half = BASE_HAZARD / 2
    cox = CoxModel(
        [f"z_{c}" for c in HAZARD], list(HAZARD.values()), [1.0, 6.0], [half, BASE_HAZARD],
        baseline=spark.createDataFrame([(1.0, half), (6.0, half)], "duration double, hazard double"),
    )
    plain = {f"{k}_{c}": v for c in fv.COX_COVARIATES for k, v in (("mean", 0.0), ("std", 1.0))}
    model = RiskModel(text, trees, cox, plain, None, None, None, float("nan"), float("nan"))
    return model, features, calibrate(model, features, book)
