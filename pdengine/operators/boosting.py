"""Boosted trees on the 47 model features."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from pdengine import fixed_values as fv
from pdengine.operators.leafwise import Growth, boost, stored_model
from pdengine.staging import stage_path

INDEX_COLS = [f"{c}_index" for c in fv.CATEGORICAL_FEATURES]
# Order of the assembled vector; the names are the model features in that order.
ROWS_PER_TASK = 20_000
VECTOR_COLS = fv.NUMERIC_FEATURES + INDEX_COLS + fv.TEXT_FEATURES


def fit_trees(
    rows: DataFrame,
    n_trees: int = 300,
    learning_rate: float = 0.05,
    leaves: int = 31,
    min_leaf: int = 30,
    feature_share: float = 0.8,
    seed: int = 42,
    label: str = "default",
) -> PipelineModel:
    """Leaf-wise trees as a pipeline that scores in the JVM. An unseen category gets an index of its own."""
    spark, given = rows.sparkSession, tree_input(rows, label)
    shaping = Pipeline(stages=[
        StringIndexer(
            inputCols=fv.CATEGORICAL_FEATURES, outputCols=INDEX_COLS,
            handleInvalid="keep", stringOrderType="alphabetAsc",
        ),
        VectorAssembler(inputCols=VECTOR_COLS, outputCol="features", handleInvalid="keep"),
    ]).fit(given)
    places = {c: VECTOR_COLS.index(c) for c in INDEX_COLS}
    categories = {places[c]: len(labels) + 1 for c, labels in zip(INDEX_COLS, shaping.stages[0].labelsArray, strict=True)}
    # the assembled vector's entries as plain columns, so that one of them is read without assembling all
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    shaped = shaping.stages[0].transform(given).select(
        F.array(*[number(c) for c in VECTOR_COLS]).alias("features"), F.col(label).cast("int").alias("label")
    )
    fitted = boost(
        shaped, len(VECTOR_COLS), Growth(leaves, min_leaf, categories=categories), n_trees, learning_rate, feature_share, seed
    )
    trees = stored_model(spark, fitted, len(VECTOR_COLS), stage_path(spark, uuid.uuid4().hex))
    return PipelineModel(stages=[*shaping.stages, trees])


def tree_input(rows: DataFrame, label: str = "default") -> DataFrame:
    """Columns that the trees are fitted on, in as many partitions as the rows are worth."""
    needed = rows.select(label, *fv.NUMERIC_FEATURES, *[F.col(c).cast("string").alias(c) for c in fv.CATEGORICAL_FEATURES], *fv.TEXT_FEATURES)
    return needed.coalesce(max(1, -(-rows.count() // ROWS_PER_TASK)))


def with_probability(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``gbm_proba`` and ``gbm_margin``."""
    text_categories = {c: F.col(c).cast("string") for c in fv.CATEGORICAL_FEATURES}
    scored = model.transform(rows.withColumns(text_categories))
    return scored.select(
        *rows.columns,
        vector_to_array("probability")[1].alias("gbm_proba"),
        vector_to_array("rawPrediction")[1].alias("gbm_margin"),
        vector_to_array("features").alias("feature_values"),
    )


def tree_nodes(spark: SparkSession, model_path: str) -> DataFrame:
    """Nodes of a saved boosting pipeline, with the weight of their tree."""
    folder = f"{model_path}/stages/*_GBTClassif*"
    weights = spark.read.parquet(f"{folder}/treesMetadata").toDF("treeID", "_meta", "weight")
    nodes = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*")
    return nodes.join(F.broadcast(weights.select("treeID", "weight")), "treeID")


def feature_importance(nodes: DataFrame, top_n: int = fv.TOP_IMPORTANCES) -> DataFrame:
    """Share of the summed split gain per feature, largest first."""
    names = F.array(*[F.lit(n) for n in fv.MODEL_FEATURES])
    gains = (
        nodes.where(F.col("leftChild") >= 0)
        .groupBy(F.element_at(names, F.col("split.featureIndex") + 1).alias("feature"))
        .agg(F.sum(F.col("gain") * F.col("rawCount") * F.col("weight")).alias("gain"))
    )
    total = gains.agg(F.sum("gain")).scalar()
    return (
        gains.select(
            "feature",
            (F.col("gain") / total * 100).alias("importance_pct"),
            F.col("feature").isin(fv.TEXT_FEATURES).alias("is_nlp"),
        )
        .orderBy(F.col("importance_pct").desc(), "feature")
        .limit(top_n)
    )
