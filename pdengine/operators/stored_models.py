"""Models worked out here, written in the layout that Spark reads, so that they transform in the JVM and persist."""

from __future__ import annotations

import json
import time
import uuid

import numpy as np
from pyspark.ml.feature import PCAModel
from pyspark.ml.linalg import DenseMatrix, DenseVector, MatrixUDT, VectorUDT
from pyspark.sql import SparkSession, types as T

from pdengine.staging import stage_path


def metadata(spark: SparkSession, kind: str, uid: str, params: dict, defaults: dict, **more) -> str:
    """The one line that names a stored model's class and parameters."""
    return json.dumps({
        "class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
        "uid": uid, "paramMap": params, "defaultParamMap": defaults, **more,
    })


def write_metadata(spark: SparkSession, line: str, path: str) -> None:
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def projection(spark: SparkSession, axes: np.ndarray, shares: np.ndarray, input_col: str, output_col: str) -> PCAModel:
    """A model that multiplies a vector column by ``axes`` (one direction per column)."""
    uid, path = f"PCA_{uuid.uuid4().hex[:12]}", stage_path(spark, uuid.uuid4().hex)
    schema = T.StructType([T.StructField("pc", MatrixUDT()), T.StructField("explainedVariance", VectorUDT())])
    matrix = DenseMatrix(axes.shape[0], axes.shape[1], np.asfortranarray(axes).ravel(order="F").tolist())
    spark.createDataFrame([(matrix, DenseVector(shares))], schema).coalesce(1).write.parquet(f"{path}/data")
    params = {"inputCol": input_col, "outputCol": output_col, "k": int(axes.shape[1])}
    write_metadata(spark, metadata(spark, "feature.PCAModel", uid, params, {"outputCol": f"{uid}__output"}), path)
    return PCAModel.load(path)
