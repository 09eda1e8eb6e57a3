"""Tables written once in the shared checkpoint folder and read many times.

A staged table cuts lineage the way a checkpoint does, but stays columnar, so
later reads keep column pruning and filter pushdown, and it survives the loss
of executors because nothing of it lives on them. A label that ends in a folder
stands for the files that lie there now: once they change, what was staged
from them is made again.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_staged: dict[tuple[str, str], str] = {}
_objects: dict[tuple[str, str], Any] = {}
_local_roots: dict[str, str] = {}
_scratch = threading.local()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the session; a local one only for local runs."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.getCheckpointDir():
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        app = spark.sparkContext.applicationId
        if app not in _local_roots:
            _local_roots[app] = tempfile.mkdtemp(prefix="pdengine-")
        root = _local_roots[app]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def stage_path(spark: SparkSession, label: str) -> str:
    digest = hashlib.sha1(label.encode()).hexdigest()[:12]
    return f"{checkpoint_root(spark)}/pdengine/{spark.sparkContext.applicationId}/{digest}"


def _marked(spark: SparkSession, label: str) -> str:
    """The label with a mark of the files in the folder it ends in: their names, sizes and times."""
    found = re.search(r"(?:[a-z][a-z0-9+.-]+://|/).*$", label)
    if not found:
        return label
    folder = spark._jvm.org.apache.hadoop.fs.Path(found.group())
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return label
    listed = sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files.listStatus(folder))
    return f"{label}@{hashlib.sha1(repr(listed).encode()).hexdigest()[:12]}"


def stage(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the table staged under ``label``; write it from ``build()`` the first time."""
    label = _marked(spark, label)
    key = (spark.sparkContext.applicationId, label)
    if key not in _staged:
        path = stage_path(spark, label)
        build().write.mode("overwrite").parquet(path)
        _staged[key] = path
    return spark.read.parquet(_staged[key])


def stage_artifact(spark: SparkSession, label: str, save: Callable[[str], None]) -> str:
    """Folder of a saved model; ``save(path)`` runs the first time only."""
    label = _marked(spark, label)
    key = (spark.sparkContext.applicationId, label)
    if key not in _staged:
        path = stage_path(spark, label)
        save(path)
        _staged[key] = path
    return _staged[key]


def staged_object(spark: SparkSession, label: str, build: Callable[[], Any]) -> Any:
    """An object made from something staged under ``label``; it goes when that is released."""
    key = (spark.sparkContext.applicationId, label)
    if key not in _objects:
        _objects[key] = build()
    return _objects[key]


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a part of a staged table that has served its purpose."""
    _delete(spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialised inside are deleted at the end, so results must have been written by then."""
    path = stage_path(spark, f"scratch-{uuid.uuid4().hex}")
    outer, _scratch.path = getattr(_scratch, "path", None), path
    try:
        yield
    finally:
        _scratch.path = outer
        _delete(spark, path)


def materialise(df: DataFrame) -> DataFrame:
    """Write an intermediate table that several later steps read, and read it back."""
    spark = df.sparkSession
    inside = getattr(_scratch, "path", None)
    path = f"{inside}/{uuid.uuid4().hex}" if inside else stage_path(spark, uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Delete everything this application staged."""
    app = spark.sparkContext.applicationId
    _delete(spark, f"{checkpoint_root(spark)}/pdengine/{app}")
    for held in (_staged, _objects):
        for key in [k for k in held if k[0] == app]:
            del held[key]
