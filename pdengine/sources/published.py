"""Tables that are replaced as a whole.

A published table is a folder of versions and a folder of numbered manifests. A
new version is written beside the old ones; only when it is complete is its
manifest moved into place, under the next number. Readers take the version
that the highest manifest names and so see the old table or the new one, never
a mixture; a job that fails before the move leaves no trace for them. Of two
jobs that publish at once the later one to finish is seen last.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

#: Versions that stay for readers who began before the last move.
KEPT = 2


@dataclass(frozen=True)
class Version:
    """What a manifest says of the version it names."""

    number: int
    folder: str
    published_at: float
    n_rows: int


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, root: str) -> list[Version]:
    """Published versions, the current one last; none if the folder is no published table."""
    files, path = _files(spark, root)
    manifests = path(f"{root}/manifests")
    if not files.exists(manifests):
        return []
    names = sorted(s.getPath().getName() for s in files.listStatus(manifests) if s.getPath().getName().endswith(".json"))
    return [Version(**json.loads(spark.read.text(f"{root}/manifests/{n}").first().value)) for n in names[-KEPT:]]


def publish(rows: DataFrame, root: str, published_at: float, write=None) -> Version:
    """Write ``rows`` as the next version and switch readers over to it.

    ``write(rows, folder)`` may lay the table out; plain Parquet otherwise.
    """
    spark = rows.sparkSession
    files, path = _files(spark, root)
    folder = f"versions/{uuid.uuid4().hex}"
    (write or (lambda r, f: r.write.parquet(f)))(rows, f"{root}/{folder}")
    n_rows = spark.read.parquet(f"{root}/{folder}").count()
    files.mkdirs(path(f"{root}/manifests"))
    while True:
        known = versions(spark, root)
        version = Version(known[-1].number + 1 if known else 1, folder, float(published_at), n_rows)
        name = f"{root}/manifests/{version.number:012d}.json"
        draft = path(f"{root}/drafts/{uuid.uuid4().hex}")
        out = files.create(draft)
        out.write(bytearray(json.dumps(asdict(version)).encode()))
        out.close()
        if not files.exists(path(name)) and files.rename(draft, path(name)):
            break
        files.delete(draft, False)  # another job took the number: take the next
    for old in _superseded(spark, root):
        files.delete(path(f"{root}/{old.folder}"), True)
        files.delete(path(f"{root}/manifests/{old.number:012d}.json"), False)
    return version


def _superseded(spark: SparkSession, root: str) -> list[Version]:
    files, path = _files(spark, root)
    names = sorted(s.getPath().getName() for s in files.listStatus(path(f"{root}/manifests")) if s.getPath().getName().endswith(".json"))
    return [Version(**json.loads(spark.read.text(f"{root}/manifests/{n}").first().value)) for n in names[:-KEPT]]


def current(spark: SparkSession, root: str) -> Version | None:
    known = versions(spark, root)
    return known[-1] if known else None


def folder_of(spark: SparkSession, root: str) -> str:
    """Where to read a table: its current version, or the folder itself if it isn't published."""
    version = current(spark, root)
    return f"{root}/{version.folder}" if version else root
