"""Lines that many documents share, by levelled sorted runs of line hashes (operator 2).

A run holds the hashes of the lines of one or more batches, each with the
number of documents that have the line, as a table dealt and sorted by hash
into the same number of buckets as all others. The lines of a new batch are
counted first, one row per line, and merge-anti-joined with the runs, so lines
already known to be common are not added again; what is left is a run of its
own. Runs of one level are merged into one of the next once there are ``fan`` of
them. Bucket by bucket all runs are in the same order, so joins and merges
neither shuffle nor sort them. Everything here is DataFrame functions.

Defined results: a null text is one empty line; a text that loses all lines
becomes empty. Rows that share id and text are one document. Columns of the
input named as a result column are replaced by it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pdengine.llm.tables import ascii_lower, attach, staged
from pdengine.staging import stage_path

BLANK = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
#: 128 bits of a document's id and text.
ROW = ["row", "row2"]
#: Lines of a batch, about; small tables are cut into ``BATCHES`` all the same. Lines of a batch in a bucket, at most:
#: every bucket of a run is a file.
BATCH_LINES, BATCHES, BUCKET_LINES = 1 << 28, 4, 1 << 18


class LineRuns:
    """Runs by level; ``min_docs`` documents make a line common."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, fan: int = 3, buckets: int = 8):
        self.spark, self.min_docs, self.fan, self.buckets = spark, min_docs, fan, buckets
        self.levels: list[list[str]] = []
        # a bucket is one sorted file, and scans of it may say so
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def add(self, lines: DataFrame) -> None:
        """Add a batch of ``h1, h2, row, row2``; all lines of a document must be in one batch."""
        self._push(0, self.unknown(lines.groupBy(*KEY).agg(F.count_distinct(*ROW).alias("n"))))

    def unknown(self, counted: DataFrame) -> DataFrame:
        """Lines, a row each, that no run knows to be common."""
        for runs in self.levels:
            for run in runs:
                known = self.spark.table(run).where(F.col("n") >= self.min_docs).select(*KEY)
                counted = counted.join(known.hint("merge"), KEY, "left_anti")
        return counted

    def _written(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = run.repartition(self.buckets, *KEY).sortWithinPartitions(*KEY)
        writer = dealt.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet")
        writer.option("path", stage_path(self.spark, name)).saveAsTable(name)
        return name

    def _push(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        runs = self.levels[level]
        runs.append(self._written(run))
        if len(runs) >= self.fan:
            self.levels[level] = []
            self._push(level + 1, self.merged(runs))
            self._drop(runs)

    def merged(self, runs: list[str]) -> DataFrame:
        """Sorted runs merged into one, the counts of equal lines added up."""
        out = self.spark.table(runs[0])
        for run in runs[1:]:
            more = self.spark.table(run).select(*KEY, F.col("n").alias("more"))
            both = out.join(more.hint("merge"), KEY, "full_outer")
            out = both.select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))
        return out

    def common(self) -> DataFrame:
        """Lines of ``min_docs`` documents or more: ``h1, h2, n``. The runs are given up."""
        runs = [r for level in self.levels for r in level]
        found = staged(self.merged(runs).where(F.col("n") >= self.min_docs))
        self._drop(runs)
        self.levels = []
        return found

    def _drop(self, runs: list[str]) -> None:
        """Take tables out of the catalog; their files stay with what the application staged."""
        for run in runs:
            self.spark.sql(f"DROP TABLE {run}")


def _hash(line: Column, min_points: int) -> Column:
    """128 bits of a line's key; null if the key is too short to count."""
    key = F.btrim(line, F.lit(BLANK))
    long_enough = F.char_length(key) >= min_points
    return F.when(long_enough, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")))


def drop_common_lines(
    docs: DataFrame, min_docs: int = 10, min_points: int = 1, batches: int | None = None, fan: int = 3
) -> DataFrame:
    """``docs`` with ``text`` less all lines found in ``min_docs`` documents, plus ``n_lines`` and ``n_dropped``.

    Lines are compared stripped of blanks at both ends and with A-Z lower-cased;
    keys of fewer than ``min_points`` code points always stay.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = [F.xxhash64(F.col("doc_id"), text).alias("row"), F.xxhash64(F.lit("second"), F.col("doc_id"), text).alias("row2")]
    keys = F.transform(F.split(ascii_lower(text), "\n"), lambda x: _hash(x, min_points))
    lines = staged(
        docs.select(*row, F.posexplode(keys).alias("pos", "h")).where("h is not null").select(*ROW, "pos", "h.h1", "h.h2")
    )
    n = lines.count()
    batches = batches or max(BATCHES, -(-n // BATCH_LINES))
    runs = LineRuns(docs.sparkSession, min_docs, fan, max(1, -(-n // (batches * BUCKET_LINES))))
    for b in range(batches):
        runs.add(lines.where(F.pmod("row", F.lit(batches)) == b).select(*ROW, *KEY))
    gone = (
        attach(lines.select(*ROW, "pos", *KEY), runs.common(), KEY, "n", ["n"])
        .where("n is not null")
        .groupBy(*ROW)
        .agg(F.collect_set("pos").alias("gone"))
    )
    split = F.split(F.col("_text"), "\n")
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "gone"), lambda i: split[i])
    kept = F.when(F.col("gone").isNull(), F.col("_text")).otherwise(F.array_join(stay, "\n"))
    return (
        docs.select(F.struct("*").alias("_doc"), text.alias("_text"), *row)
        .join(gone, ROW, "left")
        .select(
            *[kept.alias("text") if c == "text" else F.col(f"_doc.`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")],
            F.size(split).cast("long").alias("n_lines"),
            F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        )
    )
