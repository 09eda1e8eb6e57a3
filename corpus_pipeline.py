"""From raw documents to training tokens, one stage after the other.

Each stage takes the rows its predecessor kept. All but the last return the
columns of the documents they are given. Empty tables, null columns and rows
that share an id are handled as the operators' modules say; in addition a
document left without text by line dedup stays, as an empty one, and rows
without an id are never taken for copies of others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pdengine.llm import line_dedup, minhash, mixing, quality, registry, sentencepiece
from pdengine.llm.tables import numbered, staged


#: Bytes of the batches that go to Python: a worker holds a few of them, and two workers share an executor with its heap.
BATCH_BYTES = 8 << 20


def _small_batches(spark: SparkSession) -> None:
    """Bound the batches of this session unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if not now or not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model doesn't reject."""
    _small_batches(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.graded(docs, model).where("kept").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share; ``n_chars`` follows the text."""
    out = line_dedup.drop_common_lines(docs, registry.MIN_DOCS, registry.MIN_POINTS).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies (five words, similarity 0.8).

    Rows that share an id are documents of their own, unless they are equal in all columns.
    """
    _small_batches(spark)
    named = docs.where("doc_id is not null")
    row = F.struct("*").alias("_doc")  # so no column can clash with ours
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = named.select(F.col("doc_id").cast("long").alias("_row"), row)
    else:
        keyed = named.select(F.col("doc_id").cast("long").alias("_id"), mixing.row_key(named).alias("_key"), row)
        rows = numbered(staged(keyed.dropDuplicates(["_key"])), "_id", "_key").withColumnRenamed("_place", "_row")
    texts = rows.select(F.col("_row").alias("doc_id"), F.col("_doc.text").alias("text"))
    copies = minhash.near_duplicates(texts).where("not kept").select(F.col("doc_id").alias("_row"))
    return rows.join(copies, "_row", "left_anti").select("_doc.*").unionByName(docs.where("doc_id is null"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as its source's target asks."""
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids instead of texts."""
    _small_batches(spark)
    return sentencepiece.encoded(docs, registry.PIECE_BPE)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding", token_stage),
]

#: The classifier, the signatures and the token model are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = staged(docs)
    return docs
