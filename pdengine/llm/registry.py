"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pdengine.llm import (
    embedding_dedup, language_model, licenses, line_dedup, merkle, minhash, mixing, neighbours, quality, sentencepiece, sql,
    suffixes, token_counts, whitening,
)

Query = Callable[[SparkSession, str], DataFrame]

#: Public vocabulary files; every operator takes a path.
WORD_BPE, PIECE_BPE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "piece_bpe_32k.model"))
QUERY_EVERY, NEIGHBOURS, SAME = 50, 5, 0.98
MIN_DOCS, MIN_POINTS = 10, 1
REPEAT_BYTES = 200


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"), 3, 85, minhash.BANDS, minhash.ROWS)


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.drop_common_lines(_table(spark, folder, "documents"), MIN_DOCS, MIN_POINTS)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, folder, "documents"), REPEAT_BYTES).drop("kept")


def op4_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    return neighbours.search(vectors.where(F.col("vec_id") % QUERY_EVERY == 0), vectors, NEIGHBOURS)


def op5_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"))


def op6_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece.encoded(_table(spark, folder, "documents").select("doc_id", "text"), PIECE_BPE)


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, folder, "labels"))
    return quality.graded(docs, model, keep_text=False)


def op8_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, folder, "embeddings"), SAME)


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, folder, "documents"), WORD_BPE)


def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(_table(spark, folder, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"])))
    return found.select("doc_id", F.size("matches").alias("n_matches"), F.array_join(names, ",").alias("licences"), "matches")


def op11_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.scores(_table(spark, folder, "documents").select("doc_id", "text"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(_table(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"), whitening.COMPONENTS)


QUERIES: dict[str, Query] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_nearest_vectors": op4_nearest_vectors,
    "op5_mix_sources": op5_mix_sources,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_quality": op7_quality,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_license_scan": op10_license_scan,
    "op11_lm_score": op11_lm_score,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_whitening": op13_whitening,
}
SQL: dict[str, str] = {
    "op1_minhash_dedup": sql.near_duplicates(3, 85),
    "op2_line_dedup": sql.common_lines(MIN_DOCS, MIN_POINTS),
    "op4_nearest_vectors": sql.nearest(QUERY_EVERY, NEIGHBOURS),
    "op5_mix_sources": sql.mixing(1.5, 2.0, mixing.WEIGHTS, mixing.SCHEDULES),
    "op8_embedding_dedup": sql.near_vectors(SAME),
    "op11_lm_score": sql.text_scores(language_model.FOLDS, language_model.HELD, language_model.STEPS),
    "op12_merkle_manifest": sql.merkle(merkle.TAMPERED),
}
