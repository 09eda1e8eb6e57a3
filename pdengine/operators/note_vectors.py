"""Officer notes as vectors, reduced by principal components.

A note's vector is hashed tf-idf, or the tf-idf weighted sum of word vectors
learnt from the notes themselves (``learned=True``), which puts notes close that
say the same in different words. Every width is fixed by a parameter, so what
the driver holds while fitting does not grow with the notes.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import IDF, CountVectorizerModel, HashingTF, Normalizer, RegexTokenizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from pdengine import fixed_values as fv
from pdengine.operators.cooccurrence import word_vectors
from pdengine.operators.covariance import covariance, principal_components
from pdengine.operators.stored_models import projection

NOTE_DIMS = 384
#: Width of learnt word vectors.
WORD_DIMS = 64


def _reduction(rows: DataFrame, input_col: str, components: int) -> list[Transformer]:
    """Centring and projection on the leading components, fitted on ``rows``.

    The components' signs follow a rule, so a refit gives the same columns.
    Components that the vectors don't have are 0.
    """
    centring = StandardScaler(inputCol=input_col, outputCol="note_centred", withMean=True, withStd=False).fit(rows)
    n, _, cov = covariance(rows.select(vector_to_array(input_col).alias("v")), "v")
    axes, shares = principal_components(cov, components)
    wide, full = np.zeros((len(cov), components)), np.zeros(components)
    wide[:, : axes.shape[1]], full[: len(shares)] = axes, shares
    return [centring, projection(rows.sparkSession, wide, full, "note_centred", "note_components")]


def _words() -> RegexTokenizer:
    return RegexTokenizer(inputCol="rm_note", outputCol="note_words", pattern="[^\\p{L}\\p{N}]+")


def fit_notes(
    notes: DataFrame, dims: int = NOTE_DIMS, components: int = fv.N_TEXT_COMPONENTS, learned: bool = False, word_dims: int = WORD_DIMS
) -> PipelineModel:
    """Note vectors and their components, fitted on a column ``rm_note``."""
    notes = notes.select(F.coalesce("rm_note", F.lit("")).alias("rm_note"))
    split = _words().transform(notes)
    if learned:
        names, vectors = word_vectors(split, "note_words", word_dims)
        counting = CountVectorizerModel.from_vocabulary(names or ["-"], inputCol="note_words", outputCol="note_counts")
        vectors = vectors if names else np.zeros((1, word_dims))
    else:
        counting = HashingTF(inputCol="note_words", outputCol="note_counts", numFeatures=dims)
    counted = counting.transform(split)
    weighing = IDF(inputCol="note_counts", outputCol="note_weights").fit(counted)
    stages = [_words(), counting, weighing]
    if learned:
        stages.append(projection(notes.sparkSession, vectors, np.zeros(word_dims), "note_weights", "note_meaning"))
    stages.append(Normalizer(inputCol="note_meaning" if learned else "note_weights", outputCol="note_vector"))
    shaped = notes
    for stage in stages:
        shaped = stage.transform(shaped)
    return PipelineModel([*stages, *_reduction(shaped.select("note_vector"), "note_vector", components)])


def fit_vectors(rows: DataFrame, components: int = fv.N_TEXT_COMPONENTS) -> PipelineModel:
    """Components of notes that already come with a vector ``note_vector``."""
    return PipelineModel(_reduction(rows.select("note_vector"), "note_vector", components))


def as_vector(array_col: str):
    return array_to_vector(F.col(array_col).cast("array<double>"))


def with_components(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``nlp_emb_0`` onwards; a missing note counts as an empty one."""
    if "rm_note" in rows.columns:
        rows = rows.withColumn("rm_note", F.coalesce("rm_note", F.lit("")))
    done = model.transform(rows).withColumn("_parts", vector_to_array("note_components"))
    names = [f"nlp_emb_{i}" for i in range(model.stages[-1].getK())]
    return done.select(*rows.columns, *[F.col("_parts")[i].alias(n) for i, n in enumerate(names)])
