"""Training end to end: text, trees, hazards, ranks, calibration, evaluation, artifacts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from pdengine import fixed_values as fv
from pdengine.functions.bands import band
from pdengine.operators.boosting import feature_importance, fit_trees, tree_nodes, with_probability
from pdengine.operators.calibration import apply_isotonic, fit_isotonic
from pdengine.operators.cox import CoxModel, fit_cox
from pdengine.operators.note_vectors import NOTE_DIMS, fit_notes, with_components
from pdengine.operators.placed_reference import PlacedReference
from pdengine.operators.scaling import column_stats, zscore
from pdengine.operators.tree_contributions import Explainer
from pdengine.plans import reports
from pdengine.plans.fusion import band_cuts, rank_and_blend, reference_distribution
from pdengine.plans.explore import category_modes
from pdengine.sources.store import read_document, write_document
from pdengine.staging import checkpoint_root, materialise, staged_object


@dataclass(frozen=True)
class TrainingConfig:
    n_trees: int = 300
    learning_rate: float = 0.05
    leaves: int = 31
    min_leaf: int = 30
    feature_share: float = 0.8
    seed: int = 42
    cox_penalizer: float = 0.1
    note_dims: int = NOTE_DIMS
    learned_notes: bool = False
    label: str = "default"


@dataclass
class RiskModel:
    """Everything scoring needs. References and category modes are tables, never driver arrays."""

    text: PipelineModel
    trees: PipelineModel
    cox: CoxModel
    cox_stats: dict[str, float]
    isotonic: IsotonicRegressionModel
    references: PlacedReference
    modes: DataFrame
    high_cut: float
    elevated_cut: float
    path: str | None = None

    def raw_scores(self, features: DataFrame) -> DataFrame:
        """Tree probability and hazard risk; a projection, no shuffle."""
        scored = zscore(with_probability(features, self.trees), fv.COX_COVARIATES, self.cox_stats)
        return scored.withColumn("cox_risk", self.cox.risk())

    def save(self, spark: SparkSession, path: str) -> None:
        self.text.write().overwrite().save(f"{path}/text")
        self.trees.write().overwrite().save(f"{path}/trees")
        self.isotonic.write().overwrite().save(f"{path}/isotonic")
        self.references.save(f"{path}/references")
        self.modes.write.mode("overwrite").parquet(f"{path}/modes")
        self.cox.baseline.write.mode("overwrite").parquet(f"{path}/baseline")
        write_document(spark, self.config(), f"{path}/config")
        self.path = path

    def config(self) -> dict:
        return {
            "numeric_features": fv.NUMERIC_FEATURES,
            "categorical_features": fv.CATEGORICAL_FEATURES,
            "nlp_features": fv.TEXT_FEATURES,
            "cox_covariates": fv.COX_COVARIATES,
            "gbm_blend_weight": fv.GBM_WEIGHT,
            "cox_blend_weight": fv.COX_WEIGHT,
            "cox_horizon_duration": self.cox.horizon,
            "band_thresholds": {"high": self.high_cut, "elevated": self.elevated_cut},
            "cox": self.cox.document(),
            "cox_scaler": self.cox_stats,
        }

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "RiskModel":
        config = read_document(spark, f"{path}/config")
        return cls(
            PipelineModel.load(f"{path}/text"),
            PipelineModel.load(f"{path}/trees"),
            CoxModel(**config["cox"], baseline=spark.read.parquet(f"{path}/baseline")),
            config["cox_scaler"],
            IsotonicRegressionModel.load(f"{path}/isotonic"),
            PlacedReference.load(spark, f"{path}/references"),
            spark.read.parquet(f"{path}/modes"),
            config["band_thresholds"]["high"],
            config["band_thresholds"]["elevated"],
            path,
        )

    def nodes(self, spark: SparkSession) -> DataFrame:
        return tree_nodes(spark, f"{self.path}/trees")

    def explainer(self, spark: SparkSession) -> Explainer:
        """The packed trees, made once per model and application."""
        return staged_object(spark, f"explainer:{self.path}", lambda: Explainer.of(self.nodes(spark)))

    def importance(self, spark: SparkSession) -> DataFrame:
        return feature_importance(self.nodes(spark))


def fuse(model: RiskModel, raw: DataFrame, key: str) -> DataFrame:
    """Ranks, blend, calibration, score and band of narrow rows with both raw scores."""
    blended = rank_and_blend(raw, model.references, "gbm_proba", "cox_risk", key)
    scored = apply_isotonic(blended, "blend", model.isotonic)
    return banded_by(model, scored.withColumn("pd_score", F.col("calibrated") * 100))


def banded_by(model: RiskModel, scored: DataFrame) -> DataFrame:
    cut = band(F.col("pd_score"), F.lit(model.high_cut), F.lit(model.elevated_cut))
    return scored.withColumn("band", cut)


def train(
    book: DataFrame, config: TrainingConfig = TrainingConfig(), keep: Callable[[DataFrame], DataFrame] = materialise
) -> tuple[RiskModel, DataFrame, DataFrame]:
    """Fit on the train split; returns the model, the feature book and the fused scores.

    ``book`` is read several times: pass a staged table. Each estimator is a
    boundary where Spark jobs run; what is written in between are the feature
    book, by ``keep``, which writes it and reads it back, and one narrow row of
    scores per loan.
    """
    spark = book.sparkSession
    checkpoint_root(spark)
    in_train = F.col("split") == "train"
    text = fit_notes(book.where(in_train).select("rm_note"), config.note_dims, learned=config.learned_notes)
    features = keep(with_components(book, text))
    train_rows = features.where(in_train)

    trees = fit_trees(
        train_rows, config.n_trees, config.learning_rate, config.leaves, config.min_leaf, config.feature_share, config.seed, config.label
    )

    stats = {k: float(v) for k, v in column_stats(train_rows, fv.COX_COVARIATES).first().asDict().items()}
    z_names = [f"z_{c}" for c in fv.COX_COVARIATES]
    survival = materialise(
        zscore(train_rows, fv.COX_COVARIATES, stats).select("duration", "event", *z_names)
    )
    cox = fit_cox(survival, z_names, penalizer=config.cox_penalizer)

    model = RiskModel(text, trees, cox, stats, None, None, None, float("nan"), float("nan"))
    return model, features, calibrate(model, features, book)


def calibrate(model: RiskModel, features: DataFrame, book: DataFrame) -> DataFrame:
    """Give a model with trees and hazards its ranks, calibration and cuts from the train split; returns all scores."""
    in_train = F.col("split") == "train"
    raw = materialise(
        model.raw_scores(features).select("borrower_id", "split", "default", "gbm_proba", "cox_risk")
    )
    model.references = reference_distribution(raw.where(in_train), "gbm_proba", "cox_risk")
    model.modes = materialise(category_modes(book))
    blended = materialise(rank_and_blend(raw, model.references, "gbm_proba", "cox_risk"))
    model.isotonic = fit_isotonic(blended.where(in_train), "blend", "default")
    scored = materialise(
        apply_isotonic(blended, "blend", model.isotonic).withColumn("pd_score", F.col("calibrated") * 100)
    )
    cuts = band_cuts(scored.where(in_train)).first()
    model.high_cut, model.elevated_cut = float(cuts.high), float(cuts.elevated)
    return banded_by(model, scored)


def evaluate(scored: DataFrame) -> DataFrame:
    """Out-of-time quality of fused scores, as report rows."""
    return reports.performance_report(scored)
