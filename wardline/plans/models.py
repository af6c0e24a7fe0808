"""Training, persistence and application of the two model layers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.operators import classify as CL
from wardline.operators import evaluate as EV
from wardline.operators import scoring as SC
from wardline.operators.baselines import Baselines, fit_baselines, load_baselines, save_baselines
from wardline.operators.boosting import BoostedClasses
from wardline.operators.features import build_features, feature_matrix
from wardline.operators.hotkeys import DEFAULT, SkewPolicy
from wardline.operators.iforest import SAMPLE, TREES, IsolationForest, fit_forest, with_isolation_score
from wardline.operators.sampling import SEED, stratified_split
from wardline.operators.smote import oversample
from wardline.session import checkpoint
from wardline.sources.schema import FEATURES, NORMAL


@dataclass
class Models:
    baselines: Baselines
    forest: IsolationForest
    classifier: PipelineModel | BoostedClasses

    def save(self, path: str) -> None:
        save_baselines(self.baselines, f"{path}/baselines")
        self.forest.save(f"{path}/iforest")
        if isinstance(self.classifier, BoostedClasses):
            self.classifier.save(self.forest.nodes.sparkSession, f"{path}/classifier")
        else:
            self.classifier.write().overwrite().save(f"{path}/classifier")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Models":
        return Models(load_baselines(spark, f"{path}/baselines"),
                      IsolationForest.load(spark, f"{path}/iforest"),
                      BoostedClasses.load(spark, f"{path}/classifier") or PipelineModel.load(f"{path}/classifier"))


def training_table(log: DataFrame, base: Baselines, policy: SkewPolicy = DEFAULT) -> DataFrame:
    """Features and labels with the split mark, computed once for both layers."""
    matrix = feature_matrix(build_features(log, base, policy=policy), keep=("event_id", "label"))
    return stratified_split(checkpoint(matrix))


def train_anomaly(table: DataFrame, trees: int = TREES, sample: int = SAMPLE,
                  seed: int = SEED) -> tuple[IsolationForest, DataFrame]:
    """Forest on normal training rows, and its report on the held-out rows."""
    normal = table.filter(~F.col("is_test") & (F.col("label") == NORMAL))
    forest = fit_forest(normal, FEATURES, trees=trees, sample=sample, seed=seed)
    held_out = with_isolation_score(table.filter("is_test"), forest).withColumn(
        "attack", (F.col("label") != NORMAL).cast("int"))
    return forest, EV.binary_report(held_out, "decision", "attack")


def train_classes(table: DataFrame, algorithm: str = "forest", trees: int = 100, depth: int = 10,
                  seed: int = SEED, step: float = 0.1) -> tuple[PipelineModel | BoostedClasses, DataFrame]:
    """Classifier on balanced training rows, and its per-class held-out report."""
    balanced = checkpoint(oversample(table.filter(~F.col("is_test")), FEATURES, seed=seed))
    model = CL.fit_classifier(balanced, FEATURES, algorithm=algorithm, trees=trees, depth=depth, seed=seed, step=step)
    judged, columns = CL.probability_columns(CL.classify(table.filter("is_test"), model))
    return model, EV.multiclass_report(judged, "label", "attack_type", columns)


def train(log: DataFrame, policy: SkewPolicy = DEFAULT, forest_trees: int = TREES, class_trees: int = 100,
          depth: int = 10, seed: int = SEED, algorithm: str = "forest") -> tuple[Models, DataFrame, DataFrame]:
    base = fit_baselines(log)
    table = training_table(log, base, policy)
    forest, binary = train_anomaly(table, trees=forest_trees, seed=seed)
    classifier, classes = train_classes(table, algorithm, trees=class_trees, depth=depth, seed=seed)
    return Models(base, forest, classifier), binary, classes


def score_features(rows: DataFrame, models: Models, norm: str = "minmax",
                   min_confidence: float | None = None, gate: bool = False) -> DataFrame:
    """Anomaly score, class, confidence and risk of rows that carry the features.

    ``gate`` lets the classifier name only rows past the forest's offset.
    """
    numeric = rows.withColumns({f"_m_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURES})
    vectors = [f"_m_{c}" for c in FEATURES]
    scored = with_isolation_score(numeric, models.forest.on(vectors))
    if norm == "minmax":
        # The extremes need a pass of their own; keep the forest from running twice.
        scored = SC.minmax_normalised(checkpoint(scored), "decision")
    elif norm == "shift":
        scored = scored.withColumn("anomaly_score", SC.shift_normalised("decision"))
    else:
        raise ValueError(f"unknown normalisation {norm!r}")
    renamed = _on_columns(models.classifier, vectors)
    scored = CL.classify(scored, renamed, min_confidence)
    if gate:
        scored = scored.withColumn("attack_type", F.when(
            F.col("decision") >= 0, F.col("attack_type")).otherwise(NORMAL))
    return scored.withColumn(
        "risk_score", SC.risk_score("anomaly_score", "attack_type", "confidence")).drop(*vectors)


def _on_columns(model: PipelineModel | BoostedClasses, columns: list[str]) -> PipelineModel | BoostedClasses:
    """The same classifier reading its features from other columns."""
    if isinstance(model, BoostedClasses):
        return model.on(columns)
    assembler = model.stages[0].copy().setInputCols(columns)
    return PipelineModel([assembler, *model.stages[1:]])


def score(log: DataFrame, models: Models, norm: str = "minmax", min_confidence: float | None = None,
          stateful: bool = True, gate: bool = False, policy: SkewPolicy = DEFAULT) -> DataFrame:
    """Features, scores and risk of every event of a log."""
    rows = build_features(log, models.baselines, stateful=stateful, policy=policy)
    return score_features(rows, models, norm, min_confidence, gate)
