"""Attack classes with Spark ML trees."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from wardline.operators.boosting import BoostedClasses, fit_boosted, with_probabilities
from wardline.operators.sampling import SEED
from wardline.operators.scoring import apply_confidence_floor
from wardline.sources.schema import CLASSES


def class_index(label) -> Column:
    """Position in the sorted class list, null for an unknown label."""
    at = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col(label))
    return F.when(at > 0, (at - 1).cast("double"))


def class_name(index: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in CLASSES]), index.cast("int"))


def scaled_stages(features: list[str]) -> list:
    return [
        VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
    ]


def fit_classifier(train: DataFrame, features: list[str], label: str = "label",
                   algorithm: str = "forest", trees: int = 100, depth: int = 10,
                   weight_col: str | None = None, seed: int = SEED, step: float = 0.1) -> PipelineModel | BoostedClasses:
    """'forest': native multi-class.  'softmax': boosted trees of all classes together, ``trees``
    rounds.  'boosted': one boosted model per class."""
    if algorithm == "softmax":
        if weight_col:
            raise ValueError("softmax boosting takes no weights")
        return fit_boosted(train, features, label, rounds=trees, depth=depth, step=step, seed=seed)
    rows = train.withColumn("_y", class_index(label))
    if algorithm == "forest":
        learner = RandomForestClassifier(
            featuresCol="features", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed,
            maxMemoryInMB=1024)
        if weight_col:
            learner = learner.setWeightCol(weight_col)
    elif algorithm == "boosted":
        learner = OneVsRest(
            classifier=GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=step,
                                     subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed),
            featuresCol="features", labelCol="_y")
    else:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    return Pipeline(stages=[*scaled_stages(features), learner]).fit(rows)


def classify(df: DataFrame, model: PipelineModel | BoostedClasses, min_confidence: float | None = None) -> DataFrame:
    """Add ``probabilities`` (class order), ``attack_type`` and ``confidence``."""
    if isinstance(model, BoostedClasses):
        return apply_confidence_floor(_named(with_probabilities(df, model)), min_confidence)
    rows = df.fillna(0.0, subset=[c for c in model.stages[0].getInputCols() if c in df.columns])
    out = model.transform(rows)
    if "probability" in out.columns:
        out = out.withColumn("probabilities", vector_to_array("probability"))
    else:
        # One-vs-rest gives margins only: turn them into shares that add up to 1.
        margins = vector_to_array("rawPrediction")
        powers = F.transform(margins, lambda m: F.exp(m - F.array_max(margins)))
        total = F.aggregate("_e", F.lit(0.0), lambda a, e: a + e)
        out = out.withColumn("_e", powers).withColumn(
            "probabilities", F.transform("_e", lambda e: e / total)).drop("_e")
    out = _named(out).drop("_raw", "features", "rawPrediction", "probability", "prediction")
    return apply_confidence_floor(out, min_confidence)


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("confidence", F.array_max("probabilities")).withColumn(
        "attack_type", class_name(F.array_position("probabilities", F.col("confidence")) - 1))


def probability_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    names = {c: f"p_{c}" for c in CLASSES}
    return df.withColumns({p: F.get("probabilities", F.lit(i)) for i, p in enumerate(names.values())}), names
