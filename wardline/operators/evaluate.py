"""Evaluation of scores and classes from distributed running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from wardline.operators.ordered import exact_percentiles, running_totals
from wardline.sources.schema import CLASSES


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # Windowed over one row per label.
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))))


def curves(df: DataFrame, group: str, score: str, positive: str) -> DataFrame:
    """ROC-AUC and average precision per group.

    ``positive`` is 0/1.  Scores are merged to distinct thresholds with their
    counts, then totalled from the highest score down.
    """
    pos = F.col(positive).cast("long")
    steps = running_totals(df, group, score, {"p": pos, "n": F.lit(1) - pos}, descending=True)
    p, n, cum_p, cum_n = (F.col(c).cast("double") for c in ("p", "n", "cum_p", "cum_n"))
    return steps.groupBy(group).agg(
        F.max("all_p").alias("positives"), F.max("all_n").alias("negatives"),
        # A positive beats every negative below it and half of those level with it.
        F.sum(n * (cum_p - p / 2.0)).alias("_wins"),
        F.sum(p * cum_p / (cum_p + cum_n)).alias("_ap"),
    ).select(
        group, "positives", "negatives",
        F.when((F.col("positives") > 0) & (F.col("negatives") > 0),
               F.col("_wins") / (F.col("positives").cast("double") * F.col("negatives"))).alias("roc_auc"),
        F.when(F.col("positives") > 0, F.col("_ap") / F.col("positives")).alias("pr_auc"))


def score_threshold(df: DataFrame, score: str, contamination: float = 0.02) -> DataFrame:
    """Percentile (1 − contamination) of the scores, as one row."""
    long = df.select(F.lit("all").alias("name"), F.col(score).alias("value"))
    return exact_percentiles(long, "name", "value", [1.0 - contamination]).select(
        F.col("percentile").alias("threshold"))


def binary_report(df: DataFrame, score: str, positive: str, contamination: float = 0.02) -> DataFrame:
    """One row: AUCs, threshold, confusion counts, precision, recall, FPR."""
    cut = score_threshold(df, score, contamination).scalar()
    hit, real = F.col("_hit"), F.col(positive) == 1
    counts = df.withColumn("_cut", cut).withColumn("_hit", F.col(score) >= F.col("_cut")).agg(
        F.max("_cut").alias("threshold"),
        F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"),
        F.count_if(~hit & real).alias("fn"), F.count_if(~hit & ~real).alias("tn"))
    areas = curves(df.withColumn("_g", F.lit("all")), "_g", score, positive).select(
        F.struct("roc_auc", "pr_auc")).scalar()

    def ratio(a, b):
        return F.col(a) / F.greatest(F.col(a) + F.col(b), F.lit(1))

    return counts.withColumn("_a", areas).select(
        F.col("_a.roc_auc").alias("roc_auc"), F.col("_a.pr_auc").alias("pr_auc"), "threshold",
        "tp", "fp", "fn", "tn", ratio("tp", "fp").alias("precision"),
        ratio("tp", "fn").alias("recall"), ratio("fp", "tn").alias("fpr"))


def confusion_counts(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, truth: str, predicted: str,
                     classes: list[str] = CLASSES) -> DataFrame:
    return confusion_counts(df, truth, predicted).groupBy(truth).pivot(
        predicted, classes).agg(F.sum("n")).fillna(0)


def class_report(df: DataFrame, truth: str, predicted: str,
                 classes: list[str] = CLASSES) -> DataFrame:
    """Precision, recall, F1 and support of every class; 0 where undefined."""
    pairs = confusion_counts(df, truth, predicted)
    by_class = pairs.select("n", truth, predicted, F.explode(
        F.array(*[F.lit(c) for c in classes])).alias("class"))
    is_true, is_pred = F.col(truth) == F.col("class"), F.col(predicted) == F.col("class")

    def total(test):
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))

    sums = by_class.groupBy("class").agg(
        total(is_true & is_pred).alias("tp"), total(is_pred).alias("predicted"),
        total(is_true).alias("support"))
    precision = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    return sums.select("class", precision.alias("precision"), recall.alias("recall"), "support").select(
        "class", "precision", "recall",
        F.coalesce(F.try_divide(F.col("precision") * F.col("recall") * 2.0,
                                F.col("precision") + F.col("recall")), F.lit(0.0)).alias("f1"),
        "support")


def one_vs_rest_curves(df: DataFrame, truth: str, probabilities: dict[str, str]) -> DataFrame:
    """Average precision per class from one probability column per class."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("class"), F.col(col).alias("score"),
                 (F.col(truth) == c).cast("int").alias("positive"))
        for c, col in probabilities.items()])))
    return curves(long, "class", "score", "positive")


def multiclass_report(df: DataFrame, truth: str, predicted: str,
                      probabilities: dict[str, str]) -> DataFrame:
    """Per-class table: precision, recall, f1, pr_auc, support."""
    aps = one_vs_rest_curves(df, truth, probabilities).select("class", "pr_auc")
    return (class_report(df, truth, predicted, list(probabilities))
            .join(F.broadcast(aps), "class", "left").fillna(0.0, subset=["pr_auc"]))


def missing_classes(df: DataFrame, label: str = "label", classes: list[str] = CLASSES) -> DataFrame:
    """Expected classes that no row has."""
    expected = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in classes])).alias(label))
    return expected.join(df.select(label).distinct(), label, "left_anti")


def latency_percentiles(timings: DataFrame, column: str) -> DataFrame:
    """p50/p95/p99 of batch timings."""
    long = timings.select(F.lit("all").alias("name"), F.col(column).cast("double").alias("value"))
    wide = exact_percentiles(long, "name", "value", [0.5, 0.95, 0.99])
    return wide.agg(*[F.max(F.when(F.col("prob") == p, F.col("percentile"))).alias(n)
                      for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])
