"""Which features moved a tree ensemble towards a class.

Along a row's path through a tree, the change of the class share at each split
is credited to the split feature.  The credits and the root share add up to the
prediction.  This is path attribution, not Shapley values.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F, types as T

from wardline.operators.classify import class_index
from wardline.session import shared_dir


def tree_nodes(model: PipelineModel, spark) -> DataFrame:
    """Node table of the forest stage: trees x at most 2^(depth+1) rows."""
    path = f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}"
    model.stages[-1].write().save(path)
    n = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), n["leftChild"].alias("left"),
        n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"),
        F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        n["impurityStats"].alias("stats"))


def _packed(nodes: DataFrame):
    table = nodes.orderBy("tree", "node").toPandas()
    first = table.groupby("tree").cumcount().to_numpy() == 0
    starts = np.flatnonzero(first)
    base = np.repeat(starts, np.diff(np.append(starts, len(table))))
    here = np.arange(len(table))
    leaf = table["left"].to_numpy() < 0
    shares = np.stack(table["stats"].to_numpy())
    shares = shares / shares.sum(axis=1, keepdims=True)
    return (starts, np.where(leaf, 0, table["feature"].to_numpy()),
            np.where(leaf, 0.0, table["threshold"].fillna(0.0).to_numpy()),
            np.where(leaf, here, table["left"].to_numpy() + base),
            np.where(leaf, here, table["right"].to_numpy() + base), leaf, shares)


def with_attributions(scored: DataFrame, model: PipelineModel, n_top: int = 4) -> DataFrame:
    """Add ``top_features``: the strongest credits for the predicted class."""
    features = model.stages[0].getInputCols()
    mean = np.array(model.stages[1].mean.toArray())
    std = np.array(model.stages[1].std.toArray())
    std = np.where(std > 0, std, np.inf)      # the scaler maps constants to 0
    shared = scored.sparkSession.sparkContext.broadcast(
        _packed(tree_nodes(model, scored.sparkSession)))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def credits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        starts, feature, threshold, left, right, leaf, shares = shared.value
        for xs, classes in batches:
            if len(xs) == 0:
                yield pd.Series([], dtype=object)
                continue
            x = (np.stack(xs.to_numpy()) - mean) / std
            cls = classes.fillna(0).to_numpy().astype(int)
            out = np.zeros_like(x)
            rows = np.arange(len(x))
            for start in starts:
                at = np.full(len(x), start)
                while not leaf[at].all():
                    f = feature[at]
                    to = np.where(x[rows, f] <= threshold[at], left[at], right[at])
                    np.add.at(out, (rows, f), shares[to, cls] - shares[at, cls])
                    at = to
            yield pd.Series(list(out / len(starts)))

    vector = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    names = F.array(*[F.lit(c) for c in features])
    ranked = F.array_sort(F.transform("_credits", lambda v, i: F.struct(
        (-F.abs(v)).alias("rank"), i.alias("pos"), F.get(names, i).alias("feature"), v.alias("credit"))))
    return (
        scored.withColumn("_credits", credits.asNondeterministic()(vector, class_index("attack_type")))
        .withColumn("top_features", F.transform(F.slice(ranked, 1, n_top), lambda e: F.struct(
            e["feature"].alias("feature"), e["credit"].alias("credit"))))
        .drop("_credits")
    )
