"""Running totals over a global order without a single-partition sort.

Values are first merged to distinct ones, then cut into ranges by splitters
taken from a mergeable sketch.  Totals run inside each range and the (few)
range totals are added as offsets.  Results are exact: the sketch only decides
where ranges are cut.  KS gaps, ROC/PR curves and exact percentiles use it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wardline.session import checkpoint

RANGES = 64


def _splitters(totals: DataFrame, group: str, value: str, ranges: int) -> str:
    probs = [i / ranges for i in range(1, ranges)]
    # At most `ranges` numbers for each group; groups are measure or class names.
    rows = totals.groupBy(group).agg(
        F.percentile_approx(value, probs, 2000).alias("cuts")).collect()
    return json.dumps({str(r[group]): sorted({float(c) for c in r["cuts"] or []}) for r in rows})


def running_totals(df: DataFrame, group: str, value: str, weights: dict[str, Column],
                   descending: bool = False, ranges: int = RANGES) -> DataFrame:
    """One row per (group, distinct value) with cumulative ``weights``.

    ``group`` must have few distinct values (feature or class names).  For each
    weight ``w`` the result has ``w`` (total at the value), ``cum_w`` (total up
    to and including it in the chosen order) and ``all_w`` (total of the group).
    """
    names = list(weights)
    # The only pass over the input; everything after reads the merged values.
    totals = checkpoint(
        df.groupBy(group, value).agg(*[F.sum(c).alias(n) for n, c in weights.items()]))
    # A constant map of group name to cut points, so every branch of the plan
    # assigns the same range to a value.
    cuts = F.from_json(F.lit(_splitters(totals, group, value, ranges)), "map<string,array<double>>")
    points = F.element_at(cuts, F.col(group).cast("string"))
    bucket = F.coalesce(F.size(F.filter(points, lambda p: p < F.col(value))), F.lit(0))
    bucketed = totals.withColumn("_b", -bucket if descending else bucket)
    order = F.desc(value) if descending else F.asc(value)
    inside = W.partitionBy(group, "_b").orderBy(order)
    whole = W.partitionBy(group)
    across = whole.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = bucketed.groupBy(group, "_b").agg(*[F.sum(n).alias(n) for n in names]).select(
        group, "_b", *[F.coalesce(F.sum(n).over(across), F.lit(0)).alias(f"_off_{n}") for n in names],
        *[F.sum(n).over(whole).alias(f"all_{n}") for n in names])
    # One offset row per range: at most ranges x groups rows.
    return (
        bucketed.withColumns({
            f"cum_{n}": F.sum(n).over(inside.rowsBetween(W.unboundedPreceding, 0)) for n in names})
        .join(F.broadcast(offsets), [group, "_b"])
        .select(group, value, *names,
                *[(F.col(f"cum_{n}") + F.col(f"_off_{n}")).alias(f"cum_{n}") for n in names],
                *[f"all_{n}" for n in names])
    )


def unpivot(df: DataFrame, columns: list[str], keep: list[str] | None = None,
            name: str = "name", value: str = "value") -> DataFrame:
    """Long form of numeric columns as doubles."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    return df.select(*(keep or []), F.inline(pairs))


def exact_percentiles(long: DataFrame, group: str, value: str, probs: list[float]) -> DataFrame:
    """Exact percentiles with linear interpolation: (group, prob, percentile)."""
    ranked = running_totals(long.filter(F.col(value).isNotNull()), group, value, {"n": F.lit(1)})
    targets = ranked.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumn(
        "_h", F.col("prob") * (F.col("all_n") - 1))
    return (
        targets.groupBy(group, "prob")
        .agg(F.max("_h").alias("_h"),
             F.min(F.when(F.col("cum_n") > F.floor("_h"), F.col(value))).alias("_lo"),
             F.min(F.when(F.col("cum_n") > F.ceil("_h"), F.col(value))).alias("_hi"))
        .select(group, "prob", (
            F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_h") - F.floor("_h"))
        ).alias("percentile"))
    )
