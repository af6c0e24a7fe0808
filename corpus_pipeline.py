"""The corpus pipeline: stages that each apply one text operator to what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.llm import chosen_path, importance, line_join, packing, winnow
from wardline.llm.common import numbered, table
from wardline.llm.queries import tokenizer_path
from wardline.session import shared_dir, use_utc
from wardline.sources.stores import fresh_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling towards good labelled ones selects."""
    return importance.accepted(docs, importance.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those of which nothing is left go."""
    kept = line_join.without_repeats(docs)
    changed = F.col("__lines.n_removed") > 0
    kept = kept.filter(~(changed & ~F.col("text").rlike(r"\S")))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.drop("__lines")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near duplicates."""
    return chosen_path.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    hit = winnow.contamination(docs, table(spark, sf_dir, "benchmark")).filter("n_hit > 0").select("row")
    whole = numbered(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return whole.join(hit, "row", "left_anti").select("doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in training sequences."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("packing", packed)]

# No SQL: classifier, joins by chosen paths and packing are not expressible in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each writes Parquet to the shared folder, which the next one reads."""
    use_utc(spark)
    root = fresh_dir(shared_dir(spark), "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
