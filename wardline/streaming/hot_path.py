"""Live scoring: source, deduplication, scoring, alert sink and KPIs."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wardline.operators import scoring as SC
from wardline.operators.features import build_features, features_from_context
from wardline.plans.models import Models, score_features
from wardline.sources import stores
from wardline.sources.schema import LIVE_EVENT
from wardline.streaming import latency
from wardline.streaming.state import with_live_context

WATERMARK = "10 minutes"
ALL_FILES = 2**31 - 1  # all new files in one micro-batch


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1000,
                schema=LIVE_EVENT) -> DataFrame:
    """Files that land in a folder."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def read_kafka(spark: SparkSession, servers: str, topic: str, per_trigger: int = 5_000_000) -> DataFrame:
    """JSON events from Kafka; needs the connector on the class path."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).option("maxOffsetsPerTrigger", per_trigger).load())
    return raw.select(F.from_json(F.col("value").cast("string"), LIVE_EVENT).alias("e")).select("e.*")


def prepared(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Defaults for missing ids and roles, then one row per event id.

    A missing id is derived from the content, so a replayed batch repeats it.
    """
    content = F.sha2(F.to_json(F.struct(*[c for c in events.columns if c != "event_id"])), 256)
    return (
        events.withColumns({"event_id": F.coalesce("event_id", content),
                            "role": F.coalesce("role", F.lit("standard"))})
        .withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["event_id"])
    )


def score_batch(rows: DataFrame, models: Models, stateful: bool = True) -> DataFrame:
    """Scores of one micro-batch; stateful rows bring their context columns."""
    feats = (features_from_context(rows, models.baselines) if stateful
             else build_features(rows, models.baselines, stateful=False))
    return score_features(feats, models, norm="shift", min_confidence=SC.MIN_CONFIDENCE)


def process_batch(rows: DataFrame, models: Models, alert_path: str, batch: str,
                  stateful: bool = False) -> dict:
    """Score given rows, store their alerts, report counts and elapsed time."""
    started = time.time()
    created = stores.append_alerts(
        SC.alert_rows(score_batch(rows, models, stateful)), alert_path, batch, pruned=True)
    return {"events": rows.count(), "alerts_created": created,
            "elapsed_ms": round((time.time() - started) * 1000, 1)}


def start_scoring(events: DataFrame, model_path: str, alert_path: str, state_path: str,
                  stateful: bool = True, available_now: bool = False,
                  watermark: str = WATERMARK, latency_path: str | None = None) -> StreamingQuery:
    """Continuous scoring; models are read again for each batch, so a newly
    trained version is picked up without a restart.

    With ``latency_path``, sketches of how long events waited for their scores
    are kept there; every event waits for the whole of its micro-batch.
    """
    rows = prepared(events, watermark)
    if stateful:
        rows = with_live_context(rows, expire=not available_now)

    def each(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        models = Models.load(batch.sparkSession, model_path)
        done = process_batch(batch.persist(), models, alert_path, f"live-{batch_id:012d}", stateful)
        if latency_path:
            latency.store(batch, latency_path, batch_id, F.lit("score_ms"), F.lit(done["elapsed_ms"]))
        batch.unpersist()

    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", state_path)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def alert_stream(spark: SparkSession, alert_path: str) -> DataFrame:
    """New alerts as they are stored; start with ``alerts.newest`` for a snapshot."""
    return (spark.readStream.schema(stores.ALERTS).option("recursiveFileLookup", "true")
            .parquet(alert_path))


def live_kpis(alerts: DataFrame) -> DataFrame:
    """Alert counts by class and status, for update or complete mode."""
    return alerts.groupBy("attack_type", "status").agg(F.count(F.lit(1)).alias("n"))


def failure_rates(events: DataFrame, window: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """Failure share per tumbling window."""
    return (events.withWatermark("timestamp", watermark).groupBy(F.window("timestamp", window))
            .agg(F.count(F.lit(1)).alias("events"), F.count_if(~F.col("success")).alias("failures"))
            .withColumn("failure_rate", F.col("failures") / F.col("events")))


def user_sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Activity sessions of each user, split by a gap."""
    return (events.withWatermark("timestamp", watermark)
            .groupBy("user_id", F.session_window("timestamp", gap))
            .agg(F.count(F.lit(1)).alias("events"), F.count_if(~F.col("success")).alias("failures")))
