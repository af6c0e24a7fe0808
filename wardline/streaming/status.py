"""Live alert counts that follow feedback.

Alerts and feedback arrive in one stream of changes, in any order.  Keyed state
holds what is known of each alert: its class and its latest verdict.  When that
changes what the alert counts as, the old count is taken back and the new one
given: rows of -1 and +1.  Alerts share state in a fixed number of groups, as a
call for each alert costs far more than its rows.  Each micro-batch stores its sums in a partition of
its own, so a repeated batch replaces them, and the counts are the sum of all.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from wardline.session import ROCKSDB_PROVIDER
from wardline.sources.stores import read_table

CHANGES = "alert_id string, attack_type string, action string, feedback_id bigint, at_us bigint"
COUNTS = T.StructType([T.StructField("attack_type", T.StringType()), T.StructField("status", T.StringType()), T.StructField("n", T.LongType())])
#: Groups of alerts that share a call and its state; more of them rewrite less state per change.
GROUPS = 1 << 11
# What a verdict makes of an alert.
STATUS_OF = {"confirm": "confirmed", "dismiss": "dismissed"}


def alert_changes(alerts: DataFrame) -> DataFrame:
    return alerts.select(F.col("id").alias("alert_id"), "attack_type", F.lit(None).cast("string").alias("action"),
                         F.lit(None).cast("bigint").alias("feedback_id"), F.lit(None).cast("bigint").alias("at_us"))


def feedback_changes(feedback: DataFrame) -> DataFrame:
    return feedback.select("alert_id", F.lit(None).cast("string").alias("attack_type"), "action", F.col("id").alias("feedback_id"),
                           F.unix_micros("created_at").alias("at_us"))


class AlertStatus(StatefulProcessor):
    """Alerts of a group: their classes, latest verdicts with time and id, and the statuses they are counted under.

    One call serves all of a group's alerts and reads and writes their state once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alerts", T.StructType([T.StructField("alerts", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        alerts = json.loads(self.state.get()[0]) if self.state.exists() else {}
        touched = set()
        for batch in rows:
            columns = [batch[c].tolist() for c in ("alert_id", "attack_type", "action", "feedback_id", "at_us")]
            for alert, attack_type, action, feedback_id, at_us in zip(*columns):
                kind, status, at, number, counted = alerts.get(alert) or (None, "open", -1, -1, None)
                if attack_type is not None and kind is None:  # an alert's first row wins
                    kind = attack_type
                if action in STATUS_OF and (int(at_us), int(feedback_id)) > (at, number):
                    status, at, number = STATUS_OF[action], int(at_us), int(feedback_id)
                alerts[alert] = kind, status, at, number, counted
                touched.add(alert)
        changes = []
        for alert in touched:
            kind, status, at, number, counted = alerts[alert]
            if kind is not None and counted != status:
                changes += [(kind, counted, -1)] * (counted is not None) + [(kind, status, 1)]
                alerts[alert] = kind, status, at, number, status
        self.state.update((json.dumps(alerts, separators=(",", ":")),))
        yield pd.DataFrame(changes, columns=["attack_type", "status", "n"])

    def close(self) -> None:
        pass


def status_changes(changes: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(attack_type, status, n): what is taken back (-1) and given (+1).

    ``groups`` must stay the same for the life of a checkpoint.
    """
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    # Without nulls the numbers stay whole: pandas would make them floats.
    rows = changes.filter(F.col("alert_id").isNotNull()).withColumns({
        **{c: F.coalesce(c, F.lit(-1)) for c in ("feedback_id", "at_us")}, "group": F.pmod(F.xxhash64("alert_id"), F.lit(groups))})
    return rows.groupBy("group").transformWithStateInPandas(AlertStatus(), COUNTS, "Append", "None")


def start_counts(changes: DataFrame, path: str, state_path: str, available_now: bool = False) -> StreamingQuery:
    """Keep the sums of the changes of every micro-batch under ``path``."""
    def each(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy("attack_type", "status").agg(F.sum("n").alias("n"))  # classes x statuses
        sums.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = status_changes(changes).writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", state_path)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def live_counts(spark: SparkSession, path: str) -> DataFrame:
    """Alerts by class and status as of the last stored batch."""
    return (read_table(spark, path, COUNTS).groupBy("attack_type", "status").agg(F.sum("n").alias("n")).filter("n <> 0"))


def live_kpis(spark: SparkSession, path: str) -> DataFrame:
    """One row, as ``alerts.kpis`` counts it from all alerts and feedback."""
    def total(test):
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))

    status = F.col("status")
    return live_counts(spark, path).agg(total(F.lit(True)).alias("total"), *[
        total(status == s).alias(s) for s in ("open", *STATUS_OF.values())])
