"""Events that come too late are set aside and counted, not lost.

Before a stream with state drops what is behind its watermark, this step takes
every micro-batch apart: rows at most ``delay`` behind the newest event of the
batches before go on, the others are counted by the hour they belong to and
kept.  Both go to a partition of the batch, and the newest event time to a
document of the batch, so a repeated batch gives the same parts.  Rows on time
plus late rows are the rows read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wardline.sources.stores import read_document, write_document


def split_batch(batch: DataFrame, newest_us: int | None, delay_us: int) -> tuple[DataFrame, DataFrame]:
    """Rows on time and late rows; without a time a row is late."""
    us = F.unix_micros("timestamp")
    on_time = us.isNotNull() if newest_us is None else F.coalesce(us >= newest_us - delay_us, F.lit(False))
    return batch.filter(on_time), batch.filter(~on_time)


def start_split(events: DataFrame, path: str, state_path: str, delay_minutes: float = 10.0, available_now: bool = False) -> StreamingQuery:
    """Deal the stream out to ``path``/on_time and ``path``/late."""
    delay_us = int(delay_minutes * 60_000_000)

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = read_document(spark, f"{path}/newest/{batch_id - 1}", "newest bigint", {"newest": None}).first()["newest"]
        batch = batch.persist()
        on_time, late = split_batch(batch, before, delay_us)
        for name, rows in (("on_time", on_time), ("late", late)):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        newest = batch.agg(F.greatest(F.max(F.unix_micros("timestamp")), F.lit(before).cast("bigint")).alias("newest"))
        write_document(newest, f"{path}/newest/{batch_id}")
        batch.unpersist()

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", state_path)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_part(spark: SparkSession, path: str, name: str, schema) -> DataFrame:
    return spark.read.schema(f"{schema.toDDL()}, batch bigint").parquet(f"{path}/{name}")


def counts_by_hour(rows: DataFrame) -> DataFrame:
    """(hour, n), the hour of rows without a time null."""
    return rows.groupBy(F.date_trunc("hour", "timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
