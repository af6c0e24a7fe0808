"""Session helpers: a tuned local session and reliable checkpoints."""

from __future__ import annotations

import tempfile

from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings that hold on a laptop and on a cluster alike; sizes (executors,
# shuffle partitions, memory) stay with the deployment.
COMMON_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoint files go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def local_session(app: str = "wardline", cores: str | int = "*", memory: str = "8g",
                  shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    )
    for key, value in COMMON_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_utc(spark: SparkSession) -> SparkSession:
    """All hours and day boundaries are UTC, whatever the host is set to."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="wardline-")


def _name_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and cuts the lineage."""
    _name_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def checkpoint_rdd(spark: SparkSession, rdd: RDD) -> RDD:
    """The same of Python objects, made once."""
    _name_checkpoint_dir(spark)
    rdd.persist(StorageLevel.DISK_ONLY).checkpoint()
    rdd._jrdd.count()  # no Python reads them here
    return rdd.unpersist()
