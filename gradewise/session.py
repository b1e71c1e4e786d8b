"""Session helper. Every operator also works in a session built elsewhere."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings an operator benefits from but never relies on for its results.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # run logs are many small files: pack them instead of one task per file
    "spark.sql.files.openCostInBytes": str(256 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # keyed state of streams on disk, with changes written per batch
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app: str = "gradewise", cpus: int | None = None, **extra: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the cluster's own session."""
    cores = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]")
    settings = {
        **RECOMMENDED,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        **{k.replace("__", "."): v for k, v in extra.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_recommended(spark: SparkSession) -> SparkSession:
    """Set the runtime-changeable recommended settings on an existing session."""
    for key, value in RECOMMENDED.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark
