"""Tables kept between jobs: written to the folder that the cluster shares and read back, so that lost executors lose nothing."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="gradewise-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`. Without it only a session on one machine has a folder that all its tasks see."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master == "local" or master.startswith("local["):
        return _local_folder()
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(table: DataFrame, name: str) -> DataFrame:
    """`table` written and read back: its lineage ends here."""
    path = new_path(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)
