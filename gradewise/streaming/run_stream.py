"""Run rows and summaries while a log folder grows. The same operators as the batch path, over a stream of logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gradewise import schemas
from gradewise.functions.measures import truncate_int
from gradewise.operators.runs import GROUP_KEYS
from gradewise.operators.scoring import run_rows
from gradewise.sources.logs import successful_logs, with_log_origin


def stream_eval_logs(spark: SparkSession, path: str, files_per_batch: int = 10_000) -> DataFrame:
    """New `*.json` logs of a folder tree as they appear."""
    stream = (
        spark.readStream.schema(schemas.LOG)
        .option("multiLine", True)
        .option("pathGlobFilter", "*.json")
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
    )
    return with_log_origin(stream)


def run_key() -> Column:
    """What makes a run the same run; a log without a run id is known by its place."""
    return F.coalesce("run_id", F.concat_ws("/", "directory", "filename"))


def stream_runs(logs: DataFrame) -> DataFrame:
    """Scored run rows of the stream, one per delivered log; `write_run_stream` makes repeated deliveries count once."""
    return run_rows(successful_logs(logs))


def stream_summary(runs: DataFrame, keys: Sequence[str] = GROUP_KEYS) -> DataFrame:
    """Running summary per group, for update or complete output. One state row per group."""
    return (
        runs.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(
            F.avg("accuracy").alias("mean_accuracy"),
            F.stddev_samp("accuracy").alias("std_accuracy"),
            truncate_int(F.avg("input_tokens")).alias("mean_input_tokens"),
            truncate_int(F.avg("output_tokens")).alias("mean_output_tokens"),
            F.count(F.lit(1)).alias("num_runs"),
        )
    )


def _table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """The Parquet table at `path`, or none where nothing has been written."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _append(rows: DataFrame, out: str) -> None:
    rows.write.mode("append").partitionBy("prompt_schema", "benchmark").parquet(out)


def append_new_runs(rows: DataFrame, out: str) -> None:
    """Append the runs that the stored table does not have yet. Doing it twice changes nothing."""
    key = run_key().alias("_key")
    new = rows.withColumn("_key", key).dropDuplicates(["_key"])
    stored = _table(rows.sparkSession, out, rows.schema)
    if stored is not None:
        new = new.join(stored.select(key), "_key", "left_anti")
    _append(new.drop("_key"), out)


def append_batch(rows: DataFrame, batch: int, out: str, notes: str) -> None:
    """Append a micro-batch of runs whose keys the stream has not had before; `rows` has the key as `_key`.

    Before a batch is appended it is noted. A batch that is noted already was broken off, so its rows are compared with the stored table;
    no other batch reads the table, and what a batch reads doesn't grow with it. Runs from before the stream's state are known by the keys in
    `notes`, written once at the start.
    """
    spark = rows.sparkSession
    begun = _table(spark, f"{notes}/begun", StructType.fromDDL("batch bigint"))
    if begun is not None and not begun.filter(F.col("batch") == batch).isEmpty():
        append_new_runs(rows.drop("_key"), out)
        return
    earlier = _table(spark, f"{notes}/earlier", StructType.fromDDL("_key string"))
    if earlier is not None:
        rows = rows.join(earlier, "_key", "left_anti")
    spark.range(batch, batch + 1).select(F.col("id").alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{notes}/begun")
    _append(rows.drop("_key"), out)


def write_run_stream(runs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append run rows to a Parquet table; `checkpoint` must be on storage that all executors share.

    Every run is kept whatever its age and order of arrival, and once: the keys of all runs so far are keyed state of the stream (in RocksDB
    where the session has its provider, see `session.RECOMMENDED`), so a batch looks up its own keys and reads no history. No watermark
    decides whether a run counts. A stream that starts with a new checkpoint beside a stored table first writes the table's keys down once.
    """
    spark, notes = runs.sparkSession, f"{checkpoint.rstrip('/')}-notes"
    if not _is_known(spark, f"{checkpoint.rstrip('/')}/metadata"):
        stored = _table(spark, out, runs.schema)
        if stored is not None:
            stored.select(run_key().alias("_key")).distinct().write.mode("overwrite").parquet(f"{notes}/earlier")
    return (
        runs.withColumn("_key", run_key())
        .dropDuplicates(["_key"])
        .writeStream.foreachBatch(lambda rows, batch: append_batch(rows, batch, out, notes))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _is_known(spark: SparkSession, path: str) -> bool:
    """Has the stream been started with this checkpoint before?"""
    try:
        return not spark.read.text(path).isEmpty()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
