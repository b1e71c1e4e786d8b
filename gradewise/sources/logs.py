"""Run logs (JSON, one document per file) and run tables (CSV)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from gradewise import schemas

RUN_PATH = r"/([^/]+)/([^/]+)/([^/]+)/[^/]+$"


def path_parts(path: Column) -> dict[str, Column]:
    """`<prompt_schema>/<benchmark>/<model>/<file>`: the last three directory names."""
    return {
        "prompt_schema": F.regexp_extract(path, RUN_PATH, 1),
        "benchmark": F.regexp_extract(path, RUN_PATH, 2),
        "model_dir": F.regexp_extract(path, RUN_PATH, 3),
    }


def with_log_origin(logs: DataFrame) -> DataFrame:
    """Add file name and directory labels; a schema name with `cot` in it marks a chain-of-thought run."""
    path = F.col("_metadata.file_path")
    origin = path_parts(path)
    return logs.select(
        "*",
        F.col("_metadata.file_name").alias("filename"),
        F.regexp_replace(path, r"/[^/]+$", "").alias("directory"),
        *[c.alias(n) for n, c in origin.items()],
        origin["prompt_schema"].contains("cot").alias("is_cot"),
    )


def read_eval_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every `*.json` log below `path` (or one file), with its origin columns. One scan for all directories."""
    return with_log_origin(
        spark.read.schema(schemas.LOG)
        .option("multiLine", True)
        .option("pathGlobFilter", "*.json")
        .option("recursiveFileLookup", True)
        .json(path)
    )


#: Bytes of the largest log that is read as a whole; a larger one is reported.
LARGEST_LOG = 1 << 30
_UNREAD = "_unread"


def scan_logs(spark: SparkSession, path: str | list[str], stream: bool = False, files_per_batch: int = 10_000, largest: int = LARGEST_LOG) -> DataFrame:
    """Every `*.json` file below `path` as one row: its origin columns, `n_bytes`, the log in `log`, and in `reject` why it does not count.

    `reject` is null for a log of a finished run; otherwise `too large`, `unreadable` (also a log cut short, or with a field of
    another kind than the schema has), or `status ` with the status, so rows that count and rows that don't are all the files, but for those of no bytes, which Spark's listing leaves out. Spark packs small files into partitions by their bytes, and a file above `largest` is listed
    but not opened. With `stream` the rows of new files are read as they appear.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch) if stream else spark.read
    files = (
        reader.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", "*.json")
        .option("recursiveFileLookup", True)
    )
    opened = _parsed(files.load(path).filter(F.col("length") <= largest))
    # read again without `content`, so that no file is opened
    listed = files.load(path).filter(F.col("length") > largest).select(
        "path", "length", F.lit(None).cast(opened.schema["log"].dataType).alias("log"), F.lit("too large").alias("reject")
    )
    rows = opened.unionByName(listed)
    origin = path_parts(F.col("path"))
    return rows.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
        F.regexp_replace("path", r"/[^/]+$", "").alias("directory"),
        *[c.alias(n) for n, c in origin.items()],
        origin["prompt_schema"].contains("cot").alias("is_cot"),
        F.col("length").alias("n_bytes"),
        "log",
        "reject",
    )


def _parsed(files: DataFrame) -> DataFrame:
    schema = StructType.fromDDL(schemas.LOG).add(_UNREAD, StringType())
    log = F.from_json(F.col("content").cast("string"), schema, {"columnNameOfCorruptRecord": _UNREAD})
    status = F.col("log.status")
    reject = (
        F.when(status.isNull() | F.col(f"log.{_UNREAD}").isNotNull(), F.lit("unreadable"))
        .when(status != "success", F.concat(F.lit("status "), status))
    )
    return files.withColumn("log", log).select("path", "length", F.col("log").dropFields(_UNREAD).alias("log"), reject.alias("reject"))


def counted_logs(scanned: DataFrame) -> DataFrame:
    """Logs of `scan_logs` that count, in the form of `read_eval_logs`."""
    good = scanned.filter(F.col("reject").isNull())
    return good.select("log.*", "filename", "directory", "prompt_schema", "benchmark", "model_dir", "is_cot")


def log_rejects(scanned: DataFrame) -> DataFrame:
    """`(directory, filename, n_bytes, reject)` of all files of `scan_logs` that do not count."""
    return scanned.filter(F.col("reject").isNotNull()).select("directory", "filename", "n_bytes", "reject")


def successful_logs(logs: DataFrame) -> DataFrame:
    return logs.filter(F.col("status") == "success")


def rejected_logs(logs: DataFrame) -> DataFrame:
    """What `successful_logs` leaves out, for the report; unreadable files have no status."""
    return logs.filter(~F.coalesce(F.col("status") == "success", F.lit(False))).select(
        "directory", "filename", "status"
    )


def read_runs(spark: SparkSession, root: str, skip_damaged: bool = False) -> DataFrame:
    """All `results.csv` under `<root>/<prompt_schema>/<benchmark>/<model>/`.

    Benchmark and prompt schema come from the path and replace any column of that name. A file that can't be read to its end is an error,
    as is a root without any run file; with `skip_damaged` the rows before the damage are used and the rest of the file is left out.
    """
    origin = path_parts(F.col("_metadata.file_path"))
    return (
        spark.read.schema(schemas.RUN)
        .option("header", True)
        .option("escape", '"')
        .option("ignoreCorruptFiles", skip_damaged)
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[XXX]")
        .csv(f"{root.rstrip('/')}/*/*/*/results.csv")
        .withColumns({"benchmark": origin["benchmark"], "prompt_schema": origin["prompt_schema"]})
    )
