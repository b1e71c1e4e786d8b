"""Outputs. Parquet for anything read again, CSV where the table leaves Spark."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def flatten_for_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, since CSV has no nested values."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (ArrayType, MapType, StructType))]
    return df.withColumns({n: F.to_json(F.col(f"`{n}`")) for n in nested})


def write_csv(df: DataFrame, path: str) -> None:
    flatten_for_csv(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_dated_csv(df: DataFrame, folder: str, suffix: str, today: dt.date | None = None) -> str:
    """`<folder>/<yyyymmdd>_<suffix>.csv`; returns the path."""
    path = f"{folder.rstrip('/')}/{(today or dt.date.today()):%Y%m%d}_{suffix}.csv"
    write_csv(df, path)
    return path


class Publication:
    """Tables of one state, written under an attempt of their own and published together.

    An attempt's tables are files that nobody reads yet. `publish` adds one row to the manifest, a single file that Spark moves into place
    when it is complete; from then on readers see all the tables of this attempt. A run that fails before leaves the last state as it was.
    """

    def __init__(self, spark: SparkSession, root: str, today: dt.date | None = None):
        self.spark, self.root, self.today = spark, root.rstrip("/"), today or dt.date.today()
        self.attempt, self.paths = f"{dt.datetime.now(dt.UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}", {}

    def write(self, name: str, df: DataFrame) -> str:
        """`<root>/attempts/<attempt>/<yyyymmdd>_<name>.csv`; the files of a table are of like size whatever its keys."""
        path = f"{self.root}/attempts/{self.attempt}/{self.today:%Y%m%d}_{name}.csv"
        write_csv(df, path)
        self.paths[name] = path
        return path

    def publish(self) -> dict[str, str]:
        row = [(self.attempt, dt.datetime.now(dt.UTC).isoformat(), dict(self.paths))]
        manifest = self.spark.createDataFrame(row, _MANIFEST).coalesce(1)
        manifest.write.mode("append").json(f"{self.root}/manifest")
        return dict(self.paths)


_MANIFEST = "attempt string, published_at string, tables map<string,string>"


def published(spark: SparkSession, root: str) -> dict[str, str]:
    """Paths of the tables of the last published state, by name; none if nothing has been published."""
    try:
        rows = spark.read.schema(_MANIFEST).json(f"{root.rstrip('/')}/manifest")
        last = rows.orderBy(F.desc("published_at"), F.desc("attempt")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return dict(last["tables"]) if last else {}


def write_per_schema(df: DataFrame, path: str) -> None:
    """One directory per prompt schema."""
    rows = flatten_for_csv(df).hint("rebalance", "prompt_schema")
    rows.write.mode("overwrite").option("header", True).option("escape", '"').partitionBy("prompt_schema").csv(path)


def write_runs(df: DataFrame, path: str) -> None:
    """Run rows as Parquet, laid out so that later reads prune by prompt schema and benchmark.

    Rows are rebalanced by these keys first: few files for a small benchmark, several tasks and files for a large one.
    """
    df.hint("rebalance", "prompt_schema", "benchmark").write.mode("overwrite").partitionBy("prompt_schema", "benchmark").parquet(path)
