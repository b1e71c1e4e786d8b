"""Small tables: prices, model metadata, baselines, run configuration, and the stored summary."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewise import fixed_values as fixed
from gradewise import schemas
from gradewise.functions.literals import parse_dict_literal


def read_model_prices(spark: SparkSession, path: str, old_form: bool = False) -> DataFrame:
    """Tab-separated model table; prices stay text (`$2.50`) until a cost function reads them."""
    schema = schemas.MODEL_PRICES_OLD if old_form else schemas.MODEL_PRICES
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def read_model_metadata(spark: SparkSession, notable: str, large_scale: str) -> tuple[DataFrame, DataFrame]:
    """The two metadata files, in priority order. Columns are matched by name, so wider files are fine."""

    def one(path: str) -> DataFrame:
        raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
        wanted = [
            F.col(f"`{name}`").try_cast(kind).alias(name) for name, kind in schemas.MODEL_METADATA.items()
        ]
        return raw.select(*wanted)

    return one(notable), one(large_scale)


def baselines_table(spark: SparkSession, computed: Mapping[str, float] | None = None) -> DataFrame:
    """Expert, non-expert and random accuracy per benchmark. `computed` fills random values from question sets."""
    rows = []
    for name, values in fixed.BASELINES.items():
        random = (computed or {}).get(name, values["random"])
        rows.append((name, (values["expert"], values["non_expert"], random)))
    return spark.createDataFrame(rows, f"benchmark string, baselines {schemas.BASELINES_TYPE}")


def publication_dates(spark: SparkSession) -> DataFrame:
    rows = [(n, dt.date.fromisoformat(d)) for n, d in fixed.PUBLICATION_DATES.items()]
    return spark.createDataFrame(rows, "benchmark string, benchmark_publication_date date")


def initial_accuracies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(fixed.INITIAL_ACCURACY.items()), "benchmark string, fixed_initial double"
    )


def read_summary(spark: SparkSession, path: str, with_cost: bool = False) -> DataFrame:
    """A stored summary CSV with typed dates; `baselines` and `task_args` text becomes a struct and a map."""
    schema = schemas.SUMMARY_WITH_COST if with_cost else schemas.SUMMARY
    baselines = parse_dict_literal(F.col("baselines"))

    def number(key: str):
        return F.try_element_at(baselines, F.lit(key)).try_cast("double").alias(key)

    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("escape", '"')
        .csv(path)
        .withColumns(
            {
                "baselines": F.struct(number("expert"), number("non_expert"), number("random")),
                "task_args_map": parse_dict_literal(F.col("task_args")),
            }
        )
    )


def load_config(path: str) -> dict[str, Any]:
    """Run configuration (YAML). A file of a few lines, read on the driver."""
    import yaml

    with open(path, encoding="utf-8") as handle:
        return yaml.safe_load(handle) or {}


def _text(value: Any) -> str | None:
    if value is None or isinstance(value, str):
        return value
    import json

    return json.dumps(value)


def config_tables(spark: SparkSession, config: Mapping[str, Any]) -> tuple[DataFrame, DataFrame]:
    """Configuration as `models(model_key, model, settings, rag)` and `benchmarks(benchmark, enabled, runs, args)`."""
    defaults = {k: _text(v) for k, v in (config.get("global_settings") or {}).items()}
    models = []
    for key, own in (config.get("models") or {}).items():
        own = own or {}
        settings = {k: _text(v) for k, v in own.items() if k != "model"}
        models.append((key, own.get("model", key), defaults, settings, _text(own.get("rag"))))
    benchmarks = []
    for name, args in (config.get("benchmarks") or {}).items():
        args = args or {}
        benchmarks.append((name, args.get("enabled"), args.get("runs"), {k: _text(v) for k, v in args.items()}))
    return (
        spark.createDataFrame(
            models,
            "model_key string, model string, default_settings map<string,string>, settings map<string,string>, "
            "rag string",
        ),
        spark.createDataFrame(benchmarks, "benchmark string, enabled boolean, runs int, args map<string,string>"),
    )
