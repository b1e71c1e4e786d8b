"""Token cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewise.functions.pricing import (
    cost_method,
    price_from_currency,
    price_from_digits,
    token_cost,
    token_cost_rounded,
)


def with_token_cost(usage: DataFrame, prices: DataFrame, model: str = "inspect_model_name") -> DataFrame:
    """Price `usage(model, input_tokens, output_tokens)`: adds `cost` and `cost_method`; unknown models cost 0.

    `prices` has one row per model, so the join cannot multiply rows. It is broadcast after a check of its size; beyond
    that Spark joins by shuffle and splits the rows of a frequent model.
    """
    table = prices.select(
        F.col("inspect_model_name").alias(model),
        price_from_digits(F.col("input_cost_per_M_tokens")).alias("_in"),
        price_from_digits(F.col("output_cost_per_M_tokens")).alias("_out"),
        price_from_digits(F.col("cost_per_M_tokens")).alias("_both"),
        F.lit(True).alias("_known"),
    )
    priced = usage.join(table, model, "left")
    known = F.coalesce(F.col("_known"), F.lit(False))
    return priced.withColumns(
        {
            "cost": token_cost(
                F.col("input_tokens"), F.col("output_tokens"), F.col("_in"), F.col("_out"), F.col("_both")
            ),
            "cost_method": cost_method(F.col(model), known, F.col("_in"), F.col("_out"), F.col("_both")),
        }
    ).drop("_in", "_out", "_both", "_known")


def with_run_cost(runs: DataFrame) -> DataFrame:
    """`est_cost` of enriched run rows, from their separate prices, to 2 places."""
    return runs.withColumn(
        "est_cost",
        token_cost_rounded(
            F.col("input_tokens"),
            F.col("output_tokens"),
            price_from_currency(F.col("input_cost_per_M_tokens")),
            price_from_currency(F.col("output_cost_per_M_tokens")),
        ),
    )


def require_prices(runs: DataFrame, prices: DataFrame, model: str = "inspect_model_name") -> DataFrame:
    """The runs, failing at run time on a model without a price row."""
    known = prices.select(F.col("inspect_model_name").alias(model), F.lit(True).alias("_known"))
    problem = F.raise_error(F.concat(F.lit("no price row for model "), F.col(model)))
    return (
        runs.join(known, model, "left")
        .withColumn("_known", F.when(F.col("_known").isNull(), problem).otherwise(F.col("_known").cast("string")))
        .filter(F.col("_known").isNotNull())
        .drop("_known")
    )


def log_usage(logs: DataFrame) -> DataFrame:
    """One row per log and model used in it."""
    return logs.select(
        "directory",
        "filename",
        F.col("results.total_samples").alias("total_samples"),
        F.col("results.completed_samples").alias("completed_samples"),
        F.explode_outer("stats.model_usage").alias("inspect_model_name", "_usage"),
    ).select(
        "directory",
        "filename",
        "total_samples",
        "completed_samples",
        "inspect_model_name",
        F.coalesce(F.col("_usage.input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.col("_usage.output_tokens"), F.lit(0)).alias("output_tokens"),
    )


def log_cost(logs: DataFrame, prices: DataFrame, keys: Sequence[str] = ("directory", "filename")) -> DataFrame:
    """Total cost per log over all models used in it."""
    return (
        with_token_cost(log_usage(logs), prices)
        .groupBy(*keys)
        .agg(
            F.sum("cost").alias("cost"),
            F.max("total_samples").alias("total_samples"),
            F.max("completed_samples").alias("completed_samples"),
        )
    )


def cost_rollup(costs: DataFrame, key: str = "filename") -> DataFrame:
    """Totals per key and over everything (`is_total` = 1), with the cost per completed question."""
    return (
        costs.rollup(key)
        .agg(
            F.grouping(key).cast("int").alias("is_total"),
            F.sum("cost").alias("cost"),
            F.sum("total_samples").alias("total_samples"),
            F.sum("completed_samples").alias("completed_samples"),
        )
        .withColumn(
            "cost_per_question",
            F.when(F.col("completed_samples") > 0, F.col("cost") / F.col("completed_samples")),
        )
    )
