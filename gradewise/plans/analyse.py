"""Summary tables to analysis tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewise import fixed_values as fixed
from gradewise.functions.labels import benchmark_display, model_display
from gradewise.operators.compare import (
    densify_grid,
    reasoning_effect,
    results_table,
    schema_fold_ci,
    sort_results_table,
    with_reasoning_category,
)
from gradewise.operators.dims import with_display_names, with_standard_org, zero_shot
from gradewise.operators.frontier import (
    best_as_of,
    carry_last_forward,
    initial_performance,
    normalized_frontier,
    relative_frontier,
)


def prompt_schema_comparison(
    summary: DataFrame,
    models: Sequence[str] = tuple(fixed.COMPARED_MODELS),
    benchmarks: Sequence[str] = tuple(fixed.COMPARED_BENCHMARKS),
) -> DataFrame:
    """Fold change of few-shot and chain-of-thought prompts for the listed models and benchmarks, nulls where empty."""
    named = with_display_names(summary).filter(F.col("model_display").isin(list(models)))
    folds = schema_fold_ci(named.filter(F.col("benchmark_display").isNotNull()))
    return densify_grid(folds, {"model_display": models, "benchmark": benchmarks})


def accuracy_table(summary: DataFrame) -> DataFrame:
    named = zero_shot(summary).withColumn("benchmark_display", benchmark_display(F.col("benchmark")))
    return sort_results_table(results_table(named))


def reasoning_table(summary: DataFrame) -> DataFrame:
    table = reasoning_effect(with_reasoning_category(summary))
    return table.withColumn("benchmark_display", F.coalesce(benchmark_display(F.col("benchmark")), F.col("benchmark")))


def _dated(summary: DataFrame) -> DataFrame:
    rows = with_standard_org(summary).dropna(subset=["epoch_organization"])
    return rows.withColumn("order_key", F.concat_ws("|", "inspect_model_name", "task_args"))


CURVE = {"group": "benchmark", "date": "epoch_model_publication_date", "value": "mean_accuracy", "order": "order_key"}


def top_model_curve(summary: DataFrame) -> DataFrame:
    """Best zero-shot accuracy so far per benchmark at every publication date, carried to the last one."""
    curve = best_as_of(zero_shot(_dated(summary)), carried=["epoch_model_name"], **CURVE)
    return carry_last_forward(curve, "benchmark")


def expert_facts(summary: DataFrame) -> DataFrame:
    return (
        summary.groupBy("benchmark")
        .agg(
            F.max("benchmark_publication_date").alias("event_date"),
            F.max(F.col("baselines.expert")).alias("expert"),
        )
        .filter(F.col("expert").isNotNull())
    )


def human_normalized_frontier(summary: DataFrame, fixed_initial: DataFrame) -> DataFrame:
    """Improvements per benchmark between the initial accuracy (-100) and the expert (0)."""
    rows = _dated(summary)
    starts = initial_performance(
        zero_shot(rows), expert_facts(summary), fixed_initial, **CURVE
    )
    return normalized_frontier(zero_shot(rows), starts, shown="epoch_model_name", **CURVE)


def human_relative_curve(summary: DataFrame) -> DataFrame:
    experts = expert_facts(summary).select("benchmark", "expert")
    return relative_frontier(zero_shot(_dated(summary)), experts, carried=["epoch_model_name"], **CURVE)


def model_names(summary: DataFrame) -> DataFrame:
    return summary.select("inspect_model_name", model_display(F.col("inspect_model_name")).alias("model_display")).distinct()
