"""Dimension joins, name aliases and row selection for run and summary tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gradewise import fixed_values as fixed
from gradewise.functions.labels import benchmark_display, condition_label, model_display, standardize_org


def dedupe_keep_first(frames: Sequence[DataFrame], key: str, order: Sequence[str]) -> DataFrame:
    """Union of the frames in priority order with the first row per key.

    An aggregate and not a window: it combines map-side, so a key with very many copies costs one row per task.
    Within one frame, `order` decides.
    """
    ranked = None
    for rank, frame in enumerate(frames):
        tagged = frame.withColumn("_source", F.lit(rank))
        ranked = tagged if ranked is None else ranked.unionByName(tagged, allowMissingColumns=True)
    columns = [c for c in ranked.columns if c != "_source"]
    first = F.min_by(F.struct(*columns), F.struct("_source", *order))
    return ranked.groupBy(key).agg(first.alias("_first")).select("_first.*")


def model_metadata(prices: DataFrame, notable: DataFrame, large_scale: DataFrame) -> DataFrame:
    """Model table with publication data, one row per model name of the evaluation."""
    described = dedupe_keep_first(
        [notable, large_scale], "Model", ["Publication date", "Organization", "Parameters"]
    )
    return (
        prices.select(
            "inspect_model_name",
            "epoch_model_name",
            "input_cost_per_M_tokens",
            "output_cost_per_M_tokens",
            "last_updated",
        )
        .join(described, F.col("epoch_model_name") == F.col("Model"), "left")
        .select(
            "inspect_model_name",
            "epoch_model_name",
            F.col("`Publication date`").alias("epoch_model_publication_date"),
            F.col("Organization").alias("epoch_organization"),
            F.col("Parameters").alias("epoch_parameters"),
            F.col("`Training compute (FLOP)`").alias("epoch_training_compute_flop"),
            "input_cost_per_M_tokens",
            "output_cost_per_M_tokens",
            F.col("last_updated").alias("cost_source_date"),
        )
    )


def with_benchmark_facts(runs: DataFrame, baselines: DataFrame, dates: DataFrame) -> DataFrame:
    """Add `baselines` and `benchmark_publication_date`; null where unknown. Both have one row per benchmark."""
    return runs.join(baselines, "benchmark", "left").join(dates, "benchmark", "left")


def with_computed_random(baselines: DataFrame, computed: DataFrame) -> DataFrame:
    """Fill missing random values from `computed(benchmark, random)`, as question sets give them."""
    known = F.col("baselines")
    filled = F.struct(
        known["expert"].alias("expert"),
        known["non_expert"].alias("non_expert"),
        F.coalesce(known["random"], F.col("_random")).alias("random"),
    )
    return (
        baselines.join(computed.select("benchmark", F.col("random").alias("_random")), "benchmark", "left")
        .withColumn("baselines", filled)
        .drop("_random")
    )


RUN_COLUMNS = [
    "inspect_model_name", "epoch_model_name", "epoch_model_publication_date", "epoch_organization",
    "epoch_parameters", "epoch_training_compute_flop", "benchmark", "benchmark_publication_date", "task_args",
    "prompt_schema", "total_samples", "accuracy", "stderr", "baselines", "total_tokens", "input_tokens",
    "output_tokens", "est_cost", "cost_source_date", "run_id", "eval_start_time", "eval_end_time",
    "results_generated_time", "filename", "cot_scoring",
]


def enrich_runs(
    runs: DataFrame, metadata: DataFrame, baselines: DataFrame, dates: DataFrame, include_cost: bool = False
) -> DataFrame:
    """Run rows with model and benchmark facts in a fixed column order, with cost on request."""
    from gradewise.operators.costing import with_run_cost

    described = runs.join(metadata, "inspect_model_name", "left")
    joined = with_benchmark_facts(described, baselines, dates)
    if include_cost:
        return with_run_cost(joined).select(RUN_COLUMNS)
    return joined.select([c for c in RUN_COLUMNS if c not in ("est_cost", "cost_source_date")])


# --- selection -------------------------------------------------------------------------------


def zero_shot(df: DataFrame) -> DataFrame:
    return df.filter(F.col("prompt_schema") == "zero_shot")


def with_standard_org(df: DataFrame, column: str = "epoch_organization") -> DataFrame:
    return df.withColumn(column, standardize_org(F.col(column)))


def require_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def largest_of_class(df: DataFrame) -> DataFrame:
    return df.filter(F.col("biggest_in_class") == 1)


def exclude_models(
    df: DataFrame,
    rules: Sequence[tuple[str | None, str]] = tuple(fixed.EXCLUDED_MODELS),
    benchmark: str = "benchmark",
    model: str = "inspect_model_name",
) -> DataFrame:
    """Drop models by `(benchmark, model)` rules; a rule without benchmark holds everywhere.

    The rule table is a literal list of the caller, hence small by construction.
    """
    table = df.sparkSession.createDataFrame(list(rules), "_rule_benchmark string, _rule_model string")
    matches = (F.col(model) == F.col("_rule_model")) & (
        F.col("_rule_benchmark").isNull() | (F.col("_rule_benchmark") == F.col(benchmark))
    )
    return df.join(F.broadcast(table), matches, "left_anti")


def keep_listed(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return df.filter(F.col(column).isin(list(values)))


def with_display_names(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "benchmark_display": benchmark_display(F.col("benchmark")),
            "model_display": model_display(F.col("inspect_model_name")),
        }
    )


def with_condition(df: DataFrame) -> DataFrame:
    """Condition label of the prompt schema; rows of other schemas are left out."""
    return df.withColumn("condition", condition_label(F.col("prompt_schema"))).filter(F.col("condition").isNotNull())


def split_rejects(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass and rows that do not, for a report of what was dropped. A null condition is a reject."""
    passed = F.coalesce(keep, F.lit(False))
    return df.filter(passed), df.filter(~passed)


def filter_observed(df: DataFrame, keep: Column, name: str = "filter") -> tuple[DataFrame, Observation]:
    """Rows that pass, and an observation with `rows_in` and `rows_dropped` once an action has run.

    Counting rides on the same pass over the data. It keeps the condition out of the scan, so use a plain filter where
    the count is not wanted.
    """
    passed = F.coalesce(keep, F.lit(False))
    observation = Observation(name)
    counted = df.observe(
        observation, F.count(F.lit(1)).alias("rows_in"), F.count_if(~passed).alias("rows_dropped")
    )
    return counted.filter(passed), observation
