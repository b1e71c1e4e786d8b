"""Run rows to summary rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewise.functions.labels import path_label
from gradewise.functions.literals import args_text, canonical_args, with_parsed_args
from gradewise.functions.measures import truncate_int

GROUP_KEYS = ("inspect_model_name", "benchmark", "prompt_schema", "task_args")
FACTS = (
    "epoch_model_name", "epoch_model_publication_date", "epoch_organization", "epoch_parameters",
    "epoch_training_compute_flop", "benchmark_publication_date", "baselines", "cost_source_date",
)


def majority_values(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Most frequent non-null value of a column per key; the smallest on a tie.

    Counted first, so what is compared per key is distinct values and not rows.
    """
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(*keys, column)
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*keys)
        .agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias(f"{column}_majority"))
    )


def harmonize(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Set each column to the most frequent value of its key. Applying it twice changes nothing.

    The majorities are found on counts of distinct values and meet in one small table, so the rows are joined once.
    """
    common = None
    for column in columns:
        one = majority_values(df, keys, column)
        common = one if common is None else common.join(one, list(keys), "full")
    if common is None:
        return df
    filled = {c: F.coalesce(f"{c}_majority", c) for c in columns}
    return df.join(common, list(keys), "left").withColumns(filled).drop(*[f"{c}_majority" for c in columns])


def with_canonical_args(runs: DataFrame) -> DataFrame:
    """One spelling per set of arguments, so that spelling does not split a group."""
    parsed = with_parsed_args(runs, "task_args", "_args")
    return parsed.withColumn("task_args", args_text(canonical_args(F.col("_args")))).drop("_args")


def summarize_runs(
    runs: DataFrame, keys: Sequence[str] = GROUP_KEYS, include_cost: bool = False
) -> DataFrame:
    """One row per group: mean and sample deviation of accuracy, mean tokens as integers, run count, facts.

    Rows with a null key are dropped. One shuffle of partial aggregates. The facts depend on model and benchmark only,
    so they are grouped by as well: that splits nothing and keeps the aggregate in a hash table. The files of a group are a
    table of their own (`run_files`): one cell could not hold them when a group is a third of all runs.
    """
    facts = [f for f in FACTS if f in runs.columns and (include_cost or f != "cost_source_date")]
    aggregates = [
        F.min("total_samples").alias("total_samples"),
        (F.min("total_samples") != F.max("total_samples")).alias("mixed_samples"),
        F.avg("accuracy").alias("mean_accuracy"),
        F.stddev_samp("accuracy").alias("std_accuracy"),
        truncate_int(F.avg("input_tokens")).alias("mean_input_tokens"),
        truncate_int(F.avg("output_tokens")).alias("mean_output_tokens"),
        F.count(F.lit(1)).alias("num_runs"),
    ]
    if include_cost:
        aggregates.append(F.bround(F.sum("est_cost"), 2).alias("est_tot_cost"))
    summary = runs.dropna(subset=list(keys)).groupBy(*keys, *facts).agg(*aggregates)
    label = path_label(F.col("prompt_schema"), F.col("benchmark"), F.col("inspect_model_name"))
    return summary.select(
        label.alias("path"),
        *keys,
        *facts,
        "total_samples",
        "mixed_samples",
        "mean_accuracy",
        "std_accuracy",
        "mean_input_tokens",
        "mean_output_tokens",
        *(["est_tot_cost"] if include_cost else []),
        "num_runs",
    )


def run_files(runs: DataFrame, keys: Sequence[str] = GROUP_KEYS) -> DataFrame:
    """The files of every group in long form. Written with a global sort it is the sorted list of each group."""
    return runs.dropna(subset=list(keys)).select(*keys, "filename")


def sorted_run_files(runs: DataFrame, keys: Sequence[str] = GROUP_KEYS) -> DataFrame:
    """The sorted list of files of every group as a table, a row per file. A sort by ranges, so a group of any size is fine."""
    return run_files(runs, keys).orderBy(*keys, "filename")


def with_file_lists(summary: DataFrame, runs: DataFrame, keys: Sequence[str] = GROUP_KEYS) -> DataFrame:
    """The sorted file list as one cell per group, for callers whose groups are known to fit a cell; else `sorted_run_files`."""
    lists = run_files(runs, keys).groupBy(*keys).agg(F.sort_array(F.collect_list("filename")).alias("filenames"))
    return summary.join(lists, list(keys), "left")


def sort_summary(summary: DataFrame) -> DataFrame:
    return summary.orderBy("inspect_model_name", "benchmark", "prompt_schema", "task_args")


def run_totals(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count(F.lit(1)).alias("total_runs"), F.sum("total_samples").alias("total_samples"))
