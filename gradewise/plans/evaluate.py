"""Run logs to run rows and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradewise import fixed_values as fixed
from gradewise.operators.compare import lab_bench_baselines, statement_baselines
from gradewise.operators.costing import cost_rollup, log_cost
from gradewise.operators.dims import enrich_runs, model_metadata
from gradewise.operators.runs import (
    harmonize, sort_summary, sorted_run_files, summarize_runs, with_canonical_args, with_file_lists
)
from gradewise.operators.scoring import run_rows
from gradewise.sources.dimensions import baselines_table, publication_dates, read_model_metadata, read_model_prices
from gradewise.sources.logs import counted_logs, log_rejects, read_eval_logs, read_runs, scan_logs
from gradewise.sources.questions import read_jsonl, read_question_set, valid_lines
from gradewise.sources.sinks import Publication, write_csv, write_runs


def runs_from_logs(spark: SparkSession, path: str) -> DataFrame:
    """Scored run rows of every successful log, with one `task` and one `task_args` per directory."""
    rows = run_rows(counted_logs(scan_logs(spark, path)))
    return harmonize(rows, ["directory"], ["task", "task_args"])


def store_runs(spark: SparkSession, log_path: str, out: str, rejects: str | None = None) -> None:
    """Convert the small log files once; everything later reads the stored table.

    `rejects` is where the report of the files that do not count goes, as CSV; it is read without scoring anything.
    """
    write_runs(runs_from_logs(spark, log_path), out)
    if rejects:
        write_csv(log_rejects(scan_logs(spark, log_path)), rejects)


def cost_of_logs(spark: SparkSession, log_path: str, price_file: str) -> DataFrame:
    logs = read_eval_logs(spark, log_path)
    return cost_rollup(log_cost(logs, read_model_prices(spark, price_file)))


def enriched_runs(
    spark: SparkSession,
    runs: DataFrame,
    price_file: str,
    notable: str,
    large_scale: str,
    include_cost: bool = False,
    random_baselines: dict[str, float] | None = None,
    spelling: str = "literal",
) -> DataFrame:
    """Run rows with model and benchmark facts.

    `spelling` says when arguments of two runs are the same: `literal` text, `canonical` form, or `majority`, which
    gives all runs of a model, benchmark and prompt schema their most frequent arguments.
    """
    metadata = model_metadata(
        read_model_prices(spark, price_file), *read_model_metadata(spark, notable, large_scale)
    )
    if spelling == "canonical":
        runs = with_canonical_args(runs)
    elif spelling == "majority":
        runs = harmonize(runs, ["prompt_schema", "benchmark", "inspect_model_name"], ["task", "task_args"])
    elif spelling != "literal":
        raise ValueError(f"unknown spelling {spelling!r}")
    return enrich_runs(
        runs, metadata, baselines_table(spark, random_baselines), publication_dates(spark), include_cost
    )


def summary_with_files(runs: DataFrame, include_cost: bool = False) -> DataFrame:
    """The summary with the file list of each group in a cell, for groups that are known to fit one."""
    return sort_summary(with_file_lists(summarize_runs(runs, include_cost=include_cost), runs))


def computed_baselines(spark: SparkSession, lab_bench: str | None = None, vct: str | None = None) -> dict[str, float]:
    """Random accuracies that follow from question sets: the root of the one with distractors, the JSON lines of the other.

    One row per benchmark name, so the result is a handful of numbers.
    """
    found = []
    if lab_bench:
        found.append(lab_bench_baselines(read_question_set(spark, lab_bench, "lab_bench", fixed.LAB_BENCH_SUBSETS)))
    if vct:
        found.append(statement_baselines(valid_lines(read_jsonl(spark, vct))))
    return {r["benchmark"]: r["random"] for table in found for r in table.collect()}


def publish(spark: SparkSession, runs_root: str, out: str, price_file: str, notable: str, large_scale: str,
            include_cost: bool = False, lab_bench: str | None = None, vct: str | None = None,
            logs: str | None = None) -> tuple[str, str]:
    """Combine all stored run files and publish the dated tables of runs, of files per group and the summary together; returns the paths
    of runs and summary. `sinks.published` gives the paths of the last complete state.

    `lab_bench` and `vct` are the question sets from which the random baselines of their benchmarks follow. With `logs`, the folder of the
    run logs, the cost per log with its total and the rejected files are published as well.
    """
    runs = enriched_runs(
        spark, read_runs(spark, runs_root), price_file, notable, large_scale, include_cost, computed_baselines(spark, lab_bench, vct)
    )
    state = Publication(spark, out)
    state.write("files", sorted_run_files(runs))
    state.write("all_runs", runs)
    state.write("summary", sort_summary(summarize_runs(runs, include_cost=include_cost)))
    if logs:
        state.write("log_costs", cost_of_logs(spark, logs, price_file))
        state.write("rejected_logs", log_rejects(scan_logs(spark, logs)))
    paths = state.publish()
    return paths["all_runs"], paths["summary"]
