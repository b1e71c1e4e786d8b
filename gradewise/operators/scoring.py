"""Scores: from whole logs (row-local) and from sample tables (aggregates)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewise.functions.answers import (
    extract_answer,
    is_correct,
    is_single_letter,
    message_text,
    target_is_list,
    target_letters,
)
from gradewise.functions.measures import binomial_stderr
from gradewise.functions.dates import offset_timestamp, run_duration, run_started_at
from gradewise.functions.literals import args_text, merge_maps


def second_message(messages: Column) -> Column:
    return F.get(messages, F.lit(1))["content"]


def sample_rows(logs: DataFrame, keys: Sequence[str] = ("directory", "filename")) -> DataFrame:
    """One narrow row per sample. Only what scoring needs is taken from the array before it is exploded."""
    slim = F.transform(
        "samples",
        lambda s: F.struct(
            s["id"].alias("id"),
            s["input"].alias("input"),
            s["target"].alias("target"),
            message_text(second_message(s["messages"])).alias("completion"),
            F.coalesce(s["scores"]["choice"]["answer"], F.lit("")).alias("answer"),
            s["scores"]["choice"]["explanation"].alias("explanation"),
        ),
    )
    return logs.select(*keys, F.explode(slim).alias("_s")).select(*keys, "_s.*")


def score_completions(rows: DataFrame, ignore_spaces: bool = False) -> DataFrame:
    """Add `extracted`, `is_scored` (the message had text) and `is_correct`."""
    extracted = extract_answer(F.col("completion"))
    return (
        rows.withColumn("extracted", extracted)
        .withColumns(
            {
                "is_scored": F.col("completion").isNotNull(),
                "is_correct": is_correct(
                    F.col("extracted"),
                    target_letters(F.col("target")),
                    target_is_list(F.col("target")),
                    ignore_spaces,
                ),
            }
        )
    )


def cot_accuracy(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accuracy per key. Samples without text are left out; unparsed answers count as wrong; 0 when none is left."""
    n = F.sum(F.col("is_scored").cast("bigint"))
    right = F.sum((F.col("is_scored") & F.col("is_correct")).cast("bigint"))
    return (
        scored.groupBy(*keys)
        .agg(n.alias("n_scored"), right.alias("n_correct"))
        .withColumn("accuracy", F.when(F.col("n_scored") > 0, F.col("n_correct") / F.col("n_scored")).otherwise(0.0))
        .withColumn("stderr", binomial_stderr(F.col("accuracy"), F.col("n_scored")))
        .withColumn("stderr_kind", F.lit("population"))
    )


def first_match(values: Column, test: Callable[[Column], Column]) -> Column:
    """The first element that passes `test`; null when none does."""
    return F.get(F.filter(values, test), F.lit(0))


def choice_metric(scores: Column, metric: str) -> Column:
    """A metric of the first score named `choice`; null when there is none."""
    return first_match(scores, lambda s: s["name"] == "choice")["metrics"][metric]["value"]


def _in_row_score(samples: Column) -> Column:
    """Counts `struct<n, right>` over the samples of one log, without exploding them."""
    marks = F.transform(
        samples,
        lambda s: F.struct(
            message_text(second_message(s["messages"])).alias("text"), s["target"].alias("target")
        ),
    )
    # the answer is read from the text once and kept beside its target
    scored = F.transform(
        F.filter(marks, lambda m: m["text"].isNotNull()),
        lambda m: F.struct(extract_answer(m["text"]).alias("answer"), m["target"].alias("target")),
    )
    right = F.filter(scored, lambda m: is_correct(m["answer"], target_letters(m["target"]), target_is_list(m["target"])))
    return F.struct(F.size(scored).alias("n"), F.size(right).alias("right"))


def run_rows(logs: DataFrame) -> DataFrame:
    """One run row per successful log; chain-of-thought runs are scored again from the messages.

    Row-local: the scan feeds the result without a shuffle. `eval_start_time` comes from the log name.
    """
    counts = F.when(F.col("is_cot"), _in_row_score(F.col("samples")))
    usage = F.try_element_at(F.col("stats.model_usage"), F.col("eval.model"))
    scores = F.col("results.scores")
    finished = offset_timestamp(F.col("stats.completed_at"))
    prepared = logs.withColumns({"_counts": counts, "_usage": usage})
    accuracy = F.when(F.col("_counts.n") > 0, F.col("_counts.right") / F.col("_counts.n")).otherwise(0.0)
    return prepared.select(
        "directory",
        F.col("eval.model").alias("inspect_model_name"),
        F.col("eval.task").alias("task"),
        args_text(merge_maps(F.col("eval.task_args"), F.col("plan.config"))).alias("task_args"),
        "prompt_schema",
        "benchmark",
        F.col("eval.dataset.samples").alias("total_samples"),
        F.when(F.col("is_cot"), accuracy).otherwise(choice_metric(scores, "accuracy")).alias("accuracy"),
        F.when(F.col("is_cot"), binomial_stderr(accuracy, F.col("_counts.n")))
        .otherwise(choice_metric(scores, "stderr"))
        .alias("stderr"),
        F.when(F.col("is_cot"), F.lit("population")).otherwise(F.lit("sample")).alias("stderr_kind"),
        F.col("_usage.total_tokens").alias("total_tokens"),
        F.col("_usage.input_tokens").alias("input_tokens"),
        F.col("_usage.output_tokens").alias("output_tokens"),
        F.col("eval.run_id").alias("run_id"),
        F.coalesce(run_started_at(F.col("filename")), finished).alias("eval_start_time"),
        finished.alias("eval_end_time"),
        run_duration(F.col("filename"), finished).alias("run_seconds"),
        F.current_timestamp().alias("results_generated_time"),
        "filename",
        F.col("is_cot").alias("cot_scoring"),
    )


def answer_format_audit(rows: DataFrame, keys: Sequence[str], answer: str = "answer") -> DataFrame:
    """Share of samples per key whose recorded answer is not a single letter."""
    odd = (~is_single_letter(F.coalesce(F.col(answer), F.lit("")))).cast("bigint")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum(odd).alias("n_non_letter"),
        F.avg(odd).alias("share_non_letter"),
    )


def non_letter_samples(rows: DataFrame, answer: str = "answer") -> DataFrame:
    return rows.filter(~is_single_letter(F.coalesce(F.col(answer), F.lit(""))))
