"""Comparisons of prompt schemas, models and settings. One shuffle per operator, combined map-side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewise import fixed_values as fixed
from gradewise.functions.labels import (
    effort_category,
    format_mean_std,
    token_limit_category,
)
from gradewise.functions.literals import map_get
from gradewise.functions.measures import fold_ci, ratio, truncate_int

TOKEN_KINDS = ("input_tokens", "output_tokens", "total_tokens")


def safe_name(text: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in text).lower()


def first_row(columns: Sequence[str], order: Sequence[str], condition: Column | None = None) -> Column:
    """The row that comes first in `order`, among rows that meet the condition; null when none does.

    Rows that do not meet it get a null order, which the aggregate ignores.
    """
    position = F.struct(*order)
    if condition is not None:
        position = F.when(condition, position)
    return F.min_by(F.struct(*columns), position)


def token_ratios(
    summary: DataFrame,
    keys: Sequence[str] = ("benchmark", "inspect_model_name"),
    base: str = "zero_shot",
    compared: Sequence[str] = ("zero_shot_cot", "five_shot"),
    order: Sequence[str] = ("task_args",),
) -> DataFrame:
    """Tokens of each compared schema over those of the base schema, per key; a missing side gives no row.

    The reference row and the compared rows are picked in one aggregate, so there is no self-join.
    """
    rows = summary.select(
        *keys,
        "prompt_schema",
        *order,
        F.col("mean_input_tokens").alias("input_tokens"),
        F.col("mean_output_tokens").alias("output_tokens"),
        (F.col("mean_input_tokens") + F.col("mean_output_tokens")).alias("total_tokens"),
    )
    schema = F.col("prompt_schema")
    picked = rows.groupBy(*keys).agg(
        first_row(TOKEN_KINDS, order, schema == base).alias("_base"),
        *[first_row(TOKEN_KINDS, order, schema == c).alias(f"_c{i}") for i, c in enumerate(compared)],
    )
    sides = F.array(*[F.struct(F.lit(c).alias("comparison"), F.col(f"_c{i}").alias("side")) for i, c in enumerate(compared)])
    return (
        picked.select(*keys, "_base", F.explode(sides).alias("_e"))
        .filter(F.col("_base").isNotNull() & F.col("_e.side").isNotNull())
        .select(
            *keys,
            F.col("_e.comparison").alias("comparison"),
            *[F.col(f"_base.{k}").alias(f"base_{k}") for k in TOKEN_KINDS],
            *[F.col(f"_e.side.{k}").alias(f"compared_{k}") for k in TOKEN_KINDS],
            *[ratio(F.col(f"_e.side.{k}"), F.col(f"_base.{k}")).alias(f"ratio_{k}") for k in TOKEN_KINDS],
        )
    )


def mean_token_ratios(ratios: DataFrame) -> DataFrame:
    return ratios.groupBy("comparison").agg(*[F.avg(f"ratio_{k}").alias(f"mean_ratio_{k}") for k in TOKEN_KINDS])


def fold_increase(
    summary: DataFrame,
    first_models: Sequence[str] = tuple(fixed.FIRST_MODELS),
    keys: Sequence[str] = ("benchmark",),
    model: str = "inspect_model_name",
    shown: str = "epoch_model_name",
    value: str = "mean_accuracy",
    order: Sequence[str] = ("inspect_model_name",),
) -> DataFrame:
    """Best row of each benchmark against the row of a first model; benchmarks without the first model are left out."""
    is_first = F.col(model).isin(list(first_models))
    tie = F.struct(-F.col(value), *order)
    return (
        summary.filter(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(
            F.min_by(value, F.when(is_first, F.struct(*order))).alias("first_accuracy"),
            F.min_by(F.struct(F.col(shown).alias("name"), F.col(value).alias("value")), tie).alias("_top"),
        )
        .filter(F.col("first_accuracy").isNotNull())
        .select(
            *keys,
            "first_accuracy",
            F.col("_top.name").alias("top_model"),
            F.col("_top.value").alias("top_accuracy"),
            ratio(F.col("_top.value"), F.col("first_accuracy")).alias("fold_increase"),
        )
    )


def mean_fold_increase(folds: DataFrame) -> DataFrame:
    return folds.agg(F.avg("fold_increase").alias("mean_fold_increase"))


def token_pivot(
    summary: DataFrame, benchmarks: Sequence[str], keys: Sequence[str] = ("prompt_schema", "inspect_model_name")
) -> DataFrame:
    """Mean tokens as integers, one pair of columns per benchmark; null where a model has no data."""
    pivoted = (
        summary.groupBy(*keys)
        .pivot("benchmark", list(benchmarks))
        .agg(
            truncate_int(F.avg("mean_input_tokens")).alias("input_tokens"),
            truncate_int(F.avg("mean_output_tokens")).alias("output_tokens"),
        )
    )
    return pivoted


def results_table(
    summary: DataFrame,
    benchmarks: Sequence[str] = tuple(fixed.BENCHMARK_DISPLAY.values()),
    keys: Sequence[str] = (
        "inspect_model_name", "epoch_model_name", "epoch_organization", "epoch_model_publication_date",
    ),
    column: str = "benchmark_display",
    order: Sequence[str] = ("task_args",),
) -> DataFrame:
    """Models as rows, benchmarks as columns, cells `m ± s` in percent; the first setting of a model counts.

    Mean and deviation come from one pivot, so no join of two pivots is needed. Null keys are dropped.
    """
    first = F.min_by(F.struct("mean_accuracy", "std_accuracy"), F.struct(*order))
    pivoted = (
        summary.dropna(subset=list(keys)).filter(F.col(column).isNotNull()).groupBy(*keys).pivot(column, list(benchmarks)).agg(first)
    )
    cells = [
        F.coalesce(
            format_mean_std(F.col(f"`{b}`")["mean_accuracy"], F.col(f"`{b}`")["std_accuracy"]), F.lit("")
        ).alias(b)
        for b in benchmarks
    ]
    return pivoted.select(*keys, *cells)


def sort_results_table(table: DataFrame) -> DataFrame:
    """Organisations alphabetically, newest model first."""
    return table.orderBy(F.col("epoch_organization").asc(), F.col("epoch_model_publication_date").desc())


def sort_by_effort(rows: DataFrame, keys: Sequence[str], effort: str, order: Sequence[str] = tuple(fixed.EFFORT_ORDER)) -> DataFrame:
    """Rows by key and, inside a key, from low to high effort; `place` is the position, rows of another effort come last."""
    place = F.array_position(F.array(*[F.lit(e) for e in order]), F.col(effort))
    ranked = rows.withColumn("place", F.when(place > 0, place - 1).cast("int"))
    return ranked.orderBy(*keys, F.col("place").asc_nulls_last())


def schema_pivot(
    summary: DataFrame, schemas: Sequence[str], keys: Sequence[str] = ("benchmark", "model_display")
) -> DataFrame:
    """Mean of accuracy, deviation and run count per prompt schema, as columns `<schema>_<measure>`."""
    return (
        summary.dropna(subset=list(keys))
        .groupBy(*keys)
        .pivot("prompt_schema", list(schemas))
        .agg(
            F.avg("mean_accuracy").alias("accuracy"),
            F.avg("std_accuracy").alias("std"),
            F.avg("num_runs").alias("runs"),
        )
    )


def schema_fold_ci(
    summary: DataFrame,
    base: str = "zero_shot",
    compared: Mapping[str, str] | None = None,
    keys: Sequence[str] = ("benchmark", "model_display"),
) -> DataFrame:
    """Fold change against the base schema with its interval. `compared` maps a schema to a column prefix."""
    compared = compared or {"five_shot": "five_shot", "zero_shot_cot": "cot"}
    wide = schema_pivot(summary, [base, *compared], keys)

    def part(schema: str) -> list[Column]:
        return [F.col(f"`{schema}_{m}`") for m in ("accuracy", "std", "runs")]

    columns = []
    for schema, prefix in compared.items():
        fold = fold_ci(*part(schema), *part(base))
        columns += [fold[f].alias(f"{prefix}_{f}") for f in ("ratio", "ci_low", "ci_high")]
    accuracies = [F.col(f"`{base}_accuracy`").alias("base_accuracy")]
    accuracies += [F.col(f"`{s}_accuracy`").alias(f"{p}_accuracy") for s, p in compared.items()]
    return wide.select(*keys, *columns, *accuracies)


def densify_grid(data: DataFrame, axes: Mapping[str, Sequence[str]]) -> DataFrame:
    """Every combination of the listed values, with nulls where `data` has no row.

    The lists are arguments of the caller, so the grid is built from literals.
    """
    grid = data.sparkSession.range(1)
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.drop("id").join(data, list(axes), "left")


def with_reasoning_category(
    summary: DataFrame, models: Mapping[str, tuple[str, str]] = fixed.REASONING_MODELS
) -> DataFrame:
    """Reasoning setting of the listed models, read from their arguments (`task_args_map`)."""
    kind = F.lit(None).cast("string")
    label = F.lit(None).cast("string")
    for name, (display, setting) in models.items():
        here = F.col("inspect_model_name") == name
        kind = F.when(here, F.lit(setting)).otherwise(kind)
        label = F.when(here, F.lit(display)).otherwise(label)
    tokens = map_get(F.col("task_args_map"), "reasoning_tokens").try_cast("double")
    effort = map_get(F.col("task_args_map"), "reasoning_effort")
    category = F.when(F.col("_kind") == "tokens", token_limit_category(tokens)).otherwise(effort_category(effort))
    return (
        summary.withColumns({"_kind": kind, "model": label})
        .filter(F.col("_kind").isNotNull())
        .withColumn("reasoning_category", category)
        .drop("_kind")
    )


def reasoning_effect(
    rows: DataFrame,
    keys: Sequence[str] = ("benchmark", "model", "reasoning_category"),
    order: Sequence[str] = ("task_args",),
) -> DataFrame:
    """Accuracy in percent and mean output tokens per question, by reasoning setting."""
    return (
        rows.groupBy(*keys)
        .agg(
            (F.avg("mean_accuracy") * 100).alias("mean_accuracy"),
            (F.avg("std_accuracy") * 100).alias("std_accuracy"),
            F.avg("mean_output_tokens").alias("mean_output_tokens"),
            F.min_by("total_samples", F.struct(*order)).alias("total_samples"),
        )
        .withColumn("tokens_per_question", ratio(F.col("mean_output_tokens"), F.col("total_samples")))
    )


def replicated_stats(
    runs: DataFrame, keys: Sequence[str], value: str = "accuracy", replicates: int = 10
) -> tuple[DataFrame, DataFrame]:
    """Mean and deviation of groups with exactly `replicates` runs, and the groups that were left out."""
    stats = (
        runs.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
            F.count(F.lit(1)).alias("num_results"),
        )
    )
    exact = F.col("num_results") == replicates
    return stats.filter(exact), stats.filter(~exact)


def accuracy_envelope(
    rows: DataFrame, group: str = "benchmark", series: str = "model", pad: float = 0.15
) -> DataFrame:
    """Axis range in percent per group: lowest mean - 2 deviations to highest mean + 2, padded, within 0 to 100."""
    spread = 2 * F.max("std_accuracy") * 100
    per_series = rows.groupBy(group, series).agg(
        (F.min("mean_accuracy") * 100 - spread).alias("_low"), (F.max("mean_accuracy") * 100 + spread).alias("_high")
    )
    padding = (F.col("_high") - F.col("_low")) * pad
    return (
        per_series.groupBy(group)
        .agg(F.min("_low").alias("_low"), F.greatest(F.max("_high"), F.lit(0.0)).alias("_high"))
        .select(
            group,
            F.greatest(F.lit(0.0), F.col("_low") - padding).alias("axis_low"),
            F.least(F.lit(100.0), F.col("_high") + padding).alias("axis_high"),
        )
    )


def date_span_check(
    rows: DataFrame, group: str, date: str, event_date: str, buffer: float = 0.1
) -> DataFrame:
    """Is the event date of a group within the span of its dates, widened by a tenth on both sides?"""
    day = F.unix_date(F.col(date).cast("date"))
    seconds = 86400
    spans = rows.groupBy(group).agg(
        F.min(day).alias("_first"),
        F.max(day).alias("_last"),
        F.max(F.unix_date(F.col(event_date).cast("date"))).alias("_event"),
    )
    margin = F.floor((F.col("_last") - F.col("_first")) * seconds * buffer)
    return spans.select(
        group,
        F.date_from_unix_date("_first").alias("first_date"),
        F.date_from_unix_date("_last").alias("last_date"),
        F.date_from_unix_date("_event").alias("event_date"),
        F.coalesce(
            (F.col("_event") * seconds).between(
                F.col("_first") * seconds - margin, F.col("_last") * seconds + margin
            ),
            F.lit(False),
        ).alias("is_within"),
    )


def baseline_lines(rows: DataFrame, group: str = "benchmark", baselines: str = "baselines") -> DataFrame:
    """Known baselines per group in long form: `(group, kind, value)`."""
    any_row = F.max(F.struct(F.col(f"{baselines}.expert"), F.col(f"{baselines}.non_expert"), F.col(f"{baselines}.random")))
    picked = rows.filter(F.col(baselines).isNotNull()).groupBy(group).agg(any_row.alias("_b"))
    kinds = F.array(
        F.struct(F.lit("Expert accuracy").alias("kind"), F.col("_b.expert").alias("value")),
        F.struct(F.lit("Non-expert accuracy").alias("kind"), F.col("_b.non_expert").alias("value")),
        F.struct(F.lit("Random guess").alias("kind"), F.col("_b.random").alias("value")),
    )
    return (
        picked.select(group, F.explode(kinds).alias("_k"))
        .select(group, F.col("_k.kind").alias("kind"), F.col("_k.value").alias("value"))
        .filter(F.col("value").isNotNull())
    )


def distinct_groups(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


# --- baselines computed from question sets ----------------------------------------------------


def random_baseline(distractor_count: Column) -> Column:
    """Mean chance of a guess among `distractors + 1` choices, 3 places half-even."""
    return F.bround(F.avg(1 / (distractor_count + 1).cast("double")), 3)


def multi_response_baseline(statement_count: Column) -> Column:
    """Mean chance of a guess among the non-empty subsets of n statements, 3 places half-even."""
    return F.bround(F.avg(F.try_divide(F.lit(1.0), F.pow(F.lit(2.0), statement_count.cast("double")) - 1)), 3)


def lab_bench_baselines(records: DataFrame) -> DataFrame:
    """Random accuracy per subset of a question set with distractors: `(benchmark, random)`."""
    name = F.concat(F.lit("lab-bench-"), F.lower("subset"))
    return records.groupBy(name.alias("benchmark")).agg(random_baseline(F.size("distractors")).alias("random"))


def statement_baselines(records: DataFrame) -> DataFrame:
    """Random accuracy of the statement questions, text-only and all: `(benchmark, random)`."""
    wide = records.select(
        F.size("answer_statements").alias("n"),
        F.explode(
            F.when(F.col("image_file").isNull(), F.array(F.lit("vct"), F.lit("vct_images"))).otherwise(
                F.array(F.lit("vct_images"))
            )
        ).alias("benchmark"),
    )
    return wide.groupBy("benchmark").agg(multi_response_baseline(F.col("n")).alias("random"))


def array_length_stats(rows: DataFrame, column: str = "answer_statements") -> DataFrame:
    """Total, smallest and largest array size; a missing array counts as 0. No rows give nulls."""
    size = F.coalesce(F.array_size(F.col(column)), F.lit(0)).cast("bigint")
    return rows.agg(
        F.sum(size).alias("total_items"), F.min(size).alias("min_items"), F.max(size).alias("max_items")
    )
