"""Checks of requested arguments, and the run matrix of a configuration."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewise import fixed_values as fixed
from gradewise.functions.literals import drop_keys, merge_settings
from gradewise.operators.retrieval import RETRIEVER_ALIASES, RETRIEVERS
from gradewise.operators.samples import MAPPERS
from gradewise.operators.sizes import is_small

CONTROL_KEYS = ("enabled", "runs")
#: Rows of models or benchmarks that are sent whole to the other side of the run matrix.
SENT_ROWS = 20_000


@dataclass(frozen=True)
class Argument:
    """One declared argument: its allowed values, default, and a rewrite of valid values."""

    choices: Sequence[str] = ()
    default: str | None = None
    pattern: str | None = None
    rewrite: Callable[[Column], Column] | None = None
    many: bool = False
    all_word: bool = False


@dataclass(frozen=True)
class ArgumentSet:
    """Declared arguments of one benchmark."""

    arguments: Mapping[str, Argument] = field(default_factory=dict)


def _common(splits: Sequence[str], default_split: str) -> dict[str, Argument]:
    return {
        "split": Argument(choices=splits, default=default_split),
        "samples": Argument(pattern=r"\d+"),
        "n_shot": Argument(pattern=r"\d+", default="0"),
        "cot": Argument(choices=("true", "false"), default="false", rewrite=F.lower),
    }


ARGUMENTS: dict[str, ArgumentSet] = {
    "gpqa": ArgumentSet(
        {
            **_common(fixed.SPLITS["gpqa"], "train"),
            "subset": Argument(choices=fixed.GPQA_SUBSETS, default="gpqa_main"),
            "subtasks": Argument(choices=fixed.GPQA_SUBTASKS, many=True),
        }
    ),
    "mmlu": ArgumentSet(
        {
            **_common(fixed.SPLITS["mmlu"], "test"),
            "subset": Argument(choices=fixed.MMLU_SUBSETS, default="all", all_word=True),
            "subtasks": Argument(choices=("biology",)),
        }
    ),
    "mmlu_pro": ArgumentSet(
        {
            **_common(fixed.SPLITS["mmlu_pro"], "test"),
            "subtasks": Argument(choices=fixed.MMLU_PRO_SUBTASKS, default="biology", many=True, all_word=True),
        }
    ),
    "lab_bench": ArgumentSet(
        {
            **_common(fixed.SPLITS["lab_bench"], "train"),
            "subset": Argument(choices=fixed.LAB_BENCH_SUBSETS, default="all", all_word=True),
        }
    ),
    "wmdp": ArgumentSet(
        {
            **_common(fixed.SPLITS["wmdp"], "test"),
            "subset": Argument(choices=fixed.WMDP_SUBSETS, default="wmdp-bio"),
        }
    ),
    "pubmedqa": ArgumentSet(
        {
            **_common(fixed.SPLITS["pubmedqa"], "test"),
            "subset": Argument(choices=fixed.PUBMEDQA_SUBSETS, default=fixed.PUBMEDQA_SUBSETS[0], all_word=True),
        }
    ),
    "vct": ArgumentSet(
        {
            **_common(fixed.SPLITS["vct"], "all"),
            "mode": Argument(choices=("mc", "mr"), default="mc"),
            "subtasks": Argument(choices=fixed.VCT_SUBTASKS, default="all"),
        }
    ),
}


def requested_values(value: Column) -> Column:
    """One name, or the JSON text of a list of names, as an array."""
    return F.when(value.rlike(r"^\s*\["), F.from_json(value, "array<string>")).otherwise(F.array(value))


def invalid_values(requested: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requested rows without a match among the allowed rows."""
    return requested.join(allowed, list(keys), "left_anti")


def argument_problems(requests: DataFrame, declared: Mapping[str, ArgumentSet] = ARGUMENTS) -> DataFrame:
    """Invalid arguments of `requests(benchmark, args map)`: `(benchmark, argument, value, problem)`.

    The declared arguments are literals of the code, a row per benchmark and name; they are sent to the requests, which are
    read once and never moved.
    """
    rows = []
    for benchmark, group in declared.items():
        for name, argument in group.arguments.items():
            allowed = [*argument.choices, *(["all"] if argument.all_word or argument.many else [])] if argument.choices else None
            rows.append((benchmark, name, allowed, argument.pattern))
    known = requests.sparkSession.createDataFrame(
        rows, "benchmark string, argument string, _allowed array<string>, _pattern string"
    ).withColumn("_known", F.lit(True))
    given = (
        requests.select("benchmark", F.explode("args").alias("argument", "text"))
        .filter(F.col("text").isNotNull())
        .withColumn("value", F.explode(requested_values(F.col("text"))))
        .select("benchmark", "argument", F.when(F.col("argument") == "cot", F.lower("value")).otherwise(F.col("value")).alias("value"))
    )
    fits = F.rlike(F.col("value"), F.concat(F.lit("^("), F.col("_pattern"), F.lit(")$")))
    outside = F.col("_allowed").isNotNull() & ~F.coalesce(F.array_contains("_allowed", F.col("value")), F.lit(False))
    problem = (
        F.when(F.col("_known").isNull(), "unknown argument")
        .when(outside, "not an allowed value")
        .when(~fits, "wrong type")
    )
    checked = given.join(F.broadcast(known), ["benchmark", "argument"], "left")
    return checked.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select("benchmark", "argument", "value", "problem")


def checked_request(spark: SparkSession, benchmark: str, args: Mapping[str, str | Sequence[str] | int | None]) -> dict[str, str]:
    """The arguments of one request as a run uses them, defaults filled in; a bad name or value is an error."""
    text = lambda v: v if isinstance(v, str) else json.dumps(list(v)) if isinstance(v, (list, tuple)) else str(v)
    given = {k: text(v) for k, v in args.items() if v is not None}
    request = spark.createDataFrame([(benchmark, given)], "benchmark string, args map<string,string>")
    problems = [f"{r.argument}={r.value}: {r.problem}" for r in argument_problems(request).collect()]
    if problems:
        raise ValueError(f"{benchmark}: {'; '.join(sorted(problems))}")
    return complete_arguments(request).first()["args"]


def with_defaults(requests: DataFrame, declared: Mapping[str, ArgumentSet] = ARGUMENTS) -> DataFrame:
    """Arguments completed by the declared defaults; given values win."""
    rows = [
        (b, {n: a.default for n, a in group.arguments.items() if a.default is not None})
        for b, group in declared.items()
    ]
    defaults = requests.sparkSession.createDataFrame(rows, "benchmark string, _defaults map<string,string>")
    return (
        requests.join(F.broadcast(defaults), "benchmark", "left")  # one row per declared benchmark
        .withColumn("args", merge_settings(F.col("_defaults"), F.col("args")))
        .drop("_defaults")
    )


def _with_rewritten(arguments: Column, name: str, rewrite: Callable[[Column], Column]) -> Column:
    return F.transform_values(arguments, lambda k, v: F.when(k == name, rewrite(v)).otherwise(v))


def complete_arguments(requests: DataFrame, declared: Mapping[str, ArgumentSet] = ARGUMENTS) -> DataFrame:
    """Arguments as a run uses them: defaults filled in, `all` or nothing expanded to the full list, values rewritten."""
    rows = [
        (b, {n: json.dumps(list(a.choices)) for n, a in group.arguments.items() if a.all_word or a.many})
        for b, group in declared.items()
    ]
    lists = requests.sparkSession.createDataFrame(rows, "benchmark string, _lists map<string,string>")
    full = with_defaults(requests, declared).join(F.broadcast(lists), "benchmark", "left")  # a row per declared set
    listed = F.coalesce(F.col("_lists"), F.create_map().cast("map<string,string>"))
    asked = F.transform_values(
        "args", lambda k, v: F.when(v.isin("all", "[]", ""), F.coalesce(F.try_element_at(listed, k), v)).otherwise(v)
    )
    full = full.withColumn("args", merge_settings(listed, asked)).drop("_lists")
    rewrites: Column | None = None
    for benchmark, group in declared.items():
        for name, argument in group.arguments.items():
            if argument.rewrite is not None:
                here = F.col("benchmark") == benchmark
                changed = _with_rewritten(F.col("args"), name, argument.rewrite)
                rewrites = F.when(here, changed) if rewrites is None else rewrites.when(here, changed)
    return full if rewrites is None else full.withColumn("args", rewrites.otherwise(F.col("args")))


def retriever_problems(models: DataFrame, known: Sequence[str] = (*RETRIEVERS, *RETRIEVER_ALIASES)) -> DataFrame:
    """Models whose enabled retrieval names no tool, or one that is not registered: `(model_key, tool, problem)`."""
    rag = F.from_json("rag", "enabled boolean, tool string")
    read = models.select("model_key", rag["enabled"].alias("enabled"), rag["tool"].alias("tool")).filter("enabled")
    problem = F.when(F.col("tool").isNull(), F.lit("no tool")).when(
        ~F.col("tool").isin(list(known)), F.lit("unknown tool")
    )
    return read.select("model_key", "tool", problem.alias("problem")).filter(F.col("problem").isNotNull())


def known_benchmarks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in MAPPERS], "benchmark string")


def enabled_benchmarks(benchmarks: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Enabled and known benchmarks, and the enabled ones that are unknown. Enabled is the default."""
    wanted = benchmarks.filter(F.coalesce(F.col("enabled"), F.lit(True)))
    return wanted.join(known, "benchmark", "left_semi"), wanted.join(known, "benchmark", "left_anti")


def run_matrix(benchmarks: DataFrame, models: DataFrame) -> DataFrame:
    """One row per benchmark, model and run number, with arguments and settings attached.

    `models(model_key, model, default_settings, settings, rag)` and `benchmarks(benchmark, runs, args)` may be of any size; every
    benchmark is asked for every model, so the output is their product by its meaning. A side of at most `SENT_ROWS` rows is sent to the other, which is
    not moved. Where both are larger, the larger side is dealt over as many keys as a shuffle has partitions and the smaller one is repeated once per
    key, which makes it an ordinary join that no task holds alone.
    """
    runs = F.greatest(F.coalesce(F.col("runs"), F.lit(1)), F.lit(0))
    wanted = benchmarks.withColumn("_runs", runs).filter(F.col("_runs") > 0).select("benchmark", drop_keys(F.col("args"), *CONTROL_KEYS).alias("args"), "_runs")
    entries = models.select("model_key", "model", merge_settings(F.col("default_settings"), F.col("settings")).alias("settings"), "rag")
    if is_small(models, SENT_ROWS):
        pairs = wanted.crossJoin(F.broadcast(entries))
    elif is_small(wanted, SENT_ROWS):
        pairs = entries.crossJoin(F.broadcast(wanted))
    else:
        parts = max(1, int(models.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))
        sides = [(wanted, F.xxhash64("benchmark", F.map_entries("args"))), (entries, F.xxhash64("model_key", "model"))]
        if wanted.count() < entries.count():
            sides.reverse()
        (large, key), (small, _) = sides
        dealt = large.withColumn("_part", F.pmod(key, F.lit(parts).cast("bigint")))
        pairs = dealt.join(small.withColumn("_part", every), "_part")
    return (
        pairs.withColumn("run", F.explode(F.sequence(F.lit(1), F.col("_runs").cast("int"))))
        .select("benchmark", "model_key", "model", "run", "args", "settings", "rag")
    )
