"""Configuration and question sets to prompt rows."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewise import fixed_values as fixed
from gradewise.operators.prompts import augmented, build_prompts, query_with_choices
from gradewise.operators.retrieval import TOP_K, contexts, retrieve
from gradewise.operators.samples import expand_subsets, filter_subtask, repeated_ids, text_only, to_samples
from gradewise.operators.sampling import SEED, sample_exact
from gradewise.operators.validate import checked_request
from gradewise.sources.questions import read_jsonl, read_question_set, valid_lines

GROUPS = {"mmlu": {"biology": fixed.MMLU_BIOLOGY}}
ALL_SUBSETS = {
    "gpqa": fixed.GPQA_SUBSETS,
    "mmlu": fixed.MMLU_SUBSETS,
    "lab_bench": fixed.LAB_BENCH_SUBSETS,
    "wmdp": fixed.WMDP_SUBSETS,
    "pubmedqa": fixed.PUBMEDQA_SUBSETS,
}


def prepare_samples(
    spark,
    root: str,
    benchmark: str,
    subset: str | Sequence[str] | None = None,
    subtasks: str | Sequence[str] | None = None,
    split: str | None = None,
    samples: int | None = None,
    mode: str | None = None,
    seed: int = SEED,
    images: str = "images",
) -> DataFrame:
    """Uniform sample rows of one benchmark after subset, subtask and size selection.

    What is not given takes the benchmark's declared default; a name that is not declared is an error, as is an id that two records
    share, since prompts and examples are joined by it.
    """
    args = checked_request(
        spark, benchmark, {"subset": subset, "subtasks": subtasks, "split": split, "samples": samples, "mode": mode}
    )
    parts = _listed(args.get("subtasks"))
    if benchmark == "vct":
        records = valid_lines(read_jsonl(spark, root))
        if parts == ["no_images"]:
            records = text_only(records)
    else:
        wanted = parts if benchmark == "mmlu" and parts else _listed(args.get("subset"))
        names = expand_subsets(wanted, ALL_SUBSETS[benchmark], GROUPS.get(benchmark)) if wanted else None
        records = read_question_set(spark, root, benchmark, names, args.get("split"))
    rows = to_samples(benchmark, records, args.get("mode", "mc"), images)
    if benchmark == "gpqa" and parts:
        rows = filter_subtask(rows, F.col("metadata")["High-level domain"], parts)
    if benchmark == "mmlu_pro" and parts and "all" not in parts:
        rows = filter_subtask(rows, F.col("metadata")["category"], parts, ignore_case=True, required=True)
    shared = repeated_ids(rows).first()
    if shared is not None:
        raise ValueError(f"{benchmark}: {shared['n_rows']} records have the id {shared['id']!r}")
    return sample_exact(rows, "id", int(args["samples"]) if "samples" in args else None, seed)


def _listed(names: str | None) -> list[str]:
    """One name, or the JSON text of a list of names, as a list."""
    if not names:
        return []
    return json.loads(names) if names.lstrip().startswith("[") else [names]


def prepare_prompts(samples: DataFrame, cot: bool = False, n_shot: int = 0, seed: int = SEED) -> DataFrame:
    return build_prompts(samples, cot, n_shot, seed)


def prepare_retrieved_prompts(
    samples: DataFrame,
    corpus: DataFrame,
    tool: str = "lexical",
    k: int = TOP_K,
    block: Column | None = None,
    cot: bool = False,
    n_shot: int = 0,
    seed: int = SEED,
    **options,
) -> DataFrame:
    """Prompts with retrieved context before the question. Each question is searched with its choices.

    `corpus` has `doc_id` and the columns that `block` renders; `options` go to the retriever (see `operators.retrieval`).
    """
    asked = samples.select(F.col("id").alias("question_id"), query_with_choices(F.col("input"), F.col("choices")).alias("input"))
    if tool == "vector":
        asked = asked.join(samples.select(F.col("id").alias("question_id"), options.get("vector", "embedding")), "question_id")
    found = contexts(asked, retrieve(tool, asked, corpus, k=k, **options), corpus, block=block, k=k)
    prompts = build_prompts(samples, cot, n_shot, seed)
    context = found.select(F.col("question_id").alias("id"), "context")
    return prompts.join(context, "id").withColumn("prompt", augmented(F.col("context"), F.col("prompt"))).drop("context")
