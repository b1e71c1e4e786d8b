"""Explicit schemas for every source, as DDL text; nothing is inferred."""

from __future__ import annotations

# --- question sets (one per benchmark) -------------------------------------------------------

GPQA = (
    "`Record ID` string, Question string, `Correct Answer` string, `Incorrect Answer 1` string, "
    "`Incorrect Answer 2` string, `Incorrect Answer 3` string, `High-level domain` string, Subdomain string, "
    "Explanation string, `Self-reported question-writing time (minutes)` string, "
    "`Expert Validator Accuracy` string, `Non-Expert Validator Accuracy` string"
)
MMLU = ("question string, choices array<string>, answer int, subject string")
WMDP = ("question string, choices array<string>, answer int")
LAB_BENCH = (
    "id string, subtask string, question string, ideal string, distractors array<string>, protocol string, "
    "sources array<string>, `key-passage` string"
)
PUBMEDQA = (
    "id string, document_id string, type string, question string, context string, choices array<string>, "
    "answer array<string>"
)
MMLU_PRO = (
    "question_id bigint, question string, options array<string>, answer string, category string, "
    "cot_content string, src string"
)
VCT = (
    "question_id string, question string, answer_statements array<struct<statement:string,is_correct:boolean>>, "
    "answer_options array<struct<answer_statement_indices:array<int>,is_correct:boolean>>, image_file string, "
    "image_citation string, expert_approvals string, method string, explanation string, rubric_elements string, "
    "baselining string, canary_string string"
)

QUESTION_SETS = {
    "gpqa": GPQA,
    "mmlu": MMLU,
    "wmdp": WMDP,
    "lab_bench": LAB_BENCH,
    "pubmedqa": PUBMEDQA,
    "mmlu_pro": MMLU_PRO,
    "vct": VCT,
}

# The uniform row every question set is mapped to.
SAMPLE = (
    "benchmark string, subset string, id string, input string, target array<string>, is_multi boolean, "
    "choices array<string>, metadata map<string,string>"
)

# --- run logs --------------------------------------------------------------------------------
# `content` and `target` are strings on purpose: a JSON list arrives as its text, a string as itself.

LOG = (
    "status string, "
    "eval struct<task:string, task_args:map<string,string>, model:string, run_id:string, created:string, "
    "dataset:struct<samples:bigint>>, "
    "plan struct<config:map<string,string>>, "
    "results struct<total_samples:bigint, completed_samples:bigint, scores:array<struct<name:string, "
    "metrics:struct<accuracy:struct<value:double>, stderr:struct<value:double>>>>>, "
    "stats struct<completed_at:string, model_usage:map<string,struct<input_tokens:bigint,output_tokens:bigint,"
    "total_tokens:bigint>>>, "
    "samples array<struct<id:string, input:string, target:string, "
    "messages:array<struct<role:string,content:string>>, "
    "output:struct<choices:array<struct<message:struct<content:string>>>>, "
    "scores:struct<choice:struct<answer:string,explanation:string>>>>"
)

RUN = (
    "inspect_model_name string, task string, task_args string, prompt_schema string, total_samples bigint, "
    "accuracy double, stderr double, total_tokens bigint, input_tokens bigint, output_tokens bigint, run_id string, "
    "eval_start_time timestamp, eval_end_time timestamp, results_generated_time timestamp, filename string, "
    "cot_scoring boolean"
)

# --- dimensions ------------------------------------------------------------------------------

MODEL_PRICES = (
    "inspect_model_name string, epoch_model_name string, cost_per_M_tokens string, input_cost_per_M_tokens string, "
    "output_cost_per_M_tokens string, cost_source string, api_source string, last_updated date"
)
MODEL_PRICES_OLD = (
    "inspect_model_name string, epoch_model_name string, biggest_in_class int, cost_per_M_tokens string, "
    "input_cost_per_M_tokens string, output_cost_per_M_tokens string, cost_source string, api_source string, "
    "last_updated date"
)
MODEL_METADATA = {
    "Model": "string",
    "Organization": "string",
    "Publication date": "date",
    "Parameters": "double",
    "Training compute (FLOP)": "double",
}
BASELINES_TYPE = "struct<expert:double,non_expert:double,random:double>"
ARTICLE = (
    "MedlineCitation struct<PMID:struct<_VALUE:string>,"
    "Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<string>>>>"
)

SUMMARY = (
    "path string, inspect_model_name string, epoch_model_name string, epoch_model_publication_date date, "
    "epoch_organization string, epoch_parameters double, epoch_training_compute_flop double, benchmark string, "
    "benchmark_publication_date date, task_args string, prompt_schema string, total_samples bigint, "
    "mean_accuracy double, std_accuracy double, baselines string, mean_input_tokens bigint, "
    "mean_output_tokens bigint, num_runs bigint, filenames string"
)
SUMMARY_WITH_COST = (
    "path string, inspect_model_name string, epoch_model_name string, epoch_model_publication_date date, "
    "epoch_organization string, epoch_parameters double, epoch_training_compute_flop double, benchmark string, "
    "benchmark_publication_date date, task_args string, prompt_schema string, total_samples bigint, "
    "mean_accuracy double, std_accuracy double, baselines string, mean_input_tokens bigint, "
    "mean_output_tokens bigint, est_tot_cost double, cost_source_date date, num_runs bigint, filenames string"
)
