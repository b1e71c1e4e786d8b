"""Sample preparation, prompt, configuration, text and retrieval queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewise import fixed_values as fixed
from gradewise.functions import dates, literals
from gradewise.functions.labels import letter_index
from gradewise.operators import prompts, retrieval, samples, sampling, scoring, validate
from gradewise.plans.catalog import Tables, big, query, text_of
from gradewise.sources import questions

# --- question sets ---------------------------------------------------------------------------


def _part_questions(t: Tables):
    """Parts as records with one correct and three other answers."""
    blank = F.lit(None).cast("string")
    return t.part.select(
        text_of(F.col("p_partkey")).alias("Record ID"),
        F.concat(F.lit("Name of part "), text_of(F.col("p_partkey")), F.lit("?")).alias("Question"),
        F.col("p_name").alias("Correct Answer"),
        F.col("p_brand").alias("Incorrect Answer 1"),
        F.col("p_type").alias("Incorrect Answer 2"),
        F.concat(F.lit("size "), text_of(F.col("p_size"))).alias("Incorrect Answer 3"),
        F.col("p_type").alias("High-level domain"),
        F.col("p_brand").alias("Subdomain"),
        blank.alias("Explanation"),
        blank.alias("Self-reported question-writing time (minutes)"),
        blank.alias("Expert Validator Accuracy"),
        blank.alias("Non-Expert Validator Accuracy"),
    )


@query(
    "shuffle_choices",
    """
WITH c AS (SELECT p_partkey, p_name, [p_name, p_brand, p_type, 'size ' || p_size::VARCHAR] AS choices FROM part),
s AS (SELECT p_partkey, p_name, list_transform(list_sort(list_transform(choices,
        lambda v, i: {'h': md5('42|' || p_partkey::VARCHAR || '|' || (i - 1)::VARCHAR), 'p': i, 'c': v})), lambda x: x.c) AS choices
      FROM c)
SELECT p_partkey::VARCHAR AS id, array_to_string(choices, '|') AS choices,
       chr((64 + list_position(choices, p_name))::INT) AS target, (list_position(choices, p_name) - 1)::BIGINT AS target_index
FROM s
""",
)
def shuffle_choices(t: Tables):
    rows = samples.samples_gpqa(_part_questions(t))
    return rows.select(
        "id",
        F.array_join("choices", "|").alias("choices"),
        F.get("target", F.lit(0)).alias("target"),
        big(letter_index(F.get("target", F.lit(0)))).alias("target_index"),
    )


@query(
    "indexed_answer",
    """
SELECT 'order ' || o_orderkey::VARCHAR AS input, chr((65 + o_orderkey % 4)::INT) AS target, o_orderstatus AS subject,
       o_orderpriority || '|' || o_orderstatus || '|x|y' AS choices FROM orders
""",
)
def indexed_answer(t: Tables):
    records = t.orders.select(
        F.concat(F.lit("order "), text_of(F.col("o_orderkey"))).alias("question"),
        F.array(F.col("o_orderpriority"), F.col("o_orderstatus"), F.lit("x"), F.lit("y")).alias("choices"),
        (F.col("o_orderkey") % 4).cast("int").alias("answer"),
        F.col("o_orderstatus").alias("subject"),
    )
    rows = samples.samples_mmlu(records)
    return rows.select(
        "input",
        F.get("target", F.lit(0)).alias("target"),
        F.col("metadata")["subject"].alias("subject"),
        F.array_join("choices", "|").alias("choices"),
    )


@query(
    "yes_no_answer",
    """
SELECT doc_id::VARCHAR AS id, md5('Context: ' || text || chr(10) || chr(10) || 'Question: Is it ' || lang || '?') AS input_digest,
       CASE lang WHEN 'en' THEN 'A' WHEN 'de' THEN 'B' WHEN 'fr' THEN 'C' END AS target, lang AS type
FROM documents
""",
)
def yes_no_answer(t: Tables):
    answer = F.element_at(
        F.create_map(F.lit("en"), F.lit("Yes"), F.lit("de"), F.lit("no"), F.lit("fr"), F.lit("MAYBE"), F.lit("es"), F.lit("?")),
        F.col("lang"),
    )
    records = t.documents.select(
        text_of(F.col("doc_id")).alias("id"),
        F.col("source").alias("document_id"),
        F.col("lang").alias("type"),
        F.concat(F.lit("Is it "), "lang", F.lit("?")).alias("question"),
        F.col("text").alias("context"),
        F.array(F.lit("yes"), F.lit("no"), F.lit("maybe")).alias("choices"),
        F.array(answer).alias("answer"),
    )
    return samples.samples_pubmedqa(records).select(
        "id",
        F.md5("input").alias("input_digest"),
        F.get("target", F.lit(0)).alias("target"),
        F.col("metadata")["type"].alias("type"),
    )


@query(
    "category_samples",
    """
SELECT conv_id::VARCHAR AS id, turn::VARCHAR AS src, md5(text) AS input_digest, lower(role) AS category
FROM conversations WHERE role IN ('assistant', 'system')
""",
)
def category_samples(t: Tables):
    """Rows of listed categories, whatever their case."""
    records = t.conversations.select(
        F.col("conv_id").alias("question_id"),
        F.col("text").alias("question"),
        F.array(F.lit("a"), F.lit("b")).alias("options"),
        F.lit("A").alias("answer"),
        F.initcap("role").alias("category"),
        F.lit("").alias("cot_content"),
        text_of(F.col("turn")).alias("src"),
    )
    rows = samples.samples_mmlu_pro(records)
    kept = samples.filter_subtask(rows, F.col("metadata")["category"], ["assistant", "system"], ignore_case=True)
    return kept.select(
        "id",
        F.col("metadata")["src"].alias("src"),
        F.md5("input").alias("input_digest"),
        F.lower(F.col("metadata")["category"]).alias("category"),
    )


def _part_statements(t: Tables):
    """Parts as records with three statements and three options; the low bits of the size mark what is correct."""
    def bit(b):
        return F.expr(f"(p_size & {1 << b}) <> 0")

    def statement(text, b):
        return F.struct(text.alias("statement"), bit(b).alias("is_correct"))

    def option(indices, b):
        return F.struct(
            F.array(*[F.lit(i) for i in indices]).alias("answer_statement_indices"), bit(b).alias("is_correct")
        )

    others = [c for c in samples.VCT_METADATA if c not in ("question_id", "image_file")]
    return t.part.select(
        text_of(F.col("p_partkey")).alias("question_id"),
        F.concat(F.lit("About "), "p_name", F.lit(" \n")).alias("question"),
        F.array(
            statement(F.col("p_name"), 0), statement(F.col("p_brand"), 1), statement(F.col("p_type"), 2)
        ).alias("answer_statements"),
        F.array(option([0], 0), option([0, 2], 1), option([1, 2], 3)).alias("answer_options"),
        F.when(F.col("p_size") > 25, F.concat("p_brand", F.lit(".png"))).alias("image_file"),
        *[F.lit("").alias(c) for c in others],
    )


@query(
    "statements_single",
    """
SELECT p_partkey::VARCHAR AS id,
       'About ' || p_name || chr(10) || chr(10) || 'Statement 1: ' || p_name || chr(10) || 'Statement 2: ' || p_brand || chr(10)
         || 'Statement 3: ' || p_type || chr(10) AS input,
       'Statement 1|Statement 1 + Statement 3|Statement 2 + Statement 3' AS choices,
       CASE WHEN p_size & 8 <> 0 THEN 'C' WHEN p_size & 2 <> 0 THEN 'B' WHEN p_size & 1 <> 0 THEN 'A' END AS target,
       CASE WHEN p_size > 25 THEN 'images/' || p_brand || '.png' END AS image_path
FROM part
""",
)
def statements_single(t: Tables):
    rows = samples.samples_statements_mc(_part_statements(t))
    return rows.select(
        "id",
        "input",
        F.array_join("choices", "|").alias("choices"),
        F.get("target", F.lit(0)).alias("target"),
        F.col("metadata")["image_path"].alias("image_path"),
    )


@query(
    "statements_multiple",
    """
SELECT p_partkey::VARCHAR AS id, 'About ' || p_name AS input, p_name || '|' || p_brand || '|' || p_type AS choices,
       array_to_string(list_filter([CASE WHEN p_size & 1 <> 0 THEN 'A' END, CASE WHEN p_size & 2 <> 0 THEN 'B' END,
                                    CASE WHEN p_size & 4 <> 0 THEN 'C' END], lambda x: x IS NOT NULL), ',') AS target
FROM part WHERE p_size <= 25
""",
)
def statements_multiple(t: Tables):
    """Text-only records; every statement is a choice."""
    rows = samples.samples_statements_mr(samples.text_only(_part_statements(t)))
    return rows.select(
        "id", "input", F.array_join("choices", "|").alias("choices"), F.array_join("target", ",").alias("target")
    )


@query(
    "protocol_input",
    """
WITH c AS (SELECT doc_id, text, lang, source || '_' || doc_id::VARCHAR AS id, n_chars::VARCHAR AS ideal,
                  [source, lang, n_chars::VARCHAR] AS choices FROM documents),
s AS (SELECT *, list_transform(list_sort(list_transform(choices,
        lambda v, i: {'h': md5('42|' || id || '|' || (i - 1)::VARCHAR), 'p': i, 'c': v})), lambda x: x.c) AS shuffled FROM c)
SELECT id, md5('Protocol:' || chr(10) || text || chr(10) || chr(10) || 'Question:' || chr(10) || 'Length in ' || lang || '?') AS input_digest,
       array_to_string(shuffled, '|') AS choices, chr((64 + list_position(shuffled, ideal))::INT) AS target
FROM s
""",
)
def protocol_input(t: Tables):
    records = t.documents.select(
        text_of(F.col("doc_id")).alias("id"),
        F.col("source").alias("subtask"),
        F.concat(F.lit("Length in "), "lang", F.lit("?")).alias("question"),
        text_of(F.col("n_chars")).alias("ideal"),
        F.array("source", "lang").alias("distractors"),
        F.col("text").alias("protocol"),
        F.array().cast("array<string>").alias("sources"),
    )
    rows = samples.samples_protocol(records)
    return rows.select(
        "id",
        F.md5("input").alias("input_digest"),
        F.array_join("choices", "|").alias("choices"),
        F.get("target", F.lit(0)).alias("target"),
    )


@query(
    "first_match",
    """
WITH p AS (SELECT page_id, string_split(url, '/') AS parts FROM pages)
SELECT page_id, list_filter(parts, lambda x: regexp_matches(x, '^[0-9]'))[1] AS first_number,
       nullif(list_position(parts, list_filter(parts, lambda x: regexp_matches(x, '^[0-9]'))[1]) - 1, -1)::BIGINT AS first_position
FROM p
""",
)
def first_match(t: Tables):
    """First path part that begins with a digit, and where it stands."""
    parts = F.split("url", "/")
    hit = scoring.first_match(parts, lambda p: p.rlike("^[0-9]"))
    return t.pages.select("page_id", hit.alias("first_number"), big(F.array_position(parts, hit) - 1).alias("first_position"))


# --- sampling and prompts --------------------------------------------------------------------


@query(
    "sample_exact",
    "SELECT doc_id, lang, n_chars FROM documents ORDER BY md5('42|' || doc_id::VARCHAR), doc_id LIMIT 50",
)
def sample_exact(t: Tables):
    return sampling.sample_exact(t.documents.select("doc_id", "lang", "n_chars"), "doc_id", 50)


@query(
    "sample_exact_large",
    "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('42|' || o_orderkey::VARCHAR), o_orderkey LIMIT 12000",
)
def sample_exact_large(t: Tables):
    return sampling.sample_exact(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", 12_000)


def _document_samples(t: Tables):
    return t.documents.select(
        F.lit("docs").alias("benchmark"),
        text_of(F.col("doc_id")).alias("id"),
        F.col("text").alias("input"),
        F.array(F.when(F.col("lang") == "en", F.lit("A")).otherwise(F.lit("B"))).alias("target"),
        (F.col("lang") == "fr").alias("is_multi"),
        F.array("lang", "source").alias("choices"),
    )


_RING_SQL = """
s AS (SELECT doc_id::VARCHAR AS id, text, md5('42|' || text) AS td, md5('42|' || doc_id::VARCHAR) AS idd,
             text || chr(10) || chr(10) || 'A) ' || lang || chr(10) || 'B) ' || source || chr(10) || chr(10)
               || 'ANSWER: ' || CASE WHEN lang = 'en' THEN 'A' ELSE 'B' END AS example FROM documents),
r AS (SELECT *, row_number() OVER (ORDER BY td, idd, id) - 1 AS pos, count(*) OVER () AS n,
             count(*) OVER (PARTITION BY td) AS rr, ('0x' || substr(idd, 1, 13))::BIGINT AS draw FROM s),
q AS (SELECT *, min(pos) OVER (PARTITION BY td) AS rs FROM r),
w AS (SELECT id, k, (rs + rr + (draw + k - 1) % (n - rr)) % n AS pos FROM q, range(1, 4) g(k) WHERE k <= n - rr)
"""


@query(
    "fewshot_pairs",
    f"WITH {_RING_SQL} SELECT w.id, k::INT AS rank, q.id AS example_id FROM w JOIN q USING (pos)",
)
def fewshot_pairs(t: Tables):
    """Three other documents for each document, never one with the same text."""
    return sampling.fewshot_pairs(_document_samples(t), 3)


@query(
    "fewshot_examples",
    f"""
WITH {_RING_SQL}
SELECT w.id, md5(string_agg(q.example, chr(10) || chr(10) ORDER BY k)) AS examples_digest
FROM w JOIN q USING (pos) GROUP BY w.id
""",
)
def fewshot_examples(t: Tables):
    example = prompts.render_example(F.col("input"), F.col("choices"), F.col("target"))
    rows = sampling.fewshot_examples(_document_samples(t), 3, example)
    return rows.select("id", F.md5("examples").alias("examples_digest"))


def _template_sql(template: str) -> str:
    text = template.replace("'", "''")
    for slot, value in (
        ("letters", "' || 'A,B' || '"),
        ("question", "' || text || '"),
        ("choices", "' || choices || '"),
    ):
        text = text.replace("{" + slot + "}", value)
    return "'" + text.replace("\n", "' || chr(10) || '") + "'"


@query(
    "render_prompt",
    f"""
WITH d AS (SELECT doc_id, lang, text, 'A) ' || lang || chr(10) || 'B) ' || source AS choices, n_chars % 3 AS s FROM documents),
p AS (SELECT doc_id, s, CASE WHEN s = 0 AND lang = 'fr' THEN {_template_sql(fixed.MULTIPLE_ANSWER_COT)}
                        WHEN s = 0 THEN {_template_sql(fixed.SINGLE_ANSWER_COT)}
                        WHEN lang = 'fr' THEN {_template_sql(fixed.MULTIPLE_ANSWER)}
                        ELSE {_template_sql(fixed.SINGLE_ANSWER)} END AS prompt FROM d)
SELECT doc_id::VARCHAR AS id, CASE s WHEN 0 THEN 'zero_shot_cot' ELSE 'zero_shot' END AS prompt_schema,
       length(prompt)::BIGINT AS prompt_length, md5(prompt) AS prompt_digest FROM p
""",
)
def render_prompt(t: Tables):
    rows = _document_samples(t).join(
        t.documents.select(text_of(F.col("doc_id")).alias("id"), (F.col("n_chars") % 3 == 0).alias("cot")), "id"
    )
    schema = prompts.choose_prompt_schema(F.col("cot"), F.lit(0))
    prompt = prompts.render_prompt(schema, F.col("is_multi"), F.col("input"), F.col("choices"))
    return rows.select(
        "id",
        schema.alias("prompt_schema"),
        big(F.length(prompt)).alias("prompt_length"),
        F.md5(prompt).alias("prompt_digest"),
    )


@query(
    "build_prompts",
    f"""
WITH {_RING_SQL},
e AS (SELECT w.id, string_agg(q.example, chr(10) || chr(10) ORDER BY k) AS examples FROM w JOIN q USING (pos) GROUP BY w.id),
d AS (SELECT doc_id::VARCHAR AS id, lang, examples || chr(10) || chr(10) || d.text AS text,
             'A) ' || lang || chr(10) || 'B) ' || source AS choices FROM documents d JOIN e ON e.id = doc_id::VARCHAR)
SELECT id, 'few_shot' AS prompt_schema, md5(CASE WHEN lang = 'fr' THEN {_template_sql(fixed.MULTIPLE_ANSWER)}
                                                 ELSE {_template_sql(fixed.SINGLE_ANSWER)} END) AS prompt_digest
FROM d
""",
)
def build_prompts(t: Tables):
    """Complete few-shot prompts with three examples."""
    rows = prompts.build_prompts(_document_samples(t), n_shot=3)
    return rows.select("id", "prompt_schema", F.md5("prompt").alias("prompt_digest"))


@query(
    "replace_or_append_turn",
    """
WITH l AS (SELECT conv_id, max(turn) AS lt, arg_max(role, turn) AS lr, arg_max(text, turn) AS lx FROM conversations GROUP BY conv_id)
SELECT conv_id, turn, role, md5(CASE WHEN turn = lt AND lr = 'user'
         THEN 'context ' || conv_id::VARCHAR || chr(10) || chr(10) || 'Question:' || chr(10) || text ELSE text END) AS text_digest
FROM conversations JOIN l USING (conv_id)
UNION ALL
SELECT conv_id, lt + 1, 'user', md5('context ' || conv_id::VARCHAR || chr(10) || chr(10) || 'Question:' || chr(10) || 'what next?')
FROM l WHERE lr <> 'user'
""",
)
def replace_or_append_turn(t: Tables):
    contexts = t.conversations.select("conv_id").distinct().select(
        "conv_id",
        F.concat(F.lit("context "), text_of(F.col("conv_id"))).alias("context"),
        F.lit("what next?").alias("query"),
    )
    turns = prompts.augment_turns(t.conversations, contexts)
    return turns.select("conv_id", "turn", "role", F.md5("text").alias("text_digest"))


# --- configuration ---------------------------------------------------------------------------


def _map_text(column):
    entries = F.transform(
        F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return F.array_join(entries, ",")


@query(
    "run_matrix",
    """
WITH b AS (SELECT c_custkey, c_nationkey, CASE c_nationkey % 4 WHEN 3 THEN NULL ELSE c_nationkey % 4 END AS runs,
                  CASE c_nationkey % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS enabled FROM customer)
SELECT 'b' || c_custkey::VARCHAR AS benchmark, r_name AS model_key, 'm/' || r_name AS model, g.run::INT AS run, 'split=train' AS args,
       CASE WHEN r_regionkey % 2 = 0 THEN 'temperature=' || r_regionkey::VARCHAR
            ELSE 'max_tokens=10,temperature=' || r_regionkey::VARCHAR END AS settings
FROM b, region, range(1, 4) g(run)
WHERE coalesce(enabled, true) AND c_nationkey <> 7 AND g.run <= coalesce(runs, 1)
""",
)
def run_matrix(t: Tables):
    """Customers as benchmarks and regions as models; disabled and unknown ones are left out."""
    group = F.col("c_nationkey")
    benchmarks = t.customer.select(
        F.concat(F.lit("b"), text_of(F.col("c_custkey"))).alias("benchmark"),
        F.when(group % 5 == 0, F.lit(None).cast("boolean")).otherwise(group % 5 != 1).alias("enabled"),
        F.when(group % 4 != 3, group % 4).alias("runs"),
        F.create_map(F.lit("enabled"), F.lit("true"), F.lit("runs"), text_of(group), F.lit("split"), F.lit("train")).alias("args"),
    )
    known = t.customer.filter(group != 7).select(F.concat(F.lit("b"), text_of(F.col("c_custkey"))).alias("benchmark"))
    key = F.col("r_regionkey")
    models = t.region.select(
        F.col("r_name").alias("model_key"),
        F.concat(F.lit("m/"), "r_name").alias("model"),
        F.create_map(F.lit("temperature"), F.lit("0.5"), F.lit("max_tokens"), F.lit("10")).alias("default_settings"),
        F.create_map(
            F.lit("temperature"), text_of(key), F.lit("max_tokens"), F.when(key % 2 == 1, F.lit("10"))
        ).alias("settings"),
        F.lit(None).cast("string").alias("rag"),
    )
    wanted, _ = validate.enabled_benchmarks(benchmarks, known)
    matrix = validate.run_matrix(wanted, models)
    return matrix.select(
        "benchmark", "model_key", "model", "run", _map_text(F.col("args")).alias("args"),
        _map_text(F.col("settings")).alias("settings"),
    )


@query(
    "validate_values",
    """
SELECT o_orderkey, o_custkey FROM orders
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)
""",
)
def validate_values(t: Tables):
    """Requested values without a match among the allowed ones."""
    allowed = t.customer.filter(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("o_custkey"))
    return validate.invalid_values(t.orders.select("o_orderkey", "o_custkey"), allowed, ["o_custkey"])


@query(
    "argument_problems",
    """
WITH e AS (SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'gpqa' WHEN 1 THEN 'mmlu' ELSE 'lab_bench' END AS benchmark,
                  CASE event_type WHEN 'click' THEN 'gpqa_main' WHEN 'view' THEN 'virology' WHEN 'error' THEN 'all' ELSE event_type END AS subset,
                  CASE WHEN user_id % 2 = 0 THEN 'five' ELSE '5' END AS n_shot FROM events)
SELECT benchmark, 'subset' AS argument, subset AS value, 'not an allowed value' AS problem, count(*)::BIGINT AS n FROM e
WHERE NOT ((benchmark = 'gpqa' AND subset = 'gpqa_main') OR (benchmark = 'mmlu' AND subset IN ('virology', 'all'))
           OR (benchmark = 'lab_bench' AND subset = 'all')) GROUP BY ALL
UNION ALL SELECT benchmark, 'n_shot', n_shot, 'wrong type', count(*)::BIGINT FROM e WHERE n_shot = 'five' GROUP BY ALL
UNION ALL SELECT benchmark, 'colour', 'red', 'unknown argument', count(*)::BIGINT FROM e GROUP BY ALL
""",
)
def argument_problems(t: Tables):
    user, kind = F.col("user_id"), F.col("event_type")
    subset = (
        F.when(kind == "click", F.lit("gpqa_main"))
        .when(kind == "view", F.lit('["virology"]'))
        .when(kind == "error", F.lit("all"))
        .otherwise(kind)
    )
    requests = t.events.select(
        F.when(user % 3 == 0, F.lit("gpqa")).when(user % 3 == 1, F.lit("mmlu")).otherwise(F.lit("lab_bench")).alias("benchmark"),
        F.create_map(
            F.lit("subset"), subset,
            F.lit("n_shot"), F.when(user % 2 == 0, F.lit("five")).otherwise(F.lit("5")),
            F.lit("colour"), F.lit("red"),
        ).alias("args"),
    )
    return validate.argument_problems(requests).groupBy("benchmark", "argument", "value", "problem").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "union_subsets",
    """
SELECT lang, CASE WHEN lang IN ('fr', 'es') THEN 'romance' ELSE 'germanic' END AS subset, count(*)::BIGINT AS n,
       sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang
""",
)
def union_subsets(t: Tables):
    groups = {"romance": ["fr", "es"], "germanic": ["en", "de"]}
    frames = [
        t.documents.filter(F.col("lang").isin(samples.expand_subsets(name, [], groups))).withColumn("subset", F.lit(name))
        for name in groups
    ]
    return samples.union_subsets(frames).groupBy("lang", "subset").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")
    )


# --- text columns ----------------------------------------------------------------------------


@query(
    "parse_dict_literal",
    """
WITH e AS (SELECT event_id, event_id % 6 AS f, (props::JSON ->> 'k') AS k FROM events)
SELECT event_id, CASE f WHEN 0 THEN 'k=' || k || ',split=test,subset=main'
                        WHEN 1 THEN 'k=' || k || ',split=test,subtasks=["Biology"]'
                        WHEN 2 THEN 'k=' || k || ',split=test,subtasks=["Biology"]'
                        WHEN 3 THEN 'cot=true,k=' || k || ',split=test'
                        WHEN 4 THEN 'k=' || k || ',note=it''s "so",split=test'
                        ELSE 'split=test' END AS args
FROM e
""",
)
def parse_dict_literal(t: Tables):
    """Several spellings of the same settings, one that only Python can read, and unreadable text."""
    k = F.get_json_object("props", "$.k")
    forms = F.array(
        F.concat(F.lit("{'k': "), k, F.lit(", 'subset': 'main', 'none': None}")),
        F.concat(F.lit("{'cls': 'Set', 'k': "), k, F.lit(", 'subtasks': ['Biology']}")),
        F.concat(F.lit("{'subtasks': \"['Biology']\", 'k': "), k, F.lit("}")),
        F.concat(F.lit("{'cot': True, 'k': "), k, F.lit("}")),
        F.concat(F.lit("{'note': 'it\\'s \"so\"', 'k': "), k, F.lit("}")),
        F.lit("not a dict"),
    )
    rows = t.events.select("event_id", F.get(forms, (F.col("event_id") % 6).cast("int")).alias("text"))
    added = F.create_map(F.lit("split"), F.lit("test"))
    merged = literals.merge_maps(F.col("args"), added)
    return literals.with_parsed_args(rows, "text", "args").select(
        "event_id", _map_text(literals.canonical_args(merged)).alias("args")
    )


@query(
    "safe_dates",
    """
WITH o AS (SELECT o_orderkey, o_orderdate, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN 'unknown'
                  WHEN 2 THEN strftime(o_orderdate, '%Y-%m-') || '32' END AS t FROM orders)
SELECT o_orderkey, try_strptime(t, '%Y-%m-%d')::DATE AS parsed, strftime(o_orderdate, '%b %Y') AS month,
       (37 + o_orderkey % 100)::BIGINT AS run_seconds FROM o
""",
)
def safe_dates(t: Tables):
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = (
        F.when(key % 4 == 0, day)
        .when(key % 4 == 1, F.lit("unknown"))
        .when(key % 4 == 2, F.concat(F.date_format("o_orderdate", "yyyy-MM-"), F.lit("32")))
    )
    # the name carries 11:14:52 at UTC-5, the log ends `run_seconds` later
    filename = F.concat(day, F.lit("T11-14-52-05-00_task_x.json"))
    started = F.unix_timestamp(F.concat(day, F.lit("T16:14:52Z")), "yyyy-MM-dd'T'HH:mm:ssX")
    finished = F.timestamp_seconds(started + 37 + key % 100)
    return t.orders.select(
        "o_orderkey",
        dates.safe_date(text).alias("parsed"),
        dates.month_label(F.col("o_orderdate")).alias("month"),
        dates.run_duration(filename, finished).alias("run_seconds"),
    )


@query(
    "jsonl_stats",
    """
SELECT event_type, count(*) FILTER (event_id % 10 <> 0)::BIGINT AS n_valid, count(*) FILTER (event_id % 10 = 0)::BIGINT AS n_invalid,
       sum((props::JSON ->> 'k')::BIGINT) FILTER (event_id % 10 <> 0)::BIGINT AS total_k
FROM events GROUP BY event_type
""",
)
def jsonl_stats(t: Tables):
    """Every tenth line is cut off and must be reported as unreadable, not lost."""
    line = F.when(F.col("event_id") % 10 == 0, F.rtrim(F.col("props"), F.lit("}"))).otherwise(F.col("props"))
    lines = t.events.select("event_type", line.alias("line"))
    rows = questions.parse_json_lines(lines, "line", "k bigint", keep=["event_type"])
    bad = F.col(questions.BAD_LINE)
    return rows.groupBy("event_type").agg(
        F.count_if(bad.isNull()).alias("n_valid"), F.count(bad).alias("n_invalid"), F.sum("k").alias("total_k")
    )


# --- retrieval -------------------------------------------------------------------------------

_TERMS_SQL = r"""
dt AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents)
       WHERE length(term) >= 1),
qt AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM benchmark)
       WHERE length(term) >= 1),
df AS (SELECT term, count(*) AS df FROM dt GROUP BY term),
kt AS (SELECT item_id, term, coalesce(df, 0) AS df,
              row_number() OVER (PARTITION BY item_id ORDER BY coalesce(df, 0), term) AS r FROM qt LEFT JOIN df USING (term))
"""

COMMON_DF = 100


def _questions(t: Tables):
    return t.benchmark.select(F.col("item_id").alias("question_id"), F.col("text").alias("input"))


@query("key_terms", f"WITH {_TERMS_SQL} SELECT item_id AS question_id, term, df::BIGINT AS df FROM kt WHERE r <= 5")
def key_terms(t: Tables):
    terms = retrieval.question_terms(_questions(t), "question_id", "input")
    index = retrieval.postings(t.documents, "doc_id", "text")
    return retrieval.key_terms(terms, retrieval.document_frequency(index, terms.select("term").distinct()))


_LEXICAL_SQL = f"""
WITH {_TERMS_SQL},
n AS (SELECT count(*) AS n FROM documents),
h1 AS (SELECT item_id, doc_id, round(sum(ln((n + 1) / df)), 6) AS score FROM kt JOIN dt USING (term), n WHERE r <= 5 AND df > 0 GROUP BY ALL),
k2 AS (SELECT item_id, term, df, row_number() OVER (PARTITION BY item_id ORDER BY df, term) AS r FROM kt
       WHERE df > 0 AND item_id NOT IN (SELECT item_id FROM h1)),
h2 AS (SELECT item_id, doc_id, round(sum(ln((n + 1) / df)), 6) AS score FROM k2 JOIN dt USING (term), n WHERE r <= 5 GROUP BY ALL),
h AS (SELECT *, 'first' AS search FROM h1 UNION ALL SELECT *, 'second' FROM h2),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM h)
"""


@query(
    "retrieve_lexical",
    _LEXICAL_SQL + "SELECT item_id AS question_id, doc_id, score, rank::INT AS rank, search FROM k WHERE rank <= 5",
)
def retrieve_lexical(t: Tables):
    return retrieval.retrieve("lexical", _questions(t), t.documents, k=5, common_df=COMMON_DF)


@query(
    "retrieve_context",
    _LEXICAL_SQL
    + """,
b AS (SELECT item_id, string_agg('Source: ' || d.source || ' (' || d.lang || ')' || chr(10) || 'Content: ' || d.text,
                                 chr(10) || chr(10) ORDER BY rank) AS body
      FROM k JOIN documents d USING (doc_id) WHERE rank <= 5 GROUP BY item_id)
SELECT item_id AS question_id, md5(coalesce('Context from search:' || chr(10) || body, 'No relevant articles found in PubMed.')) AS context_digest,
       md5(coalesce('Context from search:' || chr(10) || body, 'No relevant articles found in PubMed.') || chr(10) || chr(10) || 'Question:' || chr(10)
           || benchmark.text || chr(10) || 'Choices: yes, no') AS prompt_digest
FROM benchmark LEFT JOIN b USING (item_id)
""",
)
def retrieve_context(t: Tables):
    """Retrieved passages as context, put before the question with its choices."""
    asked = _questions(t)
    ranked = retrieval.retrieve("lexical", asked, t.documents, k=5, common_df=COMMON_DF)
    block = prompts.source_block(F.col("source"), F.col("lang"), F.col("text"))
    rows = retrieval.contexts(asked, ranked, t.documents, block=block).join(asked, "question_id")
    question = prompts.query_with_choices(F.col("input"), F.array(F.lit("yes"), F.lit("no")))
    return rows.select(
        "question_id",
        F.md5("context").alias("context_digest"),
        F.md5(prompts.augmented(F.col("context"), question)).alias("prompt_digest"),
    )


@query(
    "retrieve_vector",
    """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.vec_id AS question_id, b.vec_id AS doc_id, list_dot_product(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT question_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5
""",
)
def retrieve_vector(t: Tables):
    asked = t.embeddings.select(F.col("vec_id").alias("question_id"), "embedding")
    corpus = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    ranked = retrieval.retrieve("vector", asked, corpus, k=5, exclude_self=True)
    return ranked.withColumn("score", F.round("score", 6))


@query(
    "retrieve_vector_near",
    "SELECT count(*)::BIGINT AS n_questions, least(count(*) - 1, 5) * count(*)::BIGINT AS n_wanted, true AS is_recall_reached FROM embeddings",
)
def retrieve_vector_near(t: Tables):
    """How much of the exact result the approximate retrieval finds for all vectors as questions: 0.9 or more."""
    asked = t.embeddings.select(F.col("vec_id").alias("question_id"), "embedding")
    corpus = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    exact = retrieval.retrieve("vector", asked, corpus, k=5, exclude_self=True).select("question_id", "doc_id")
    near = retrieval.retrieve("vector_near", asked, corpus, k=5, exclude_self=True).select("question_id", "doc_id", F.lit(True).alias("is_found"))
    return exact.join(near, ["question_id", "doc_id"], "left").agg(
        F.count_distinct("question_id").alias("n_questions"),
        F.count(F.lit(1)).alias("n_wanted"),
        (F.count("is_found") >= 0.9 * F.count(F.lit(1))).alias("is_recall_reached"),
    )


@query(
    "complete_arguments",
    """
WITH e AS (SELECT user_id % 2 AS f, event_type, user_id % 3 AS n FROM events)
SELECT CASE f WHEN 0 THEN 'wmdp' ELSE 'vct' END AS benchmark,
       'cot=' || (event_type = 'click')::VARCHAR || CASE f WHEN 0 THEN '' ELSE ',mode=mr' END || ',n_shot=' || CASE n WHEN 0 THEN '0' ELSE n::VARCHAR END
       || ',split=' || CASE f WHEN 0 THEN 'test,subset=' || CASE event_type WHEN 'view' THEN 'wmdp-chem' ELSE 'wmdp-bio' END ELSE 'all,subtasks=all' END AS args,
       count(*)::BIGINT AS n
FROM e GROUP BY ALL
""",
)
def complete_arguments(t: Tables):
    """Requests with names left out, null or in another case, as a run uses them."""
    user, kind = F.col("user_id"), F.col("event_type")
    is_first = user % 2 == 0
    shots = F.when(user % 3 != 0, text_of(user % 3))
    flag = F.when(kind == "click", F.lit("True")).otherwise(F.lit("FALSE"))
    first = F.create_map(F.lit("cot"), flag, F.lit("subset"), F.when(kind == "view", F.lit("wmdp-chem")).otherwise(F.lit("wmdp-bio")))
    second = F.create_map(F.lit("cot"), flag, F.lit("mode"), F.lit("mr"))
    given = F.when(is_first, first).otherwise(second)
    requests = t.events.select(
        F.when(is_first, F.lit("wmdp")).otherwise(F.lit("vct")).alias("benchmark"),
        F.when(shots.isNull(), given).otherwise(F.map_concat(given, F.create_map(F.lit("n_shot"), shots))).alias("args"),
    )
    complete = validate.complete_arguments(requests)
    return complete.groupBy("benchmark", _map_text(F.col("args")).alias("args")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "registered_samples",
    """
WITH r AS (SELECT p_name AS input, chr((65 + p_size % 4)::INT) AS target, p_brand || '|' || p_type || '|x|y' AS choices, p_partkey % 2 AS f FROM part)
SELECT CASE f WHEN 0 THEN 'mmlu' ELSE 'wmdp' END AS benchmark, input, target, choices, count(*)::BIGINT AS n FROM r GROUP BY ALL
""",
)
def registered_samples(t: Tables):
    """Records of two benchmarks, mapped by the names under which their mappers are registered."""
    records = t.part.select(
        F.col("p_name").alias("question"), F.array("p_brand", "p_type", F.lit("x"), F.lit("y")).alias("choices"),
        (F.col("p_size") % 4).alias("answer"), F.col("p_brand").alias("subject"), "p_partkey",
    )
    rows = [samples.to_samples(name, records.filter(F.col("p_partkey") % 2 == f).drop("p_partkey")) for f, name in enumerate(("mmlu", "wmdp"))]
    return (
        rows[0].unionByName(rows[1])
        .groupBy("benchmark", "input", F.get("target", F.lit(0)).alias("target"), F.array_join("choices", "|").alias("choices"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "n_shot_guard",
    """
WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT lang, shots AS n_shot, n > shots AS is_enough FROM n, (SELECT unnest([0, 5, 100, 100000]) AS shots)
""",
)
def n_shot_guard(t: Tables):
    """For the samples of each language: is there a run with so many examples, or is it refused?"""
    langs = [r.lang for r in t.documents.select("lang").distinct().collect()]  # four

    def is_enough(lang: str, n: int) -> bool:
        try:
            return sampling.check_n_shot(t.documents.filter(F.col("lang") == lang), n) is not None
        except ValueError:
            return False

    rows = [(lang, n, is_enough(lang, n)) for lang in langs for n in (0, 5, 100, 100_000)]
    return t.spark.createDataFrame(rows, "lang string, n_shot int, is_enough boolean")
