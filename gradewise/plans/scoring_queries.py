"""Scoring, cost and run-table queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewise.functions.answers import extract_answer, is_correct_multi, is_correct_single, message_text
from gradewise.functions.labels import letter
from gradewise.functions.measures import binomial_stderr
from gradewise.operators import compare, costing, dims, runs, scoring
from gradewise.plans.catalog import Tables, big, query, r6, text_of
from gradewise.sources.dimensions import baselines_table, publication_dates


def _event_runs(t: Tables):
    """Events as run rows: event type is the model, user group the benchmark."""
    return t.events.select(
        F.concat(F.lit("shop/"), "event_type").alias("inspect_model_name"),
        F.concat(F.lit("set"), (F.col("user_id") % 7).cast("string")).alias("benchmark"),
        F.lit("zero_shot").alias("prompt_schema"),
        F.lit("{}").alias("task_args"),
        F.col("user_id").alias("total_samples"),
        F.col("value").alias("accuracy"),
        F.floor(F.col("value") * 100).alias("input_tokens"),
        F.col("event_id").alias("output_tokens"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("filename"),
    )


_EVENT_RUNS_SQL = """
runs AS (
  SELECT 'shop/' || event_type AS inspect_model_name, 'set' || (user_id % 7)::VARCHAR AS benchmark,
         'zero_shot' AS prompt_schema, '{}' AS task_args, user_id AS total_samples, value AS accuracy,
         floor(value * 100)::BIGINT AS input_tokens, event_id AS output_tokens,
         lpad(event_id::VARCHAR, 12, '0') AS filename
  FROM events)
"""


@query(
    "summarize_runs",
    f"""
WITH {_EVENT_RUNS_SQL}
SELECT prompt_schema || '/' || benchmark || '/' || split_part(inspect_model_name, '/', 2) AS path,
       inspect_model_name, benchmark, prompt_schema, task_args,
       min(total_samples)::BIGINT AS total_samples,
       min(total_samples) <> max(total_samples) AS mixed_samples,
       round(avg(accuracy), 6) AS mean_accuracy, round(stddev_samp(accuracy), 6) AS std_accuracy,
       trunc(avg(input_tokens))::BIGINT AS mean_input_tokens,
       trunc(avg(output_tokens))::BIGINT AS mean_output_tokens, count(*)::BIGINT AS num_runs
FROM runs GROUP BY ALL
""",
)
def summarize_runs(t: Tables):
    summary = runs.summarize_runs(_event_runs(t))
    return runs.sort_summary(
        summary.withColumns({c: r6(F.col(c)) for c in ("mean_accuracy", "std_accuracy")})
    )


@query(
    "run_files",
    f"""
WITH {_EVENT_RUNS_SQL}
SELECT inspect_model_name, benchmark, prompt_schema, task_args, filename FROM runs
""",
)
def run_files(t: Tables):
    return runs.run_files(_event_runs(t))


@query(
    "binomial_accuracy",
    """
SELECT lang, n_scored, n_correct, round(accuracy, 6) AS accuracy,
       round(CASE WHEN n_scored > 0 THEN sqrt(accuracy * (1 - accuracy) / n_scored) ELSE 0 END, 6) AS stderr_population,
       round(CASE WHEN n_scored > 1 THEN sqrt(accuracy * (1 - accuracy) / (n_scored - 1)) ELSE 0 END, 6) AS stderr_sample
FROM (SELECT lang, count(*) FILTER (toxic = 0)::BIGINT AS n_scored,
             count(*) FILTER (toxic = 0 AND quality = 1)::BIGINT AS n_correct,
             CASE WHEN count(*) FILTER (toxic = 0) > 0
                  THEN count(*) FILTER (toxic = 0 AND quality = 1) / count(*) FILTER (toxic = 0) ELSE 0 END AS accuracy
      FROM labels JOIN documents USING (doc_id) GROUP BY lang)
""",
)
def binomial_accuracy(t: Tables):
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").select(
        "lang", (F.col("toxic") == 0).alias("is_scored"), (F.col("quality") == 1).alias("is_correct")
    )
    p, n = F.col("accuracy"), F.col("n_scored")
    return scoring.cot_accuracy(rows, ["lang"]).select(
        "lang",
        "n_scored",
        "n_correct",
        r6(p).alias("accuracy"),
        r6(F.col("stderr")).alias("stderr_population"),
        r6(binomial_stderr(p, n, "sample")).alias("stderr_sample"),
    )


_ANSWER_FORMS = [
    "ANSWER: B", "answer :  a, c \nmore", "so ANSWER: D.", "**ANSWER: C**", "ANSWER: $B$", "nothing to say",
]


def _completions(t: Tables):
    forms = F.array(*[F.lit(f) for f in _ANSWER_FORMS])
    return t.conversations.select(
        "conv_id",
        "turn",
        F.concat(F.col("text"), F.lit("\n"), F.get(forms, (F.col("conv_id") % 6).cast("int"))).alias("completion"),
        letter(F.col("turn") % 4).alias("target"),
    )


@query(
    "extract_answer",
    r"""
WITH c AS (
  SELECT conv_id, turn, chr((65 + turn % 4)::INT) AS target,
         text || chr(10) || (['ANSWER: B', 'answer :  a, c ' || chr(10) || 'more', 'so ANSWER: D.', '**ANSWER: C**',
                              'ANSWER: $B$', 'nothing to say'])[(conv_id % 6 + 1)::INT] AS completion
  FROM conversations),
e AS (
  SELECT conv_id, turn, target,
         upper(trim(coalesce(
           nullif(regexp_extract(completion, '(?im)^ANSWER\s*:\s*([A-Za-z ,]+)\s*(?:$|\n)', 1), ''),
           nullif(regexp_extract(completion, '(?i)ANSWER\s*:\s*([A-Za-z ,]+)(?:[^\w]|\n|$)', 1), '')))) AS extracted
  FROM c)
SELECT conv_id, turn, extracted, coalesce(extracted <> '' AND extracted = target, false) AS is_correct FROM e
""",
)
def extract(t: Tables):
    return _completions(t).select(
        "conv_id",
        "turn",
        extract_answer(F.col("completion")).alias("extracted"),
        is_correct_single(extract_answer(F.col("completion")), F.col("target")).alias("is_correct"),
    )


@query(
    "message_text",
    """
SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN NULL ELSE md5(text) END AS text_digest FROM conversations
""",
)
def message(t: Tables):
    """Plain content, parts with the text second, and parts without text."""
    image = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))
    text = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    content = (
        F.when(F.col("turn") % 3 == 0, F.col("text"))
        .when(F.col("turn") % 3 == 1, F.to_json(F.array(image, text)))
        .otherwise(F.to_json(F.array(image, image)))
    )
    return t.conversations.select("conv_id", "turn", F.md5(message_text(content)).alias("text_digest"))


def _bit_letters(number):
    flags = [F.when(F.expr(f"({number} & {1 << b}) <> 0"), F.lit(chr(65 + b))) for b in range(4)]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


@query(
    "multi_response_score",
    """
WITH p AS (
  SELECT p_partkey, p_size,
         list_filter([CASE WHEN p_size & 1 <> 0 THEN 'A' END, CASE WHEN p_size & 2 <> 0 THEN 'B' END,
                      CASE WHEN p_size & 4 <> 0 THEN 'C' END, CASE WHEN p_size & 8 <> 0 THEN 'D' END],
                     lambda x: x IS NOT NULL) AS given,
         CASE WHEN p_type = 'ECONOMY' THEN p_size + 1 ELSE p_size END AS t
  FROM part),
a AS (
  SELECT p_partkey,
         CASE p_size % 3 WHEN 0 THEN array_to_string(list_reverse(given), '')
              WHEN 1 THEN array_to_string(list_reverse(given), ', ')
              ELSE array_to_string(list_reverse(given), ' ') END AS answer,
         list_filter([CASE WHEN t & 1 <> 0 THEN 'A' END, CASE WHEN t & 2 <> 0 THEN 'B' END,
                      CASE WHEN t & 4 <> 0 THEN 'C' END, CASE WHEN t & 8 <> 0 THEN 'D' END],
                     lambda x: x IS NOT NULL) AS target
  FROM p),
s AS (
  SELECT p_partkey, answer, target, list_transform(string_split(answer, ','), lambda x: upper(trim(x))) AS pieces FROM a)
SELECT p_partkey, answer, array_to_string(target, ',') AS target,
       answer <> '' AND list_sort(CASE WHEN len(pieces) = 1 THEN string_split(pieces[1], '') ELSE pieces END)
                        = list_sort(target) AS is_correct
FROM s
""",
)
def multi_response_score(t: Tables):
    given = F.reverse(_bit_letters("p_size"))
    answer = (
        F.when(F.col("p_size") % 3 == 0, F.array_join(given, ""))
        .when(F.col("p_size") % 3 == 1, F.array_join(given, ", "))
        .otherwise(F.array_join(given, " "))
    )
    shifted = t.part.withColumn(
        "t", F.when(F.col("p_type") == "ECONOMY", F.col("p_size") + 1).otherwise(F.col("p_size"))
    )
    return shifted.select(
        "p_partkey",
        answer.alias("answer"),
        F.array_join(_bit_letters("t"), ",").alias("target"),
        is_correct_multi(answer, _bit_letters("t")).alias("is_correct"),
    )


@query(
    "answer_format_audit",
    r"""
WITH c AS (SELECT role, (['A', 'b', 'A, C', '', 'é'])[(conv_id % 5 + 1)::INT] AS answer FROM conversations)
SELECT role, count(*)::BIGINT AS n_samples,
       count(*) FILTER (NOT regexp_full_match(answer, '\p{L}'))::BIGINT AS n_non_letter,
       round(avg(CASE WHEN regexp_full_match(answer, '\p{L}') THEN 0.0 ELSE 1.0 END), 6) AS share_non_letter
FROM c GROUP BY role
""",
)
def answer_format_audit(t: Tables):
    forms = F.array(*[F.lit(f) for f in ("A", "b", "A, C", "", "é")])
    rows = t.conversations.select("role", F.get(forms, (F.col("conv_id") % 5).cast("int")).alias("answer"))
    audit = scoring.answer_format_audit(rows, ["role"])
    return audit.withColumn("share_non_letter", r6(F.col("share_non_letter")))


@query(
    "token_cost",
    """
WITH prices AS (
  SELECT p_partkey, p_retailprice AS p_in, CASE WHEN p_type = 'PROMO' THEN 0.0 ELSE p_retailprice + 0.5 END AS p_out,
         CASE WHEN p_size < 20 THEN 12.25 ELSE 0.0 END AS p_both
  FROM part WHERE p_size < 45),
c AS (
  SELECT l_linestatus, l_quantity * 1000 AS i, l_quantity * 10 AS o, p_partkey, p_in, p_out, p_both
  FROM lineitem LEFT JOIN prices ON l_partkey = p_partkey),
d AS (
  SELECT l_linestatus, i, o,
         CASE WHEN p_partkey IS NULL THEN 'unknown model'
              WHEN p_in <> 0 AND p_out <> 0 THEN 'separate input/output costs'
              WHEN p_both <> 0 THEN 'combined cost' ELSE 'No cost data available for this model' END AS cost_method,
         CASE WHEN p_partkey IS NULL THEN 0
              WHEN p_in <> 0 AND p_out <> 0 THEN p_in / 1000000 * i + p_out / 1000000 * o
              WHEN p_both <> 0 THEN p_both / 1000000 * (i + o) ELSE 0 END AS cost
  FROM c)
SELECT l_linestatus, cost_method, count(*)::BIGINT AS n_usages, round(sum(cost), 2) AS cost,
       sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens
FROM d GROUP BY ALL
""",
)
def token_cost(t: Tables):
    """Each part is a model with price texts such as `$1,234.50`; parts of size 45 and more have no price row."""
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 2))
    prices = t.part.filter(F.col("p_size") < 45).select(
        F.col("p_partkey").cast("string").alias("inspect_model_name"),
        money(F.col("p_retailprice")).alias("input_cost_per_M_tokens"),
        F.when(F.col("p_type") != "PROMO", money(F.col("p_retailprice") + 0.5)).alias("output_cost_per_M_tokens"),
        F.when(F.col("p_size") < 20, F.lit("$12.25")).otherwise(F.lit("")).alias("cost_per_M_tokens"),
    )
    usage = t.lineitem.select(
        F.col("l_partkey").cast("string").alias("inspect_model_name"),
        "l_linestatus",
        (F.col("l_quantity") * 1000).alias("input_tokens"),
        (F.col("l_quantity") * 10).alias("output_tokens"),
    )
    method = F.when(F.col("cost_method").startswith("Model "), F.lit("unknown model")).otherwise(F.col("cost_method"))
    return (
        costing.with_token_cost(usage, prices)
        .groupBy("l_linestatus", method.alias("cost_method"))
        .agg(
            F.count(F.lit(1)).alias("n_usages"),
            F.round(F.sum("cost"), 2).alias("cost"),
            big(F.sum("input_tokens")).alias("input_tokens"),
            big(F.sum("output_tokens")).alias("output_tokens"),
        )
    )


@query(
    "summary_cost",
    """
WITH r AS (
  SELECT p_brand AS inspect_model_name, l_linestatus AS benchmark, l_returnflag AS prompt_schema,
         CASE WHEN p_type = 'PROMO' THEN 0
              ELSE round_even(p_retailprice / 1000000 * (l_quantity * 1000) + 10.01::DOUBLE / 1000000 * (2 * l_linenumber + 1), 2) END AS est_cost
  FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT inspect_model_name, benchmark, prompt_schema, round(sum(est_cost), 2) AS est_tot_cost, count(*)::BIGINT AS num_runs
FROM r GROUP BY ALL
""",
)
def summary_cost(t: Tables):
    """Lines as runs of a brand, with price texts; promotional parts lack a price. Each run's cost is rounded, then summed.

    The odd token and price numbers keep every cost away from a rounding tie.
    """
    facts = t.part.select(
        F.col("p_partkey").alias("l_partkey"),
        F.col("p_brand").alias("inspect_model_name"),
        F.concat(F.lit("$"), F.format_number("p_retailprice", 2)).alias("input_cost_per_M_tokens"),
        F.when(F.col("p_type") != "PROMO", F.lit("$10.01")).alias("output_cost_per_M_tokens"),
    )
    lines = t.lineitem.select(
        "l_partkey",
        F.col("l_linestatus").alias("benchmark"),
        F.col("l_returnflag").alias("prompt_schema"),
        F.lit("{}").alias("task_args"),
        F.lit(1).alias("total_samples"),
        F.col("l_discount").alias("accuracy"),
        (F.col("l_quantity") * 1000).alias("input_tokens"),
        (F.col("l_linenumber") * 2 + 1).alias("output_tokens"),
    )
    summary = runs.summarize_runs(costing.with_run_cost(lines.join(facts, "l_partkey")), include_cost=True)
    return summary.select("inspect_model_name", "benchmark", "prompt_schema", F.round("est_tot_cost", 2).alias("est_tot_cost"), "num_runs")


@query(
    "cost_rollup",
    """
SELECT o_orderpriority AS filename, grouping(o_orderpriority)::INT AS is_total, round(sum(l_extendedprice), 2) AS cost,
       count(*)::BIGINT AS total_samples, count(*) FILTER (l_linestatus = 'F')::BIGINT AS completed_samples,
       round(CASE WHEN count(*) FILTER (l_linestatus = 'F') > 0
                  THEN sum(l_extendedprice) / count(*) FILTER (l_linestatus = 'F') END, 4) AS cost_per_question
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ROLLUP (o_orderpriority)
""",
)
def cost_rollup(t: Tables):
    # lines are summed per order before the join: the join then moves one row per order
    per_order = t.lineitem.groupBy("l_orderkey").agg(
        F.sum("l_extendedprice").alias("cost"),
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(F.col("l_linestatus") == "F").alias("completed_samples"),
    )
    costs = per_order.join(
        t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("filename")),
        "l_orderkey",
    )
    return costing.cost_rollup(costs).withColumns(
        {"cost": F.round("cost", 2), "cost_per_question": F.round("cost_per_question", 4)}
    )


@query(
    "majority_value",
    """
WITH n AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL),
m AS (SELECT o_custkey, o_orderstatus AS top,
             row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderstatus) AS r FROM n)
SELECT o_orderkey, o_custkey, top AS o_orderstatus FROM orders JOIN m USING (o_custkey) WHERE r = 1
""",
)
def majority_value(t: Tables):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    return runs.harmonize(rows, ["o_custkey"], ["o_orderstatus"]).select("o_orderkey", "o_custkey", "o_orderstatus")


_REGION_BENCHMARKS = ["gpqa", "mmlu", "pubmedqa", "vct", "other"]


@query(
    "enrich_dimension",
    """
WITH b(i, benchmark, expert, non_expert, random, published, display) AS (VALUES
  (0, 'gpqa', 0.667, 0.432, 0.25, DATE '2023-11-20', 'GPQA-Bio'), (1, 'mmlu', 0.898, 0.345, 0.25, DATE '2020-09-07', 'MMLU-Bio'),
  (2, 'pubmedqa', 0.78, NULL, 0.333, DATE '2019-09-13', 'PubMedQA'), (3, 'vct', 0.226, NULL, NULL, DATE '2025-04-21', 'VCT-Text'),
  (4, 'other', NULL, NULL, NULL, NULL, NULL)),
c AS (SELECT c_nationkey, count(*) AS n, sum(c_acctbal) AS balance FROM customer GROUP BY c_nationkey)
SELECT n_name AS inspect_model_name, r_name AS region, b.benchmark, c.n::BIGINT AS n_customers,
       round(balance, 2) AS balance, expert::DOUBLE AS expert, non_expert::DOUBLE AS non_expert,
       random::DOUBLE AS random, published AS benchmark_publication_date, display AS benchmark_display
FROM c LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN b ON b.i = n_regionkey
""",
)
def enrich_dimension(t: Tables):
    spark = t.region.sparkSession
    names = F.array(*[F.lit(b) for b in _REGION_BENCHMARKS])
    rows = (
        t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey"))
        .agg(F.count(F.lit(1)).alias("n_customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
        .join(t.nation, "n_nationkey", "left")
        .join(t.region.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey", "left")
        .select(
            F.col("n_name").alias("inspect_model_name"),
            F.col("r_name").alias("region"),
            F.get(names, F.col("n_regionkey")).alias("benchmark"),
            "n_customers",
            "balance",
        )
    )
    enriched = dims.with_benchmark_facts(rows, baselines_table(spark), publication_dates(spark))
    return dims.with_display_names(enriched).select(
        "inspect_model_name",
        "region",
        "benchmark",
        "n_customers",
        "balance",
        "baselines.expert",
        "baselines.non_expert",
        "baselines.random",
        "benchmark_publication_date",
        "benchmark_display",
    )


@query(
    "dedupe_keep_first",
    """
WITH u AS (
  SELECT s_nationkey AS nation, s_name AS name, s_acctbal AS balance, 0 AS source FROM supplier
  UNION ALL SELECT c_nationkey, c_name, c_acctbal, 1 FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY source, name) AS r FROM u)
SELECT nation::BIGINT AS nation, name, balance FROM r WHERE r = 1
""",
)
def dedupe_keep_first(t: Tables):
    suppliers = t.supplier.select(
        big(F.col("s_nationkey")).alias("nation"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    customers = t.customer.select(
        big(F.col("c_nationkey")).alias("nation"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")
    )
    return dims.dedupe_keep_first([suppliers, customers], "nation", ["name"])


@query(
    "random_baseline",
    """
WITH n AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey),
o AS (SELECT coalesce(lines, 0) AS n FROM orders LEFT JOIN n ON o_orderkey = l_orderkey)
SELECT round_even(avg(1.0::DOUBLE / (n + 1)), 3) AS random_baseline,
       round_even(avg(1.0::DOUBLE / nullif(pow(2, n) - 1, 0)), 3) AS multi_response_baseline,
       sum(n)::BIGINT AS total_items, min(n)::BIGINT AS min_items, max(n)::BIGINT AS max_items
FROM o
""",
)
def random_baseline(t: Tables):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    n = F.coalesce(F.col("lines"), F.lit(0))
    return (
        t.orders.select("o_orderkey")
        .join(lines, "o_orderkey", "left")
        .agg(
            compare.random_baseline(n).alias("random_baseline"),
            compare.multi_response_baseline(n).alias("multi_response_baseline"),
            F.sum(n).alias("total_items"),
            F.min(n).alias("min_items"),
            F.max(n).alias("max_items"),
        )
    )


@query(
    "array_length_stats",
    """
WITH s AS (SELECT CASE WHEN lang = 'de' THEN 0 ELSE len(string_split(text, ' ')) END AS n FROM documents)
SELECT sum(n)::BIGINT AS total_items, min(n)::BIGINT AS min_items, max(n)::BIGINT AS max_items FROM s
""",
)
def array_length_stats(t: Tables):
    """Words as items; documents in one language have no array at all."""
    words = F.when(F.col("lang") != "de", F.split(F.col("text"), " "))
    return compare.array_length_stats(t.documents.select(words.alias("words")), "words")


@query(
    "log_cost",
    """
WITH u AS (SELECT l_orderkey, l_quantity * 1000 AS i, l_linenumber AS o, p_retailprice AS p, l_linenumber AS total, l_returnflag = 'R' AS is_open
           FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size < 40)
SELECT l_orderkey::VARCHAR AS directory, round(sum(coalesce(round(p, 2) / 1000000 * i + 2.5::DOUBLE / 1000000 * o, 0)), 8) AS cost,
       max(total)::BIGINT AS total_samples, max(CASE WHEN NOT is_open THEN total END)::BIGINT AS completed_samples
FROM u GROUP BY ALL
""",
)
def log_cost(t: Tables):
    """Lines as logs of an order, each with the usage of a part as model and of a model that no price is known of."""
    prices = t.part.filter(F.col("p_size") < 40).select(
        text_of(F.col("p_partkey")).alias("inspect_model_name"),
        F.concat(F.lit("$"), F.format_number("p_retailprice", 2)).alias("input_cost_per_M_tokens"),
        F.lit("$2.50").alias("output_cost_per_M_tokens"),
        F.lit(None).cast("string").alias("cost_per_M_tokens"),
    )
    usage = lambda i, o: F.struct(big(i).alias("input_tokens"), big(o).alias("output_tokens"))
    number = F.col("l_linenumber")
    logs = t.lineitem.select(
        text_of(F.col("l_orderkey")).alias("directory"),
        text_of(number).alias("filename"),
        F.struct(big(number).alias("total_samples"), F.when(F.col("l_returnflag") != "R", big(number)).alias("completed_samples")).alias("results"),
        F.struct(
            F.create_map(
                text_of(F.col("l_partkey")), usage(F.col("l_quantity") * 1000, number), F.lit("unlisted/model"), usage(number, number)
            ).alias("model_usage")
        ).alias("stats"),
    )
    return costing.log_cost(logs, prices, ["directory"]).withColumn("cost", F.round("cost", 8))
