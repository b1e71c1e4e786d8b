"""Queries of row selection, enrichment, question sets and order over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewise.operators import compare, dims, retrieval, runs, samples, scoring
from gradewise.plans.catalog import Tables, query, r6, text_of
from gradewise.plans.scoring_queries import _EVENT_RUNS_SQL, _event_runs
from gradewise.sources import logs
from gradewise.sources.dimensions import baselines_table, publication_dates


@query(
    "file_list",
    f"WITH {_EVENT_RUNS_SQL} SELECT inspect_model_name, benchmark, prompt_schema, task_args, filename FROM runs ORDER BY ALL",
)
def file_list(t: Tables):
    """The sorted list of files of each group, a row per file."""
    return runs.sorted_run_files(_event_runs(t))


@query(
    "successful_logs",
    """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'success' WHEN o_orderstatus = 'O' THEN 'error' END AS status
FROM orders WHERE o_orderstatus = 'F'
""",
)
def successful_logs(t: Tables):
    """Orders as logs: finished ones succeeded, open ones failed, the rest has no status."""
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "error")
    return logs.successful_logs(t.orders.select("o_orderkey", status.alias("status")))


@query(
    "choice_metric",
    """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice WHEN o_orderstatus = 'O' THEN o_custkey::DOUBLE END AS accuracy
FROM orders
""",
)
def choice_metric(t: Tables):
    """The first score named `choice`: of two, of one behind another name, or none."""
    metrics = lambda c: F.create_map(F.lit("accuracy"), F.struct(c.cast("double").alias("value")))
    score = lambda name, c: F.struct(F.lit(name).alias("name"), metrics(c).alias("metrics"))
    price, priority = F.col("o_totalprice"), F.col("o_custkey")
    scores = (
        F.when(F.col("o_orderstatus") == "F", F.array(score("choice", price), score("choice", priority)))
        .when(F.col("o_orderstatus") == "O", F.array(score("match", price), score("choice", priority)))
        .otherwise(F.array(score("match", price)))
    )
    return t.orders.select("o_orderkey", scoring.choice_metric(scores, "accuracy").alias("accuracy"))


@query(
    "selected_runs",
    """
SELECT p_partkey, p_size FROM part WHERE p_size <= 25 AND p_size > 10 AND p_brand IN ('Brand#11', 'Brand#22', 'Brand#33')
""",
)
def selected_runs(t: Tables):
    """Zero-shot rows of the largest models of their class, of the listed ones only."""
    rows = t.part.select(
        "p_partkey",
        "p_size",
        "p_brand",
        F.when(F.col("p_size") <= 25, "zero_shot").otherwise("five_shot").alias("prompt_schema"),
        (F.col("p_size") > 10).cast("int").alias("biggest_in_class"),
    )
    listed = dims.keep_listed(dims.largest_of_class(dims.zero_shot(rows)), "p_brand", ["Brand#11", "Brand#22", "Brand#33"])
    return listed.select("p_partkey", "p_size")


@query(
    "enrich_runs",
    """
WITH notable AS (SELECT 'E' || s_nationkey AS model, date '2020-01-01' + s_suppkey::INT AS published, s_name AS organization, s_acctbal AS parameters, 0 AS source FROM supplier),
large AS (SELECT 'E' || (c_nationkey + 5) AS model, date '2021-01-01' + c_custkey::INT AS published, c_name AS organization, c_acctbal AS parameters, 1 AS source FROM customer),
m AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY source, published, organization, parameters) AS r FROM (FROM notable UNION ALL FROM large)),
p AS (SELECT 'nation' || n_nationkey AS inspect_model_name, 'E' || (n_nationkey + n_regionkey) AS epoch_model_name FROM nation)
SELECT c_custkey::VARCHAR AS run_id, inspect_model_name, epoch_model_name, published AS epoch_model_publication_date,
       organization AS epoch_organization, round(parameters, 6) AS epoch_parameters, c_mktsegment AS benchmark, c_acctbal AS accuracy
FROM customer LEFT JOIN p ON inspect_model_name = 'nation' || c_nationkey LEFT JOIN m ON m.model = epoch_model_name AND r = 1
""",
)
def enrich_runs(t: Tables):
    """Customers as runs of the model of their nation; models are described by suppliers first, else by customers."""
    days = lambda start, key: F.date_add(F.lit(start).cast("date"), F.col(key).cast("int"))

    def described(table, nation, shift, start, key, name, number):
        return table.select(
            F.concat(F.lit("E"), text_of(F.col(nation) + shift)).alias("Model"),
            days(start, key).alias("Publication date"),
            F.col(name).alias("Organization"),
            F.col(number).cast("double").alias("Parameters"),
            F.lit(None).cast("double").alias("Training compute (FLOP)"),
        )

    prices = t.nation.select(
        F.concat(F.lit("nation"), text_of(F.col("n_nationkey"))).alias("inspect_model_name"),
        F.concat(F.lit("E"), text_of(F.col("n_nationkey") + F.col("n_regionkey"))).alias("epoch_model_name"),
        *[F.lit(None).cast("string").alias(c) for c in ("input_cost_per_M_tokens", "output_cost_per_M_tokens", "last_updated")],
    )
    metadata = dims.model_metadata(
        prices,
        described(t.supplier, "s_nationkey", 0, "2020-01-01", "s_suppkey", "s_name", "s_acctbal"),
        described(t.customer, "c_nationkey", 5, "2021-01-01", "c_custkey", "c_name", "c_acctbal"),
    )
    facts = {"inspect_model_name", "benchmark", "run_id", "accuracy"}
    known = {c for c in metadata.columns} | {"baselines", "benchmark_publication_date", "est_cost"}
    rows = t.customer.select(
        text_of(F.col("c_custkey")).alias("run_id"),
        F.concat(F.lit("nation"), text_of(F.col("c_nationkey"))).alias("inspect_model_name"),
        F.col("c_mktsegment").alias("benchmark"),
        F.col("c_acctbal").alias("accuracy"),
        *[F.lit(None).cast("string").alias(c) for c in dims.RUN_COLUMNS if c not in facts | known],
    )
    joined = dims.enrich_runs(rows, metadata, baselines_table(t.spark), publication_dates(t.spark))
    return joined.select(
        "run_id",
        "inspect_model_name",
        "epoch_model_name",
        "epoch_model_publication_date",
        "epoch_organization",
        r6(F.col("epoch_parameters")).alias("epoch_parameters"),
        "benchmark",
        "accuracy",
    )


@query(
    "samples_distractors",
    """
WITH k AS (SELECT *, o_orderpriority || '_' || o_orderkey::VARCHAR AS id FROM orders),
c AS (SELECT id, o_orderstatus, list_transform(list_sort([
        {'h': md5('42|' || id || '|0'), 'pos': 0, 'c': o_orderpriority},
        {'h': md5('42|' || id || '|1'), 'pos': 1, 'c': o_custkey::VARCHAR},
        {'h': md5('42|' || id || '|2'), 'pos': 2, 'c': o_orderstatus}]), lambda x: x.c) AS choices
      FROM k)
SELECT id, array_to_string(choices, '|') AS choices, chr(64 + list_position(choices, o_orderstatus)::INT) AS target FROM c
""",
)
def samples_distractors(t: Tables):
    """Orders as questions: the status is the ideal answer among priority and customer."""
    records = t.orders.select(
        F.col("o_orderpriority").alias("subtask"),
        text_of(F.col("o_orderkey")).alias("id"),
        F.col("o_orderstatus").alias("question"),
        F.array("o_orderpriority", text_of(F.col("o_custkey"))).alias("distractors"),
        F.col("o_orderstatus").alias("ideal"),
        F.lit(None).cast("string").alias("key-passage"),
        F.lit(None).cast("array<string>").alias("sources"),
    )
    rows = samples.samples_distractors(records)
    return rows.select("id", F.array_join("choices", "|").alias("choices"), F.get("target", F.lit(0)).alias("target"))


@query(
    "question_baselines",
    """
WITH d AS (SELECT lang, source, len(string_split(text, chr(10))) AS n FROM documents)
SELECT 'lab-bench-' || lang AS benchmark, round_even(avg(1.0::DOUBLE / (n + 1)), 3) AS random FROM d GROUP BY lang
UNION ALL SELECT 'vct_images', round_even(avg(1.0::DOUBLE / (pow(2, n) - 1)), 3) FROM d
UNION ALL SELECT 'vct', round_even(avg(1.0::DOUBLE / (pow(2, n) - 1)), 3) FROM d WHERE source = 'src1'
""",
)
def question_baselines(t: Tables):
    """Lines of a document as distractors and as statements; documents of one source have no image."""
    lines = F.split("text", "\n")
    lab = compare.lab_bench_baselines(t.documents.select(F.col("lang").alias("subset"), lines.alias("distractors")))
    image = F.when(F.col("source") != "src1", F.col("source"))
    vct = compare.statement_baselines(t.documents.select(lines.alias("answer_statements"), image.alias("image_file")))
    return lab.unionByName(vct)


@query(
    "effort_order",
    """
SELECT l_returnflag, l_linestatus AS model, effort, sum(l_quantity) AS quantity, CASE effort WHEN 'Low reasoning effort' THEN 0
       WHEN 'Medium reasoning effort' THEN 1 WHEN 'High reasoning effort' THEN 2 END::INT AS place
FROM (SELECT *, CASE WHEN l_linenumber <= 2 THEN 'High reasoning effort' WHEN l_linenumber <= 4 THEN 'Low reasoning effort'
             ELSE 'Medium reasoning effort' END AS effort FROM lineitem)
GROUP BY ALL ORDER BY l_returnflag, model, place
""",
)
def effort_order(t: Tables):
    """Rows of a group in the order of their reasoning effort."""
    effort = (
        F.when(F.col("l_linenumber") <= 2, "High reasoning effort")
        .when(F.col("l_linenumber") <= 4, "Low reasoning effort")
        .otherwise("Medium reasoning effort")
    )
    rows = (
        t.lineitem.groupBy("l_returnflag", F.col("l_linestatus").alias("model"), effort.alias("effort"))
        .agg(F.sum("l_quantity").alias("quantity"))
    )
    return compare.sort_by_effort(rows, ["l_returnflag", "model"], "effort")


@query(
    "results_order",
    """
SELECT n_name AS epoch_organization, date '2020-01-01' + s_suppkey::INT AS epoch_model_publication_date, s_name
FROM supplier JOIN nation ON s_nationkey = n_nationkey ORDER BY 1, 2 DESC
""",
)
def results_order(t: Tables):
    """Suppliers as models: nations alphabetically, the newest first."""
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("epoch_organization"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("s_suppkey").cast("int")).alias("epoch_model_publication_date"),
        "s_name",
    )
    return compare.sort_results_table(rows)


@query(
    "repeated_ids",
    "SELECT l_orderkey::VARCHAR AS id, count(*)::BIGINT AS n_rows FROM lineitem GROUP BY 1 HAVING count(*) > 1",
)
def repeated_ids(t: Tables):
    return samples.repeated_ids(t.lineitem.select(text_of(F.col("l_orderkey")).alias("id")))


@query(
    "retrieve_vector_text",
    """
WITH v AS (SELECT 'LitQA2_' || vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.id AS question_id, b.id AS doc_id, list_dot_product(a.e, b.e) AS score FROM v a JOIN v b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT question_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 3
""",
)
def retrieve_vector_text(t: Tables):
    """Ids as text, as the samples of the question sets have them."""
    rows = t.embeddings.select(F.concat(F.lit("LitQA2_"), text_of(F.col("vec_id"))).alias("id"), "embedding")
    ranked = retrieval.retrieve_vector(rows, rows, k=3, question_id="id", doc_id="id", exclude_self=True)
    return ranked.withColumn("score", F.round("score", 6))


@query(
    "first_score",
    """
WITH p AS (SELECT page_id, string_split(url, '/') AS parts FROM pages)
SELECT page_id, list_filter(parts, lambda x: regexp_matches(x, '^[0-9]'))[1] AS first_number FROM p
""",
)
def first_score(t: Tables):
    """First path part that begins with a digit, by the operator."""
    return t.pages.select("page_id", scoring.first_match(F.split("url", "/"), lambda p: p.rlike("^[0-9]")).alias("first_number"))
