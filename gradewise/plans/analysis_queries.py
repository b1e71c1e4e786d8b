"""Comparison, quantile and frontier queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewise.functions import labels
from gradewise.functions.literals import parse_dict_literal
from gradewise.functions.measures import percent
from gradewise.operators import compare, dims, frontier, quantiles
from gradewise.plans.catalog import Tables, big, query, r6, text_of


# --- comparisons -----------------------------------------------------------------------------

_LINE_SUMMARY_SQL = """
s AS (SELECT l_linestatus, 'm' || (l_suppkey % 10)::VARCHAR AS model, l_returnflag,
             trunc(avg(l_quantity * 100))::BIGINT AS i, trunc(avg(l_extendedprice))::BIGINT AS o
      FROM lineitem GROUP BY ALL)
"""


def _line_summary(t: Tables):
    """Lines as a token summary: return flag is the prompt schema, line status the benchmark."""
    return t.lineitem.groupBy(
        F.col("l_linestatus").alias("benchmark"),
        F.concat(F.lit("m"), (F.col("l_suppkey") % 10).cast("string")).alias("inspect_model_name"),
        F.col("l_returnflag").alias("prompt_schema"),
    ).agg(
        F.lit("{}").alias("task_args"),
        big(F.avg(F.col("l_quantity") * 100)).alias("mean_input_tokens"),
        big(F.avg("l_extendedprice")).alias("mean_output_tokens"),
    )


_RATIO_SQL = f"""
WITH {_LINE_SUMMARY_SQL},
r AS (SELECT b.l_linestatus AS benchmark, b.model AS inspect_model_name, c.l_returnflag AS comparison,
             b.i AS base_input_tokens, b.o AS base_output_tokens, b.i + b.o AS base_total_tokens,
             c.i AS compared_input_tokens, c.o AS compared_output_tokens, c.i + c.o AS compared_total_tokens,
             c.i / b.i AS ri, c.o / b.o AS ro, (c.i + c.o) / (b.i + b.o) AS rt
      FROM s b JOIN s c ON b.l_linestatus = c.l_linestatus AND b.model = c.model
      WHERE b.l_returnflag = 'N' AND c.l_returnflag IN ('A', 'R'))
"""


@query(
    "token_ratios",
    _RATIO_SQL
    + """
SELECT * EXCLUDE (ri, ro, rt), round(ri, 6) AS ratio_input_tokens, round(ro, 6) AS ratio_output_tokens,
       round(rt, 6) AS ratio_total_tokens FROM r
""",
)
def token_ratios(t: Tables):
    ratios = compare.token_ratios(_line_summary(t), base="N", compared=["A", "R"])
    return ratios.withColumns({f"ratio_{k}": r6(F.col(f"ratio_{k}")) for k in compare.TOKEN_KINDS})


@query(
    "mean_token_ratios",
    _RATIO_SQL
    + """
SELECT comparison, round(avg(ri), 6) AS mean_ratio_input_tokens, round(avg(ro), 6) AS mean_ratio_output_tokens,
       round(avg(rt), 6) AS mean_ratio_total_tokens FROM r GROUP BY comparison
""",
)
def mean_token_ratios(t: Tables):
    means = compare.mean_token_ratios(compare.token_ratios(_line_summary(t), base="N", compared=["A", "R"]))
    return means.withColumns({f"mean_ratio_{k}": r6(F.col(f"mean_ratio_{k}")) for k in compare.TOKEN_KINDS})


_FOLD_SQL = """
WITH s AS (SELECT o_orderstatus AS benchmark, o_orderpriority AS model, avg(o_totalprice) AS a FROM orders GROUP BY ALL),
f AS (SELECT benchmark, max(a) FILTER (model = '1-URGENT') AS first_accuracy, arg_max(model, a) AS top_model,
             max(a) AS top_accuracy FROM s GROUP BY benchmark)
"""


@query(
    "fold_increase",
    _FOLD_SQL
    + """
SELECT benchmark, round(first_accuracy, 6) AS first_accuracy, top_model, round(top_accuracy, 6) AS top_accuracy,
       round(top_accuracy / first_accuracy, 6) AS fold_increase FROM f WHERE first_accuracy IS NOT NULL
""",
)
def fold_increase(t: Tables):
    folds = _order_folds(t)
    return folds.withColumns({c: r6(F.col(c)) for c in ("first_accuracy", "top_accuracy", "fold_increase")})


def _order_folds(t: Tables):
    summary = t.orders.groupBy(
        F.col("o_orderstatus").alias("benchmark"), F.col("o_orderpriority").alias("inspect_model_name")
    ).agg(F.avg("o_totalprice").alias("mean_accuracy"))
    return compare.fold_increase(summary, ["1-URGENT"], shown="inspect_model_name")


@query(
    "mean_fold_increase",
    _FOLD_SQL + "SELECT round(avg(top_accuracy / first_accuracy), 6) AS mean_fold_increase FROM f",
)
def mean_fold_increase(t: Tables):
    return compare.mean_fold_increase(_order_folds(t)).select(r6(F.col("mean_fold_increase")).alias("mean_fold_increase"))


EVENT_TYPES = ["signup", "view", "click", "error", "purchase"]


@query(
    "results_table",
    """
WITH s AS (SELECT 'm' || (user_id % 7)::VARCHAR AS model, event_type, avg(value / 500) AS m, stddev_samp(value / 500) AS s
           FROM events GROUP BY ALL),
c AS (SELECT model, event_type,
             round((m * 100)::DECIMAL(18,6), 1)::DECIMAL(18,1)::VARCHAR || ' ± '
               || round((s * 100)::DECIMAL(18,6), 1)::DECIMAL(18,1)::VARCHAR AS cell FROM s)
SELECT model, coalesce(max(cell) FILTER (event_type = 'signup'), '') AS signup,
       coalesce(max(cell) FILTER (event_type = 'view'), '') AS view,
       coalesce(max(cell) FILTER (event_type = 'click'), '') AS click,
       coalesce(max(cell) FILTER (event_type = 'error'), '') AS error,
       coalesce(max(cell) FILTER (event_type = 'purchase'), '') AS purchase
FROM c GROUP BY model
""",
)
def results_table(t: Tables):
    share = F.col("value") / 500
    summary = t.events.groupBy(
        F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("model"),
        F.col("event_type").alias("benchmark_display"),
    ).agg(
        F.lit("{}").alias("task_args"), F.avg(share).alias("mean_accuracy"), F.stddev_samp(share).alias("std_accuracy")
    )
    return compare.results_table(summary, EVENT_TYPES, keys=["model"])


@query(
    "token_pivot",
    f"""
WITH {_LINE_SUMMARY_SQL}
SELECT l_linestatus AS prompt_schema, model AS inspect_model_name,
       trunc(avg(i) FILTER (l_returnflag = 'A'))::BIGINT AS "A_input_tokens",
       trunc(avg(o) FILTER (l_returnflag = 'A'))::BIGINT AS "A_output_tokens",
       trunc(avg(i) FILTER (l_returnflag = 'N'))::BIGINT AS "N_input_tokens",
       trunc(avg(o) FILTER (l_returnflag = 'N'))::BIGINT AS "N_output_tokens",
       trunc(avg(i) FILTER (l_returnflag = 'R'))::BIGINT AS "R_input_tokens",
       trunc(avg(o) FILTER (l_returnflag = 'R'))::BIGINT AS "R_output_tokens"
FROM s GROUP BY ALL
""",
)
def token_pivot(t: Tables):
    summary = _line_summary(t).select(
        F.col("benchmark").alias("prompt_schema"),
        "inspect_model_name",
        F.col("prompt_schema").alias("benchmark"),
        "mean_input_tokens",
        "mean_output_tokens",
    )
    return compare.token_pivot(summary, ["A", "N", "R"])


BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@query(
    "schema_fold_ci",
    """
WITH s AS (SELECT l_linestatus AS benchmark, p_brand AS model, l_returnflag AS f, avg(l_extendedprice) AS m,
                  stddev_samp(l_extendedprice) AS sd, count(*) AS n
           FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
w AS (SELECT benchmark, model, max(m) FILTER (f = 'N') AS m0, max(sd) FILTER (f = 'N') AS s0, max(n) FILTER (f = 'N') AS n0,
             max(m) FILTER (f = 'A') AS ma, max(sd) FILTER (f = 'A') AS sa, max(n) FILTER (f = 'A') AS na,
             max(m) FILTER (f = 'R') AS mr, max(sd) FILTER (f = 'R') AS sr, max(n) FILTER (f = 'R') AS nr
      FROM s GROUP BY ALL),
e AS (SELECT *, sqrt(pow(sa / ma, 2) / na + pow(s0 / m0, 2) / n0) AS ea, sqrt(pow(sr / mr, 2) / nr + pow(s0 / m0, 2) / n0) AS er FROM w),
g AS (SELECT b.benchmark, 'Brand#' || i::VARCHAR AS model FROM (VALUES ('F'), ('O'), ('X')) b(benchmark), range(1, 26) r(i))
SELECT g.benchmark, g.model AS model_display,
       round(ma / m0, 6) AS a_ratio, round(exp(ln(ma / m0) - 1.96 * ea), 6) AS a_ci_low, round(exp(ln(ma / m0) + 1.96 * ea), 6) AS a_ci_high,
       round(mr / m0, 6) AS r_ratio, round(exp(ln(mr / m0) - 1.96 * er), 6) AS r_ci_low, round(exp(ln(mr / m0) + 1.96 * er), 6) AS r_ci_high,
       round(m0, 4) AS base_accuracy, round(ma, 4) AS a_accuracy, round(mr, 4) AS r_accuracy
FROM g LEFT JOIN e USING (benchmark, model)
""",
)
def schema_fold_ci(t: Tables):
    lines = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    summary = lines.groupBy(
        F.col("l_linestatus").alias("benchmark"),
        F.col("p_brand").alias("model_display"),
        F.col("l_returnflag").alias("prompt_schema"),
    ).agg(
        F.avg("l_extendedprice").alias("mean_accuracy"),
        F.stddev_samp("l_extendedprice").alias("std_accuracy"),
        F.count(F.lit(1)).alias("num_runs"),
    )
    folds = compare.schema_fold_ci(summary, base="N", compared={"A": "a", "R": "r"})
    grid = compare.densify_grid(folds, {"benchmark": ["F", "O", "X"], "model_display": BRANDS})
    return grid.withColumns(
        {
            **{f"{p}_{m}": r6(F.col(f"{p}_{m}")) for p in "ar" for m in ("ratio", "ci_low", "ci_high")},
            **{f"{p}_accuracy": F.round(f"{p}_accuracy", 4) for p in ("base", "a", "r")},
        }
    )


_REASONING_SQL = """
e AS (
  SELECT event_id, value, user_id,
         CASE WHEN event_type IN ('click', 'view') THEN 'Claude 3.7 Sonnet' WHEN event_type IN ('error', 'signup') THEN 'o3-mini' END AS model,
         (props::JSON ->> 'k')::INT AS k FROM events),
r AS (
  SELECT *, CASE model WHEN 'Claude 3.7 Sonnet' THEN
                 CASE WHEN k % 10 = 0 THEN 'No reasoning limit specified'
                      ELSE (k * 1500 // 1000)::VARCHAR || 'k reasoning token limit' END
            ELSE CASE k % 4 WHEN 0 THEN 'Medium' WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' ELSE 'High' END || ' reasoning effort' END
            AS reasoning_category FROM e WHERE model IS NOT NULL)
"""


def _reasoning_rows(t: Tables):
    """Events as summary rows of two reasoning models, with the setting kept in a dict literal."""
    model = (
        F.when(F.col("event_type").isin("click", "view"), F.lit("anthropic/claude-3-7-sonnet-20250219"))
        .when(F.col("event_type").isin("error", "signup"), F.lit("openai/o3-mini-2025-01-31"))
        .otherwise(F.lit("other"))
    )
    k = F.get_json_object("props", "$.k").cast("int")
    effort = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.greatest(k % 4, F.lit(1)))
    tokens = F.when(k % 10 == 0, F.lit("None")).otherwise((k * 1500).cast("string"))
    task_args = F.concat(
        F.lit("{'reasoning_tokens': "), tokens, F.lit(", 'reasoning_effort': "),
        F.when(k % 4 == 0, F.lit("None")).otherwise(F.concat(F.lit("'"), effort, F.lit("'"))), F.lit("}"),
    )
    rows = t.events.select(
        (F.col("user_id") % 3).cast("string").alias("benchmark"),
        model.alias("inspect_model_name"),
        task_args.alias("task_args"),
        (F.col("value") / 500).alias("mean_accuracy"),
        (F.col("value") / 5000).alias("std_accuracy"),
        F.col("event_id").alias("mean_output_tokens"),
        (F.col("user_id") + 1).alias("total_samples"),
        F.col("event_id").alias("row_id"),
    )
    return rows.withColumn("task_args_map", parse_dict_literal(F.col("task_args"), python_fallback=False))


@query(
    "reasoning_effect",
    f"""
WITH {_REASONING_SQL}
SELECT (user_id % 3)::VARCHAR AS benchmark, model, reasoning_category, round(avg(value / 500) * 100, 6) AS mean_accuracy,
       round(avg(value / 5000) * 100, 6) AS std_accuracy, round(avg(event_id), 6) AS mean_output_tokens,
       (arg_min(user_id, event_id) + 1)::BIGINT AS total_samples,
       round(avg(event_id) / (arg_min(user_id, event_id) + 1), 6) AS tokens_per_question
FROM r GROUP BY ALL
""",
)
def reasoning_effect(t: Tables):
    table = compare.reasoning_effect(compare.with_reasoning_category(_reasoning_rows(t)), order=["row_id"])
    rounded = ("mean_accuracy", "std_accuracy", "mean_output_tokens", "tokens_per_question")
    return table.withColumns({c: r6(F.col(c)) for c in rounded})


@query(
    "replicated_stats",
    """
SELECT event_type, user_id, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*)::BIGINT AS num_results,
       count(*) = 10 AS is_kept
FROM events GROUP BY event_type, user_id
""",
)
def replicated_stats(t: Tables):
    """Groups with exactly ten rows are kept; the others are the report of what was dropped."""
    kept, dropped = compare.replicated_stats(t.events, ["event_type", "user_id"], "value")
    both = kept.withColumn("is_kept", F.lit(True)).unionByName(dropped.withColumn("is_kept", F.lit(False)))
    return both.withColumns({c: r6(F.col(c)) for c in ("mean", "std")})


@query(
    "accuracy_envelope",
    """
WITH s AS (SELECT event_type, user_id % 7 AS series, avg(value / 1000) AS m, stddev_samp(value / 8000) AS sd
           FROM events GROUP BY event_type, user_id % 7, (props::JSON ->> 'k')::INT % 3),
p AS (SELECT event_type, series, min(m) * 100 - 2 * max(sd) * 100 AS lo, max(m) * 100 + 2 * max(sd) * 100 AS hi FROM s GROUP BY ALL),
g AS (SELECT event_type, min(lo) AS lo, greatest(max(hi), 0) AS hi FROM p GROUP BY event_type)
SELECT event_type AS benchmark, round(greatest(0, lo - (hi - lo) * 0.15::DOUBLE), 6) AS axis_low,
       round(least(100, hi + (hi - lo) * 0.15::DOUBLE), 6) AS axis_high FROM g
""",
)
def accuracy_envelope(t: Tables):
    setting = F.get_json_object("props", "$.k").cast("int") % 3
    rows = t.events.groupBy(
        F.col("event_type").alias("benchmark"), (F.col("user_id") % 7).alias("model"), setting.alias("setting")
    ).agg(F.avg(F.col("value") / 1000).alias("mean_accuracy"), F.stddev_samp(F.col("value") / 8000).alias("std_accuracy"))
    return compare.accuracy_envelope(rows).withColumns({c: r6(F.col(c)) for c in ("axis_low", "axis_high")})


@query(
    "date_span_check",
    """
WITH d AS (SELECT o_orderpriority AS benchmark, o_orderdate::DATE AS d,
                  DATE '1992-01-01' + 1000 * ascii(o_orderpriority[1])::INT - 49000 + 600 AS e FROM orders),
s AS (SELECT benchmark, min(d) AS a, max(d) AS b, max(e) AS e FROM d GROUP BY benchmark)
SELECT benchmark, a AS first_date, b AS last_date, e AS event_date,
       (e - DATE '1970-01-01') * 86400 BETWEEN (a - DATE '1970-01-01') * 86400 - floor((b - a) * 86400 * 0.1::DOUBLE)
         AND (b - DATE '1970-01-01') * 86400 + floor((b - a) * 86400 * 0.1::DOUBLE) AS is_within
FROM s
""",
)
def date_span_check(t: Tables):
    """Priorities get event dates a thousand days apart, from before the first order to after the last."""
    offset = (F.ascii("o_orderpriority") - 49) * 1000 + 600
    rows = t.orders.select(
        F.col("o_orderpriority").alias("benchmark"),
        F.col("o_orderdate").alias("date"),
        F.date_add(F.lit("1992-01-01").cast("date"), offset).alias("event"),
    )
    return compare.date_span_check(rows, "benchmark", "date", "event")


@query(
    "baseline_lines",
    """
WITH b AS (SELECT event_type, max(CASE WHEN event_type IN ('click', 'view') THEN 0.7 END)::DOUBLE AS e,
                  max(CASE WHEN event_type = 'click' THEN 0.4 END)::DOUBLE AS n,
                  max(CASE WHEN event_type <> 'error' THEN 0.25 END)::DOUBLE AS r, count(*)::BIGINT AS n_rows
           FROM events GROUP BY event_type)
SELECT event_type AS benchmark, 'Expert accuracy' AS kind, e AS value, n_rows FROM b WHERE e IS NOT NULL
UNION ALL SELECT event_type, 'Non-expert accuracy', n, n_rows FROM b WHERE n IS NOT NULL
UNION ALL SELECT event_type, 'Random guess', r, n_rows FROM b WHERE r IS NOT NULL
""",
)
def baseline_lines(t: Tables):
    kind = F.col("event_type")
    rows = t.events.select(
        kind.alias("benchmark"),
        F.struct(
            F.when(kind.isin("click", "view"), F.lit(0.7)).alias("expert"),
            F.when(kind == "click", F.lit(0.4)).alias("non_expert"),
            F.when(kind != "error", F.lit(0.25)).alias("random"),
        ).alias("baselines"),
    )
    return compare.baseline_lines(rows).join(compare.distinct_groups(rows, "benchmark"), "benchmark")


@query(
    "label_and_filter",
    """
WITH e AS (
  SELECT CASE event_type WHEN 'click' THEN 'zero_shot' WHEN 'view' THEN 'five_shot' WHEN 'error' THEN 'zero_shot_cot' ELSE 'other' END AS prompt_schema,
         CASE user_id % 4 WHEN 0 THEN 'Google DeepMind,Google' WHEN 1 THEN 'OpenAI' WHEN 2 THEN 'Meta AI' END AS org,
         'model-' || (user_id % 5)::VARCHAR AS model, CASE user_id % 3 WHEN 0 THEN 'gpqa' WHEN 1 THEN 'wmdp' ELSE 'vct' END AS benchmark,
         CASE user_id % 2 WHEN 0 THEN 'Biology' ELSE 'LAW' END AS category, value
  FROM events)
SELECT CASE prompt_schema WHEN 'zero_shot' THEN 'Zero-shot' WHEN 'five_shot' THEN 'Five-shot' ELSE 'Zero-shot CoT' END AS condition,
       CASE org WHEN 'Google DeepMind,Google' THEN 'Google DeepMind' ELSE org END AS epoch_organization,
       CASE benchmark WHEN 'gpqa' THEN 'GPQA-Bio' WHEN 'wmdp' THEN 'WMDP-Bio' ELSE 'VCT-Text' END AS benchmark_display,
       CASE benchmark WHEN 'vct' THEN 0 WHEN 'wmdp' THEN 4 ELSE 5 END::BIGINT AS benchmark_rank,
       count(*)::BIGINT AS n_rows, round(sum(value), 2) AS total
FROM e
WHERE prompt_schema <> 'other' AND org IS NOT NULL AND lower(category) IN ('biology', 'math')
  AND model <> 'model-1' AND NOT (benchmark = 'vct' AND model = 'model-2')
GROUP BY ALL
""",
)
def label_and_filter(t: Tables):
    kind, user = F.col("event_type"), F.col("user_id")
    rows = t.events.select(
        F.when(kind == "click", F.lit("zero_shot"))
        .when(kind == "view", F.lit("five_shot"))
        .when(kind == "error", F.lit("zero_shot_cot"))
        .otherwise(F.lit("other"))
        .alias("prompt_schema"),
        F.when(user % 4 == 0, F.lit("Google DeepMind,Google"))
        .when(user % 4 == 1, F.lit("OpenAI"))
        .when(user % 4 == 2, F.lit("Meta AI"))
        .alias("epoch_organization"),
        F.concat(F.lit("model-"), text_of(user % 5)).alias("inspect_model_name"),
        F.when(user % 3 == 0, F.lit("gpqa")).when(user % 3 == 1, F.lit("wmdp")).otherwise(F.lit("vct")).alias("benchmark"),
        F.when(user % 2 == 0, F.lit("Biology")).otherwise(F.lit("LAW")).alias("category"),
        "value",
    )
    from gradewise.fixed_values import COMPARED_BENCHMARKS
    from gradewise.operators.samples import filter_subtask

    kept = dims.require_values(dims.with_standard_org(dims.with_condition(rows)), "epoch_organization")
    kept = filter_subtask(kept, F.col("category"), ["biology", "math"], ignore_case=True)
    kept = dims.exclude_models(kept, [(None, "model-1"), ("vct", "model-2")])
    return (
        dims.with_display_names(kept)
        .withColumn("benchmark_rank", big(labels.explicit_rank(F.col("benchmark"), COMPARED_BENCHMARKS)))
        .groupBy("condition", "epoch_organization", "benchmark_display", "benchmark_rank")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("value"), 2).alias("total"))
    )


@query(
    "labels_text",
    """
WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, o_totalprice * pow(10, o_orderkey % 20) AS x FROM orders),
p AS (SELECT *, floor(log10(x))::INT AS p FROM o)
SELECT o_orderkey, 'zero_shot/' || o_orderstatus || '/' || o_orderpriority AS path,
       CASE WHEN p >= 10 THEN '1e' || p::VARCHAR
            WHEN round_even(x / pow(10, p), 0) >= 10 THEN CASE WHEN p + 1 < 1 THEN '1' ELSE '1e+' || lpad((p + 1)::VARCHAR, 2, '0') END
            WHEN p < 1 THEN round_even(x / pow(10, p), 0)::INT::VARCHAR
            ELSE round_even(x / pow(10, p), 0)::INT::VARCHAR || 'e+' || lpad(p::VARCHAR, 2, '0') END AS exponent_label,
       CASE WHEN o_totalprice >= 1000 THEN trunc(o_totalprice / 1000)::BIGINT::VARCHAR || 'k'
            ELSE trunc(o_totalprice)::BIGINT::VARCHAR END AS thousand_label,
       round(o_totalprice / 600000 * 100, 6) AS percent
FROM p
""",
)
def labels_text(t: Tables):
    price = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey",
        labels.path_label(F.lit("zero_shot"), F.col("o_orderstatus"), F.concat(F.lit("a/b/"), "o_orderpriority")).alias("path"),
        labels.exponent_label(price * F.pow(F.lit(10.0), (F.col("o_orderkey") % 20).cast("double"))).alias("exponent_label"),
        labels.thousand_label(price).alias("thousand_label"),
        r6(percent(price / 600000)).alias("percent"),
    )


# --- quantiles -------------------------------------------------------------------------------


@query(
    "median_rank",
    """
SELECT event_type, count(*)::BIGINT AS n, round(median(value), 6) AS median FROM events GROUP BY event_type ORDER BY median DESC
""",
)
def median_rank(t: Tables):
    medians = quantiles.median_rank(t.events, ["event_type"], "value")
    return medians.withColumn("median", r6(F.col("median"))).orderBy(F.col("median").desc())


@query(
    "quartile_summary",
    """
WITH q AS (SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, quantile_cont(l_extendedprice, 0.25) AS q1,
                  median(l_extendedprice) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY ALL)
SELECT q.l_returnflag, q.l_linestatus, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       min(l_extendedprice) AS whisker_low, max(l_extendedprice) AS whisker_high
FROM q JOIN lineitem l ON l.l_returnflag = q.l_returnflag AND l.l_linestatus = q.l_linestatus
WHERE l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)
GROUP BY ALL
""",
)
def quartile_summary(t: Tables):
    box = quantiles.quartile_summary(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return box.withColumns({c: r6(F.col(c)) for c in ("q1", "median", "q3")})


# --- frontiers -------------------------------------------------------------------------------

_ORDER_CURVE = {"group": "o_orderpriority", "date": "o_orderdate", "value": "o_totalprice", "order": "o_orderkey"}
_DAILY_SQL = """
d AS (SELECT o_orderpriority, o_orderdate::DATE AS date, max(o_totalprice) AS v,
             arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS k FROM orders GROUP BY ALL)
"""
_RUNNING_SQL = """
w AS (SELECT o_orderpriority, date, max((v, -k)) OVER (PARTITION BY o_orderpriority ORDER BY date) AS m FROM d)
"""


@query(
    "running_best",
    f"""
WITH {_DAILY_SQL}, {_RUNNING_SQL}
SELECT o_orderpriority, date, m[1] AS o_totalprice, (-m[2])::BIGINT AS o_orderkey FROM w
""",
)
def running_best(t: Tables):
    return frontier.running_best(t.orders, **_ORDER_CURVE)


@query(
    "best_as_of",
    f"""
WITH {_DAILY_SQL},
g AS (SELECT a.o_orderpriority, b.date FROM (SELECT o_orderpriority, min(date) AS f FROM d GROUP BY 1) a
      JOIN (SELECT DISTINCT date FROM d) b ON b.date >= a.f),
w AS (SELECT g.o_orderpriority, g.date, max(CASE WHEN v IS NOT NULL THEN (v, -k) END)
             OVER (PARTITION BY g.o_orderpriority ORDER BY g.date) AS m
      FROM g LEFT JOIN d USING (o_orderpriority, date))
SELECT o_orderpriority, date, m[1] AS o_totalprice, (-m[2])::BIGINT AS o_orderkey, false AS is_carried FROM w
UNION ALL
SELECT o_orderpriority, max(date), arg_max(m[1], date), (-arg_max(m[2], date))::BIGINT, true FROM w GROUP BY o_orderpriority
""",
)
def best_as_of(t: Tables):
    return frontier.carry_last_forward(frontier.best_as_of(t.orders, **_ORDER_CURVE), "o_orderpriority")


_STARTS_SQL = """
f AS (SELECT o_orderpriority, max(o_totalprice) * 0.95::DOUBLE AS expert,
             min(o_orderdate)::DATE + CASE WHEN o_orderpriority = '5-LOW' THEN -30 ELSE 365 END AS event_date
      FROM orders GROUP BY o_orderpriority),
i AS (SELECT o_orderpriority, event_date, expert,
             CASE WHEN o_orderpriority = '5-LOW' THEN 1000.0::DOUBLE
                  ELSE (SELECT arg_min(o.o_totalprice, (o.o_orderdate, o.o_orderkey)) FROM orders o
                        WHERE o.o_orderpriority = f.o_orderpriority AND o.o_orderdate >= f.event_date) END AS initial
      FROM f),
st AS (SELECT * FROM i WHERE initial < expert)
"""
_FRONTIER_SQL = f"""
WITH {_DAILY_SQL}, {_RUNNING_SQL}, {_STARTS_SQL},
c AS (SELECT w.o_orderpriority, date, m[1] AS v, (-m[2])::BIGINT AS k, event_date, expert, initial,
             lag(m[1]) OVER (PARTITION BY w.o_orderpriority ORDER BY date) AS before
      FROM w JOIN st USING (o_orderpriority) WHERE date >= event_date)
"""


def _order_starts(t: Tables):
    lead = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(-30)).otherwise(F.lit(365))
    facts = (
        t.orders.groupBy("o_orderpriority")
        .agg(F.min(F.col("o_orderdate").cast("date")).alias("_first"), (F.max("o_totalprice") * 0.95).alias("expert"))
        .select("o_orderpriority", F.date_add("_first", lead).alias("event_date"), "expert")
    )
    fixed = t.orders.sparkSession.createDataFrame([("5-LOW", 1000.0)], "o_orderpriority string, fixed_initial double")
    return frontier.initial_performance(t.orders, facts, fixed, **_ORDER_CURVE)


@query(
    "initial_performance",
    f"WITH {_STARTS_SQL} SELECT o_orderpriority, event_date, round(expert, 4) AS expert, initial FROM st",
)
def initial_performance(t: Tables):
    return _order_starts(t).withColumn("expert", F.round("expert", 4))


@query(
    "improvement_frontier",
    _FRONTIER_SQL
    + """
SELECT o_orderpriority, date, v AS o_totalprice, k AS o_orderkey FROM c WHERE v > greatest(coalesce(before, initial), initial)
""",
)
def improvement_frontier(t: Tables):
    points = frontier.improvement_frontier(t.orders, _order_starts(t), **_ORDER_CURVE)
    return points.select("o_orderpriority", "date", "o_totalprice", "o_orderkey")


@query(
    "normalized_frontier",
    _FRONTIER_SQL
    + """
SELECT o_orderpriority, date, k::VARCHAR AS model, v AS raw_accuracy,
       round((v - expert) * 100 / (expert - initial), 6) AS normalized_accuracy
FROM c WHERE v > greatest(coalesce(before, initial), initial)
UNION ALL SELECT o_orderpriority, event_date, 'Initial', initial, -100.0::DOUBLE FROM st
""",
)
def normalized_frontier(t: Tables):
    points = frontier.normalized_frontier(t.orders, _order_starts(t), shown="o_orderkey", **_ORDER_CURVE)
    return points.withColumn("normalized_accuracy", r6(F.col("normalized_accuracy")))


@query(
    "relative_frontier",
    f"""
WITH {_DAILY_SQL},
g AS (SELECT a.o_orderpriority, b.date FROM (SELECT o_orderpriority, min(date) AS f FROM d GROUP BY 1) a
      JOIN (SELECT DISTINCT date FROM d) b ON b.date >= a.f),
w AS (SELECT g.o_orderpriority, g.date, max(v) OVER (PARTITION BY g.o_orderpriority ORDER BY g.date) AS v
      FROM g LEFT JOIN d USING (o_orderpriority, date)),
x AS (SELECT o_orderpriority, avg(o_totalprice) / 1000000 AS expert FROM orders WHERE o_orderpriority <> '3-MEDIUM' GROUP BY 1)
SELECT o_orderpriority, date, round((v / 1000000 - expert) / (1 - expert), 6) AS normalized_accuracy
FROM w JOIN x USING (o_orderpriority)
""",
)
def relative_frontier(t: Tables):
    """One priority has no expert value and is left out."""
    rows = t.orders.withColumn("share", F.col("o_totalprice") / 1000000)
    experts = rows.groupBy("o_orderpriority").agg(F.avg("share").alias("expert")).withColumn(
        "expert", F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("expert"))
    )
    curve = frontier.relative_frontier(rows, experts, "o_orderpriority", "o_orderdate", "share", "o_orderkey")
    return curve.select("o_orderpriority", "date", r6(F.col("normalized_accuracy")).alias("normalized_accuracy"))


@query(
    "best_setting",
    """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part)
SELECT p_brand, p_type, p_retailprice, p_partkey, p_name FROM r WHERE r = 1
""",
)
def best_setting(t: Tables):
    return frontier.best_setting(t.part, ["p_brand", "p_type"], "p_retailprice", ["p_partkey"], ["p_partkey", "p_name"])
