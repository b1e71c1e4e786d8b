import collections
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewise.operators import compare, dims, frontier, quantiles, runs
from gradewise.plans import analyse
from gradewise.sources import dimensions

SUMMARY_DDL = (
    "inspect_model_name string, epoch_model_name string, epoch_organization string, epoch_model_publication_date date, "
    "benchmark string, benchmark_publication_date date, task_args string, prompt_schema string, total_samples bigint, "
    "mean_accuracy double, std_accuracy double, mean_input_tokens bigint, mean_output_tokens bigint, num_runs bigint, "
    "baselines struct<expert:double,non_expert:double,random:double>, task_args_map map<string,string>"
)
D = dt.date


def summary(spark, rows):
    full = []
    for r in rows:
        base = dict(
            inspect_model_name="m/a", epoch_model_name="A", epoch_organization="OpenAI",
            epoch_model_publication_date=D(2024, 1, 1), benchmark="gpqa", benchmark_publication_date=D(2023, 11, 20),
            task_args="{}", prompt_schema="zero_shot", total_samples=78, mean_accuracy=0.5, std_accuracy=0.01,
            mean_input_tokens=100, mean_output_tokens=10, num_runs=10, baselines=(0.667, 0.432, 0.25), task_args_map={},
        )
        full.append({**base, **r})
    return spark.createDataFrame(full, SUMMARY_DDL)


def test_token_ratios(spark):
    rows = [
        dict(), dict(prompt_schema="five_shot", mean_input_tokens=600, mean_output_tokens=5), dict(inspect_model_name="b", prompt_schema="five_shot"),
        dict(task_args="~", mean_input_tokens=7), dict(inspect_model_name="c"),
    ]
    got = compare.token_ratios(summary(spark, rows))
    (row,) = got.collect()
    assert (row.comparison, row.base_total_tokens, row.ratio_input_tokens, row.ratio_output_tokens) == ("five_shot", 110, 6.0, 0.5)
    assert compare.mean_token_ratios(got).first().mean_ratio_total_tokens == pytest.approx(605 / 110)


def test_fold_increase(spark):
    rows = [
        dict(inspect_model_name="openai/gpt-3.5-turbo-0125", mean_accuracy=0.4), dict(mean_accuracy=0.8, epoch_model_name="Top"),
        dict(mean_accuracy=0.8, inspect_model_name="z", epoch_model_name="Later"), dict(benchmark="vct", mean_accuracy=0.9),
    ]
    (row,) = compare.fold_increase(summary(spark, rows)).collect()
    assert tuple(row) == ("gpqa", 0.4, "Top", 0.8, 2.0)
    assert compare.mean_fold_increase(compare.fold_increase(summary(spark, rows))).first()[0] == 2.0


def test_accuracy_table_first_setting_and_blanks(spark):
    rows = [
        dict(task_args="b", mean_accuracy=0.1), dict(task_args="a", mean_accuracy=0.6923076923076923, std_accuracy=0.03364960629919577),
        dict(benchmark="mmlu", std_accuracy=None), dict(benchmark="unknown"), dict(epoch_organization=None, inspect_model_name="n"),
        dict(inspect_model_name="new", epoch_model_publication_date=D(2025, 1, 1)), dict(prompt_schema="five_shot", benchmark="vct"),
    ]
    table = analyse.accuracy_table(summary(spark, rows)).collect()
    assert [r.inspect_model_name for r in table] == ["new", "m/a"]
    assert table[1]["GPQA-Bio"] == "69.2 ± 3.4" and table[1]["MMLU-Bio"] == "" and table[1]["VCT-Text"] == ""


def test_prompt_schema_grid(spark):
    rows = [
        dict(inspect_model_name="openai/gpt-4o"), dict(inspect_model_name="openai/gpt-4o-2024-08-06", mean_accuracy=0.7),
        dict(inspect_model_name="openai/gpt-4o", prompt_schema="zero_shot_cot", mean_accuracy=0.9),
    ]
    grid = analyse.prompt_schema_comparison(summary(spark, rows))
    assert grid.count() == 32
    row = grid.filter("model_display = 'GPT-4o' and benchmark = 'gpqa'").first()
    assert row.base_accuracy == pytest.approx(0.6) and row.cot_ratio == pytest.approx(1.5) and row.five_shot_ratio is None


def test_reasoning_table(spark):
    claude, o3 = "anthropic/claude-3-7-sonnet-20250219", "openai/o3-mini-2025-01-31"
    rows = [
        dict(inspect_model_name=claude, task_args_map={"reasoning_tokens": "16000"}, mean_output_tokens=329218, mean_accuracy=0.7435897435897436),
        dict(inspect_model_name=claude), dict(inspect_model_name=o3, task_args_map={"reasoning_effort": "high"}), dict(inspect_model_name=o3),
        dict(inspect_model_name=o3, task_args_map={"reasoning_effort": "medium"}, mean_accuracy=0.7), dict(),
    ]
    got = {(r.model, r.reasoning_category): r for r in analyse.reasoning_table(summary(spark, rows)).collect()}
    assert set(got) == {
        ("Claude 3.7 Sonnet", "16k reasoning token limit"), ("Claude 3.7 Sonnet", "No reasoning limit specified"),
        ("o3-mini", "High reasoning effort"), ("o3-mini", "Medium reasoning effort"),
    }
    top = got[("Claude 3.7 Sonnet", "16k reasoning token limit")]
    assert top.tokens_per_question == pytest.approx(4220.74358974359) and top.mean_accuracy == pytest.approx(74.35897435897436)
    assert got[("o3-mini", "Medium reasoning effort")].mean_accuracy == pytest.approx(60.0) and top.benchmark_display == "GPQA-Bio"


def test_top_curve_and_frontier(spark):
    day = lambda m: D(2024, m, 1)
    rows = [
        dict(epoch_model_publication_date=D(2023, 5, 1), mean_accuracy=0.3, epoch_model_name="old", inspect_model_name="o"),
        dict(epoch_model_publication_date=day(1), mean_accuracy=0.4, epoch_model_name="first"),
        dict(epoch_model_publication_date=day(2), mean_accuracy=0.4, epoch_model_name="tie", inspect_model_name="zz"),
        dict(epoch_model_publication_date=day(3), mean_accuracy=0.6, epoch_model_name="up", inspect_model_name="u"),
        dict(epoch_model_publication_date=day(4), mean_accuracy=0.5, epoch_model_name="down", inspect_model_name="d"),
        dict(epoch_model_publication_date=day(5), mean_accuracy=0.9335, epoch_model_name="top", inspect_model_name="t"),
        dict(epoch_model_publication_date=day(6), benchmark="mmlu", mean_accuracy=0.8, baselines=(0.898, None, None), benchmark_publication_date=D(2020, 9, 7)),
        dict(epoch_model_publication_date=day(6), benchmark="easy", mean_accuracy=0.9),
        dict(epoch_model_publication_date=day(6), benchmark="none", baselines=None),
    ]
    table = summary(spark, rows)
    curve = [r for r in analyse.top_model_curve(table).orderBy("date", "is_carried").collect() if r.benchmark == "gpqa"]
    assert [r.epoch_model_name for r in curve] == ["old", "first", "first", "up", "up", "top", "top", "top"]
    assert curve[-1].is_carried and curve[-1].date == day(6)

    points = analyse.human_normalized_frontier(table, dimensions.initial_accuracies(spark)).orderBy("date").collect()
    by = collections.defaultdict(list)
    for p in points:
        by[p.benchmark].append((p.model, round(p.normalized_accuracy, 6)))
    assert by["gpqa"] == [("Initial", -100), ("up", round((0.6 - 0.667) * 100 / 0.267, 6)), ("top", round((0.9335 - 0.667) * 100 / 0.267, 6))]
    assert by["mmlu"] == [("Initial", -100), ("A", round((0.8 - 0.898) * 100 / (0.898 - 0.44), 6))]
    assert set(by) == {"gpqa", "mmlu"}
    raw = [p.raw_accuracy for p in points if p.benchmark == "gpqa"]
    assert raw == sorted(set(raw))
    relative = analyse.human_relative_curve(table).filter("benchmark = 'gpqa'").orderBy("date").collect()
    assert relative[-1].normalized_accuracy == pytest.approx((0.9335 - 0.667) / (1 - 0.667)) and len(relative) == 7


def test_frontier_with_many_rows_on_one_day(spark):
    rows = spark.range(2000).select(F.lit("g").alias("g"), F.lit(D(2024, 1, 1)).alias("d"), (F.col("id") % 97).cast("double").alias("v"), "id")
    (row,) = frontier.running_best(rows, "g", "d", "v", "id").collect()
    assert (row.v, row.id) == (96.0, 96)


def test_dedupe_and_majority(spark):
    a = spark.createDataFrame([("m", "z"), ("m", "a"), ("n", "q")], "Model string, o string")
    b = spark.createDataFrame([("m", "0"), ("p", "r")], "Model string, o string")
    assert sorted(map(tuple, dims.dedupe_keep_first([a, b], "Model", ["o"]).collect())) == [("m", "a"), ("n", "q"), ("p", "r")]
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "x"), (2, "x"), (2, "y"), (3, None)], "k int, v string")
    assert sorted(map(tuple, runs.harmonize(rows, ["k"], ["v"]).collect()), key=str) == sorted(
        [(1, "a")] * 3 + [(2, "x")] * 3 + [(3, None)], key=str
    )


def test_filters(spark):
    rows = spark.createDataFrame(
        [("gpqa", "anthropic/claude-3-5-sonnet-20240620"), ("gpqa", "google/gemini-1.0-pro"), ("lab-bench-cloningscenarios", "google/gemini-1.0-pro"), ("x", "ok")],
        "benchmark string, inspect_model_name string",
    )
    assert sorted(map(tuple, dims.exclude_models(rows).collect())) == [("gpqa", "google/gemini-1.0-pro"), ("x", "ok")]
    sized = spark.createDataFrame([(1,), (0,), (None,)], "biggest_in_class int")
    assert dims.largest_of_class(sized).count() == 1
    kept, dropped = dims.split_rejects(sized, F.col("biggest_in_class") == 1)
    assert (kept.count(), dropped.count()) == (1, 2)
    rows, seen = dims.filter_observed(sized, F.col("biggest_in_class") == 1)
    assert len(rows.collect()) == 1 and seen.get == {"rows_in": 3, "rows_dropped": 2}


def test_replicates_and_baselines(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", 1.0)] * 9, "k string, accuracy double")
    kept, dropped = compare.replicated_stats(rows, ["k"])
    assert [r.k for r in kept.collect()] == ["a"] and [r.num_results for r in dropped.collect()] == [9]
    counts = spark.createDataFrame([(1,), (3,)], "n int")
    assert counts.select(compare.random_baseline(F.col("n"))).first()[0] == 0.375
    counts = spark.createDataFrame([(1,), (2,), (3,)], "n int")
    assert counts.select(compare.multi_response_baseline(F.col("n"))).first()[0] == 0.492


@pytest.mark.parametrize("cuts", [2, 7, 1000])
def test_quantiles_against_numpy(spark, cuts):
    generator = np.random.default_rng(3)
    data = {
        "hot": np.concatenate([np.full(3000, 5.0), generator.normal(size=1000)]),
        "wide": generator.normal(size=777) * 1e6,
        "one": np.array([4.0]),
        "two": np.array([1.0, 2.0]),
    }
    rows = [(k, float(x)) for k, xs in data.items() for x in xs] + [("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: r for r in quantiles.group_quantiles(df, ["k"], "v", shares, cuts).collect()}
    for k, xs in data.items():
        assert got[k].n == len(xs) and got[k].quantiles == pytest.approx(list(np.quantile(xs, shares)), rel=1e-12)
    box = {r.k: r for r in quantiles.quartile_summary(df, ["k"], "v").collect()}
    q1, q3 = np.quantile(data["wide"], [0.25, 0.75])
    inside = data["wide"][(data["wide"] >= q1 - 1.5 * (q3 - q1)) & (data["wide"] <= q3 + 1.5 * (q3 - q1))]
    assert (box["wide"].whisker_low, box["wide"].whisker_high) == (inside.min(), inside.max())


def test_a_crowded_cell_is_cut_again(spark):
    """A million distinct values of one group, two cuts, and a task may rank a thousand rows; frequent values and outliers beside them."""
    rows = spark.range(1_000_000).select(F.lit("all").alias("k"), (F.pmod(F.col("id") * 7919, F.lit(1_000_000)) / 8).alias("v"))
    odd = [("odd", x) for x in [3.0] * 4000 + [float(i) for i in range(3000)] + [1e300, -1e300, float("inf")] * 3]
    df = rows.unionByName(spark.createDataFrame(odd, "k string, v double"))
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {r.k: r for r in quantiles.group_quantiles(df, ["k"], "v", shares[1:5], cuts=2, rows=1000).collect()}
    assert got["all"].quantiles == pytest.approx(list(np.quantile(np.arange(1_000_000) / 8, shares[1:5])), rel=1e-12)
    assert got["odd"].quantiles == pytest.approx(list(np.quantile([x for _, x in odd], shares[1:5])), rel=1e-12)
    assert (got["all"].n, got["odd"].n) == (1_000_000, len(odd))
    for cuts in (2, 50):
        box = {r.k: r for r in quantiles.quartile_summary(df, ["k"], "v", cuts, 1000).collect()}
        for k, values in (("all", np.arange(1_000_000) / 8), ("odd", np.array([x for _, x in odd]))):
            q1, q3 = np.quantile(values, [0.25, 0.75])
            inside = values[(values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))]
            assert (box[k].whisker_low, box[k].whisker_high) == (inside.min(), inside.max())


def test_intervals_follow_changes(spark):
    days = [D(2024, m, d) for m in (1, 2, 3) for d in range(1, 29)] + [D(2026, 6, 1)]
    rows = [("a", d, 1.0 if i < 40 else 2.0, i) for i, d in enumerate(days)] + [("b", days[50], 5.0, 0), ("b", None, 9.0, 1), ("c", days[0], None, 2)]
    df = spark.createDataFrame(rows, "g string, d date, v double, o int")
    found = [tuple(r) for r in frontier.best_intervals(df, "g", "d", "v", "o").orderBy("g", "date").select("g", "date", "until", "v", "o").collect()]
    assert found == [("a", days[0], days[40], 1.0, 0), ("a", days[40], None, 2.0, 40), ("b", days[50], None, 5.0, 0)]
    held = {(r.g, r.date): (r.v, r.o) for r in frontier.best_as_of(df, "g", "d", "v", "o").collect()}
    want = {("a", d): (1.0, 0) if i < 40 else (2.0, 40) for i, d in enumerate(days)} | {("b", d): (5.0, 0) for d in days[50:]}
    assert held == want


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert quantiles.median_rank(df, ["k"], "v").count() == 0


def test_date_span_and_envelope(spark):
    rows = spark.createDataFrame(
        [("in", D(2024, 1, 1), D(2023, 12, 30)), ("in", D(2024, 2, 1), None), ("out", D(2024, 1, 1), D(2023, 1, 1)), ("null", D(2024, 1, 1), None)],
        "b string, d date, e date",
    )
    got = {r.b: r.is_within for r in compare.date_span_check(rows, "b", "d", "e").collect()}
    assert got == {"in": True, "out": False, "null": False}
    rows = spark.createDataFrame([("g", "a", 0.5, 0.01), ("g", "a", 0.6, 0.02), ("g", "b", 0.99, 0.2)], "benchmark string, model string, mean_accuracy double, std_accuracy double")
    (row,) = compare.accuracy_envelope(rows).collect()
    low, high = min(50 - 4, 99 - 40), 99 + 40
    assert row.axis_low == pytest.approx(max(0, low - (high - low) * 0.15)) and row.axis_high == 100.0
