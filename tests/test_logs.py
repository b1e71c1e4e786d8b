import math

import pytest
from pyspark.sql import functions as F

import logs
from gradewise.operators import costing, runs, scoring
from gradewise.plans import evaluate
from gradewise.sources import logs as source
from gradewise.streaming import run_stream


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return logs.tree(tmp_path_factory.mktemp("logs"))


@pytest.fixture(scope="module")
def all_logs(spark, root):
    return source.read_eval_logs(spark, root)


def test_rejected_logs_are_reported(all_logs):
    assert source.successful_logs(all_logs).count() == 6
    rejected = source.rejected_logs(all_logs).collect()
    assert [(r.filename, r.status) for r in rejected] == [(logs.name(2), "error")]


def test_single_file(spark, root):
    one = source.read_eval_logs(spark, f"{root}/zero_shot/gpqa/gpt-4o/{logs.name(0)}")
    assert [(r.prompt_schema, r.benchmark, r.model_dir) for r in one.collect()] == [("zero_shot", "gpqa", "gpt-4o")]


def test_run_rows(all_logs):
    rows = {r.run_id: r for r in scoring.run_rows(source.successful_logs(all_logs)).collect()}
    assert rows["a"].accuracy == 0.5 and rows["a"].stderr == 0.05 and not rows["a"].cot_scoring
    assert rows["g"].accuracy is None
    cot = rows["e"]
    # one sample has no text and is left out, the unparsed one counts as wrong: B right, C wrong, none wrong, C,A right
    assert cot.cot_scoring and cot.accuracy == 0.5 and cot.stderr == pytest.approx(math.sqrt(0.25 / 4))
    assert rows["f"].accuracy == 0.0 and rows["f"].stderr == 0.0
    assert cot.task_args == '{"subset":"gpqa_main","n_shot":"0","temperature":"1"}'
    assert cot.run_seconds == 49 and cot.eval_start_time < cot.eval_end_time
    assert rows["g"].total_tokens == 2_000_000


def test_exploded_and_in_row_scores_agree(all_logs):
    scored = scoring.score_completions(scoring.sample_rows(all_logs.filter("is_cot")))
    (row,) = scoring.cot_accuracy(scored, ["filename"]).filter("n_scored > 0").collect()
    assert (row.n_scored, row.n_correct, row.accuracy) == (4, 2, 0.5)


def test_answer_audit(all_logs):
    rows = scoring.sample_rows(all_logs.filter("is_cot"))
    (audit,) = scoring.answer_format_audit(rows, ["filename"]).collect()
    assert (audit.n_samples, audit.n_non_letter, audit.share_non_letter) == (5, 2, 0.4)
    assert {r.id for r in scoring.non_letter_samples(rows).collect()} == {"4", "5"}


def test_harmonised_runs(spark, root):
    rows = evaluate.runs_from_logs(spark, root)
    zero = rows.filter("benchmark = 'gpqa' and prompt_schema = 'zero_shot'")
    assert [tuple(r) for r in zero.select("task", "task_args").distinct().collect()] == [
        ("gpqa", '{"subset":"gpqa_main","n_shot":"5"}')
    ]
    again = runs.harmonize(rows, ["directory"], ["task", "task_args"])
    columns = [c for c in rows.columns if c != "results_generated_time"]
    assert sorted(map(str, again.select(columns).collect())) == sorted(map(str, rows.select(columns).collect()))


PRICES = [
    ("openai/gpt-4o", "GPT-4o", "", "$2.50", "$10.00", "", "", None),
    ("openai/o3", "o3", "$3.00", "", "", "", "", None),
]


@pytest.fixture(scope="module")
def prices(spark):
    from gradewise.schemas import MODEL_PRICES

    return spark.createDataFrame(PRICES, MODEL_PRICES)


def test_log_cost_and_rollup(all_logs, prices):
    good = source.successful_logs(all_logs)
    costs = costing.log_cost(good, prices)
    by_file = {(r.directory, r.filename): r.cost for r in costs.collect()}
    assert [c for (d, _), c in by_file.items() if d.endswith("/o3")] == [pytest.approx(6.0)]
    one = 2.5e-6 * 1000 + 10e-6 * 100
    total = costing.cost_rollup(costs, "directory")
    rows = {r.directory: r for r in total.collect()}
    assert rows[None].is_total == 1
    assert rows[None].cost == pytest.approx(sum(by_file.values())) == pytest.approx(6.0 + 5 * one)
    assert rows[None].cost == pytest.approx(sum(r.cost for k, r in rows.items() if k))
    assert next(r for k, r in rows.items() if k and k.endswith("o3")).cost_per_question is None
    assert rows[None].cost_per_question == pytest.approx(rows[None].cost / rows[None].completed_samples)


def test_unknown_model_label_and_strict_variant(all_logs, prices):
    usage = costing.log_usage(source.successful_logs(all_logs))
    labels = {r.cost_method for r in costing.with_token_cost(usage, prices).collect()}
    assert "Model unknown/model not found in model data" in labels and "combined cost" in labels
    assert costing.require_prices(usage.filter("inspect_model_name = 'openai/o3'"), prices).count() == 1
    with pytest.raises(Exception, match="no price row for model unknown/model"):
        costing.require_prices(usage, prices).collect()


def test_stored_runs_are_partitioned(spark, root, tmp_path):
    evaluate.store_runs(spark, root, str(tmp_path / "runs"))
    stored = spark.read.parquet(str(tmp_path / "runs"))
    assert stored.filter("prompt_schema = 'zero_shot_cot'").count() == 2
    assert (tmp_path / "runs" / "prompt_schema=zero_shot" / "benchmark=vct").is_dir()


def test_stream_matches_batch(spark, root, tmp_path):
    stream = run_stream.stream_runs(run_stream.stream_eval_logs(spark, root, 3))
    query = run_stream.write_run_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = scoring.run_rows(source.successful_logs(source.read_eval_logs(spark, root)))
    columns = ["run_id", "accuracy", "total_tokens", "benchmark", "prompt_schema"]
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, want.select(columns).collect()), key=str)


def test_stream_keeps_every_run(spark, root, tmp_path):
    """Logs months apart, one per batch, some delivered twice, one without an end time: the rows of the batch path."""
    logs = source.successful_logs(source.read_eval_logs(spark, root))
    runs = scoring.run_rows(logs)
    shifted = [runs.withColumn("run_id", F.concat("run_id", F.lit(f"-{m}"))).withColumn("eval_end_time", F.col("eval_end_time") - F.expr(f"interval {m} months")) for m in (7, 0, 3)]
    shifted.append(runs.withColumn("run_id", F.concat("run_id", F.lit("-open"))).withColumn("eval_end_time", F.lit(None).cast(runs.schema["eval_end_time"].dataType)))
    out = str(tmp_path / "table")
    for batch in (shifted[1], shifted[0], shifted[3], shifted[2], shifted[0], shifted[1].unionByName(shifted[1])):
        run_stream.append_new_runs(batch, out)
    got = spark.read.parquet(out).select("run_id").collect()
    want = [r.run_id for part in shifted for r in part.select("run_id").collect()]
    assert sorted(r.run_id for r in got) == sorted(want)

    one_by_one = run_stream.stream_runs(run_stream.stream_eval_logs(spark, root, 1))
    for _ in range(2):  # the second time with a state that has been lost: all logs are delivered again
        query = run_stream.write_run_stream(one_by_one, str(tmp_path / "single"), str(tmp_path / f"state{_}"))
        query.awaitTermination(240)
    stored = spark.read.parquet(str(tmp_path / "single"))
    assert sorted(r.run_id for r in stored.select("run_id").collect()) == sorted(r.run_id for r in runs.select("run_id").collect())


def test_stream_summary(spark, root):
    rows = run_stream.stream_summary(
        scoring.run_rows(source.successful_logs(run_stream.stream_eval_logs(spark, root)))
    )
    query = rows.writeStream.format("memory").queryName("summary_out").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("summary_out").filter("prompt_schema = 'zero_shot' and benchmark = 'gpqa'").collect()
    assert sorted(r.num_runs for r in got) == [1, 2]


def keys_of(spark, out):
    return sorted(r.run_id for r in spark.read.parquet(out).select("run_id").collect())


def test_stream_reads_no_history(spark, root, tmp_path, monkeypatch):
    """A batch is compared with the stored table only when it was broken off before."""
    compared = []
    whole = run_stream.append_new_runs
    monkeypatch.setattr(run_stream, "append_new_runs", lambda rows, out: (compared.append(1), whole(rows, out)))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):  # the second start finds its state and no new log
        run_stream.write_run_stream(run_stream.stream_runs(run_stream.stream_eval_logs(spark, root, 2)), out, state).awaitTermination(240)
    assert keys_of(spark, out) == ["a", "b", "d", "e", "f", "g"] and not compared

    rows = scoring.run_rows(source.successful_logs(source.read_eval_logs(spark, root))).withColumn("_key", run_stream.run_key())
    more = rows.withColumn("run_id", F.concat("run_id", F.lit("-2"))).withColumn("_key", F.col("run_id"))
    notes = str(tmp_path / "notes")
    run_stream.append_batch(more.filter("run_id < 'c'"), 7, out, notes)
    run_stream.append_batch(more.filter("run_id < 'c'"), 7, out, notes)  # run again: its rows are there
    assert compared == [1]
    run_stream.append_batch(more.filter("run_id > 'c'"), 8, out, notes)
    assert compared == [1] and len(keys_of(spark, out)) == 12 == len(set(keys_of(spark, out)))


def test_files_are_rows_or_rejects(spark, tmp_path):
    root = tmp_path / "logs"
    logs.tree(root)
    folder = root / "zero_shot" / "gpqa" / "gpt-4o"
    (folder / "empty.json").write_text(" ")
    (folder / "broken.json").write_text('{"status": "success", "eval": {"task"')
    (folder / "bytes.json").write_bytes(b"\xff\xfe\x00 no json")
    (folder / "list.json").write_text("[]")
    (folder / "large.json").write_text('{"status": "success", "samples": []}' + " " * 50_000)
    (folder / "notes.txt").write_text("not a log")
    scanned = source.scan_logs(spark, str(root), largest=40_000)
    counted, rejects = source.counted_logs(scanned), source.log_rejects(scanned)
    assert counted.count() + rejects.count() == 7 + 5
    assert {r.filename: r.reject for r in rejects.collect()} == {
        "empty.json": "unreadable", "broken.json": "unreadable", "bytes.json": "unreadable", "list.json": "unreadable", "large.json": "too large",
        logs.name(2): "status error",
    }
    plain = source.successful_logs(source.read_eval_logs(spark, str(root))).filter("filename NOT IN ('large.json', 'broken.json')")
    assert counted.columns == plain.columns
    scored = [scoring.run_rows(rows).drop("directory", "results_generated_time") for rows in (counted, plain)]
    assert sorted(map(str, scored[0].collect())) == sorted(map(str, scored[1].collect()))
    evaluate.store_runs(spark, str(root), str(tmp_path / "runs"), str(tmp_path / "rejects"))
    assert spark.read.option("header", True).csv(str(tmp_path / "rejects")).count() == 5

    stream = source.log_rejects(source.scan_logs(spark, str(root), stream=True, files_per_batch=3, largest=40_000))
    query = stream.writeStream.format("memory").queryName("rejects_out").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert {tuple(r) for r in spark.table("rejects_out").collect()} == {tuple(r) for r in rejects.collect()}
