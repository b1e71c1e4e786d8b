import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gradewise import schemas
from gradewise.operators import compare, dims, runs, samples, validate
from gradewise.plans import evaluate, prepare
from gradewise.sources import dimensions, logs, questions, sinks

HEADER = (
    "inspect_model_name,task,task_args,prompt_schema,total_samples,accuracy,stderr,total_tokens,input_tokens,"
    "output_tokens,run_id,eval_start_time,eval_end_time,results_generated_time,filename,cot_scoring"
)
ZERO = [54, 52, 53, 50, 52, 56, 52, 58, 56, 57]
FIVE = [52, 56, 52, 54, 54, 53, 58, 53, 52, 52]


def run_csv(root, schema, benchmark, model_dir, model, correct, n=78):
    folder = root / schema / benchmark / model_dir
    folder.mkdir(parents=True)
    lines = [HEADER]
    for i, c in enumerate(correct):
        args = "\"{'subset': 'gpqa_main', 'subtasks': \"\"['Biology']\"\"}\"" if i % 2 else "\"{'subset': 'gpqa_main', 'subtasks': ['Biology']}\""
        lines.append(
            f"{model},gpqa,{args},{'' if i == 0 else schema},{n},{c / n},0.05,1100,{1000 + i},{100 + i},run{i},"
            f"2024-11-05T11:15:41-05:00,2024-11-05T11:15:41-05:00,2025-01-28T12:15:30,"
            f"2024-11-05T11-14-{10 + i}-05-00_gpqa_{i}.json,False"
        )
    (folder / "results.csv").write_bytes(("\r\n".join(lines) + "\r\n").encode())


@pytest.fixture(scope="module")
def stored(tmp_path_factory):
    root = tmp_path_factory.mktemp("stored")
    run_csv(root, "zero_shot", "gpqa", "gpt-4o", "openai/gpt-4o", ZERO)
    run_csv(root, "five_shot", "gpqa", "gpt-4o", "openai/gpt-4o", FIVE)
    prices = root / "models.tsv"
    prices.write_text(
        "inspect_model_name\tepoch_model_name\tcost_per_M_tokens\tinput_cost_per_M_tokens\toutput_cost_per_M_tokens\t"
        "cost_source\tapi_source\tlast_updated\nopenai/gpt-4o\tGPT-4o\t\t$2.50\t$10.00\ta\tb\t2025-02-28\n"
        "x/y\tUnlisted\t\t\t\t\t\t2025-02-28\n"
    )
    (root / "notable.csv").write_text(
        "Domain,Model,Organization,Publication date,Parameters,Training compute (FLOP)\n"
        'Language,GPT-4o,"OpenAI",2024-05-13,,3.8e25\nLanguage,GPT-4o,Copy,2025-05-13,1,1\n'
    )
    (root / "large.csv").write_text(
        "Model,Organization,Publication date,Parameters,Training compute (FLOP)\nGPT-4o,Other,2023-01-01,7,1e20\n"
    )
    return root


def test_read_runs_takes_labels_from_the_path(spark, stored):
    rows = logs.read_runs(spark, str(stored))
    assert rows.count() == 20
    assert rows.filter("prompt_schema = 'zero_shot'").count() == 10
    first = rows.orderBy("filename", "prompt_schema").first()
    assert first.benchmark == "gpqa" and first.cot_scoring is False
    assert first.eval_end_time == dt.datetime(2024, 11, 5, 16, 15, 41)
    assert first.task_args.startswith("{'subset'")
    assert rows.filter("accuracy is null or total_samples <> 78").count() == 0


def test_no_run_files_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        logs.read_runs(spark, str(tmp_path)).count()


@pytest.mark.parametrize("spelling", ["canonical", "majority"])
def test_summary_golden(spark, stored, spelling):
    rows = evaluate.enriched_runs(
        spark, logs.read_runs(spark, str(stored)), str(stored / "models.tsv"), str(stored / "notable.csv"),
        str(stored / "large.csv"), include_cost=True, spelling=spelling,
    )
    assert rows.columns == dims.RUN_COLUMNS
    summary = {r.prompt_schema: r for r in evaluate.summary_with_files(rows, include_cost=True).collect()}
    zero, five = summary["zero_shot"], summary["five_shot"]
    assert zero.mean_accuracy == pytest.approx(0.6923076923076923, abs=1e-12)
    assert zero.std_accuracy == pytest.approx(0.03364960629919577, abs=1e-12)
    assert five.mean_accuracy == pytest.approx(0.6871794871794872, abs=1e-12)
    assert five.std_accuracy == pytest.approx(0.025783082271792077, abs=1e-12)
    assert (zero.num_runs, zero.mean_input_tokens, zero.mean_output_tokens, zero.mixed_samples) == (10, 1004, 104, False)
    assert zero.path == "zero_shot/gpqa/gpt-4o" and zero.epoch_organization == "OpenAI"
    assert zero.epoch_training_compute_flop == 3.8e25 and zero.benchmark_publication_date == dt.date(2023, 11, 20)
    assert zero.baselines.expert == 0.667 and len(zero.filenames) == 10 and zero.filenames == sorted(zero.filenames)
    assert zero.est_tot_cost == pytest.approx(0.0, abs=0.11)
    literal = runs.summarize_runs(logs.read_runs(spark, str(stored)))
    assert sorted(r.num_runs for r in literal.collect()) == [5, 5, 5, 5]

    named = dims.with_display_names(runs.summarize_runs(rows))
    fold = compare.schema_fold_ci(named).collect()[0]
    assert fold.five_shot_ratio == pytest.approx(0.9925925925925926, abs=1e-9)
    assert fold.five_shot_ci_low == pytest.approx(0.9555269227559487, abs=1e-9)
    assert fold.five_shot_ci_high == pytest.approx(1.0310960700385465, abs=1e-9)
    assert fold.cot_ratio is None


def test_publish_and_read_back(spark, stored, tmp_path):
    run_path, summary_path = evaluate.publish(
        spark, str(stored), str(tmp_path), str(stored / "models.tsv"), str(stored / "notable.csv"), str(stored / "large.csv")
    )
    assert run_path.endswith("_all_runs.csv") and summary_path.endswith("_summary.csv")
    back = spark.read.option("header", True).option("escape", '"').csv(summary_path)
    files = spark.read.option("header", True).csv(summary_path.replace("_summary", "_files"))
    assert files.count() == 20
    lists = files.groupBy("inspect_model_name", "benchmark", "prompt_schema").agg(F.first("filename").alias("filenames"))
    back = back.join(lists, ["inspect_model_name", "benchmark", "prompt_schema"])
    wanted = [c.split()[0] for c in schemas.SUMMARY.split(", ")]
    sinks.write_csv(back.select(wanted), str(tmp_path / "shaped"))
    typed = dimensions.read_summary(spark, str(tmp_path / "shaped"))
    row = typed.filter("prompt_schema = 'zero_shot'").first()
    assert row.baselines.expert == 0.667 and row.baselines.non_expert == 0.432
    assert row.task_args_map["subset"] == "gpqa_main"
    assert row.epoch_model_publication_date == dt.date(2024, 5, 13)


def test_an_interrupted_publication_leaves_the_last_state(spark, stored, tmp_path, monkeypatch):
    arguments = (str(stored), str(tmp_path), str(stored / "models.tsv"), str(stored / "notable.csv"), str(stored / "large.csv"))
    assert sinks.published(spark, str(tmp_path)) == {}
    first = evaluate.publish(spark, *arguments)
    state = sinks.published(spark, str(tmp_path))
    assert set(state) == {"files", "all_runs", "summary"} and (state["all_runs"], state["summary"]) == first

    def broken(*_, **__):
        raise OSError("disk is gone")

    with monkeypatch.context() as patch:  # breaks off after two of three tables
        patch.setattr(evaluate, "sort_summary", broken)
        with pytest.raises(OSError):
            evaluate.publish(spark, *arguments)
    assert sinks.published(spark, str(tmp_path)) == state
    assert spark.read.option("header", True).csv(state["files"]).count() == 20
    again = evaluate.publish(spark, *arguments)
    now = sinks.published(spark, str(tmp_path))
    assert (now["all_runs"], now["summary"]) == again and now["summary"] != state["summary"]
    assert spark.read.option("header", True).csv(state["summary"]).count() == spark.read.option("header", True).csv(now["summary"]).count()


def test_costs_and_rejects_are_published(spark, stored, tmp_path):
    import logs as invented

    tree = invented.tree(tmp_path / "logs")
    evaluate.publish(
        spark, str(stored), str(tmp_path / "out"), str(stored / "models.tsv"), str(stored / "notable.csv"), str(stored / "large.csv"), logs=tree
    )
    state = sinks.published(spark, str(tmp_path / "out"))
    costs = spark.read.option("header", True).csv(state["log_costs"])
    assert [r.is_total for r in costs.filter("filename is null").collect()] == ["1"] and costs.count() == 5
    assert [r.reject for r in spark.read.option("header", True).csv(state["rejected_logs"]).collect()] == ["status error"]


def test_files_of_a_large_group(spark, stored, tmp_path):
    rows = logs.read_runs(spark, str(stored))
    assert runs.run_files(rows).count() == 20
    large = rows.limit(1).crossJoin(spark.range(12_000)).withColumn("filename", F.format_string("f%06d", 11_999 - F.col("id")))
    files = [r.filename for r in runs.sorted_run_files(large).collect()]
    assert len(files) == 12_000 and files == sorted(files)
    assert runs.summarize_runs(large).first().num_runs == 12_000


def test_jsonl(spark, tmp_path):
    good = {"question_id": "1", "question": "q ", "answer_statements": [{"statement": "s", "is_correct": True}], "image_file": None}
    other = {"question_id": "2", "image_file": "i.png", "answer_statements": [{"statement": "a", "is_correct": False}] * 3}
    (tmp_path / "v.jsonl").write_text("\n".join([json.dumps(good), "", "   ", "{broken", json.dumps(other), json.dumps({"question_id": "3"})]))
    rows = questions.read_jsonl(spark, str(tmp_path / "v.jsonl"))
    valid = questions.valid_lines(rows)
    assert valid.count() == 3
    assert [r[0] for r in questions.invalid_lines(rows).collect()] == ["{broken"]
    assert tuple(compare.array_length_stats(valid).first()) == (4, 0, 3)
    assert tuple(compare.array_length_stats(valid.limit(0)).first()) == (None, None, None)
    assert samples.text_only(valid).count() == 2


def test_question_set_pruning(spark, tmp_path):
    root = str(tmp_path / "mmlu")
    rows = [("q1", ["a", "b"], 1, "s", "virology", "test"), ("q2", ["a", "b"], 0, "s", "anatomy", "test"),
            ("q3", ["a", "b"], 0, "s", "sociology", "test"), ("q4", ["a", "b"], 0, "s", "virology", "dev")]
    spark.createDataFrame(rows, f"{schemas.MMLU}, subset string, split string").write.partitionBy("subset", "split").parquet(root)
    scan = questions.read_question_set(spark, root, "mmlu", ["virology"], "test")
    assert [r.question for r in scan.collect()] == ["q1"]
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "subset" in plan.split("PartitionFilters")[1][:200]
    bio = prepare.prepare_samples(spark, root, "mmlu", subtasks="biology", split="test")
    assert {r.input for r in bio.collect()} == {"q1", "q2"}
    assert prepare.prepare_samples(spark, root, "mmlu", subset="all", split="test", samples=2).count() == 2


def test_copies_in_a_question_set_keep_their_own_ids(spark, tmp_path, monkeypatch):
    from gradewise.operators import sampling

    root = str(tmp_path / "mmlu")
    rows = [("same", ["a", "b"], 1, "s", "virology", "test")] * 50 + [(f"q{i}", ["a", "b"], 0, "s", "anatomy", "test") for i in range(50)]
    spark.createDataFrame(rows, f"{schemas.MMLU}, subset string, split string").write.partitionBy("subset", "split").parquet(root)
    monkeypatch.setattr(sampling, "TOP_N_LIMIT", 0)
    for n in (1, 33, 70):
        got = prepare.prepare_samples(spark, root, "mmlu", split="test", samples=n)
        assert got.count() == n == got.select("id").distinct().count()


def test_preparation_by_subtask_and_mode(spark, tmp_path):
    root = str(tmp_path / "gpqa")
    rows = [(f"r{i}", f"q{i}", "a", "b", "c", "d", "Biology" if i % 2 else "Physics", "", "", "", "", "", "gpqa_main", "train") for i in range(20)]
    spark.createDataFrame(rows, f"{schemas.GPQA}, subset string, split string").write.partitionBy("subset", "split").parquet(root)
    bio = prepare.prepare_samples(spark, root, "gpqa", subset="gpqa_main", subtasks="Biology", split="train")
    assert bio.count() == 10
    done = prepare.prepare_prompts(bio, n_shot=3)
    assert done.count() == 10 and {r.prompt.count("ANSWER: ") for r in done.collect()} == {4}
    pro = str(tmp_path / "pro")
    spark.createDataFrame([(1, "q", ["x"], "A", "Biology", "", "", None, "test")], f"{schemas.MMLU_PRO}, subset string, split string").write.partitionBy("subset", "split").parquet(pro)
    assert prepare.prepare_samples(spark, pro, "mmlu_pro", subtasks="biology", split="test").count() == 1
    with pytest.raises(ValueError, match="no samples"):
        prepare.prepare_samples(spark, pro, "mmlu_pro", subtasks="law", split="test")
    record = {"question_id": "1", "question": "Q", "image_file": None, "answer_statements": [{"statement": "s", "is_correct": True}]}
    (tmp_path / "v.jsonl").write_text("\n".join(json.dumps({**record, "image_file": f}) for f in (None, "i.png")))
    vct = prepare.prepare_samples(spark, str(tmp_path / "v.jsonl"), "vct", subtasks="no_images", mode="mr")
    assert [r.target for r in vct.collect()] == [["A"]]


def test_preparation_defaults_and_bad_names(spark, tmp_path):
    root = str(tmp_path / "gpqa")
    row = lambda i, subset: (f"r{i}", f"q{i}", "a", "b", "c", "d", "Biology", "", "", "", "", "", subset, "train")
    rows = [row(i, "gpqa_main") for i in range(4)] + [row(i, "gpqa_diamond") for i in range(2)]
    spark.createDataFrame(rows, f"{schemas.GPQA}, subset string, split string").write.partitionBy("subset", "split").parquet(root)
    samples = prepare.prepare_samples(spark, root, "gpqa")
    assert samples.count() == 4 == samples.select("id").distinct().count()
    assert [r.prompt.count("ANSWER: ") for r in prepare.prepare_prompts(samples, n_shot=1).collect()] == [2] * 4
    for bad in ({"subset": "bogus"}, {"subtasks": "Biolgy"}, {"split": "tset"}, {"mode": "mc"}):
        with pytest.raises(ValueError, match="not an allowed value|unknown argument"):
            prepare.prepare_samples(spark, root, "gpqa", **bad)
    twice = str(tmp_path / "twice")
    spark.createDataFrame([row(1, "gpqa_main"), row(1, "gpqa_main")], f"{schemas.GPQA}, subset string, split string").write.partitionBy("subset", "split").parquet(twice)
    with pytest.raises(ValueError, match="2 records have the id"):
        prepare.prepare_samples(spark, twice, "gpqa")
    corpus = spark.createDataFrame([(1, "all about q1 and more", "T", "u"), (2, "nothing here", "T", "u")], "doc_id long, text string, title string, url string").withColumn("content", F.col("text"))
    found = {r.input: r.prompt for r in prepare.prepare_retrieved_prompts(samples, corpus, "pubmed").collect()}
    assert len(found) == 4 and "Content: all about q1 and more\n\nQuestion:\n" in found["q1"]


def test_computed_baselines_reach_the_runs(spark, tmp_path):
    record = {"question_id": "1", "question": "Q", "image_file": None, "answer_statements": [{"statement": "s", "is_correct": True}] * 2}
    (tmp_path / "v.jsonl").write_text("\n".join(json.dumps({**record, "image_file": f}) for f in (None, "i.png")))
    lab = str(tmp_path / "lab")
    fields = [f.strip().rsplit(" ", 1) for f in schemas.QUESTION_SETS["lab_bench"].split(", ")]
    table = spark.createDataFrame([(s, "train") for s in ("LitQA2", "CloningScenarios", "ProtocolQA")], "subset string, split string")
    table = table.withColumns({n.strip("`"): (F.array(F.lit("x"), F.lit("y")) if "array" in t else F.lit("x")).cast(t) for n, t in fields if n.strip("`") not in table.columns})
    table.write.partitionBy("subset", "split").parquet(lab)
    computed = evaluate.computed_baselines(spark, lab, str(tmp_path / "v.jsonl"))
    got = {r.benchmark: r.baselines.random for r in dimensions.baselines_table(spark, computed).collect()}
    assert all(got[b] is not None for b in got), got


def test_articles(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version='1'>11</PMID><Article><ArticleTitle>One</ArticleTitle>"
        "<Abstract><AbstractText Label='x'>Text</AbstractText><AbstractText>More</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"
        "<PubmedArticle><MedlineCitation><PMID Version='1'>12</PMID><Article><ArticleTitle>Two</ArticleTitle></Article>"
        "</MedlineCitation></PubmedArticle></PubmedArticleSet>"
    )
    (tmp_path / "b.xml").write_text("<PubmedArticleSet><PubmedArticle><Medline")
    rows = questions.read_articles_xml(spark, str(tmp_path)).orderBy("pmid").collect()
    assert [tuple(r) for r in rows] == [("11", "One", "Text"), ("12", "Two", "No abstract available")]


def test_outputs(spark, tmp_path):
    df = spark.createDataFrame([("zero_shot", [1, 2]), ("five_shot", None)], "prompt_schema string, a array<int>")
    sinks.write_per_schema(df, str(tmp_path / "t"))
    assert (tmp_path / "t" / "prompt_schema=zero_shot").is_dir()
    path = sinks.write_dated_csv(df, str(tmp_path), "summary", dt.date(2025, 1, 2))
    assert path.endswith("/20250102_summary.csv") and spark.read.option("header", True).csv(path).count() == 2


CONFIG = """
environment: {LOG_DIR: ./logs}
global_settings: {temperature: 0.5, max_tokens: 10}
models:
  openai/o3-mini: {reasoning_effort: high, temperature: null}
  named: {model: x/y, rag: {enabled: true, tool: lexical}}
benchmarks:
  wmdp: {enabled: true, subset: wmdp-bio, runs: 2}
  gpqa: {subset: gpqa_main, subtasks: [Biology], n_shot: 5}
  mmlu: {enabled: false}
  chess: {runs: 3}
"""


def test_configuration_to_run_matrix(spark, tmp_path):
    (tmp_path / "c.yaml").write_text(CONFIG)
    models, benchmarks = dimensions.config_tables(spark, dimensions.load_config(str(tmp_path / "c.yaml")))
    wanted, unknown = validate.enabled_benchmarks(benchmarks, validate.known_benchmarks(spark))
    assert [r.benchmark for r in unknown.collect()] == ["chess"]
    matrix = validate.run_matrix(wanted, models).collect()
    assert sorted((r.benchmark, r.model, r.run) for r in matrix) == [
        ("gpqa", "openai/o3-mini", 1), ("gpqa", "x/y", 1), ("wmdp", "openai/o3-mini", 1), ("wmdp", "openai/o3-mini", 2),
        ("wmdp", "x/y", 1), ("wmdp", "x/y", 2),
    ]
    o3 = next(r for r in matrix if r.model == "openai/o3-mini")
    assert o3.settings == {"reasoning_effort": "high", "max_tokens": "10"}
    assert "runs" not in o3.args and "enabled" not in o3.args
    many = models.limit(1).crossJoin(spark.range(200)).withColumn("model", F.concat("model", F.col("id").cast("string"))).drop("id")
    assert validate.run_matrix(wanted, many).count() == 3 * 200


@pytest.mark.parametrize("sent", [None, 0])
def test_run_matrix_sends_the_smaller_side(spark, monkeypatch, sent):
    """Few rows of one side are sent to the other, which stays where it is; without sending, the product is the same."""
    if sent is not None:
        monkeypatch.setattr(validate, "SENT_ROWS", sent)
    pair = F.create_map(F.lit("a"), F.col("id").cast("string"), F.lit("runs"), F.lit("9"))
    for n, m in ((300, 4), (4, 300)):
        benchmarks = spark.range(n).select(F.concat(F.lit("b"), "id").alias("benchmark"), (F.col("id") % 3).cast("int").alias("runs"), pair.alias("args"))
        models = spark.range(m).select(
            F.concat(F.lit("k"), "id").alias("model_key"), F.concat(F.lit("m"), "id").alias("model"),
            pair.alias("default_settings"), F.create_map(F.lit("runs"), F.lit(None).cast("string")).alias("settings"), F.lit(None).cast("string").alias("rag"),
        )
        matrix = validate.run_matrix(benchmarks, models)
        got = [(r.benchmark, r.model, r.run, r.args, r.settings) for r in matrix.collect()]
        want = [(f"b{b}", f"m{k}", r, {"a": str(b)}, {"a": str(k)}) for b in range(n) for k in range(m) for r in range(1, b % 3 + 1)]
        assert sorted(got, key=str) == sorted(want, key=str)
        if sent is None:
            assert "BroadcastNestedLoopJoin" in matrix._jdf.queryExecution().executedPlan().toString()


def test_argument_checks(spark):
    requests = spark.createDataFrame(
        [("gpqa", {"subset": "gpqa_main", "subtasks": '["Biology","Alchemy"]', "n_shot": "5"}), ("wmdp", {"subset": "all", "cot": "True"}),
         ("mmlu_pro", {"subtasks": "all"}), ("vct", {"mode": "xx", "samples": "ten"})],
        "benchmark string, args map<string,string>",
    )
    got = {(r.benchmark, r.argument, r.value, r.problem) for r in validate.argument_problems(requests).collect()}
    assert got == {
        ("gpqa", "subtasks", "Alchemy", "not an allowed value"), ("wmdp", "subset", "all", "not an allowed value"),
        ("vct", "mode", "xx", "not an allowed value"), ("vct", "samples", "ten", "wrong type"),
    }
    full = {r.benchmark: r.args for r in validate.with_defaults(requests).collect()}
    done = {r.benchmark: r.args for r in validate.complete_arguments(requests).collect()}
    assert json.loads(done["mmlu_pro"]["subtasks"])[:2] == ["biology", "medicine"] and len(json.loads(done["mmlu_pro"]["subtasks"])) == 15
    assert done["gpqa"]["subtasks"] == '["Biology","Alchemy"]' and done["wmdp"]["cot"] == "true" and done["vct"]["cot"] == "false"
    assert full["gpqa"]["split"] == "train" and full["gpqa"]["n_shot"] == "5" and full["vct"]["subtasks"] == "all"


def test_retriever_checks(spark):
    rows = [("a", '{"enabled": true, "tool": "web"}'), ("b", '{"enabled": false, "tool": "web"}'), ("c", '{"enabled": true}'),
            ("d", '{"enabled": true, "tool": "lexical"}'), ("e", None)]
    got = validate.retriever_problems(spark.createDataFrame(rows, "model_key string, rag string")).collect()
    assert sorted(map(tuple, got), key=str) == [("a", "web", "unknown tool"), ("c", None, "no tool")]


def test_baselines_from_question_sets(spark):
    lab = spark.createDataFrame(
        [("LitQA2", ["a"]), ("LitQA2", ["a", "b", "c"]), ("ProtocolQA", ["a"])], "subset string, distractors array<string>"
    )
    vct = spark.createDataFrame(
        [([1], None), ([1, 2], None), ([1, 2, 3], "i.png")], "answer_statements array<int>, image_file string"
    )
    computed = compare.lab_bench_baselines(lab).unionByName(compare.statement_baselines(vct))
    table = dims.with_computed_random(dimensions.baselines_table(spark), computed)
    got = {r.benchmark: r.baselines for r in table.collect()}
    assert got["lab-bench-litqa2"].random == 0.375 and got["lab-bench-protocolqa"].random == 0.5
    assert got["vct_images"].random == 0.492 and got["vct"].random == 0.667 and got["gpqa"].random == 0.25
    assert got["lab-bench-cloningscenarios"].random is None and got["lab-bench-litqa2"].expert == 0.7
