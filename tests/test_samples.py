import collections
import random

import pytest
from pyspark.sql import functions as F

from gradewise import schemas
from gradewise.operators import prompts, samples, sampling


def test_gpqa_properties(spark):
    rows = [(f"r{i}", f"q{i}", f"right{i}", "w1", "w2", "w3", "Biology", None, "e", None, None, None) for i in range(60)]
    mapped = samples.samples_gpqa(spark.createDataFrame(rows, schemas.GPQA))
    got = mapped.collect()
    for r in got:
        i = int(r.id[1:])
        assert r.choices[ord(r.target[0]) - 65] == f"right{i}" and sorted(r.choices) == sorted([f"right{i}", "w1", "w2", "w3"])
        assert r.metadata["Subdomain"] == "" and r.metadata["High-level domain"] == "Biology"
    assert len({r.target[0] for r in got}) == 4
    again = samples.samples_gpqa(spark.createDataFrame(rows, schemas.GPQA).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert samples.filter_subtask(mapped, F.col("metadata")["High-level domain"], ["Physics"]).count() == 0
    with pytest.raises(ValueError, match="no samples"):
        samples.filter_subtask(mapped, F.col("metadata")["High-level domain"], ["Physics"], required=True)


def test_lab_bench(spark):
    ddl = schemas.LAB_BENCH + ", subset string"
    rows = [
        ("1", "lit", "q", "same", ["same"], None, ["s"], "kp", "LitQA2"),
        ("2", "clone", "q", "i", [f"d{k}" for k in range(7)], None, None, None, "CloningScenarios"),
        ("3", "prot", "q", "i", ["d"], "steps", None, None, "ProtocolQA"),
    ]
    got = {r.id: r for r in samples.to_samples("lab_bench", spark.createDataFrame(rows, ddl)).collect()}
    assert got["lit_1"].target == ["A"] and got["lit_1"].metadata == {"key_passage": "kp", "sources": '["s"]'}
    assert len(got["clone_2"].choices) == 8 and got["clone_2"].choices[ord(got["clone_2"].target[0]) - 65] == "i"
    assert got["prot_3"].input == "Protocol:\nsteps\n\nQuestion:\nq"


def test_other_mappers(spark):
    pub = spark.createDataFrame([("7", "d", "t", "q", "c", ["yes", "no", "maybe"], ["Yes"])], schemas.PUBMEDQA)
    row = samples.to_samples("pubmedqa", pub).first()
    assert (row.target, row.input, row.metadata["document_id"]) == (["A"], "Context: c\n\nQuestion: q", "d")
    pro = spark.createDataFrame([(5, "q", ["x", "y"], "B", "Biology", "cot", "src")], schemas.MMLU_PRO)
    assert samples.to_samples("mmlu_pro", pro).first().target == ["B"]
    wmdp = spark.createDataFrame([("q", ["a", "b", "c", "d"], 3)], schemas.WMDP)
    assert samples.to_samples("wmdp", wmdp).first().target == ["D"]
    with pytest.raises(KeyError):
        samples.to_samples("chess", wmdp)


def vct(spark):
    base = dict(image_citation="", expert_approvals="", method="", explanation="", rubric_elements="", baselining="", canary_string="")
    rows = [
        {"question_id": "1", "question": "Q \n ", "image_file": "a.png",
         "answer_statements": [{"statement": "s1", "is_correct": True}, {"statement": "s2", "is_correct": False}, {"statement": "s3", "is_correct": True}],
         "answer_options": [{"answer_statement_indices": [0], "is_correct": True}, {"answer_statement_indices": [0, 2], "is_correct": True}]},
        {"question_id": "2", "question": "R", "image_file": None, "answer_statements": [{"statement": "s", "is_correct": False}],
         "answer_options": [{"answer_statement_indices": [0], "is_correct": False}]},
    ]
    return spark.createDataFrame([{**base, **r} for r in rows], schemas.VCT)


def test_statement_samples(spark):
    one, two = samples.to_samples("vct", vct(spark)).orderBy("id").collect()
    assert one.input == "Q\n\nStatement 1: s1\nStatement 2: s2\nStatement 3: s3\n"
    assert one.choices == ["Statement 1", "Statement 1 + Statement 3"] and one.target == ["B"] and two.target == [None]
    assert one.metadata["image_path"] == "images/a.png" and two.metadata["image_path"] is None
    multi = samples.to_samples("vct", vct(spark), mode="mr").orderBy("id").collect()
    assert [(m.input, m.target, m.is_multi) for m in multi] == [("Q", ["A", "C"], True), ("R", [], True)]


@pytest.mark.parametrize("n", [0, None, 1, 137, 999, 1000, 5000])
def test_sample_exact(spark, n, monkeypatch):
    df = spark.range(1000).withColumn("x", F.col("id") * 2)
    top = sorted(r.id for r in sampling.sample_exact(df, "id", n).collect())
    monkeypatch.setattr(sampling, "TOP_N_LIMIT", 0)
    cut = sorted(r.id for r in sampling.sample_exact(df.repartition(13), "id", n).collect())
    assert top == cut and len(top) == (min(n, 1000) if n else 1000) == len(set(top))


@pytest.mark.parametrize("digits", [1, 4])
@pytest.mark.parametrize("n_shot", [1, 3, 5])
def test_fewshot_pairs_with_heavy_copies(spark, monkeypatch, n_shot, digits):
    monkeypatch.setattr(sampling, "BUCKET_DIGITS", digits)
    monkeypatch.setattr(sampling, "SLICE_DIGITS", digits)
    generator = random.Random(7)
    texts = ["hot"] * 120 + [f"t{generator.randrange(90)}" for _ in range(180)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, input string")
    ring = sorted(r.position for r in sampling.example_ring(df).collect())
    assert ring == list(range(300))
    pairs = sampling.fewshot_pairs(df, n_shot).collect()
    by = collections.defaultdict(list)
    for p in pairs:
        by[p.id].append(p.example_id)
    for i, text in enumerate(texts):
        got = by[str(i)]
        assert len(got) == len(set(got)) == n_shot and all(texts[int(e)] != text for e in got)
    other = sampling.fewshot_pairs(df.repartition(9), n_shot).collect()
    assert sorted(map(tuple, pairs)) == sorted(map(tuple, other))
    # copies of one text do not all get the same examples
    assert len({tuple(by[str(i)]) for i in range(120)}) > 60


def test_fewshot_few_available(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b")], "id string, input string")
    counts = {r.id: r.n_examples for r in sampling.distinct_examples(sampling.fewshot_pairs(df, 5), ["id"]).collect()}
    assert counts == {"1": 1, "2": 1, "3": 2}
    alone = spark.createDataFrame([("1", "a"), ("2", "a")], "id string, input string")
    assert sampling.fewshot_pairs(alone, 5).count() == 0
    with pytest.raises(ValueError, match="n_shot"):
        sampling.check_n_shot(df, 3)


def _prompt_rows(spark):
    rows = [("gpqa", str(i), f"q{i} {{choices}}", ["A"], False, ["x", "y"], {}) for i in range(4)]
    return spark.createDataFrame(
        rows, "benchmark string, id string, input string, target array<string>, is_multi boolean, choices array<string>, metadata map<string,string>"
    )


def test_prompts(spark):
    rows = _prompt_rows(spark)
    zero = prompts.build_prompts(rows).filter("id = '1'").first()
    assert zero.prompt_schema == "zero_shot" and zero.prompt.endswith("one of A,B.\n\nq1 {choices}\nA) x\nB) y")
    cot = prompts.build_prompts(rows, cot=True, n_shot=3).first()
    assert cot.prompt_schema == "zero_shot_cot" and "step-by-step" in cot.prompt and cot.prompt.endswith("\n\nA) x\nB) y")
    few = prompts.build_prompts(rows, n_shot=2).filter("id = '1'").first()
    head, _, body = few.prompt.partition("A,B.\n\n")
    blocks = body.split("\n\nANSWER: A\n\n")
    assert few.prompt_schema == "few_shot" and len(blocks) == 3 and blocks[2] == "q1 {choices}\nA) x\nB) y"
    assert all(b.endswith("\n\nA) x\n\nB) y") and not b.startswith("q1") for b in blocks[:2])
    multi = prompts.build_prompts(rows.withColumn("is_multi", F.lit(True))).first()
    assert "multiple answers may be correct" in multi.prompt
    with pytest.raises(ValueError):
        prompts.build_prompts(rows, n_shot=4)


def test_cot_wrapper_and_query_text(spark):
    (row,) = spark.range(1).select(
        prompts.cot_prompt(F.lit("P {x}")).alias("c"),
        prompts.query_with_choices(F.lit("Q"), F.array(F.lit("a"), F.lit("b"))).alias("q"),
        prompts.article_block(F.lit("T"), F.lit("1"), F.lit("A")).alias("a"),
        prompts.paper_block(F.lit("T"), F.array(F.lit("X"), F.lit("Y")), F.lit(2020), F.lit(None).cast("string")).alias("p"),
    ).collect()
    assert row.c.startswith("P {x}\nBefore answering") and row.q == "Q\nChoices: a, b"
    assert row.a == "Title: T\nPMID: 1\nAbstract: A"
    assert row.p == "Title: T\nAuthors: X, Y\nYear: 2020\nAbstract: No abstract available"


def test_turn_edits(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "system", "s"), (2, 1, "user", "u"), (3, 0, "user", "z")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    edits = spark.createDataFrame([(1, "N1"), (2, "N2"), (9, "N9")], "conv_id bigint, new_text string")
    got = sorted(map(tuple, prompts.replace_or_append_turn(turns, edits).collect()))
    assert got == [
        (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "N1"), (2, 0, "system", "s"), (2, 1, "user", "N2"),
        (3, 0, "user", "z"), (9, 0, "user", "N9"),
    ]
