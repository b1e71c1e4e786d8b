import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from gradewise.functions import answers, dates, labels, literals, measures, pricing


def values(spark, rows, ddl, **columns):
    df = spark.createDataFrame(rows, ddl)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


PROBES = [
    ("x\nANSWER: B", "B"),
    ("answer :  a, c \nmore", "A, C"),
    ("so ANSWER: D.", "D"),
    ("ANSWER:\nB is right", "B IS RIGHT"),
    ("ANSWER: ", ""),
    ("none", None),
    ("ANSWER: A\r\n", "A"),
    ("**ANSWER: C**", "C"),
    ("ANSWER: $B$", ""),
    ("first ANSWER: A.\nANSWER: B", "B"),
    ("", None),
    (None, None),
]


def test_extract_answer_probes(spark):
    got = values(spark, [(p,) for p, _ in PROBES], "c string", x=answers.extract_answer(F.col("c")))
    assert [g[0] for g in got] == [want for _, want in PROBES]


def test_extract_answer_agrees_with_python_on_random_text(spark):
    generator = random.Random(1)
    pieces = ["ANSWER", "answer", ":", " ", "\n", "A", "C", ",", "b", "$", "é", ".", "\r", "\t", "\u2028", "*", " : ", "\u00a0", "1"]
    texts = ["".join(generator.choices(pieces, k=generator.randrange(1, 25))) for _ in range(3000)]

    def python(text):
        found = re.search(answers.STRICT_ANSWER.replace("(?imdU)", "(?i)"), text, re.MULTILINE)
        found = found or re.search(answers.LOOSE_ANSWER.replace("(?idU)", "(?i)"), text)
        return found.group(1).strip().upper() if found else None

    got = values(spark, [(t,) for t in texts], "c string", x=answers.extract_answer(F.col("c")))
    wrong = [(t, g[0], python(t)) for t, g in zip(texts, got) if g[0] != python(t)]
    assert not wrong
    assert sum(g[0] is not None for g in got) > 100


@pytest.mark.parametrize(
    "answer,right,lenient",
    [("C, A", True, True), ("CA", True, True), ("A C", False, True), ("A", False, False), ("A,,C", False, False), ("", False, False)],
)
def test_multi_response(spark, answer, right, lenient):
    target = F.array(F.lit("A"), F.lit("C"))
    (row,) = values(
        spark, [(answer,)], "a string",
        strict=answers.is_correct_multi(F.col("a"), target), loose=answers.is_correct_multi(F.col("a"), target, True),
    )
    assert row == (right, lenient)


def test_single_response(spark):
    rows = [("B", " b\n"), ("B IS RIGHT", "B"), (None, "B"), ("", "")]
    got = values(spark, rows, "a string, t string", x=answers.is_correct_single(F.col("a"), F.col("t")))
    assert [g[0] for g in got] == [True, False, False, False]


def test_message_text(spark):
    rows = [
        "plain", '[{"type":"image","image":"x"},{"type":"text","text":"hi"},{"type":"text","text":"no"}]',
        '[{"type":"image"}]', "[]", "[not json", '[{"type":"text"}]',
    ]
    got = values(spark, [(r,) for r in rows], "c string", x=answers.message_text(F.col("c")))
    assert [g[0] for g in got] == ["plain", "hi", None, None, "[not json", ""]


def test_targets_and_letters(spark):
    rows = [("B",), ('["A","C"]',)]
    got = values(spark, rows, "t string", x=answers.target_letters(F.col("t")), m=answers.target_is_list(F.col("t")))
    assert got == [(["B"], False), (["A", "C"], True)]
    single = values(
        spark, [("A",), ("é",), ("AB",), ("",), (None,), ("1",), ("A\n",)], "a string", x=answers.is_single_letter(F.col("a"))
    )
    assert [s[0] for s in single] == [True, True, False, False, False, False, False]


def test_prices(spark):
    rows = [("$1,234.50",), ("$0.00",), ("",), (None,), ("free",)]
    got = values(
        spark, rows, "p string", a=pricing.price_from_digits(F.col("p")), b=pricing.price_from_currency(F.col("p"))
    )
    assert got == [(1234.5, 1234.5), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)]


def test_token_cost_branches(spark):
    rows = [(8.0, 24.0, 0.0), (0.0, 24.0, 5.0), (0.0, 0.0, 0.0), (None, None, None)]
    both = [F.col(c) for c in ("i", "o", "b")]
    tokens = (F.lit(1_000_000), F.lit(500_000))
    got = values(
        spark, rows, "i double, o double, b double",
        cost=pricing.token_cost(*tokens, *both), rounded=pricing.token_cost_rounded(*tokens, both[0], both[1]),
        method=pricing.cost_method(F.lit("m"), both[0].isNotNull(), *both),
    )
    assert got == [
        (20.0, 20.0, pricing.SEPARATE), (5.0 / 1_000_000 * 1_500_000, 0.0, pricing.COMBINED), (0.0, 0.0, pricing.NO_PRICE),
        (0.0, 0.0, "Model m not found in model data"),
    ]


def test_stderr_kinds(spark):
    p, n = F.lit(0.6794871794871795), F.col("n")
    got = values(
        spark, [(78,), (0,), (1,)], "n bigint", s=measures.binomial_stderr(p, n, "sample"), q=measures.binomial_stderr(p, n)
    )
    assert got[0][0] == pytest.approx(0.05318240510717429, abs=1e-15)
    assert got[0][1] == pytest.approx(math.sqrt(0.6794871794871795 * (1 - 0.6794871794871795) / 78))
    assert got[1] == (0.0, 0.0) and got[2][0] == 0.0


def test_fold_ci_golden(spark):
    row = (0.6871794871794872, 0.025783082271792077, 10, 0.6923076923076923, 0.03364960629919577, 10)
    ddl = "a double, b double, c bigint, d double, e double, f bigint"
    cols = [F.col(c) for c in "abcdef"]
    (got,) = values(spark, [row], ddl, x=measures.fold_ci(*cols))
    assert tuple(got[0]) == pytest.approx((0.9925925925925926, 0.9555269227559487, 1.0310960700385465), abs=1e-12)
    (same,) = values(spark, [row], ddl, x=measures.fold_ci(*cols[:3], *cols[:3]))
    assert same[0].ratio == 1.0 and same[0].ci_low <= 1.0 <= same[0].ci_high
    (bad,) = values(spark, [(0.0, 0.1, 10, 0.5, 0.1, 10)], ddl, x=measures.fold_ci(*cols))
    assert tuple(bad[0]) == (None, None, None)


def test_normalisation(spark):
    rows = [(0.4,), (0.6,), (0.8,), (1.0,), (0.2,)]
    got = values(
        spark, rows, "a double",
        n=measures.normalized_to_expert(F.col("a"), F.lit(0.8), F.lit(0.4)), r=measures.relative_to_expert(F.col("a"), F.lit(0.8)),
    )
    assert [round(g[0], 9) for g in got] == [-100, -50, 0, 50, -100]
    assert got[3][1] == pytest.approx(1.0) and got[2][1] == 0.0


def test_format_mean_std(spark):
    rows = [(0.6923076923076923, 0.03364960629919577), (0.5, None), (None, 0.1), (1.0, 0.0)]
    got = values(spark, rows, "m double, s double", x=labels.format_mean_std(F.col("m"), F.col("s")))
    assert [g[0] for g in got] == ["69.2 ± 3.4", "", "", "100.0 ± 0.0"]


def test_number_labels(spark):
    numbers = [0.0, 3.2e24, 1e10, 9.9e9, 1234.0, 7.0, 0.96, 0.05, 0.00012, 0.00001, 123456.0, 999.0, 1000.0]
    got = values(
        spark, [(n,) for n in numbers], "x double", e=labels.exponent_label(F.col("x")), k=labels.thousand_label(F.col("x"))
    )
    want = ["0" if n == 0 else f"1e{math.floor(math.log10(n))}" if n >= 1e10 else f"{n:.1g}" for n in numbers]
    assert [g[0] for g in got] == want
    assert [g[1] for g in got[-3:]] == ["123k", "999", "1k"]


def test_names_and_orders(spark):
    rows = [("gpqa", "openai/gpt-4o-2024-08-06", "Google DeepMind,Google", "five_shot"), ("x", "y/z", "OpenAI", "q")]
    got = values(
        spark, rows, "b string, m string, o string, s string",
        b=labels.benchmark_display(F.col("b")), m=labels.model_display(F.col("m")), o=labels.standardize_org(F.col("o")),
        c=labels.condition_label(F.col("s")), p=labels.path_label(F.col("s"), F.col("b"), F.col("m")),
        r=labels.explicit_rank(F.col("b"), ["mmlu", "gpqa"]),
    )
    assert got == [
        ("GPQA-Bio", "GPT-4o", "Google DeepMind", "Five-shot", "five_shot/gpqa/gpt-4o-2024-08-06", 1),
        (None, "y/z", "OpenAI", None, "q/x/z", None),
    ]


def test_reasoning_categories(spark):
    got = values(
        spark, [(None, None), (16000.0, "high"), (4096.0, "LOW")], "t double, e string",
        t=labels.token_limit_category(F.col("t")), e=labels.effort_category(F.col("e")),
    )
    assert got == [
        ("No reasoning limit specified", "Medium reasoning effort"),
        ("16k reasoning token limit", "High reasoning effort"),
        ("4k reasoning token limit", "Low reasoning effort"),
    ]


def test_letters(spark):
    got = values(
        spark, [(0,), (25,)], "i int", l=labels.letter(F.col("i")), back=labels.letter_index(labels.letter(F.col("i")))
    )
    assert got == [("A", 0), ("Z", 25)]


SPELLINGS = [
    "{'subset': 'gpqa_main', 'subtasks': ['Biology'], 'split': 'train'}",
    "{'subset': 'gpqa_main', 'subtasks': \"['Biology']\", 'split': 'train'}",
    "{'cls': 'GPQABenchmark', 'subset': 'gpqa_main', 'subtasks': \"['Biology']\", 'split': 'train'}",
    "{'split': 'train', 'subtasks': [ 'Biology' ], 'subset': 'gpqa_main', 'samples': None}",
]
FLAGS = ["{'split': 'train', 'subset': 'ProtocolQA', 'cot': 'True'}", "{'subset': 'ProtocolQA', 'split': 'train', 'cot': True}"]


@pytest.mark.parametrize("group", [SPELLINGS, FLAGS])
def test_spellings_share_one_form(spark, group):
    text = literals.args_text(literals.canonical_args(literals.parse_dict_literal(F.col("t"))))
    got = values(spark, [(s,) for s in group], "t string", x=text)
    assert len({g[0] for g in got}) == 1


def test_literals_exact_and_safe(spark):
    rows = ["{'a': 'x, None, True', 'b': False}", "{'n': 'it\\'s \"so\"'}", "{'t': (1, 2)}", "nope", None, "__import__('os')", "[1]"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    plain = [r.x for r in df.select(literals.parse_dict_literal(F.col("t")).alias("x")).collect()]
    staged = [r.x for r in literals.with_parsed_args(df, "t", "x").select("x").collect()]
    assert plain == staged
    assert plain == [{"a": "x, None, True", "b": "false"}, {"n": 'it\'s "so"'}, {"t": "[1,2]"}, {}, {}, {}, {}]


def test_long_quoted_text_does_not_overflow(spark):
    text = "{'a': '" + "x y " * 50_000 + "', 'b': None, 'c': True}"
    (got,) = values(spark, [(text,)], "t string", x=F.map_keys(literals.parse_dict_literal(F.col("t"), False)))
    assert sorted(got[0]) == ["a", "b", "c"]


def test_maps(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": None, "c": "3"}), (None, {"x": "y"})], "l map<string,string>, r map<string,string>")
    got = [
        (r.m, r.s, r.d) for r in df.select(
            literals.merge_maps(F.col("l"), F.col("r")).alias("m"),
            literals.merge_settings(F.col("l"), F.col("r")).alias("s"),
            literals.map_get(F.col("l"), "a", "none").alias("d"),
        ).collect()
    ]
    assert got == [({"a": "1", "b": None, "c": "3"}, {"a": "1", "c": "3"}, "1"), ({"x": "y"}, {"x": "y"}, "none")]


def test_dates(spark):
    name = "2024-11-05T11-14-52-05-00_gpqa_M5H85.json"
    rows = [("2024-06-20", name, "2024-11-05T11:15:41-05:00"), ("2024-13-01", "bad.json", "soon")]
    got = values(
        spark, rows, "d string, f string, e string",
        d=dates.safe_date(F.col("d")), m=dates.month_label(dates.safe_date(F.col("d"))),
        s=dates.run_duration(F.col("f"), dates.offset_timestamp(F.col("e"))),
        n=dates.dated_name(dates.safe_date(F.col("d")), "summary"),
    )
    assert got[0] == (dt.date(2024, 6, 20), "Jun 2024", 49, "20240620_summary")
    assert got[1] == (None, None, None, None)
