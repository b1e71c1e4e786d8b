"""Question records to uniform sample rows. All of it is row-local: no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewise import fixed_values as fixed
from gradewise.functions.labels import letter

SEED = 42


def shuffle_choices(choices: Column, key: Column, seed: int = SEED) -> Column:
    """A permutation that depends only on seed, record key and position, so a retried task gives the same order."""
    tagged = F.transform(
        choices,
        lambda choice, pos: F.struct(
            F.md5(F.concat_ws("|", F.lit(str(seed)), key, pos.cast("string"))).alias("h"),
            pos.alias("pos"),
            choice.alias("choice"),
        ),
    )
    return F.transform(F.array_sort(tagged), lambda t: t["choice"])


def letter_of(choices: Column, correct: Column) -> Column:
    """Letter of the first choice with the correct text; null when there is none."""
    position = F.array_position(choices, correct)
    return F.when(position > 0, letter(position - 1))


def _sample(
    records: DataFrame,
    benchmark: str,
    ident: Column,
    text: Column,
    target: Column,
    choices: Column,
    metadata: dict[str, Column],
    is_multi: bool = False,
) -> DataFrame:
    subset = F.col("subset") if "subset" in records.columns else F.lit(None).cast("string")
    pairs = [x for name, value in metadata.items() for x in (F.lit(name), value.cast("string"))]
    return records.select(
        F.lit(benchmark).alias("benchmark"),
        subset.alias("subset"),
        ident.cast("string").alias("id"),
        text.alias("input"),
        target.alias("target"),
        F.lit(is_multi).alias("is_multi"),
        choices.alias("choices"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def _blank(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


GPQA_METADATA = [
    "Record ID",
    "High-level domain",
    "Subdomain",
    "Explanation",
    "Self-reported question-writing time (minutes)",
    "Expert Validator Accuracy",
    "Non-Expert Validator Accuracy",
]


def samples_gpqa(records: DataFrame, seed: int = SEED) -> DataFrame:
    """The correct answer always comes first in the source, so choices are shuffled."""
    correct = F.col("`Correct Answer`")
    choices = F.array(correct, *[F.col(f"`Incorrect Answer {i}`") for i in (1, 2, 3)])
    shuffled = records.withColumn("_choices", shuffle_choices(choices, F.col("`Record ID`"), seed))
    return _sample(
        shuffled,
        "gpqa",
        F.col("`Record ID`"),
        F.col("Question"),
        F.array(letter_of(F.col("_choices"), correct)),
        F.col("_choices"),
        {name: _blank(name) for name in GPQA_METADATA},
    )


def _content_id(records: DataFrame) -> Column:
    """These sources carry no id: a digest of question and choices, and of the stored place where it is known."""
    place = [F.col("_row_key")] if "_row_key" in records.columns else []
    return F.md5(F.concat_ws("|", F.col("question"), F.array_join("choices", "|"), *place))


def samples_mmlu(records: DataFrame) -> DataFrame:
    return _sample(
        records, "mmlu", _content_id(records), F.col("question"), F.array(letter(F.col("answer"))), F.col("choices"),
        {"subject": _blank("subject")},
    )


def samples_wmdp(records: DataFrame) -> DataFrame:
    return _sample(
        records, "wmdp", _content_id(records), F.col("question"), F.array(letter(F.col("answer"))), F.col("choices"), {}
    )


def _with_distractors(records: DataFrame, seed: int) -> DataFrame:
    key = F.concat_ws("_", F.coalesce(F.col("subtask"), F.lit("")), F.col("id"))
    choices = F.concat(F.col("distractors"), F.array(F.col("ideal")))
    return records.withColumns({"_id": key, "_choices": shuffle_choices(choices, key, seed)})


def samples_distractors(records: DataFrame, seed: int = SEED) -> DataFrame:
    return _sample(
        _with_distractors(records, seed),
        "lab_bench",
        F.col("_id"),
        F.col("question"),
        F.array(letter_of(F.col("_choices"), F.col("ideal"))),
        F.col("_choices"),
        {
            "key_passage": _blank("key-passage"),
            "sources": F.to_json(F.coalesce(F.col("sources"), F.array().cast("array<string>"))),
        },
    )


def protocol_input(protocol: Column, question: Column) -> Column:
    return F.concat(F.lit("Protocol:\n"), protocol, F.lit("\n\nQuestion:\n"), question)


def samples_protocol(records: DataFrame, seed: int = SEED) -> DataFrame:
    return _sample(
        _with_distractors(records, seed),
        "lab_bench",
        F.col("_id"),
        protocol_input(F.col("protocol"), F.col("question")),
        F.array(letter_of(F.col("_choices"), F.col("ideal"))),
        F.col("_choices"),
        {},
    )


def samples_lab_bench(records: DataFrame, seed: int = SEED) -> DataFrame:
    """Protocol questions have a two-block input, the other subsets a plain one."""
    is_protocol = F.col("subset") == "ProtocolQA"
    return samples_protocol(records.filter(is_protocol), seed).unionByName(
        samples_distractors(records.filter(~is_protocol), seed)
    )


def yes_no_letter(answer: Column) -> Column:
    pairs = [F.lit(x) for item in fixed.PUBMEDQA_LETTERS.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.lower(answer))


def context_input(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Context: "), context, F.lit("\n\nQuestion: "), question)


def samples_pubmedqa(records: DataFrame) -> DataFrame:
    return _sample(
        records,
        "pubmedqa",
        F.col("id"),
        context_input(F.col("context"), F.col("question")),
        F.array(yes_no_letter(F.get("answer", F.lit(0)))),
        F.col("choices"),
        {"document_id": F.col("document_id"), "type": F.col("type")},
    )


def samples_mmlu_pro(records: DataFrame) -> DataFrame:
    return _sample(
        records,
        "mmlu_pro",
        F.col("question_id"),
        F.col("question"),
        F.array(F.col("answer")),
        F.col("options"),
        {name: F.col(name) for name in ("category", "cot_content", "src")},
    )


VCT_METADATA = [
    "question_id", "image_file", "image_citation", "expert_approvals", "method", "explanation", "rubric_elements",
    "baselining", "canary_string",
]


def numbered_statements(question: Column, statements: Column) -> Column:
    """Question, a blank line, then `Statement 1: ...` lines."""
    lines = F.transform(
        statements,
        lambda s, i: F.concat(F.lit("Statement "), (i + 1).cast("string"), F.lit(": "), s, F.lit("\n")),
    )
    return F.concat(rstrip(question), F.lit("\n\n"), F.array_join(lines, ""))


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def option_text(indices: Column) -> Column:
    """`Statement 1 + Statement 3` for the zero-based indices [0, 2]."""
    return F.array_join(
        F.transform(indices, lambda i: F.concat(F.lit("Statement "), (i + 1).cast("string"))), " + "
    )


def last_true_letter(flags: Column) -> Column:
    """Letter of the last true flag; null when none is true."""
    hits = F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())
    return letter(F.array_max(hits))


def true_letters(flags: Column) -> Column:
    marked = F.transform(flags, lambda f, i: F.when(f, letter(i)))
    return F.filter(marked, lambda x: x.isNotNull())


def image_path(file: Column, folder: str) -> Column:
    return F.when(F.coalesce(file, F.lit("")) != "", F.concat(F.lit(f"{folder.rstrip('/')}/"), file))


def _vct_metadata(folder: str) -> dict[str, Column]:
    return {**{n: F.col(n) for n in VCT_METADATA}, "image_path": image_path(F.col("image_file"), folder)}


def samples_statements_mc(records: DataFrame, folder: str = "images") -> DataFrame:
    """Options are sets of statements; the target is the last option marked correct, null when none is."""
    options = F.col("answer_options")
    return _sample(
        records,
        "vct",
        F.col("question_id"),
        numbered_statements(F.col("question"), F.transform("answer_statements", lambda s: s["statement"])),
        F.array(last_true_letter(F.transform(options, lambda o: o["is_correct"]))),
        F.transform(options, lambda o: option_text(o["answer_statement_indices"])),
        _vct_metadata(folder),
    )


def samples_statements_mr(records: DataFrame, folder: str = "images") -> DataFrame:
    """The statements are the choices; the target holds the letters of all correct ones."""
    return _sample(
        records,
        "vct",
        F.col("question_id"),
        rstrip(F.col("question")),
        true_letters(F.transform("answer_statements", lambda s: s["is_correct"])),
        F.transform("answer_statements", lambda s: s["statement"]),
        _vct_metadata(folder),
        is_multi=True,
    )


# A mapper is any `DataFrame -> DataFrame` that gives the uniform columns; add one to support a new question set.
MAPPERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "gpqa": samples_gpqa,
    "mmlu": samples_mmlu,
    "mmlu_pro": samples_mmlu_pro,
    "lab_bench": samples_lab_bench,
    "wmdp": samples_wmdp,
    "pubmedqa": samples_pubmedqa,
    "vct": samples_statements_mc,
}


def repeated_ids(rows: DataFrame, ident: str = "id") -> DataFrame:
    """Ids that more than one row has: `(id, n_rows)`."""
    return rows.groupBy(F.col(ident).alias("id")).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def to_samples(benchmark: str, records: DataFrame, mode: str = "mc", images: str = "images") -> DataFrame:
    """Uniform samples of one benchmark; `images` is the folder of the pictures that records name."""
    if benchmark not in MAPPERS:
        raise KeyError(f"unknown benchmark {benchmark!r}; known: {sorted(MAPPERS)}")
    if benchmark == "vct":
        return (samples_statements_mr if mode == "mr" else samples_statements_mc)(records, images)
    return MAPPERS[benchmark](records)


# --- selection -------------------------------------------------------------------------------


def filter_subtask(
    rows: DataFrame, column: Column, wanted: Sequence[str], ignore_case: bool = False, required: bool = False
) -> DataFrame:
    """Rows whose domain is in `wanted`. `required` makes an empty result an error."""
    value = F.lower(column) if ignore_case else column
    kept = rows.filter(value.isin(list(wanted)))
    if required and kept.isEmpty():
        raise ValueError(f"no samples found for {list(wanted)}")
    return kept


def text_only(records: DataFrame, column: str = "image_file") -> DataFrame:
    """Records without an image."""
    return records.filter(F.col(column).isNull())


def union_subsets(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def expand_subsets(wanted: str | Sequence[str] | None, available: Sequence[str], groups=None) -> list[str]:
    """`all` or nothing gives every subset; a group name gives its members."""
    if wanted is None or wanted == "all":
        return list(available)
    names = [wanted] if isinstance(wanted, str) else list(wanted)
    return [member for name in names for member in (groups or {}).get(name, [name])]
