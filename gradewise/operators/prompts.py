"""Prompt text from sample rows, and edits of conversations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewise import fixed_values as fixed
from gradewise.functions.labels import letter
from gradewise.operators.sampling import SEED, check_n_shot, fewshot_examples

# Question sets whose examples separate choices by a blank line; the others use one newline.
BLANK_LINE_CHOICES = ("gpqa", "wmdp", "lab_bench")

ZERO_SHOT, FEW_SHOT, COT = "zero_shot", "few_shot", "zero_shot_cot"


def render_choices(choices: Column, separator: Column | str = "\n") -> Column:
    """`A) text` lines."""
    lines = F.transform(choices, lambda c, i: F.concat(letter(i), F.lit(") "), c))
    if isinstance(separator, str):
        return F.array_join(lines, separator)
    return F.when(separator == "\n", F.array_join(lines, "\n")).otherwise(F.array_join(lines, "\n\n"))


def choice_letters(choices: Column) -> Column:
    return F.array_join(F.transform(choices, lambda _, i: letter(i)), ",")


def fill_template(template: str, **slots: Column) -> Column:
    """Fill `{name}` slots. The template is cut up beforehand, so braces in the data are never taken for slots."""
    pieces = re.split(r"\{(\w+)\}", template)
    columns = [slots[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces) if p or i % 2]
    return F.concat(*columns)


def choices_as_text(choices: Column) -> Column:
    return F.array_join(choices, ", ")


def query_with_choices(text: Column, choices: Column) -> Column:
    return F.concat(text, F.lit("\nChoices: "), choices_as_text(choices))


def render_example(text: Column, choices: Column, target: Column, separator: Column | str = "\n") -> Column:
    return fill_template(
        fixed.FEWSHOT_EXAMPLE,
        question=text,
        choices=render_choices(choices, separator),
        target=F.array_join(target, ","),
    )


def choose_prompt_schema(cot: Column, n_shot: Column) -> Column:
    """Chain of thought wins over examples."""
    return (
        F.when(F.coalesce(cot, F.lit(False)), F.lit(COT))
        .when(F.coalesce(n_shot, F.lit(0)) > 0, F.lit(FEW_SHOT))
        .otherwise(F.lit(ZERO_SHOT))
    )


def render_prompt(
    schema: Column, is_multi: Column, question: Column, choices: Column, examples: Column | None = None
) -> Column:
    """The prompt of one sample under its schema; `examples` is only used for few-shot."""
    shown = {"letters": choice_letters(choices), "choices": render_choices(choices)}
    if examples is not None:
        wrapped = fill_template(fixed.FEWSHOT_WRAPPER, examples=F.coalesce(examples, F.lit("")), question=question)
        question_part = F.when(schema == FEW_SHOT, wrapped).otherwise(question)
    else:
        question_part = question
    return (
        F.when((schema == COT) & is_multi, fill_template(fixed.MULTIPLE_ANSWER_COT, question=question, **shown))
        .when(schema == COT, fill_template(fixed.SINGLE_ANSWER_COT, question=question, **shown))
        .when(is_multi, fill_template(fixed.MULTIPLE_ANSWER, question=question_part, **shown))
        .otherwise(fill_template(fixed.SINGLE_ANSWER, question=question_part, **shown))
    )


def cot_prompt(prompt: Column) -> Column:
    return fill_template(fixed.DEFAULT_COT, prompt=prompt)


def choice_separator(benchmark: Column) -> Column:
    return F.when(benchmark.isin(*BLANK_LINE_CHOICES), F.lit("\n\n")).otherwise(F.lit("\n"))


def build_prompts(samples: DataFrame, cot: bool = False, n_shot: int = 0, seed: int = SEED) -> DataFrame:
    """Sample rows of one benchmark to prompt rows: adds `prompt_schema` and `prompt`."""
    schema = choose_prompt_schema(F.lit(cot), F.lit(n_shot))
    examples = None
    if n_shot > 0 and not cot:
        check_n_shot(samples, n_shot)
        example = render_example(
            F.col("input"), F.col("choices"), F.col("target"), choice_separator(F.col("benchmark"))
        )
        samples = samples.join(fewshot_examples(samples, n_shot, example, seed=seed), "id", "left")
        examples = F.col("examples")
    prompt = render_prompt(schema, F.col("is_multi"), F.col("input"), F.col("choices"), examples)
    return samples.withColumns({"prompt_schema": schema, "prompt": prompt}).drop("examples")


def augmented(context: Column, prompt: Column) -> Column:
    return F.concat(context, F.lit("\n\nQuestion:\n"), prompt)


def _edit_ends(turns: DataFrame, edits: DataFrame, new_text: Column) -> DataFrame:
    """Put `new_text` at the end of the conversations in `edits`.

    `new_text` may use the columns of the edit and `_role`, `_text` of the last turn. The last turn is found by a
    narrow maximum; the join is on `(conv_id, turn)`, so a conversation with very many turns is spread over tasks, and
    the row of the last turn gives either its replacement or itself and the appended message.
    """
    ends = turns.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    placed = edits.join(ends, "conv_id", "left").withColumns(
        {"turn": F.coalesce("turn", F.lit(-1)), "_has_turns": F.col("turn").isNotNull(), "_edit": F.lit(True)}
    )
    last = turns.select("conv_id", "turn", F.col("role").alias("_role"), F.col("text").alias("_text"))
    joined = last.join(placed.filter("_has_turns").drop("_has_turns"), ["conv_id", "turn"], "left")
    is_user = F.col("_role") == "user"

    def message(turn: Column, role: Column, text: Column) -> Column:
        return F.struct(turn.cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))

    own = message(F.col("turn"), F.col("_role"), F.col("_text"))
    messages = (
        F.when(F.col("_edit").isNull(), F.array(own))
        .when(is_user, F.array(message(F.col("turn"), F.col("_role"), new_text)))
        .otherwise(F.array(own, message(F.col("turn") + 1, F.lit("user"), new_text)))
    )
    edited = joined.select("conv_id", F.inline(messages))
    absent = placed.filter(~F.col("_has_turns")).withColumns(
        {"_role": F.lit(None).cast("string"), "_text": F.lit(None).cast("string")}
    )
    begun = absent.select("conv_id", F.inline(F.array(message(F.lit(0), F.lit("user"), new_text))))
    return edited.unionByName(begun)


def replace_or_append_turn(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """Put `edits(conv_id, new_text)` at the end of conversations `turns(conv_id, turn, role, text)`.

    A last message from the user gets the new text; otherwise a user message is appended.
    """
    return _edit_ends(turns, edits, F.col("new_text"))


def augment_turns(turns: DataFrame, contexts: DataFrame) -> DataFrame:
    """Put retrieved context before the last question of each conversation: `contexts(conv_id, context, query)`."""
    asked = F.when(F.col("_role") == "user", F.col("_text")).otherwise(F.col("query"))
    return _edit_ends(turns, contexts, augmented(F.col("context"), asked))


def source_block(title: Column, url: Column, content: Column) -> Column:
    return F.concat(F.lit("Source: "), title, F.lit(" ("), url, F.lit(")\nContent: "), content)


def article_block(title: Column, pmid: Column, abstract: Column) -> Column:
    return F.concat(F.lit("Title: "), title, F.lit("\nPMID: "), pmid, F.lit("\nAbstract: "), abstract)


def paper_block(title: Column, authors: Column, year: Column, abstract: Column) -> Column:
    return F.concat(
        F.lit("Title: "), title, F.lit("\nAuthors: "), F.array_join(authors, ", "), F.lit("\nYear: "),
        year.cast("string"), F.lit("\nAbstract: "), F.coalesce(abstract, F.lit(fixed.NO_ABSTRACT)),
    )


def build_context(ranked: DataFrame, key: str, heading: str, block: Column, rank: str = "rank") -> DataFrame:
    """Join the k ranked passages of a question under a heading: `(key, context)`. k rows per group at most."""
    return (
        ranked.groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b")))).alias("_list"))
        .select(
            key,
            F.concat(
                F.lit(f"{heading}\n"), F.array_join(F.transform("_list", lambda e: e["b"]), "\n\n")
            ).alias("context"),
        )
    )
