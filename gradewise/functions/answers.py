"""Answer extraction and scoring as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two answer patterns.
# Flags: i ignore case, m line anchors, d only "\n" ends a line, U Unicode classes.
STRICT_ANSWER = r"(?imdU)^ANSWER\s*:\s*([A-Za-z ,]+)\s*(?:$|\n)"
LOOSE_ANSWER = r"(?idU)ANSWER\s*:\s*([A-Za-z ,]+)(?:[^\w]|\n|$)"

TEXT_PARTS = "array<struct<type:string,text:string>>"


def strip(text: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def extract_answer(completion: Column) -> Column:
    """The answer letters of a completion, upper case; null when there is none.

    A line that holds only the answer wins over an answer inside a sentence.
    """
    strict = F.nullif(F.regexp_extract(completion, STRICT_ANSWER, 1), F.lit(""))
    loose = F.nullif(F.regexp_extract(completion, LOOSE_ANSWER, 1), F.lit(""))
    return F.upper(F.trim(F.coalesce(strict, loose)))


def is_correct_single(answer: Column, target: Column) -> Column:
    return F.coalesce((answer != "") & (answer == F.upper(strip(target))), F.lit(False))


def answer_letters(answer: Column, ignore_spaces: bool = False) -> Column:
    """Sorted letters of a multiple-response answer: split at commas, or into characters when there is no comma."""
    text = F.regexp_replace(answer, " ", "") if ignore_spaces else answer
    pieces = F.transform(F.split(text, ","), lambda p: F.upper(F.trim(p)))
    return F.when(F.size(pieces) == 1, F.array_sort(F.split(F.get(pieces, F.lit(0)), ""))).otherwise(
        F.array_sort(pieces)
    )


def is_correct_multi(answer: Column, targets: Column, ignore_spaces: bool = False) -> Column:
    """An answer `A B` without commas keeps its blank and is wrong unless `ignore_spaces`."""
    return F.coalesce(
        (answer != "") & (answer_letters(answer, ignore_spaces) == F.array_sort(targets)), F.lit(False)
    )


def is_correct(answer: Column, targets: Column, is_multi: Column, ignore_spaces: bool = False) -> Column:
    return F.when(is_multi, is_correct_multi(answer, targets, ignore_spaces)).otherwise(
        is_correct_single(answer, F.get(targets, F.lit(0)))
    )


def is_single_letter(answer: Column) -> Column:
    return F.coalesce(answer.rlike(r"^\p{L}\z"), F.lit(False))


def message_text(content: Column) -> Column:
    """Text of a message whose content is either a plain string or the JSON text of a list of typed parts.

    Null when it is a list of parts with no text part.
    """
    parts = F.when(content.rlike(r"^\s*\["), F.from_json(content, TEXT_PARTS))
    typed = F.filter(parts, lambda p: p["type"].isNotNull())
    first_text = F.get(F.filter(parts, lambda p: p["type"] == "text"), F.lit(0))
    return (
        F.when(F.size(typed) > 0, F.when(first_text.isNotNull(), F.coalesce(first_text["text"], F.lit(""))))
        .when(content.rlike(r"^\s*\[\s*\]\s*$"), F.lit(None).cast("string"))
        .otherwise(content)
    )


def target_is_list(target: Column) -> Column:
    return F.coalesce(target.rlike(r"^\s*\["), F.lit(False))


def target_letters(target: Column) -> Column:
    """A target that is one letter, or the JSON text of a list of letters, as an array."""
    return F.when(target_is_list(target), F.from_json(target, "array<string>")).otherwise(F.array(target))
