"""Maps kept as text: Python dict literals and JSON, read without evaluating anything."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAP = "map<string,string>"


def empty_map() -> Column:
    return F.create_map().cast(MAP)


def merge_maps(left: Column, right: Column) -> Column:
    """Union of two maps; the right one wins. Does not depend on the session's duplicate-key policy."""
    left = F.coalesce(left, empty_map())
    right = F.coalesce(right, empty_map())
    kept = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    return F.map_concat(kept, right)


def merge_settings(defaults: Column, own: Column) -> Column:
    """Own settings override defaults; a null value removes the key."""
    return F.map_filter(merge_maps(defaults, own), lambda _, v: v.isNotNull())


def drop_keys(arguments: Column, *names: str) -> Column:
    return F.map_filter(arguments, lambda k, _: ~k.isin(*names))


def map_get(arguments: Column, key: str, default: str | None = None) -> Column:
    value = F.try_element_at(arguments, F.lit(key))
    return value if default is None else F.coalesce(value, F.lit(default))


_QUOTED = r"""'[^'\\]*(?:\\.[^'\\]*)*'|"[^"\\]*(?:\\.[^"\\]*)*\""""
# A quoted text is matched whole, so nothing inside it is taken for a constant or a bracket.
_TOKENS = rf"({_QUOTED})|(\b(?:None|True|False)\b|\(|,?\s*\))"
_CONSTANTS = {"None": "null", "True": "true", "False": "false", "(": "["}
# A flat tuple: empty, or with a comma after its first value, which tells it from a value in brackets.
_TUPLE = r"\(\s*\)|\([^()\[\]{},]+,[^()\[\]{}]*\)"
_JSON_OPTIONS = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}


def python_literal_to_json(text: Column) -> Column:
    """Rewrite Python's constants and flat tuples; single quotes are left to the JSON reader, which accepts them.

    Text with other round brackets (nested tuples, values in brackets) is not rewritten there, so the reader rejects it.
    """
    marked = F.regexp_replace(text, _TOKENS, "$1\u0001$2\u0002")
    plain = F.replace(marked, F.lit("\u0001\u0002"), F.lit(""))
    for name, constant in _CONSTANTS.items():
        plain = F.replace(plain, F.lit(f"\u0001{name}\u0002"), F.lit(constant))
    plain = F.regexp_replace(plain, "\u0001,?\\s*\\)\u0002", "]")
    unquoted = F.when(text.contains("("), F.regexp_replace(text, _QUOTED, "''"))
    other = F.regexp_replace(unquoted, _TUPLE, "").rlike("[()]")
    return F.when(F.coalesce(other, F.lit(False)), text).when(text.rlike(r"None|True|False|\("), plain).otherwise(text)


def _literal_reader():
    """The Arrow function for text the JSON reader rejects.

    It is defined inside a function so that it travels to the workers by value; they need not have this package.
    """

    def read(text):
        try:
            value = ast.literal_eval(text)
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            return None
        return json.dumps({str(k): v for k, v in value.items()}, default=str) if isinstance(value, dict) else None

    def read_batch(texts: pd.Series) -> pd.Series:
        return texts if texts.isna().all() else texts.map(read, na_action="ignore")

    return F.pandas_udf(read_batch, StringType())


def parse_dict_literal(text: Column, python_fallback: bool = True) -> Column:
    """Dict-literal or JSON text as a map; null or unreadable text is an empty map.

    Almost all text is read by built-in expressions; only what they reject is sent to Python, in Arrow batches.
    """
    parsed = F.from_json(python_literal_to_json(text), MAP, _JSON_OPTIONS)
    if not python_fallback:
        return F.coalesce(parsed, empty_map())
    rejected = F.when(parsed.isNull() & text.isNotNull(), text)
    return F.coalesce(parsed, F.from_json(_literal_reader()(rejected), MAP), empty_map())


def with_parsed_args(df: DataFrame, column: str, into: str) -> DataFrame:
    """`parse_dict_literal` as a step of its own: one scan, every text read once, rows in their order. Python gets the rejected texts alone."""
    staged = df.withColumn(into, F.from_json(python_literal_to_json(F.col(column)), MAP, _JSON_OPTIONS))
    rejected = F.when(F.col(into).isNull(), F.col(column))
    return staged.withColumn(into, F.coalesce(into, F.from_json(_literal_reader()(rejected), MAP), empty_map()))


def canonical_value(value: Column) -> Column:
    """One spelling for a value: lists as JSON without blanks, constants in lower case."""
    is_list = value.rlike(r"^\s*\[")
    as_list = F.regexp_replace(F.regexp_replace(value, "'", '"'), r"\s*([,\[\]])\s*", "$1")
    return F.when(is_list, as_list).when(value.isin("True", "False"), F.lower(value)).otherwise(value)


def canonical_args(arguments: Column, drop: tuple[str, ...] = ("cls",)) -> Column:
    """Arguments with sorted keys and one spelling per value, so that equal settings compare equal."""
    kept = F.map_filter(arguments, lambda k, v: ~k.isin(*drop) & v.isNotNull())
    return F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(kept, lambda _, v: canonical_value(v)))))


def args_text(arguments: Column) -> Column:
    """Text form of a map, usable as a group key."""
    return F.to_json(arguments)
