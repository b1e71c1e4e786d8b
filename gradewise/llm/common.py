"""Helpers shared by the corpus operators: reading, stored tables, row keys, and match positions as columns.

Row key. A document row is known by `doc_id` and a digest of its text, so rows may share an id or have none. Rows that agree in
both are the same document and get the same result. Null texts count as empty texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewise.storage import kept as stored

__all__ = ["WORD", "count_kind", "found", "keyed", "let", "overlaps", "read", "span_text", "stored", "unpacked", "whole_rows", "with_rows"]

#: A word of a text, as a pattern that Java, Python and RE2 read alike.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, th, text, more): the row key and the whole text, null as empty. No other column of `docs` is read."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"), *more)


def with_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on the row key; `right` has one row per key and no other column name of `left`."""
    other = right.withColumnsRenamed({"doc_id": "_doc_id", "th": "_th"})
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("th") == F.col("_th"))
    return left.join(other, same, "left").drop("_doc_id", "_th")


def whole_rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, th): every row as one struct beside its key, so that no column of it can clash with a column of ours."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("th"))


def unpacked(rows: DataFrame, columns: list[str], text: Column | None = None) -> DataFrame:
    """The columns of the struct `row`, `text` replaced if given."""
    return rows.select(*[(text if c == "text" and text is not None else F.col("row")[c]).alias(c) for c in columns])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it in `body` as often as needed."""
    return F.element_at(F.transform(F.array(value), body), 1)


def found(text: Column, pattern: str | Column) -> Column:
    """Leftmost matches that do not overlap: array of (s, e, m), code points from 0, end exclusive. Empty matches are not allowed."""

    def placed(v: Column) -> Column:
        sizes = F.zip_with(
            F.slice(v["g"], F.lit(1), F.size(v["h"])),
            v["h"],
            lambda g, h: F.struct(F.char_length(g).alias("g"), F.char_length(h).alias("n")),
        )
        return let(F.struct(v["h"].alias("h"), sizes.alias("z")), with_starts)

    def with_starts(u: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            before = F.aggregate(F.slice(u["z"], F.lit(1), i), F.lit(0), lambda a, x: a + x["g"] + x["n"])
            start = before + F.get(u["z"], i)["g"]
            return F.struct(start.alias("s"), (start + F.char_length(m)).alias("e"), m.alias("m"))

        return F.transform(u["h"], one)

    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    return let(F.struct(hits.alias("h"), F.split(text, pattern, -1).alias("g")), placed)


def overlaps(spans: Column, s: Column, e: Column) -> Column:
    return F.exists(spans, lambda x: (x["s"] < e) & (s < x["e"]))


def span_text(spans: Column, names: tuple[str, ...]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined. `spans`: array of structs with k, s, e; k indexes `names`."""
    kinds = F.array(*[F.lit(n) for n in names])
    ordered = F.array_sort(
        F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    )
    return F.array_join(
        F.transform(ordered, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))),
        ",",
    )


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == kind)).cast("long")
