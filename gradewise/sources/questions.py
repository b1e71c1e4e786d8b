"""Question-set scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewise import schemas

BAD_LINE = "_bad_line"
ROW_KEY = "_row_key"


def read_question_set(
    spark: SparkSession, root: str, benchmark: str, subsets: Sequence[str] | None = None, split: str | None = None
) -> DataFrame:
    """Rows of a question set stored as `<root>/subset=<name>/split=<name>/*.parquet`.

    Both filters are on partition columns, so only the wanted directories are read. `_row_key` is the place of a row
    in the stored set, for sources that have no id of their own.
    """
    schema = f"{schemas.QUESTION_SETS[benchmark]}, subset string, split string"
    place = F.concat_ws(
        ":",
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+/[^/]+)$", 1),
        F.col("_metadata.row_index").cast("string"),
    )
    rows = spark.read.schema(schema).parquet(root).select("*", place.alias(ROW_KEY))
    if subsets is not None:
        rows = rows.filter(F.col("subset").isin(list(subsets)))
    if split is not None:
        rows = rows.filter(F.col("split") == split)
    return rows


def read_jsonl(spark: SparkSession, path: str, schema: str = schemas.VCT) -> DataFrame:
    """One JSON document per line with the raw text of unreadable lines in `_bad_line`; blank lines are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return parse_json_lines(lines, "value", schema)


def parse_json_lines(lines: DataFrame, column: str, schema: str, keep: Sequence[str] = ()) -> DataFrame:
    parsed = F.from_json(
        F.col(column), f"{schema}, {BAD_LINE} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE}
    )
    return lines.select(*keep, parsed.alias("_row")).select(*keep, "_row.*")


def valid_lines(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col(BAD_LINE).isNull()).drop(BAD_LINE)


def invalid_lines(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col(BAD_LINE).isNotNull()).select(BAD_LINE)


def read_articles_xml(spark: SparkSession, path: str) -> DataFrame:
    """Article sets as `(pmid, title, content)`; an article without abstract gets a fixed text, bad files no rows."""
    from gradewise.fixed_values import NO_ABSTRACT

    article = F.col("MedlineCitation.Article")
    return (
        spark.read.format("xml")
        .option("rowTag", "PubmedArticle")
        .option("mode", "DROPMALFORMED")
        .schema(schemas.ARTICLE)
        .load(path)
        .select(
            F.col("MedlineCitation.PMID._VALUE").alias("pmid"),
            article["ArticleTitle"].alias("title"),
            F.coalesce(F.get(article["Abstract"]["AbstractText"], F.lit(0)), F.lit(NO_ABSTRACT)).alias("content"),
        )
        .filter(F.col("pmid").isNotNull())
    )
