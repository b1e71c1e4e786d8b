"""The registered queries of this subpackage, one per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewise.llm import chunks, lines, lm, merkle, neardup, packing, pieces, pii, quality, ranked, secrets, topk, toxicity
from gradewise.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read(spark, sf_dir, "documents"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.every_nth(read(spark, sf_dir, "embeddings"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.difference_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_report(read(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(read(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source counts as an owner, a language of it as one of its repositories; what stands in four of these is copied."""
    docs = read(spark, sf_dir, "documents")
    return secrets.secret_report(docs, docs["source"], F.concat_ws("/", docs["source"], docs["lang"]), example_repos=4)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(read(spark, sf_dir, "documents"))


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_report(read(spark, sf_dir, "documents"))


def op13_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.exact_duplicates(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_pieces": op2_pieces,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_top_k": op5_top_k,
    "op6_lm": op6_lm,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_line_dedup": op8_line_dedup,
    "op9_secrets": op9_secrets,
    "op10_pii": op10_pii,
    "op11_ranked": op11_ranked,
    "op12_merkle": op12_merkle,
    "op13_exact_duplicates": op13_exact_duplicates,
}

SQL: dict[str, str] = {
    "op5_top_k": topk.TOPK_SQL,
    "op8_line_dedup": lines.LINES_SQL,
    "op11_ranked": ranked.RANKED_SQL,
    "op12_merkle": merkle.MERKLE_SQL,
    "op13_exact_duplicates": chunks.COPIES_SQL,
}
