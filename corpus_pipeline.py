"""The corpus pipeline: quality rules, line dedup, near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. The first drops documents that the quality rules reject; the
second deletes later copies of runs of lines, and documents of which nothing is left; the third keeps one document of each class of
near-duplicates; the fourth masks secrets; the last packs token sequences and returns their pieces.

No SQL stands beside it: the EM of the first stage and the tokens of the last cannot be expressed there; tests hold the stages against
brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewise.llm import lines, neardup, packing, quality, secrets
from gradewise.llm.common import read, stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.without_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.without_secrets(docs, docs["source"], F.concat_ws("/", docs["source"], docs["lang"]), example_repos=4)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows written as Parquet before the next reads them."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
