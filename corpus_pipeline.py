"""The corpus pipeline: each stage is written as Parquet and read again as the documents of the next.

Rejected documents go, one document of each class of near copies stays, documents that hold a benchmark item go, secrets
are masked in the text, and what is left is encoded. All stages but the last return the columns of documents, and keep
further columns, whatever their names.

Null and empty texts have no words, so the quality rules reject them. Repeated rows are near copies, of which one stays. Null
ids and null values of other columns stay as they are. Very long texts go through every stage whole. An empty table gives no
rows, and empty labels or benchmark items reject nothing by themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm import bpe, decontaminate, jaccard, quality, secrets
from cuemill.llm.common import staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and text, which is decoded from the ids."""
    return bpe.encoded(docs).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("secret_masks", secret_masks),
    ("token_ids", token_ids),
]

#: The stages use trained cutoffs, sketches and merges, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
