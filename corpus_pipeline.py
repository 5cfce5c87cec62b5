"""A corpus in five stages: quality rules, exact and near deduplication, removal of personal data, packing.

Each stage takes all that the one before kept; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hushframe.llm import exact_dedup, near_dedup, packing, pii, quality_rules
from hushframe.llm.common import documents, written
from hushframe.llm.tokens import default_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep; the list learns from the labelled ones among them."""
    return quality_rules.passing(docs, quality_rules.fit(docs, documents(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return near_dedup.deduplicate(docs, least=0.75, words=5)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind, and n_chars to match."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 token ids."""
    return packing.pack(docs, default_path("byte_bpe_50k.json"), window=1024, end_id=0)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("quality_rules", quality), ("exact_dedup", exact), ("minhash_near_dedup", near), ("pii", private), ("packing", packed)]

#: The learned rules, the field and the tokenizer have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each stage's rows are written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
