"""The corpus pipeline: quality, near copies, benchmark leaks, personal data, tokens.

Nulls: a document without text is rejected by the first stage, one without id is
judged like any other and has no near copies.  Empty texts are rejected, very
long ones go through whole, an empty table gives no rows.  Repeated rows meet in
near-dedup, where those with one id stay together and those with more keep the
least.  Extra columns of any name are carried to the last stage, which returns
ids and tokens only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import bpe, decontaminate, near_dedup, pii, quality
from orrery.llm.common import table, written
from orrery.llm.queries import tokenizer_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each class of near copies."""
    return near_dedup.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that share a window with a benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts and counts their characters anew."""
    return pii.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of the decoded text."""
    return bpe.tokenized(docs, tokenizer_path())


STAGES = [("quality rules", good), ("MinHash near-dedup", distinct), ("benchmark decontamination", decontaminated), ("PII", masked), ("BPE encoding and decoding", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
