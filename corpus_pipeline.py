"""Training-data pipeline: documents -> packed sequences, in five stages.

Each stage calls one operator of ``evtide.llm`` on all that the stage before
kept; its result is written as Parquet in the shared folder and read again.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evtide.llm import line_dedup, packing, quality, secret_scan, simhash_dedup
from evtide.llm.common import materialise, recorded, release, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: shared lines stay in one document. The banners of private
    keys are alike in many documents and stay for the secret scan."""
    return line_dedup.rewrite_documents(docs, spare=secret_scan.opens_or_ends_key)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: the smallest doc_id of each group stays."""
    return simhash_dedup.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: found secrets are replaced by a mark."""
    return secret_scan.redact_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of sequences of 2048 tokens, with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_classifier", good_documents), ("line_dedup", without_shared_lines),
          ("simhash_near_dedup", without_near_copies), ("secret_scan", without_secrets),
          ("packing", packed)]

# The classifier, the fingerprints and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``. What a stage wrote for itself, and the
    documents it read, are deleted once its own documents are written."""
    docs, spent = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with recorded() as made:
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        release(*spent, *made[:-1])
        spent = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
