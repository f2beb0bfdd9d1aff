"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from townsheet.llm import bpe, quality, secrets, simhash, templates
from townsheet.llm.common import documents, forget, saved, scratch, unused

TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that fail the rules or lie far from their language and source go; equal rows go or stay together."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of each component of texts alike by 0.8 in five-word shingles, the smallest id if there is one."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold a benchmark item, as it is or with other values, go."""
    return templates.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; secrets in its text are replaced by their kind in brackets. Null texts stay null."""
    return secrets.redact(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, with n_tokens and ids in place of text; columns with these two names are replaced, all others stay."""
    (tokens,) = unused(docs, "tokens")
    return bpe.encode(docs, public_tokenizers.path(TOKENIZER), tokens).drop(tokens)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("BPE encoding", bpe_encoding),
]

#: SQL cannot express the robust estimates, similarities or the encoder: tests/llm/test_pipeline.py holds the whole chain
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over all documents, each result written and the one before it deleted."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        with scratch():
            kept = saved(stage(spark, docs, sf_dir), "stage", keep=True)
        forget(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
