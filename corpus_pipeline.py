"""The corpus pipeline: from `documents` to packed training sequences.

Stages, each over all that the one before kept:

1. toxicity: documents the weakly supervised classifier scores 0.5 or more go.
2. lines: later copies of repeated runs of lines are cut out; documents that lose
   every word go.
3. near_duplicates: of each group of texts whose five-word shingles have a similarity of
   0.8 or more one document stays, found through SimHash fingerprints.
4. benchmark: documents that hold a benchmark item go.
5. packing: what is left is packed into bins of 2048 tokens.  No near copies are left by
   then, so bins keep sources apart, and copies that differ in case or spacing.

All stages but the last return the columns of `documents`.  Nulls, empty and
repeated rows are treated as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.llm import decontamination, line_dedup, packing, simhash, token_counts, toxicity
from quillvec.llm.common import discard, durable

#: Whose tokens bins are measured in.
TOKENIZER = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.remove(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_similar(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tokens = token_counts.token_count_column(spark, F.col("text"), public_tokenizers.path(TOKENIZER))
    return packing.pack(docs, size=tokens, unit="tokens")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("lines", cut_lines),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark),
    ("packing", pack),
]

#: The stages learn, search and pack; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
