"""Queries over the operators of this subpackage, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.llm import decontamination, line_dedup, oracle, packing, pii, quality_classifier, quality_rules, simhash, substring_dedup, token_counts, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans_text(found: DataFrame, count: str) -> DataFrame:
    """Digest columns of removed spans: how many, how many words, and `start-end` pairs."""
    return found.select(
        F.col("id").alias("doc_id"), F.col(count).cast("long").alias(count), F.size("spans").cast("long").alias("n_removed"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("words_removed"),
        F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"], x["end"])), " ").alias("removed"),
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, clusters=packing.near_copies(docs))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_text(substring_dedup.repeats(table(spark, sf_dir, "documents")), "n_units")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_text(line_dedup.repeats(table(spark, sf_dir, "documents")), "n_lines")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    grades = quality_classifier.grades_of(table(spark, sf_dir, "labels"))
    return quality_classifier.grade(table(spark, sf_dir, "documents"), grades, 3)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


#: Of the query; a deployment passes a secret of its own.
PII_KEY = "example key"


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    counts = {f"n_{kind}": (F.size("pii") - F.size(F.array_remove("pii", kind))).cast("long") for kind in pii.KINDS}
    return done.where(F.size("pii") > 0).withColumns(counts).drop("pii")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_decontamination": op7_decontamination,
    "op8_simhash": op8_simhash,
    "op9_token_counts": op9_token_counts,
    "op10_pii": op10_pii,
}

#: Learning, search, packing, tokens, fingerprints, templates and keyed permutations are tested against brute force instead.
ORACLE_SQL: dict[str, str] = oracle.ORACLE_SQL
