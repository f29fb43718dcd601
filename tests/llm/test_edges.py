"""Every operator over nulls, empty, long and repeated texts, empty tables and clashing columns."""

import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillvec.llm import decontamination, line_dedup, packing, pii, quality_classifier, quality_rules, simhash, substring_dedup, token_counts, toxicity

from .conftest import CLASHING, EDGES

BENCHMARK = [(1, "one two three four five six seven eight nine ten"), (2, None), (3, ""), (None, "short"), (1, "one two three four five six seven eight nine ten")]


def benchmark(spark):
    return spark.createDataFrame(BENCHMARK, "item_id long, text string")


#: name: (operator, whether it returns a row for every document)
OPERATORS = {
    "packing": (lambda s, d, l: packing.pack(d, capacity=64), False),
    "substring_dedup": (lambda s, d, l: substring_dedup.repeats(d, least_words=5), False),
    "substring_remove": (lambda s, d, l: substring_dedup.remove(d, least_words=5), False),
    "line_dedup": (lambda s, d, l: line_dedup.repeats(d, least_words=5), False),
    "line_remove": (lambda s, d, l: line_dedup.remove(d, least_words=5), False),
    "toxicity": (lambda s, d, l: toxicity.score(d, l), True),
    "toxicity_reject": (lambda s, d, l: toxicity.reject(d, l), False),
    "quality_rules": (lambda s, d, l: quality_rules.judge(d), True),
    "quality_clean": (lambda s, d, l: quality_rules.clean(d), False),
    "quality_classifier": (lambda s, d, l: quality_classifier.grade(d, quality_classifier.grades_of(l), 3), True),
    "decontamination": (lambda s, d, l: decontamination.leaks(d, benchmark(s)), False),
    "decontamination_remove": (lambda s, d, l: decontamination.remove(d, benchmark(s)), True),
    "simhash": (lambda s, d, l: simhash.near_duplicates(d), True),
    "simhash_keep_one": (lambda s, d, l: simhash.keep_one(d), False),
    "token_counts": (lambda s, d, l: token_counts.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")), True),
    "pii": (lambda s, d, l: pii.pseudonymise(d, "key"), True),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges_and_clashing_columns(spark, edges, clashing, none, labels, name):
    operator, whole = OPERATORS[name]
    plain, more = operator(spark, edges, labels), operator(spark, clashing, labels)
    assert more.count() == plain.count()
    if whole:
        assert plain.count() == len(EDGES)
    if name in ("substring_remove", "line_remove", "toxicity_reject", "quality_clean", "decontamination_remove", "simhash_keep_one", "pii"):
        assert set(more.columns) == set(clashing.columns)
        kept = [c for c in CLASHING if not (name == "pii" and c == "pii")]
        assert not more.where(" OR ".join(f"`{c}` <> 'own {c}'" for c in kept)).count()
    assert operator(spark, none, labels).count() == 0


def test_empty_side_tables(spark, edges, labels):
    no_labels = labels.where("false")
    assert toxicity.score(edges, no_labels).where("score between 0 and 1").count() == len(EDGES)
    assert quality_classifier.grade(edges, quality_classifier.grades_of(no_labels), 3).count() == len(EDGES)
    assert decontamination.leaks(edges, benchmark(spark).where("false")).count() == 0


def test_equal_rows_get_equal_answers(spark, edges, labels):
    for df, column in ((toxicity.score(edges, labels), "score"), (simhash.near_duplicates(edges), "component_id"), (quality_rules.judge(edges), "n_words")):
        assert df.where("doc_id in (7, 8)").select(column).distinct().count() == 1


def test_empty_texts_have_defined_results(spark, edges, labels):
    rows = {r["doc_id"]: r for r in quality_rules.judge(edges).collect()}
    assert all(rows[i]["n_words"] == 0 and rows[i]["base_failed"] and not rows[i]["kept"] for i in (1, 2, 3))
    prints = {r["doc_id"]: r for r in simhash.near_duplicates(edges).collect()}
    assert all(prints[i]["fp"] == 0 and prints[i]["component_id"] == 1 for i in (1, 2, 3))
    hidden = pii.pseudonymise(edges, "key").where("doc_id in (1, 2)").orderBy("doc_id").collect()
    assert hidden[0]["text"] is None and hidden[1]["text"] == ""
    packed = packing.pack(edges, capacity=64)
    assert packed.where("doc_id in (1, 2, 3)").count() == 0 and packed.agg(F.sum("n_words")).first()[0] == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in EDGES)


def test_keep_one_keeps_each_component_once(edges):
    """Ids 1 to 3 and a null id have fingerprint zero; the two rows of id 7 and id 8 are copies."""
    kept = simhash.keep_one(edges).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [1, 4, 5, 6, 7, 9, 10]
    assert [r["text"] for r in kept if r["doc_id"] is None] == ["a null id with some words in it"]


def test_pipeline_on_edges(spark, clashing, labels, tmp_path):
    root = f"file://{tmp_path}"
    clashing.write.parquet(f"{root}/documents.parquet")
    labels.write.parquet(f"{root}/labels.parquet")
    benchmark(spark).write.parquet(f"{root}/benchmark.parquet")
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, root)
        assert name == "packing" or set(after.columns) == set(clashing.columns)
        after.write.parquet(f"{root}/out-{name}")
        docs = spark.read.parquet(f"{root}/out-{name}")
        assert docs.count() > 0
