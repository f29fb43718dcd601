"""The pipeline's stages, each on what the one before kept, against brute force."""

import re
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillvec.llm import toxicity

from .conftest import SCHEMA
from .test_exact import SF, jaccard, plain_lines

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def kept(spark):
    """The input and every stage's result, written and read again."""
    out, folder = {}, spark.conf.get("spark.checkpoint.dir")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/stage-{name}"
        stage(spark, docs, SF).write.mode("overwrite").parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_stage_names():
    assert list(STAGES) == ["toxicity", "lines", "near_duplicates", "benchmark", "packing"]


def test_toxic_documents_go(spark, kept):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r["doc_id"] for r in toxicity.score(kept["input"], labels).where("predicted = 1").collect()}
    before, after = rows(kept["input"]), rows(kept["toxicity"])
    assert toxic and after == {i: r for i, r in before.items() if i not in toxic}


def test_later_runs_of_lines_go(kept):
    before, after = rows(kept["toxicity"]), rows(kept["lines"])
    cuts = plain_lines(sorted((i, r["text"]) for i, r in before.items()), 25)
    assert cuts
    for i, r in before.items():
        text, at = "", 0
        for a, b in cuts.get(i, []):
            text, at = text + r["text"][at:a], b
        text += r["text"][at:]
        if i in cuts and not text.split():
            assert i not in after
        else:
            assert after[i] == r | {"text": text}


def test_one_of_each_group_of_near_copies_stays(kept):
    before, after = rows(kept["lines"]), rows(kept["near_duplicates"])
    texts = sorted((i, r["text"]) for i, r in before.items())
    group = {i: i for i, _ in texts}
    for k, (i, x) in enumerate(texts):
        for j, y in texts[:k]:
            if 0.6 < (len(x) + 1) / (len(y) + 1) < 1.7 and group[i] != group[j] and (x == y or jaccard(x, y) >= 0.8):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {a: new if g == old else g for a, g in group.items()}
    assert after == {i: r for i, r in before.items() if group[i] == i}


def test_documents_with_benchmark_items_go(spark, kept):
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = rows(kept["near_duplicates"]), rows(kept["benchmark"])
    holds = {i for i, r in before.items() if any(x in " ".join(r["text"].split()) for x in items)}
    assert holds and after == {i: r for i, r in before.items() if i not in holds}


def test_bins_hold_tokens_of_different_sources(kept):
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    before = rows(kept["benchmark"])
    packed = kept["packing"].collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in packed:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["n_tokens"]))
        bins[r["bin"]].append(r)
    for i, r in before.items():
        n = len(library.encode(r["text"], add_special_tokens=False).ids)
        at = 0
        for k, (piece, start, size) in enumerate(sorted(pieces.get(i, []))):
            assert (piece, start) == (k, at)
            at += size
        assert at == n
    for members in bins.values():
        assert sum(r["n_tokens"] for r in members) <= 2048 and sorted(r["place"] for r in members) == list(range(len(members)))
        sources = [before[r["doc_id"]]["source"] for r in members]
        words = [" ".join(re.findall(r"[^\x20\x09-\x0D]+", before[r["doc_id"]]["text"].lower())) for r in members]
        assert len(set(sources)) == len(sources) and len(set(words)) == len(words)


def test_run_is_the_stages_one_after_another(spark, kept):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, kept["packing"].collect()))


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    root = f"file://{tmp_path}"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{root}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{root}/{name}.parquet")
    out = corpus_pipeline.run(spark, root)
    assert out.columns == ["bin", "place", "doc_id", "piece", "start", "n_tokens"] and out.count() == 0
