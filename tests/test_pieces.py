import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillvec import queries, store_queries
from quillvec.catalog import Catalog
from quillvec.functions import metric as M
from quillvec.model import InvalidArgument
from quillvec.operators import ann, mvcc, ranking
from quillvec.plans import stats
from quillvec.sources.jsonl import read_puts
from quillvec.streaming import ingest


def test_metadata_filters_stay_above_the_version_window(spark, sf_dir):
    """Otherwise an older matching version would come back."""
    d = queries.log_bytes(spark, sf_dir)
    plan = mvcc.live(mvcc.at(d, 800)).where(queries.tested(queries.NARROW))._jdf.queryExecution().optimizedPlan().toString()
    window = plan.index("Window")
    assert plan.index("variant_get") < window < plan.index("<= 800", window)
    wrong = mvcc.live(d.where(queries.tested(queries.NARROW))).count()
    assert mvcc.live(d).where(queries.tested(queries.NARROW)).count() < wrong


def test_jsonl(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    rows = [{"id": f"r{i}", "vector": [i, 1], "metadata": {"n": i}} for i in range(30)]
    path.write_text("\n".join(json.dumps(r) for r in rows) + '\n\n{"id":"plain","vector":[1,2]}\n')
    got = read_puts(spark, f"file://{path}", 200).orderBy("ord").collect()
    assert [r["id"] for r in got] == [r["id"] for r in rows] + ["plain"] and got[-1]["metadata"] == "{}" and json.loads(got[3]["metadata"]) == {"n": 3}
    assert [r["batch"] for r in got] == sorted(r["batch"] for r in got) and got[-1]["batch"] > 3
    with pytest.raises(InvalidArgument):
        read_puts(spark, f"file://{path}", 10)
    (tmp_path / "empty.jsonl").write_text("\n")
    with pytest.raises(InvalidArgument):
        read_puts(spark, f"file://{tmp_path}/empty.jsonl")
    (tmp_path / "bad.jsonl").write_text("nonsense\n")
    with pytest.raises(Exception, match="not a record"):
        read_puts(spark, f"file://{tmp_path}/bad.jsonl").collect()


def test_jsonl_into_a_collection(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text("".join(json.dumps({"id": f"r{i:03d}", "vector": [i, 0]}) + "\n" for i in range(50)))
    c = Catalog(spark, f"file://{tmp_path}/root").create_collection("docs", 2, "dot")
    assert c.write(read_puts(spark, f"file://{path}")).last_seq_no == 50
    assert [(r["id"], r["seq_no"]) for r in c.scan().collect()] == [(f"r{i:03d}", i + 1) for i in range(50)]


def test_stream(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/root").create_collection("docs", 1, "dot")
    source = f"file://{tmp_path}/in"
    spark.createDataFrame([(1, "put", "a", [1.0], "{}"), (2, "put", "a", [2.0], "{}"), (3, "put", "b", [3.0], "{}")], ingest.OPERATIONS).coalesce(1).write.parquet(source)
    ingest.ingest(ingest.operations_stream(spark, source), c, f"{tmp_path}/check").awaitTermination()
    spark.createDataFrame([(4, "delete", "b", None, None)], ingest.OPERATIONS).coalesce(1).write.mode("append").parquet(source)
    ingest.ingest(ingest.operations_stream(spark, source), c, f"{tmp_path}/check").awaitTermination()
    assert [(r["id"], r["vector"]) for r in c.scan().collect()] == [("a", [2.0])] and c.snapshot().visible_seq_no == 3


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_an_index_of_clustered_vectors_is_read_in_part(spark, tmp_path, metric):
    """Written with the unit, read by the query: 0.9 of the neighbours from a quarter of the vectors or less."""
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(32, 8)) * 4
    vectors = [(centers[i % 32] + rng.normal(size=8) * 0.3).tolist() for i in range(1600)]
    c = Catalog(spark, f"file://{tmp_path}/root").create_collection("docs", 8, metric)
    c.write([("put", f"{i:04}", v, f'{{"half":{i % 2}}}') for i, v in enumerate(vectors)])
    c.flush()
    entry = c.manifest()["units"][0]
    index = ann.Index(**c.files.read(f"indexes/{entry['unit_id']}.json"))
    assert entry["index_kind"] == "ivf" == index.kind and index.recall >= 0.9 and entry["component_bytes"]["indexes"] > 0
    hits = read = 0
    asked = range(0, 1600, 160)
    for i in asked:
        lists, _ = c.indexed([entry["unit_id"]], vectors[i])
        read += lists.count()
        assert all("list=" in f for f in lists.inputFiles())
        r = c.query(vectors[i], 10, explain="plan")
        assert r.plan == "vector_first_ann"
        want = {x["id"] for x in ranking.top_k(c.scan(), vectors[i], metric, 10).collect()}
        hits += len(want & {x["id"] for x in r.matches.collect()})
    assert hits >= 0.9 * 10 * len(asked) and read <= 0.25 * 1600 * len(asked)
    narrow = c.query(vectors[0], 5, filters={"half": 1}).matches.collect()
    assert len(narrow) == 5 and all('"half":1' in x["metadata"] for x in narrow)


def test_vectors_that_hardly_cluster_are_scanned(spark, tmp_path):
    rng = np.random.default_rng(3)
    c = Catalog(spark, f"file://{tmp_path}/root").create_collection("docs", 32, "cosine")
    c.write([("put", str(i), rng.normal(size=32).tolist()) for i in range(1200)])
    c.flush()
    entry = c.manifest()["units"][0]
    assert entry["index_kind"] == "raw" and not c.files.exists(f"indexes/unit_id={entry['unit_id']}")
    assert c.query([1.0] * 32, 3).plan == "unfiltered_exact_scan"


def test_recall_over_the_embeddings(spark, sf_dir):
    row = queries.QUERIES["ann_recall"](spark, sf_dir).first()
    assert row["queries"] == 10 and row["reached"]


def test_unit_candidates_take_the_newest_version(spark):
    rows = [(s, "put", i, [v, 0.0], "{}", u) for s, i, v, u in [(1, "hot", 12, "u1"), (2, "x", 1, "u1"), (3, "hot", 11, "u2"), (4, "y", 2, "u2"), (5, "hot", 10, "u3"), (6, "z", 3, "u3")]]
    d = spark.createDataFrame([(s, o, i, [float(v[0]), 0.0], m, u) for s, o, i, v, m, u in rows], "seq_no long, op string, id string, vector array<float>, metadata string, unit_id string")
    got = ranking.unit_candidates(d, [1.0, 0.0], "dot", 2).collect()
    assert (got[0]["id"], got[0]["seq_no"], got[0]["value"]) == ("hot", 5, 10.0) and len(got) == 2


def test_field_statistics_match_the_in_memory_form(spark):
    metadata = ['{"a":1,"b":"x"}', '{"a":2.5,"b":null}', '{"a":"s","c":{"d":1}}', '{"a":true}', "[]", '{"a":1,"b":"y"}', '{"a":1e21}', '{"a":1e-7}', '{"a":123456789.5}', '{"a":18446744073709551615}']
    d = spark.createDataFrame([(i + 1, "put", str(i), [1.0], m, "u") for i, m in enumerate(metadata)], "seq_no long, op string, id string, vector array<float>, metadata string, unit_id string")
    want = {}
    for m in map(json.loads, metadata):
        for k, v in (m.items() if isinstance(m, dict) else ()):
            want.setdefault(k, stats.FieldStats()).add(v)
    keys = {k for f in want.values() for k in f.counts}
    (unit,) = stats.units_from(stats.unit_counts(d), stats.field_stats(d), stats.field_histogram(d), set(want), keys, {})
    assert unit.fields == want and unit.put_count == len(metadata)


def test_short_vectors_are_not_padded(spark):
    with pytest.raises(Exception, match="mismatch"):
        spark.range(1).select(M.checked(F.array(F.lit(1.0)), 2)).collect()


def test_vectors_are_joined_to_the_newest_operations(spark, sf_dir):
    """What is written to a collection: versions are dropped before vectors join, not after."""
    plan = store_queries.batches(spark, sf_dir)(0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")


def test_lists_and_centroids_are_not_columns_for_each_list(spark):
    """The list of a vector is found for a batch at a time, whatever the number of lists."""
    d = spark.range(8).selectExpr("cast(id AS string) AS id", "array(float(id % 4 = 0), float(id % 4 = 1), float(id % 4 > 1)) AS vector")
    centroids = ann.fit(d, 3, "cosine")
    placed = d.withColumn("list", ann.list_of(F.col("vector"), centroids, "cosine"))
    assert "aggregate" not in placed._jdf.queryExecution().optimizedPlan().toString()
    lists = {tuple(r["vector"]): r["list"] for r in placed.collect()}
    assert len(lists) == 3 == len(set(lists.values()))


def test_jsonl_batches_go_across_splits(spark, tmp_path):
    """Greedy over each whole file, in splits of a few lines, of less than a batch or of many batches."""
    rng = np.random.default_rng(2)
    want = []
    for name in ("a", "b"):
        lines = [json.dumps({"id": f"{name}{i:03}", "vector": [1], "metadata": {"t": "x" * int(rng.integers(0, 150))}}) for i in range(120)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
        fill, batch = 1 << 30, want[-1][1] if want else -1
        for line in lines:
            fill, batch = (len(line) + 1, batch + 1) if fill + len(line) + 1 > 1000 else (fill + len(line) + 1, batch)
            want.append((line[8:12], batch))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for size in (150, 700, 5000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            assert sorted((r["id"], r["batch"]) for r in read_puts(spark, f"file://{tmp_path}", 1000).collect()) == sorted(want)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_unit_of_the_stream_is_many_files(spark, sf_dir, monkeypatch):
    """No task writes or reads a whole unit, a unit is still one batch, and what is visible stays the same."""
    made = []
    monkeypatch.setattr(store_queries, "STREAM_FILE_ROWS", 40)
    monkeypatch.setattr(store_queries, "new_path", lambda s, name, f=store_queries.new_path: made.append(f(s, name)) or made[-1])
    got = queries.QUERIES["store_stream"](spark, sf_dir)
    want = mvcc.live(queries.log_bytes(spark, sf_dir)).select("id", "metadata")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    source, streamed = (next(p for p in made if f"/{name}-" in p) for name in ("stream", "streamed"))
    assert len(spark.read.parquet(source).inputFiles()) > 3 * store_queries.UNITS
    assert len(spark.read.text(f"{streamed}/*/*/commits", recursiveFileLookup=True).inputFiles()) == store_queries.UNITS
