import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillvec.functions import metric as M
from quillvec.operators import ranking

VECTORS = [[3.0, 4.0], [0.0, 0.0], [-1.5, 2.25], [1e20, -1e20]]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_known_values(spark):
    q, c = M.literal([1, 2]), M.literal([3, 4])
    assert one(spark, M.cosine(q, c)) == pytest.approx(0.9838699, abs=1e-6)
    assert one(spark, M.dot(q, c)) == 11.0
    assert one(spark, M.l2(q, c)) == pytest.approx(2.828427, abs=1e-6)


def test_zero_vector_has_cosine_zero(spark):
    assert one(spark, M.cosine(M.literal([0, 0]), M.literal([1, 2]))) == 0.0


def test_single_precision_is_a_sequential_fold(spark):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(40, 64)).astype(np.float32)
    q = rng.normal(size=64).astype(np.float32)

    def fold(values):
        total = np.float32(0)
        for x in values:
            total = np.float32(total + x)
        return total

    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id int, vector array<float>")
    got = df.select("id", M.dot(M.literal(q.tolist()), F.col("vector")).alias("dot"), M.l2(M.literal(q.tolist()), F.col("vector")).alias("l2")).orderBy("id").collect()
    for r, v in zip(got, rows):
        assert np.float32(r["dot"]) == fold(q * v)
        assert np.float32(r["l2"]) == np.float32(np.sqrt(np.float64(fold((q - v) * (q - v)))))


def test_wrong_stored_dimension_is_an_error(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], "{}"), ("b", [1.0], "{}")], "id string, vector array<float>, metadata string")
    with pytest.raises(Exception, match="dimension mismatch"):
        ranking.top_k(df, [1.0, 2.0], "dot", 2).collect()


def test_order_and_ties(spark):
    df = spark.createDataFrame([("10", [1.0, 0.0], "{}"), ("2", [1.0, 0.0], "{}"), ("b", [2.0, 0.0], "{}"), ("z", [0.0, 0.0], "{}"), ("y", [-0.0, 0.0], "{}")], "id string, vector array<float>, metadata string")
    assert [r["id"] for r in ranking.top_k(df, [1.0, 0.0], "dot", 3).collect()] == ["b", "10", "2"]
    assert [r["id"] for r in ranking.top_k(df, [1.0, 0.0], "l2", 2).collect()] == ["10", "2"]
    assert ranking.top_k(df, [1.0, 0.0], "dot", 0).count() == 0
    assert ranking.top_k(df, [1.0, 0.0], "dot", 99).count() == 5
    assert "TakeOrderedAndProject" in ranking.top_k(df, [1.0, 0.0], "dot", 3)._jdf.queryExecution().executedPlan().toString()


def test_batch_matches_single(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(str(i), rng.normal(size=4).tolist(), "{}") for i in range(60)], "id string, vector array<float>, metadata string")
    queries = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(5)], "query_id int, query_vector array<float>")
    got = ranking.nearest(queries, df, "cosine", 4, block=2).orderBy("query_id", "rank").collect()
    for q in queries.collect():
        assert [r["id"] for r in got if r["query_id"] == q["query_id"]] == [r["id"] for r in ranking.top_k(df, q["query_vector"], "cosine", 4).collect()]


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_blocks_equal_the_columns(spark, metric):
    """Matrix products find the same neighbours as pairs of Columns, with ties, zeros, nulls, NaN and vectors of any size; no pair is a row."""
    rng = np.random.default_rng(5)
    rows = [[float(x) for x in v] for v in rng.normal(size=(40, 3))]
    rows += [[0.0, 0.0, 0.0], [-0.0, 0.0, -0.0], rows[0], rows[0], rows[0], [1e-30, 0.0, 2e-30], [1e30, -1e30, 1e30], [float("nan"), 1.0, 2.0], [float("inf"), 0.0, 1.0], [1.0, None, 2.0], None]
    d = spark.createDataFrame([(f"{i * 7 % 51:03}", v) for i, v in enumerate(rows)], "id string, vector array<float>")
    asked = [*rows[:3], [0.0, 0.0, 0.0], [1e-30, 1.0, 0.0], [float("nan"), 0.0, 0.0]]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query_vector array<float>")
    for precision in ("f32", "f64"):
        got = ranking.nearest(queries, d, metric, 6, precision)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan and "Generate" not in plan
        pairs = queries.crossJoin(d).select("query_id", "id", M.value(metric, F.col("query_vector"), F.col("vector"), precision).alias("value"))
        want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*M.order(metric)))).where("rank <= 6")
        assert repr(sorted(map(tuple, got.collect()))) == repr(sorted(map(tuple, want.collect())))
