"""Queries over the driver's tables, one for each operator, and the same in DuckDB SQL.

The log of operations comes from `events`: an event is a put, or a delete if its
type is `error`; the id is the user; a put's vector is the embedding of that
number, counted round; units are four fifths of the sequence numbers, and the last
fifth is mutable.  Metadata gets fields that are missing, null, of other types or
nested, by the event's number.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.functions import metric as M
from quillvec.model import COSINE, DOT, L2, MUTABLE_UNIT
from quillvec.operators import ann, mvcc, ranking
from quillvec.operators.predicate import And, Not, Or, Predicate, combine, compile_predicate, from_json, parse_clauses, where
from quillvec.plans import engine, planner, stats
from quillvec.sources.files import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
K = 10
#: Immutable units, and the mutable one, each a like share of the log.
UNITS = 5
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLE_SQL[name] = sql
        return query

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the static collection ----------------------------------------------------------------


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.format_string('{"label":%d}', "label").alias("metadata"), F.col("vec_id").alias("seq_no"))


def query_vector(spark: SparkSession, sf_dir: str, number: int = 0) -> list[float]:
    """The vector of one embedding, which serves as the query."""
    row = read(spark, sf_dir, "embeddings").where(F.col("vec_id") == number).select("embedding").first()
    return list(row["embedding"]) if row else [0.0] * 64


def rounded(matches: DataFrame, places: int = 5) -> DataFrame:
    return matches.withColumn("value", F.round(F.col("value").cast("double"), places))


# single-precision folds in SQL: lists of FLOAT stay FLOAT, summed left to right in double
Q_SQL = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
METRIC_SQL = {
    DOT: "list_dot_product(embedding::DOUBLE[], q)",
    COSINE: "CASE WHEN list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) = 0 OR list_dot_product(q, q) = 0 THEN 0 ELSE list_cosine_similarity(embedding::DOUBLE[], q) END",
    L2: "list_distance(embedding::DOUBLE[], q)",
}


def knn_sql(metric: str, places: int = 5) -> str:
    direction = "ASC" if metric == L2 else "DESC"
    return f"""SELECT id, round(v, {places}) AS value, metadata FROM (
  SELECT vec_id::VARCHAR AS id, {METRIC_SQL[metric]} AS v, '{{"label":' || label || '}}' AS metadata FROM embeddings, {Q_SQL}
) ORDER BY v {direction}, id LIMIT {K}"""


def knn(metric: str, precision: str, places: int) -> Query:
    return lambda spark, sf_dir: rounded(ranking.top_k(records(spark, sf_dir), query_vector(spark, sf_dir), metric, K, precision), places)


for _metric in (DOT, COSINE, L2):
    register(f"knn_{_metric}", knn_sql(_metric))(knn(_metric, "f64", 5))
    register(f"knn_{_metric}_f32", knn_sql(_metric, 3))(knn(_metric, "f32", 3))


@register("vector_norm", "SELECT vec_id::VARCHAR AS id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings")
def vector_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("id", F.round(M.norm(F.col("vector"), "f64"), 5).alias("norm"))


@register(
    "knn_batch",
    f"""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id::VARCHAR AS id, list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]) AS v FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)
SELECT query_id, id, round(v, 5) AS value, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, id) AS rank FROM p) WHERE rank <= {K}""",
)
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every row whose id is divisible by 50, among all rows."""
    rows = records(spark, sf_dir)
    asked = read(spark, sf_dir, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = ranking.nearest(asked, rows, COSINE, K, "f64")
    return found.select("query_id", "id", F.round("value", 5).alias("value"), F.col("rank").cast("long").alias("rank"))


# --- the log ------------------------------------------------------------------------------

N_SQL = "(SELECT max(event_id) + 1 FROM events)"
LOG_SQL = f"""WITH log AS (
  SELECT event_id + 1 AS seq_no, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, user_id::VARCHAR AS id, CASE WHEN event_type <> 'error' THEN emb.embedding END AS vector,
    '{{"k":' || (props->>'k') || ',"type":"' || event_type || '"' || CASE event_id % 8 WHEN 0 THEN '' WHEN 1 THEN ',"x":null' WHEN 2 THEN ',"x":7' WHEN 3 THEN ',"x":7.5' WHEN 4 THEN ',"x":"7"'
      WHEN 5 THEN ',"x":true' WHEN 6 THEN ',"x":{{"y":1}}' ELSE ',"x":' || (event_id % 20) END || '}}' AS metadata,
    CASE WHEN event_id * {UNITS} // {N_SQL} < {UNITS - 1} THEN 'unit-' || (event_id * {UNITS} // {N_SQL}) ELSE '{MUTABLE_UNIT}' END AS unit_id
  FROM events LEFT JOIN embeddings emb ON emb.vec_id = user_id % (SELECT max(vec_id) + 1 FROM embeddings)
), latest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq_no DESC) = 1),
live AS (SELECT * FROM latest WHERE op = 'put')
"""


def size_of(spark: SparkSession, sf_dir: str, name: str, column: str) -> int:
    """How many numbers `column` runs through."""
    return (read(spark, sf_dir, name).agg(F.max(column)).first()[0] or 0) + 1


def log(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    e, total = read(spark, sf_dir, "events"), size_of(spark, sf_dir, "events", "event_id")
    n = F.col("event_id") % 8
    x = (
        F.when(n == 0, "").when(n == 1, ',"x":null').when(n == 2, ',"x":7').when(n == 3, ',"x":7.5').when(n == 4, ',"x":"7"').when(n == 5, ',"x":true')
        .when(n == 6, ',"x":{"y":1}').otherwise(F.concat(F.lit(',"x":'), (F.col("event_id") % 20).cast("string")))
    )
    metadata = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"type":"'), "event_type", F.lit('"'), x, F.lit("}"))
    number = F.call_function("div", F.col("event_id") * UNITS, F.lit(total))
    unit = F.when(number < UNITS - 1, F.concat(F.lit("unit-"), number.cast("string"))).otherwise(MUTABLE_UNIT)
    put = F.col("event_type") != "error"
    columns = [(F.col("event_id") + 1).alias("seq_no"), F.when(put, "put").otherwise("delete").alias("op"), F.col("user_id").cast("string").alias("id")]
    plain = e.select(*columns, metadata.alias("metadata"), unit.alias("unit_id"))
    return with_vectors(plain, spark, sf_dir) if vectors else plain


def with_vectors(plain: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the log with the vectors of puts."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_v"), F.col("embedding").alias("vector"))
    joined = plain.withColumn("_v", F.col("id").cast("long") % size_of(spark, sf_dir, "embeddings", "vec_id")).join(v, "_v", "left")
    return joined.select("seq_no", "op", "id", F.when(F.col("op") == "put", F.col("vector")).alias("vector"), "metadata", "unit_id")


def log_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log without vectors, for what never reads them."""
    return log(spark, sf_dir, vectors=False)


def share(d: DataFrame, sf_dir: str, part: int, parts: int) -> int:
    """The sequence number after `part` of `parts` of the log."""
    return size_of(d.sparkSession, sf_dir, "events", "event_id") * part // parts


IDS = ["1", "2", "3", "15", "77", "120", "no such id"]
SHOWN = "id, seq_no, metadata"
FROM_UNITS = LOG_SQL.split(", latest AS")[0]
#: name: (SQL, query on the log and the tables' folder)
VERSIONS: dict[str, tuple[str, Callable[[DataFrame, str], DataFrame]]] = {
    "scan_visible": (LOG_SQL + f"SELECT {SHOWN} FROM live", lambda d, at: mvcc.scan(d).select("id", "seq_no", "metadata")),
    "scan_selected_units": (
        FROM_UNITS + f"SELECT {SHOWN} FROM (SELECT * FROM log WHERE unit_id IN ('unit-1', 'unit-2') QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq_no DESC) = 1) WHERE op = 'put'",
        lambda d, at: mvcc.scan(d, None, ["unit-1", "unit-2"], False).select("id", "seq_no", "metadata"),
    ),
    "scan_no_units": (
        FROM_UNITS + f"SELECT {SHOWN} FROM (SELECT * FROM log WHERE unit_id = '{MUTABLE_UNIT}' QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq_no DESC) = 1) WHERE op = 'put'",
        lambda d, at: mvcc.scan(d, None, []).select("id", "seq_no", "metadata"),
    ),
    "latest_by_ids": (
        LOG_SQL + f"SELECT {SHOWN} FROM live WHERE id IN ({', '.join(repr(i) for i in IDS)})",
        lambda d, at: mvcc.lookup(d, d.sparkSession.createDataFrame([(i,) for i in IDS], "id string")).select("id", "seq_no", "metadata"),
    ),
    "delta_tail": (LOG_SQL + f"SELECT seq_no, op, id, metadata FROM log WHERE seq_no > {N_SQL} * 4 // 5", lambda d, at: d.where(F.col("seq_no") > share(d, at, 4, 5)).select("seq_no", "op", "id", "metadata")),
    "mvcc_latest": (LOG_SQL + "SELECT id, seq_no, op, unit_id FROM latest", lambda d, at: mvcc.latest(d).select("id", "seq_no", "op", "unit_id")),
    "mvcc_live": (LOG_SQL + "SELECT id, seq_no FROM live", lambda d, at: mvcc.live(d).select("id", "seq_no")),
    "mvcc_deleted": (LOG_SQL + "SELECT id, seq_no FROM latest WHERE op = 'delete'", lambda d, at: mvcc.deleted(d).select("id", "seq_no")),
    "compact_image": (
        FROM_UNITS + f"SELECT id, seq_no, op FROM log WHERE unit_id <> '{MUTABLE_UNIT}' QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq_no DESC) = 1",
        lambda d, at: mvcc.compact_image(d).select("id", "seq_no", "op"),
    ),
    "unit_visible": (
        FROM_UNITS + "SELECT unit_id, id, seq_no FROM (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY unit_id, id ORDER BY seq_no DESC) = 1) WHERE op = 'put'",
        lambda d, at: mvcc.unit_visible(d).select("unit_id", "id", "seq_no"),
    ),
    "hybrid_merge": (
        FROM_UNITS + f"""SELECT id, seq_no FROM (
  SELECT * FROM (SELECT * FROM log WHERE op = 'put' AND unit_id = 'unit-3') UNION ALL SELECT * FROM log WHERE op = 'put' AND unit_id = '{MUTABLE_UNIT}'
) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq_no DESC) = 1""",
        lambda d, at: mvcc.merge_latest(*(d.where((F.col("op") == "put") & (F.col("unit_id") == u)) for u in ("unit-3", MUTABLE_UNIT))).select("id", "seq_no"),
    ),
    "time_travel": (
        FROM_UNITS + f"SELECT {SHOWN} FROM (SELECT * FROM log WHERE seq_no <= {N_SQL} // 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq_no DESC) = 1) WHERE op = 'put'",
        lambda d, at: mvcc.scan(d, share(d, at, 1, 2)).select("id", "seq_no", "metadata"),
    ),
    "current_snapshot": (LOG_SQL + "SELECT max(seq_no) AS visible_seq_no FROM log", lambda d, at: d.agg(F.max("seq_no").alias("visible_seq_no"))),
    "unit_counts": (
        LOG_SQL + "SELECT unit_id, count(*) FILTER (op = 'put') AS put_count, count(*) FILTER (op = 'delete') AS delete_count, min(seq_no) AS min_seq_no, max(seq_no) AS max_seq_no FROM log GROUP BY 1",
        lambda d, at: stats.unit_counts(d).drop("approx_bytes"),
    ),
    "approx_bytes": (
        LOG_SQL + "SELECT unit_id, sum(CASE WHEN op = 'put' THEN strlen(id) + 4 * len(vector) + strlen(metadata) + 32 ELSE strlen(id) + 16 END)::BIGINT AS approx_bytes FROM log GROUP BY 1",
        lambda d, at: stats.unit_counts(d).select("unit_id", "approx_bytes"),
    ),
    "collection_stats": (
        LOG_SQL + f"""SELECT (SELECT count(*) FROM live) AS live_count, (SELECT count(*) FROM latest WHERE op = 'delete') AS deleted_count,
  (SELECT count(*) FROM log WHERE unit_id = '{MUTABLE_UNIT}') AS mutable_ops, (SELECT count(DISTINCT unit_id) FROM log WHERE unit_id <> '{MUTABLE_UNIT}') AS segment_count""",
        lambda d, at: stats.collection_stats(d),
    ),
    "inspect_segment": (LOG_SQL + "SELECT seq_no, op, id FROM log WHERE unit_id = 'unit-2'", lambda d, at: d.where("unit_id = 'unit-2'").select("seq_no", "op", "id")),
    "inspect_wal": (LOG_SQL + f"SELECT seq_no, op, id FROM log WHERE unit_id = '{MUTABLE_UNIT}'", lambda d, at: d.where(F.col("unit_id") == MUTABLE_UNIT).select("seq_no", "op", "id")),
}
WITH_BYTES = ("unit_counts", "approx_bytes")
for _name, (_sql, _query) in VERSIONS.items():
    register(_name, _sql)(lambda spark, sf_dir, q=_query, v=_name in WITH_BYTES: q(log(spark, sf_dir, v), sf_dir))

# --- statistics of fields -----------------------------------------------------------------

FIELDS_SQL = FROM_UNITS + """, fields AS (
  SELECT unit_id, field, json_type(metadata, '$."' || field || '"') AS t, json_extract(metadata, '$."' || field || '"') AS j FROM log, unnest(['k', 'type', 'x']) AS u(field) WHERE op = 'put'
), keyed AS (SELECT *, CASE WHEN t = 'NULL' THEN 'null' WHEN t = 'BOOLEAN' THEN 'bool:' || j::VARCHAR WHEN t = 'VARCHAR' THEN 'string:' || (j->>'$')
  WHEN t IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number:' || j::VARCHAR END AS key FROM fields WHERE t IS NOT NULL)
"""


#: Scalars of all types in one order: booleans, numbers, strings.
RANKED_SQL = "{'r': CASE WHEN t = 'BOOLEAN' THEN 0 WHEN t = 'VARCHAR' THEN 2 ELSE 1 END, 'n': CASE WHEN t IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN j::VARCHAR::DOUBLE END, 's': key}"
FIELD_STATS_SQL = f"""SELECT unit_id, field, count(*) AS present_count, count(*) FILTER (key = 'null') AS null_count, count(DISTINCT key) AS distinct_count,
  arg_min(key, {RANKED_SQL}) FILTER (key <> 'null') AS least, arg_max(key, {RANKED_SQL}) FILTER (key <> 'null') AS most FROM keyed GROUP BY 1, 2"""


@register("field_stats", FIELDS_SQL + FIELD_STATS_SQL)
def field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = ["unit_id", "field", "present_count", "null_count", "distinct_count"]
    return stats.field_stats(log_bytes(spark, sf_dir)).select(*shown, F.col("least.key").alias("least"), F.col("most.key").alias("most"))


@register("field_histogram", FIELDS_SQL + "SELECT unit_id, field, key AS value_key, count(*) AS n FROM keyed WHERE key IS NOT NULL GROUP BY 1, 2, 3")
def field_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.field_histogram(log_bytes(spark, sf_dir))


# --- predicates ---------------------------------------------------------------------------

X, T = "json_extract(metadata, '$.x')", "json_type(metadata, '$.x')"
NUMBER = f"{T} IN ('UBIGINT', 'BIGINT', 'DOUBLE')"
K_NUMBER = "(metadata->>'$.k')::BIGINT"
PREDICATES: dict[str, tuple[str, Predicate]] = {
    "pred_eq": (f"coalesce({T} IN ('UBIGINT', 'BIGINT') AND try_cast({X}::VARCHAR AS BIGINT) = 7, false)", where("x", "eq", 7)),
    "pred_eq_string": (f"coalesce({T} = 'VARCHAR' AND {X}->>'$' = '7', false)", where("x", "eq", "7")),
    "pred_eq_float": (f"coalesce({T} = 'DOUBLE' AND try_cast({X}::VARCHAR AS DOUBLE) = 7.5, false)", where("x", "eq", 7.5)),
    "pred_eq_null": (f"coalesce({T} = 'NULL', false)", where("x", "eq", None)),
    "pred_ne": (f"coalesce({T} NOT IN ('OBJECT', 'ARRAY') AND NOT ({T} IN ('UBIGINT', 'BIGINT') AND {X}::VARCHAR = '7'), false)", where("x", "ne", 7)),
    "pred_lt": (f"coalesce({NUMBER} AND try_cast({X}::VARCHAR AS DOUBLE) < 7.5, false)", where("x", "lt", 7.5)),
    "pred_lte": (f"coalesce({NUMBER} AND try_cast({X}::VARCHAR AS DOUBLE) <= 7.5, false)", where("x", "lte", 7.5)),
    "pred_gt": (f"coalesce({NUMBER} AND try_cast({X}::VARCHAR AS DOUBLE) > 7, false)", where("x", "gt", 7)),
    "pred_gte": (f"coalesce({NUMBER} AND try_cast({X}::VARCHAR AS DOUBLE) >= 7, false)", where("x", "gte", 7)),
    "pred_gt_string": ("metadata->>'$.type' > 'click'", where("type", "gt", "click")),
    "pred_lte_string": ("metadata->>'$.type' <= 'error'", where("type", "lte", "error")),
    "pred_text": (f"{K_NUMBER} >= 20 AND coalesce({T} = 'VARCHAR' AND {X}->>'$' = '7', false) AND metadata->>'$.type' <> 'view'", parse_clauses(["k:gte:json:20", "x:eq:7", "type:ne:view"])),
    "pred_json": (
        f"NOT ({K_NUMBER} < 50 OR metadata->>'$.type' = 'view') AND json_exists(metadata, '$.x')",
        from_json('{"kind":"and","children":[{"kind":"not","child":{"kind":"or","children":[{"kind":"comparison","field":"k","operator":"lt","value":50},{"kind":"comparison","field":"type","operator":"eq","value":"view"}]}},{"kind":"comparison","field":"x","operator":"exists"}]}'),
    ),
    "pred_exists": ("json_exists(metadata, '$.x')", where("x", "exists")),
    "pred_is_null": (f"coalesce({T} = 'NULL', false)", where("x", "is_null")),
    "pred_and": (f"{K_NUMBER} >= 20 AND metadata->>'$.type' = 'click'", And((where("k", "gte", 20), where("type", "eq", "click")))),
    "pred_or": (f"{K_NUMBER} < 10 OR coalesce({T} = 'BOOLEAN' AND {X}::VARCHAR = 'true', false)", Or((where("k", "lt", 10), where("x", "eq", True)))),
    "pred_not": (f"NOT coalesce({T} IN ('UBIGINT', 'BIGINT') AND try_cast({X}::VARCHAR AS BIGINT) = 7, false)", Not(where("x", "eq", 7))),
    "legacy_filters": (f"metadata->>'$.type' = 'view' AND coalesce({T} = 'VARCHAR' AND {X}->>'$' = '7', false) AND {K_NUMBER} > 3", combine({"type": "view", "x": "7"}, where("k", "gt", 3))),
}
for _name, (_sql, _predicate) in PREDICATES.items():
    register(_name, LOG_SQL + f"SELECT {SHOWN} FROM live WHERE {_sql}")(
        lambda spark, sf_dir, p=_predicate: mvcc.live(log_bytes(spark, sf_dir)).where(compile_predicate(p, F.col("metadata"))).select("id", "seq_no", "metadata")
    )

# --- ranking over versions ----------------------------------------------------------------

BROAD, NARROW = where("k", "gte", 30), where("type", "eq", "click")
VALUE_SQL = "list_dot_product(vector::DOUBLE[], q)"
BUDGET = planner.budget(K, 1.0)


def from_log(query: Callable[[DataFrame, list[float]], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(query(log(spark, sf_dir), query_vector(spark, sf_dir)))


def tested(p: Predicate) -> Column:
    return compile_predicate(p, F.col("metadata"))


TOP_SQL = f"SELECT id, round(v, 5) AS value, metadata FROM (SELECT *, {VALUE_SQL} AS v FROM {{rows}}, {Q_SQL}) ORDER BY v DESC, id LIMIT {K}"
register("answer_predicate", LOG_SQL + TOP_SQL.format(rows=f"(SELECT * FROM live WHERE {K_NUMBER} >= 30)"))(from_log(lambda d, q: ranking.top_k(mvcc.live(d), q, DOT, K, "f64", tested(BROAD))))
@register("answer_time_travel", LOG_SQL + TOP_SQL.format(rows=f"(SELECT * FROM (SELECT * FROM log WHERE seq_no <= {N_SQL} * 3 // 5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq_no DESC) = 1) WHERE op = 'put')"))
def answer_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = log(spark, sf_dir)
    return rounded(ranking.top_k(mvcc.live(mvcc.at(d, share(d, sf_dir, 3, 5))), query_vector(spark, sf_dir), DOT, K, "f64"))


CANDIDATES_SQL = LOG_SQL + f""", vis AS (SELECT * FROM (SELECT * FROM log WHERE unit_id <> '{MUTABLE_UNIT}' QUALIFY row_number() OVER (PARTITION BY unit_id, id ORDER BY seq_no DESC) = 1) WHERE op = 'put' AND {{condition}}),
best AS (SELECT *, {VALUE_SQL} AS v FROM vis, {Q_SQL} QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY v DESC, id) <= {BUDGET}),
cand AS (SELECT * FROM (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq_no DESC) = 1) ORDER BY v DESC, seq_no DESC, id, unit_id LIMIT {BUDGET})
"""


def candidates(d: DataFrame, q: list[float], test: Column | None = None) -> DataFrame:
    return ranking.unit_candidates(mvcc.at(d, include_mutable=False), q, DOT, BUDGET, "f64", test)


register("ann_candidates", CANDIDATES_SQL.replace("{condition}", "true") + "SELECT id, seq_no, round(v, 5) AS value, unit_id FROM cand")(from_log(candidates))
register("ann_filtered", CANDIDATES_SQL.replace("{condition}", "metadata->>'$.type' = 'click'") + "SELECT id, seq_no, round(v, 5) AS value, unit_id FROM cand")(from_log(lambda d, q: candidates(d, q, tested(NARROW))))
register("ann_exact_fallback", LOG_SQL + f"SELECT id, seq_no, round(v, 5) AS value, 'exact-fallback' AS unit_id FROM (SELECT *, {VALUE_SQL} AS v FROM live, {Q_SQL}) ORDER BY v DESC, id LIMIT {BUDGET}")(
    from_log(lambda d, q: ranking.exact_fallback(d, q, DOT, BUDGET, K, "f64"))
)
register("ann_rerank", CANDIDATES_SQL.replace("{condition}", "true") + TOP_SQL.format(rows=f"(SELECT * FROM live WHERE id IN (SELECT id FROM cand) AND {K_NUMBER} >= 30)"))(
    from_log(lambda d, q: ranking.rerank(d, candidates(d, q), q, DOT, K, "f64", tested(BROAD)))
)
register(
    "hybrid_topk",
    CANDIDATES_SQL.replace("{condition}", "true") + f""", mut AS (SELECT * FROM (SELECT * FROM log WHERE unit_id = '{MUTABLE_UNIT}' QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq_no DESC) = 1) WHERE op = 'put'),
both_sides AS (SELECT * FROM (SELECT * FROM live WHERE id IN (SELECT id FROM cand) UNION ALL SELECT * FROM mut) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq_no DESC) = 1)
""" + TOP_SQL.format(rows="both_sides"),
)(from_log(lambda d, q: ranking.top_k(mvcc.merge_latest(mvcc.lookup(d, candidates(d, q)), mvcc.live(mvcc.at(d, None, [], True))), q, DOT, K, "f64")))


@register("ann_recall", f"SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the inverted-file index finds 0.9 of the exact ten neighbours of every row whose id is divisible by 50, at the probes it measured for itself."""
    rows = records(spark, sf_dir)
    asked = read(spark, sf_dir, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    centroids = ann.fit(rows, 16, COSINE)
    indexed = rows.withColumn("list", ann.list_of(F.col("vector"), centroids, COSINE))
    probes, _, _ = ann.calibrated(indexed, centroids, COSINE)
    found = ann.search_many(indexed, asked, centroids, COSINE, K, probes).select("query_id", "id")
    exact = ranking.nearest(asked, rows, COSINE, K).select("query_id", "id")
    both = exact.join(found.withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("reached"))


# --- plans --------------------------------------------------------------------------------

PLAN_CASES: dict[str, tuple[Predicate | None, bool]] = {
    "none, indexed": (None, True), "none, raw": (None, False), "type click": (NARROW, True), "k broad, raw": (BROAD, False), "type click, raw": (NARROW, False),
    "tiny": (where("k", "eq", -1), True), "absent": (where("only_new", "exists"), True),
}
EXPLAINED = """SELECT * FROM (VALUES {rows}) v(name, plan, selectivity, units_considered, units_pruned, units_scanned, scan_mix)"""
SHARE_SQL = "(SELECT round((count(*) FILTER ({test}) / count(*))::FLOAT::DOUBLE, 4) FROM log WHERE op = 'put')"
_ANN, _RAW = "{''mutable_exact'': 1, ''immutable_ann'': 4}", "{''mutable_exact'': 1, ''immutable_exact'': 4}"
_EXPLAINED_ROWS = [
    ("none, indexed", planner.HYBRID, "1.0", 5, 0, 5, _ANN), ("none, raw", planner.UNFILTERED, "1.0", 5, 0, 5, _RAW),
    ("type click", planner.HYBRID, SHARE_SQL.format(test="metadata->>'$.type' = 'click'"), 5, 0, 5, _ANN),
    ("k broad, raw", planner.VECTOR_FIRST, "0.6", 5, 0, 5, _RAW),
    ("type click, raw", planner.PREDICATE_FIRST, SHARE_SQL.format(test="metadata->>'$.type' = 'click'"), 5, 0, 5, _RAW),
    ("tiny", planner.TINY, "0.0", 5, 0, 5, _RAW), ("absent", planner.TINY, "0.0", 5, 0, 5, _RAW),
]
EXPLAIN_SQL = LOG_SQL + EXPLAINED.format(rows=", ".join(f"('{n}', '{p}', {x}, {c}::INTEGER, {d}::INTEGER, {r}::INTEGER, '{m}')" for n, p, x, c, d, r, m in _EXPLAINED_ROWS))


@register("explain_units", EXPLAIN_SQL)
def explain_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the planner decides for some predicates: units considered, pruned and scanned, plan and mix.

    Units with deletions are never pruned; `prune_units` has a log without.
    """
    d = log_bytes(spark, sf_dir).withColumn("vector", F.array().cast("array<float>"))
    names, keys = (set().union(*x) for x in zip(*(planner.named(p) for p, _ in PLAN_CASES.values())))
    plain = stats.planning_stats(d, names, keys, {})
    return spark.createDataFrame([explained(name, p, plain, indexed) for name, (p, indexed) in PLAN_CASES.items()], EXPLAIN_COLUMNS)


EXPLAIN_COLUMNS = "name string, plan string, selectivity double, units_considered int, units_pruned int, units_scanned int, scan_mix string"


def explained(name: str, p: Predicate | None, units: list[stats.UnitStats], indexed: bool) -> tuple:
    units = [replace(u, index_kind="ivf") if indexed and u.tier != "mutable" else u for u in units]
    selection, part = planner.select_units(p, units), planner.selectivity(p, units)
    plan = planner.choose_plan(p, part, K, selection)
    return name, plan, round(float(part), 4), selection.considered, selection.pruned, selection.scanned, str(planner.scan_mix(plan, selection))


@register(
    "prune_units",
    LOG_SQL + f""", puts AS (SELECT * FROM log WHERE op = 'put'), n AS (SELECT {N_SQL} AS total)
SELECT 'seq_no above ' || cut AS name, (SELECT count(DISTINCT unit_id) FROM puts)::INTEGER AS units_considered,
  (SELECT count(*) FROM (SELECT max(seq_no) AS most FROM puts WHERE unit_id <> '{MUTABLE_UNIT}' GROUP BY unit_id) WHERE most <= bound)::INTEGER AS units_pruned
FROM n, LATERAL (SELECT unnest([0, 1, 2, 3, 5]) AS cut) c, LATERAL (SELECT total * cut // 5 AS bound) b""",
)
def prune_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old units that no record can match are left out: sequence numbers as a field, in a log of puts only."""
    puts = log_bytes(spark, sf_dir).where("op = 'put'").withColumns({"metadata": F.format_string('{"s":%d}', "seq_no"), "vector": F.array().cast("array<float>")})
    total = size_of(spark, sf_dir, "events", "event_id")
    rows = []
    units = stats.planning_stats(puts, {"s"}, set(), {})
    for cut in (0, 1, 2, 3, 5):
        chosen = planner.select_units(where("s", "gt", total * cut // 5), units)
        rows.append((f"seq_no above {cut}", chosen.considered, chosen.pruned))
    return spark.createDataFrame(rows, "name string, units_considered int, units_pruned int")


@register(
    "candidate_budget",
    """SELECT k::INTEGER AS k, share::DOUBLE AS share, greatest(16, greatest(k, 1) * CASE WHEN share <= 0.2 THEN 10 WHEN share <= 0.45 THEN 8 ELSE 6 END)::INTEGER AS budget
FROM (SELECT unnest([0, 1, 2, 5, 10, 100]) AS k), (SELECT unnest([0.0, 0.1, 0.3, 0.5, 1.0]) AS share)""",
)
def candidate_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates are generated for a top-k and an estimated selectivity."""
    return spark.createDataFrame([(k, x, planner.budget(k, np.float32(x))) for k in (0, 1, 2, 5, 10, 100) for x in (0.0, 0.1, 0.3, 0.5, 1.0)], "k int, share double, budget int")


@register("planned_query", LOG_SQL + TOP_SQL.format(rows=f"(SELECT * FROM live WHERE {K_NUMBER} >= 30)"))
def planned_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path: statistics, plan, DataFrame; units without an index, so an exact plan."""
    d = log(spark, sf_dir)
    units = stats.planning_stats(log_bytes(spark, sf_dir).withColumn("vector", F.array().cast("array<float>")), *planner.named(BROAD), {})
    return rounded(engine.execute(d, units, query_vector(spark, sf_dir), DOT, K, predicate=BROAD, precision="f64").matches)


@register("jsonl_ingest", """SELECT 'put' AS op, vec_id::VARCHAR AS id, len(embedding)::INTEGER AS dimensions, '{"label":' || label || '}' AS metadata FROM embeddings""")
def jsonl_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings written as JSON lines and read back in batches."""
    from quillvec.sources.jsonl import read_puts

    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    rows = records(spark, sf_dir).select(F.to_json(F.struct("id", "vector", F.parse_json("metadata").alias("metadata"))).alias("value"))
    rows.write.mode("overwrite").text(path)
    return read_puts(spark, path).select("op", "id", F.size("vector").alias("dimensions"), "metadata")


JSONL_BATCH = 4000


@register(
    "jsonl_batches",
    f"""WITH RECURSIVE lines AS (SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, strlen('{{"id":"' || vec_id || '","vector":[' || label || '.0],"metadata":{{"t":"' || repeat('x', (vec_id * 37 % 400)::INTEGER) || '"}}}}') + 1 AS b FROM embeddings),
taken AS (SELECT n, vec_id, b AS fill, 0::BIGINT AS batch FROM lines WHERE n = 1 UNION ALL
  SELECT l.n, l.vec_id, CASE WHEN t.fill + l.b > {JSONL_BATCH} THEN l.b ELSE t.fill + l.b END, CASE WHEN t.fill + l.b > {JSONL_BATCH} THEN t.batch + 1 ELSE t.batch END FROM taken t JOIN lines l ON l.n = t.n + 1)
SELECT batch, vec_id::VARCHAR AS id FROM taken""",
)
def jsonl_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of many lengths, and the batches they are taken in."""
    from quillvec.sources.jsonl import read_puts

    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    e = read(spark, sf_dir, "embeddings")
    line = F.format_string('{"id":"%d","vector":[%d.0],"metadata":{"t":"%s"}}', "vec_id", "label", F.repeat(F.lit("x"), (F.col("vec_id") * 37 % 400).cast("int")))
    e.select("vec_id", line.alias("value")).coalesce(1).sortWithinPartitions("vec_id").select("value").write.text(path)
    return read_puts(spark, path, JSONL_BATCH).select("batch", "id")
