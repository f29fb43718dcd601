"""Shared pieces: words, row keys, durable tables, sorted groups and components.

Row keys: `doc_id` may be null or repeated, so an operator that has to find a
row again uses 128 bits of id and text.  Rows equal in both are the same
document to every operator and get the same answer.
"""

from __future__ import annotations

import ctypes
import gc
import threading
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.llm.ship import ship
from quillvec.sources.files import shared_dir

#: ASCII white space, which separates words.
SPACE = "\\x20\\x09-\\x0D"


def python_udf(kind: str) -> Callable:
    """`pandas_udf`, with this package on the executors."""
    ship()
    return F.pandas_udf(kind)


_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from batch to batch under `name`.

    One thing at a time: workers go from one operator to the next, and their tables
    would add up.  What is dropped goes back to the system where it has a way to say so.
    """
    if name not in _HELD:
        if _HELD:
            _HELD.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)
        _HELD[name] = make()
    return _HELD[name]


def nothing_held() -> None:
    """For operators that keep nothing: what another has left in the worker goes."""
    held("", object)


#: Texts whose words are held as Python objects at a time.
PART_TEXTS = 200


def parts(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """`texts` in lists of at most `PART_TEXTS`, null as empty, whatever the size of Arrow batches."""
    whole = list(texts)
    for at in range(0, max(1, len(whole)), PART_TEXTS):
        yield [t or "" for t in whole[at : at + PART_TEXTS]]


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The runs of characters other than ASCII white space; null has none."""
    return F.array_remove(F.split(text_or_empty(text), f"[{SPACE}]+"), "")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once a row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def whole_row(docs: DataFrame) -> Column:
    """All columns of `docs` as one, so that helper columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def row_key(id_col: str, text_col: str) -> Column:
    """Tells documents apart: 128 bits of the id and the whole text."""
    return F.unhex(F.md5(F.concat_ws("\x1f", F.coalesce(F.col(id_col).cast("string"), F.lit("\x1e")), F.coalesce(F.col(text_col), F.lit("\x1e"))).cast("binary")))


#: Rows that go to a Python worker at a time while a table is written; texts are long.
BATCH_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


_BATCH_LOCK, _BATCH_USERS = threading.Lock(), Counter()
_BATCH_BEFORE: dict[int, str] = {}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Python workers get small batches meanwhile; the session's setting comes back with the last of several writers."""
    session = id(spark._jsparkSession)
    with _BATCH_LOCK:
        if not _BATCH_USERS[session]:
            _BATCH_BEFORE[session] = before = spark.conf.get(BATCH_SETTING)
            spark.conf.set(BATCH_SETTING, min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS)
        _BATCH_USERS[session] += 1
    try:
        yield
    finally:
        with _BATCH_LOCK:
            _BATCH_USERS[session] -= 1
            if not _BATCH_USERS[session]:
                spark.conf.set(BATCH_SETTING, _BATCH_BEFORE.pop(session))


def durable(df: DataFrame) -> DataFrame:
    """`df` written as a table in the shared folder and read again.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of `durable` that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._table_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sorted_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of equal `keys` from batches sorted by them, one after another."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        new = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
        if rest and all(rest[-1][k].iloc[-1] == batch[k].iloc[0] for k in keys):
            new = new[1:]
        elif not rest:
            new = new[1:]
        at = 0
        for cut in new:
            if cut > at:
                rest.append(batch.iloc[at:cut])
            if rest:
                yield pd.concat(rest) if len(rest) > 1 else rest[0]
            rest, at = [], cut
        rest.append(batch.iloc[at:])
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges(a, b)`: rows `(node, root)`, root the least node.

    Alternates large and small stars until nothing moves: each round is a few
    joins and aggregations, edges never grow in number, and no node's
    neighbours are gathered anywhere.  Nodes without an edge have no row.
    """

    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = pairs
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        near = both.join(least, "a")
        moved = near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else near.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        return moved.where("a != b").distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    before = mark(now)
    while before[0]:
        # a star's edges run from the larger node to its root
        new = durable(stars(stars(now, True), False))
        discard(now)
        now, after = new, mark(new)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
