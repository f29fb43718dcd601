"""Inverted-file indexes: vectors in lists by their nearest centroid.

An index belongs to an immutable unit and is written with it.  It holds the unit's
newest put of each id that the unit does not delete, every one of them, in folders
by list, with its norm.  Centroids are fitted on at most `SAMPLE_ROWS` vectors.
How many lists a query has to read is measured when the index is built: the least
number at which `CHECK_QUERIES` vectors of the unit find `RECALL` of their exact
ten neighbours.  If that takes more than `MOST_READ` of the vectors an index would
not pay, and the unit is left raw: queries scan it exactly.  Units of at most
`FLAT_ROWS` records have one list, which is always read.

Cosine and dot product probe by the angle to the centroids, L2 by distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.functions import metric as M
from quillvec.model import L2
from quillvec.operators import blocks, mvcc, ranking
from quillvec.ship import ship

FLAT_ROWS = 1024
SAMPLE_ROWS = 100_000
MOST_LISTS = 256
CHECK_QUERIES = 64
RECALL = 0.95
MOST_READ = 0.5
RAW, FLAT, IVF = "raw", "flat", "ivf"


@dataclass
class Index:
    """What the driver knows of a unit's index; `probes`: lists that a query reads."""

    kind: str
    centroids: list[list[float]]
    probes: int
    recall: float
    read_share: float


def sampled(records: DataFrame, rows: int, salt: int) -> DataFrame:
    """At most `rows` records, chosen by a hash of the id."""
    return records.orderBy(F.xxhash64(F.lit(salt), "id"), "id").limit(rows)


def fit(records: DataFrame, lists: int, metric: str, sample_rows: int = SAMPLE_ROWS, seed: int = 1) -> np.ndarray:
    """Centroids from at most `sample_rows` records, fitted in one task."""
    ship(records.sparkSession)
    columns = records.withColumn("dimensions", F.size("vector")).select("id", "vector", "dimensions")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            if batch.num_rows:
                own = blocks.Vectors.of(batch.column("vector"), batch.column("dimensions")[0].as_py(), "f32")
                parts.append(own.values[own.known])
        found = kmeans(np.concatenate(parts).astype(float), lists, metric, seed) if parts else np.zeros((0, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array(found.tolist(), pa.list_(pa.float64()))], names=["list", "centroid"])

    rows = sampled(columns, sample_rows, seed).mapInArrow(run, "list int, centroid array<double>").collect()
    return np.array([r["centroid"] for r in sorted(rows, key=lambda r: r["list"])])


def kmeans(vectors: np.ndarray, lists: int, metric: str, seed: int, rounds: int = 15) -> np.ndarray:
    """At most `lists` centroids: distinct vectors far from each other, then rounds of Lloyd's.  Angles count but for L2, so zero vectors don't."""
    if metric != L2:
        vectors = unit(vectors[np.linalg.norm(vectors, axis=1) > 0])
    vectors = vectors[np.isfinite(vectors).all(axis=1)]
    if not len(vectors):
        return np.zeros((1, vectors.shape[1]))
    rng = np.random.default_rng(seed)
    chosen, far = [int(rng.integers(len(vectors)))], np.full(len(vectors), np.inf)
    while len(chosen) < lists:
        far = np.minimum(far, ((vectors - vectors[chosen[-1]]) ** 2).sum(axis=1))
        if far.max() < 1e-12:
            break
        chosen.append(int(rng.choice(len(vectors), p=far / far.sum())))
    centroids = vectors[chosen]
    for _ in range(rounds):
        at = nearest_list(vectors, centroids, L2)
        sums = np.stack([np.bincount(at, vectors[:, d], len(centroids)) for d in range(vectors.shape[1])], axis=1)
        counts = np.bincount(at, minlength=len(centroids))
        means = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
        if metric != L2:
            means = np.where(np.linalg.norm(means, axis=1, keepdims=True) > 0, unit(means), centroids)
        if np.array_equal(means, centroids):
            break
        centroids = means
    return centroids


def unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(size == 0, 1, size)


def farness(vectors: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    """A matrix that orders lists for each vector, the nearest least."""
    if metric == L2:
        return (centroids**2).sum(axis=1) - 2 * vectors @ centroids.T
    return -(vectors @ unit(centroids).T)


def nearest_list(vectors: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    """The list of each vector: the nearest centroid, the first of equals."""
    return np.concatenate([np.zeros(0, np.int64), *(farness(vectors[x : x + 4096], centroids, metric).argmin(axis=1) for x in range(0, len(vectors), 4096))])


def list_of(vector: Column, centroids: np.ndarray, metric: str) -> Column:
    """The list of a vector."""
    ship()

    @F.arrow_udf("int")
    def lists(column: pa.Array) -> pa.Array:
        return pa.array(nearest_list(blocks.Vectors.of(column, centroids.shape[1], "f64").values, centroids, metric), pa.int32())

    return lists(vector)


def order_of(query: Sequence[float], centroids: np.ndarray, metric: str) -> list[int]:
    """All lists, nearest first."""
    q = np.array(query, float)
    if metric == L2:
        far = np.linalg.norm(centroids - q, axis=1)
    else:
        far = -(centroids @ q) / np.maximum(np.linalg.norm(centroids, axis=1), 1e-12)
    return np.argsort(far, kind="stable").tolist()


def probed(query: Sequence[float], centroids: np.ndarray, metric: str, probes: int) -> list[int]:
    return order_of(query, centroids, metric)[:probes]


def search_many(indexed: DataFrame, queries: DataFrame, centroids: np.ndarray, metric: str, k: int, probes: int, precision: str = "f32") -> DataFrame:
    """The best `k` for every row of `queries(query_id, query_vector)`, in the lists nearest to it; `indexed` has the column `list`."""

    def probing(vectors: np.ndarray) -> np.ndarray:
        out = np.zeros((len(vectors), len(centroids)), bool)
        near = np.argsort(farness(vectors, centroids, metric), axis=1, kind="stable")[:, :probes]
        np.put_along_axis(out, near, True, axis=1)
        return out

    return ranking.nearest(queries, indexed, metric, k, precision, probing=probing)


def calibrated(indexed: DataFrame, centroids: np.ndarray, metric: str, k: int = 10) -> tuple[int, float, float]:
    """Probes for `RECALL`, the recall measured with them, and the share of vectors they read.

    The exact neighbours of `CHECK_QUERIES` vectors are found once, with their lists;
    what is collected is `CHECK_QUERIES * k` rows and the sizes of the lists.
    """
    asked = sampled(indexed, CHECK_QUERIES, 2).select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    truth = ranking.nearest(asked, indexed, metric, k).select("query_id", "id")
    rows = truth.join(indexed.select("id", "list"), "id").collect()
    vectors = {r["query_id"]: r["query_vector"] for r in asked.collect()}
    sizes = np.zeros(len(centroids))
    for r in indexed.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    place = {i: {at: p for p, at in enumerate(order_of(v, centroids, metric))} for i, v in vectors.items()}
    depths = np.sort([place[r["query_id"]][r["list"]] for r in rows])
    probes = int(depths[math.ceil(RECALL * len(depths)) - 1]) + 1
    read = np.mean([sizes[[at for at, p in order.items() if p < probes]].sum() for order in place.values()]) / max(sizes.sum(), 1)
    return probes, float((depths < probes).mean()), float(read)


def build(unit: DataFrame, path: str, metric: str, dimensions: int, flat_rows: int = FLAT_ROWS) -> Index:
    """Index the rows of one unit under `path`; nothing is written for a raw unit."""
    visible = mvcc.live(unit).select("id", "seq_no", "vector", "metadata", M.norm(F.col("vector")).alias("norm"))
    rows = visible.count()
    if rows <= flat_rows:
        visible.withColumn("list", F.lit(0)).write.partitionBy("list").parquet(path)
        return Index(FLAT, [[0.0] * dimensions], 1, 1.0, 1.0)
    lists = min(MOST_LISTS, max(4, round(math.sqrt(rows) / 2)))
    centroids = fit(visible, lists, metric)
    placed = visible.withColumn("list", list_of(F.col("vector"), centroids, metric))
    placed.repartition("list", F.pmod(F.xxhash64("id"), F.lit(max(1, rows // 1_000_000)))).write.partitionBy("list").parquet(path)
    probes, recall, read = calibrated(unit.sparkSession.read.parquet(path), centroids, metric)
    return Index(IVF if read <= MOST_READ else RAW, centroids.tolist(), probes, recall, read)


def candidates(lists: DataFrame, vector: Sequence[float], metric: str, budget: int, precision: str = "f32", filter_by: Column | None = None) -> DataFrame:
    """As `ranking.unit_candidates`, from the lists of indexes that a query reads."""
    if filter_by is not None:
        lists = lists.where(filter_by)
    return ranking.best_of_units(ranking.scored(lists, vector, metric, precision), metric, budget)
