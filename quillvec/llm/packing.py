"""Conflict-constrained best-fit packing of documents into bins of `capacity` words, or tokens.

Documents longer than a bin are cut into pieces of exactly `capacity`, each
a bin of its own, and a rest.  Pieces go, longest first, into the fullest bin that
still has room and holds no document of the same source and none of the same
cluster of duplicates.  Bins are ordered by what room they have left, and each
carries a bitmap of its sources and one of its clusters; the search starts at the
least sufficient room and goes on to the next until a bin is compatible, so the
tightest compatible bin is found.  If there is none, a new bin is opened.

Sources and clusters get bit numbers within a shard.  For every room left, the
search also knows how many bins there are and how many hold each source, and skips
a level where all of them do.

Scale: pieces are dealt to shards by a hash of document and piece; a shard has
about `shard_rows` pieces however large the corpus or a single source is, and is
packed by one task.  Only ids, places and lengths are shuffled, never text.  Bins
of different shards never mix, which costs at most one poorly filled end a shard.

Documents without a word (or token) are left out of bins.  Among pieces of one length
the lesser id goes first, then the lesser key of the row and the piece; among
compatible bins of one room the older one is taken.  Null sources are one source, and
a null cluster conflicts with nothing.  Clusters are exact copies, whatever the case
and spacing, unless `clusters` names others, such as `near_copies`.  Rows equal in id and text are separate
pieces, kept apart by their cluster.  An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.llm import simhash
from quillvec.llm.common import SPACE, durable, sorted_groups, text_or_empty, words
from quillvec.llm.ship import ship


class Packer:
    """Bins of one shard."""

    def __init__(self, capacity: int, n_sources: int):
        self.capacity = capacity
        self.rooms: list[int] = []  # rooms left of which there is a bin, ascending
        self.at: dict[int, dict[int, None]] = {}  # bins by room left, oldest first
        self.with_source: dict[int, list[int]] = {}
        self.room: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.n_sources = n_sources

    def place(self, length: int, source: int, cluster: int) -> int:
        """The bin for a piece; `cluster`: its bit, or 0 for none."""
        found = self.search(length, 1 << source, cluster)
        if found is None:
            found = len(self.room)
            self.room.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            self.leave(found)
        self.room[found] -= length
        self.sources[found] |= 1 << source
        self.clusters[found] |= cluster
        self.enter(found)
        return found

    def search(self, length: int, source: int, cluster: int) -> int | None:
        number = source.bit_length() - 1
        for k in range(bisect_left(self.rooms, length), len(self.rooms)):
            level = self.at[self.rooms[k]]
            if self.with_source[self.rooms[k]][number] == len(level):
                continue
            for b in level:
                if not self.sources[b] & source and not self.clusters[b] & cluster:
                    return b
        return None

    def enter(self, b: int) -> None:
        room = self.room[b]
        if room == 0:
            return
        if room not in self.at:
            insort(self.rooms, room)
            self.at[room], self.with_source[room] = {}, [0] * self.n_sources
        self.at[room][b] = None
        self.count(room, self.sources[b], 1)

    def leave(self, b: int) -> None:
        room = self.room[b]
        del self.at[room][b]
        self.count(room, self.sources[b], -1)
        if not self.at[room]:
            del self.at[room], self.with_source[room]
            self.rooms.pop(bisect_left(self.rooms, room))

    def count(self, room: int, sources: int, by: int) -> None:
        of = self.with_source[room]
        while sources:
            low = sources & -sources
            of[low.bit_length() - 1] += by
            sources ^= low


def pack_shard(lengths: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece, in the order given (longest first)."""
    _, source = np.unique(sources, return_inverse=True)
    _, cluster, often = np.unique(clusters, return_inverse=True, return_counts=True)
    shared = np.cumsum(often > 1) - 1  # only clusters met again need a bit
    packer = Packer(capacity, int(source.max(initial=0)) + 1)
    return np.array([packer.place(n, s, 1 << int(shared[c]) if often[c] > 1 else 0) for n, s, c in zip(lengths.tolist(), source.tolist(), cluster.tolist())], np.int64)


def cluster_of(text: Column) -> Column:
    """The cluster of documents with the same words, whatever the case and spacing."""
    return F.xxhash64(F.regexp_replace(F.trim(F.lower(text_or_empty(text))), f"[{SPACE}]+", " "))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Clusters `(row, cluster)` of near copies, which hold those of exact copies: SimHash components over lower-cased texts."""
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("id"), F.lower(F.col(text_col)).alias("text"))
    marked, named = simhash.groups(rows, "id", "text", 4, 4, 4096)
    return marked.join(named, "fp").groupBy(F.col("id").alias("row")).agg(F.min("component_id").alias("cluster"))


def pack(docs: DataFrame, capacity: int = 2048, shard_rows: int = 8192, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None, clusters: DataFrame | None = None, size: Column | None = None, unit: str = "words") -> DataFrame:
    """Rows `(bin, place, id_col, piece, start, n_<unit>)`: words (or what `size` counts) start .. start + n of a document.

    `bin` is shard * 2**32 + number; `place` counts the pieces of a bin.  `clusters(row, cluster)`,
    one row each, goes before `cluster`.
    """
    ship(docs.sparkSession)
    cluster = cluster_of(F.col(text_col)) if cluster is None else cluster
    sized = docs.select(
        F.col(id_col).alias("id"), (F.size(words(F.col(text_col))) if size is None else size).cast("int").alias("n"), F.coalesce(F.xxhash64(F.col(source_col)), F.lit(0)).alias("source"), cluster.alias("cluster"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"),
    )
    # texts are read once: a filter or an inner explode of what is counted would count it a second time
    sized = durable(sized).where("n > 0")
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int"))))
    pieces = pieces.withColumn("length", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity)).drop("n")
    if clusters is not None:
        named = clusters.select(F.col("row").alias("named_row"), F.col("cluster").alias("named"))
        pieces = pieces.join(named, F.col("row") == F.col("named_row"), "left").withColumn("cluster", F.coalesce("named", "cluster")).drop("named_row", "named")
    shards = max(1, -(-pieces.count() // shard_rows))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))
    pieces = pieces.withColumn("cluster", F.when(F.col("length") < capacity, F.coalesce("cluster", F.xxhash64("row", "piece"))).otherwise(F.xxhash64("row", "piece")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in sorted_groups(batches, ["shard"]):
            bins = pack_shard(*(x[c].to_numpy(np.int64) for c in ("length", "source", "cluster")), capacity)
            place = pd.Series(bins).groupby(bins).cumcount().to_numpy()
            number = x["shard"].to_numpy(np.int64) * (1 << 32) + bins
            yield pd.DataFrame({"bin": number, "place": place, "id": x["id"].to_numpy(), "piece": x["piece"].to_numpy(), "start": x["piece"].to_numpy(np.int64) * capacity, "n_words": x["length"].to_numpy()})

    kind = docs.schema[id_col].dataType.simpleString()
    columns = pieces.select("shard", "id", "row", "piece", "length", "source", "cluster")
    named = F.col("id").cast("string").alias("id")  # pandas has no whole numbers with nulls
    dealt = columns.repartition(max(1, min(shards, 1 << 16)), "shard").sortWithinPartitions("shard", F.desc("length"), "id", "row", "piece")
    packed = dealt.select("shard", named, "piece", "length", "source", "cluster").mapInPandas(run, "bin long, place long, id string, piece int, start long, n_words int")
    return packed.select("bin", "place", F.col("id").cast(kind).alias(id_col), "piece", "start", F.col("n_words").alias(f"n_{unit}"))
