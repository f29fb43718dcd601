"""SimHash near-duplicates: exact Hamming neighbours from sharded BK-trees.

A text's fingerprint has a bit set where over half of its shingle hashes have
it.  Two fingerprints are linked at `radius` or fewer differing bits, and a
component is what links reach.

Search.  Cut 64 bits into `radius + 1` or more blocks: two linked fingerprints
agree in enough whole blocks, so each fingerprint joins one shard for every
choice of blocks that may agree.  A shard's BK-tree (children keyed by their
integer Hamming distance to the parent) is built by the task that owns the
shard; a query follows only the edges within the radius of its distance to a
node.  Broadcasting the trees of all shards would send the whole index
everywhere, and that grows with the corpus: trees meet their queries by a
shuffle of 16 bytes a fingerprint instead.

Skew.  Copies collapse to one fingerprint before the search.  A shard with over
`shard_rows` fingerprints is cut into parts, and the tree of a part is sent to
the queries of every other part of that shard only.  A task reports a spanning
forest of the links it finds, never all pairs.

Similar texts (`keep_one_similar`).  Texts whose sets of shingles have a similarity
of `least` differ in some 15 % of the bits of a fingerprint, which no choice of few
blocks survives, and 64 bits are too few to tell them from others.  So fingerprints
have 128 bits there, a shard holds those that agree in one of many short runs of
bits, as many runs as a pair at the expected distance needs to meet with a
probability of `MEET`, and links within the radius are candidates only: the links of
each shard's closest spanning forest are checked against the whole texts.
What that leaves out is found by an exact search: sets of shingles in different groups
that share a shingle of their prefixes, the rarest fifth or so in one order, are
checked as well.  So groups are those that all pairs give.

Nulls and empty texts have fingerprint zero and are linked like any other; texts of
any length are read whole.  Repeated rows are returned as often as they come.  An
empty table gives no rows.  A null doc_id never becomes a component's id unless all
its ids are null.  Of a component the least id stays, null ids last, and of rows with
equal ids the one with the least key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.llm.common import components, discard, durable, nothing_held, python_udf, row_key, sorted_groups, whole_row
from quillvec.llm.ship import ship

SEED = 42
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of `text`, as an unsigned integer."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) < shingle:
        grams = iter([b" ".join(found)])
        n = 1
    else:
        n = len(found) - shingle + 1
        grams = map(b" ".join, zip(*(found[k:] for k in range(shingle))))
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        size = min(BLOCK, n - at)
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED, size)) if n > BLOCK else map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, size)
        ones += np.unpackbits(h.view(np.uint8).reshape(size, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column, shingle: int = 4) -> Column:
    """The fingerprint as a signed long."""

    @python_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        nothing_held()
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return of(text)


class BKTree:
    """A BK-tree over distinct values, searched in batches."""

    def __init__(self, values: np.ndarray):
        """`values`: 64-bit words, one or several a value (then with two dimensions)."""
        self.values = values.reshape(len(values), -1)
        plain = [sum(w << 64 * k for k, w in enumerate(v)) for v in self.values.tolist()]
        children: list[dict[int, int]] = [{} for _ in plain]
        for k in range(1, len(plain)):
            at, x = 0, plain[k]
            while True:
                d = (plain[at] ^ x).bit_count()
                below = children[at].get(d)
                if below is None:
                    children[at][d] = k
                    break
                at = below
        sizes = np.fromiter(map(len, children), np.int64, len(children))
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.edge = np.fromiter((d for c in children for d in c), np.int64, int(sizes.sum()))
        self.child = np.fromiter((k for c in children for k in c.values()), np.int64, int(sizes.sum()))

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices (query, node) of all pairs within `radius`, and their distances."""
        queries = queries.reshape(len(queries), -1)
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        hits = []
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.values[node]).sum(axis=1, dtype=np.int64)
            close = d <= radius
            hits.append((q[close], node[close], d[close]))
            fan = self.first[node + 1] - self.first[node]
            up = np.repeat(np.arange(len(q)), fan)
            slot = np.arange(len(up)) - np.repeat(np.cumsum(fan) - fan, fan) + self.first[node[up]]
            keep = np.abs(self.edge[slot] - d[up]) <= radius
            q, node = q[up[keep]], self.child[slot[keep]]
        return tuple(np.concatenate([h[k] for h in hits]) for k in range(3))


def forest(trees: np.ndarray, queries: np.ndarray | None, radius: int, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest among `trees`, or between it and `queries`, close ones before others.

    Pairs of indices; those of `queries` count on from those of `trees`.
    """
    tree = BKTree(trees)
    asked, shift = (trees, 0) if queries is None else (queries, len(trees))
    up = np.arange(len(trees) + (0 if queries is None else len(queries)))
    out = []

    def roots(x: np.ndarray) -> np.ndarray:
        while True:
            y = up[x]
            if (y == x).all():
                return x
            x = y

    for at in range(0, len(asked), step):
        q, node, d = tree.near(asked[at : at + step], radius)
        q = q + at + shift
        a, b = roots(q), roots(node)
        order = np.flatnonzero(a != b)
        order = order[np.argsort(d[order], kind="stable")]
        _, first = np.unique(np.minimum(a, b)[order] * len(up) + np.maximum(a, b)[order], return_index=True)
        for k in order[np.sort(first)].tolist():
            x, y = int(a[k]), int(b[k])
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((int(q[k]), int(node[k])))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def shard_masks(n: int, radius: int, target: int = 128) -> list[int]:
    """Bit masks of which linked values agree on at least one in whole.

    Cuts 64 bits into `radius + j` blocks and takes every choice of `j`; `j`
    grows with the number of values so that a shard of evenly spread values
    stays near `target`.
    """
    j = 1
    while n >> (64 * j // (radius + j)) > target and j < 8:
        j += 1
    cuts = np.linspace(0, 64, radius + j + 1).astype(int).tolist()
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(blocks, j)]


def shards(keyed: DataFrame, shard_rows: int) -> DataFrame:
    """Rows of `keyed(part, ...)` for the tasks that search: `i` and `j` number the parts that a large shard is cut into.

    A task has the rows of part i, and of part j those that ask (none if they are the same).
    Rows alone in their shard are left out.
    """
    rest = [c for c in keyed.columns if c != "part"]
    size = keyed.groupBy("part").count().where("count > 1")
    parted = keyed.join(size, "part").withColumn("n", F.ceil(F.col("count") / shard_rows)).drop("count")
    own = F.pmod(F.xxhash64(*rest), F.col("n"))
    spread = parted.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    dealt = spread.select("part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("asks"), *rest)
    keys = ["part", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys)


def searching(values: list[str], names: str, radius: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Searches shards, and yields the links of their forests between the entries of column `names`."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in sorted_groups(batches, ["part", "i", "j"]):
            fp = np.stack([group[c].to_numpy(np.int64).view(np.uint64) for c in values], 1)
            name, asks = group[names].to_numpy(np.int64), group["asks"].to_numpy(bool)
            if group["i"].iloc[0] == group["j"].iloc[0]:
                a, b = forest(fp, None, radius)
            elif asks.any() and not asks.all():
                a, b = forest(fp[~asks], fp[asks], radius)
                name = np.concatenate([name[~asks], name[asks]])
            else:
                continue
            if len(a):
                yield pd.DataFrame({"a": name[a], "b": name[b]})

    return search


def links(values: DataFrame, radius: int = 4, shard_rows: int = 4096) -> DataFrame:
    """Rows `(a, b)` whose components are those of all links among `values(fp)`, distinct longs."""
    ship(values.sparkSession)
    masks = shard_masks(values.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    each = values.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("mask", "bits"))
    keyed = each.select(F.xxhash64("mask", "bits").alias("part"), "fp")  # shards whose hashes meet are searched as one
    return shards(keyed, shard_rows).mapInPandas(searching(["fp"], "fp", radius), "a long, b long")


def groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """Documents as `(id, row, fp)`, and fingerprints as `(fp, component_id, keeper)`; keeper is the row with the least id."""
    marked = durable(docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row"), fingerprint_column(F.col(text_col), shingle).alias("fp")))
    first = F.struct(F.col("id").isNull().alias("unnamed"), "id", "row")
    values = durable(marked.groupBy("fp").agg(F.min("id").alias("least"), F.min(first).alias("first")))
    found = components(links(values.select("fp"), radius, shard_rows))
    rooted = values.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
    return marked, rooted.select("fp", "root").join(ids, "root").select("fp", "component_id", F.col("first.row").alias("keeper"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, shard_rows: int = 4096) -> DataFrame:
    """One row a document: `(id_col, fp, component_id)`; component_id is the least id reachable."""
    marked, named = groups(docs, id_col, text_col, shingle, radius, shard_rows)
    return marked.join(named.drop("keeper"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def only(docs: DataFrame, keepers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` whose key is in `keepers(row)`, of equal rows one."""
    keyed = docs.select(whole_row(docs), row_key(id_col, text_col).alias("row"))
    return keyed.join(keepers, "row", "left_semi").dropDuplicates(["row"]).select("doc.*")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, shard_rows: int = 4096) -> DataFrame:
    """`docs` with one document of each component: the one with the least id, null ids last, and of equal rows one."""
    _, named = groups(docs, id_col, text_col, shingle, radius, shard_rows)
    return only(docs, named.select(F.col("keeper").alias("row")).distinct(), id_col, text_col)


# --- similar texts ------------------------------------------------------------------------

#: Probability that a pair at the expected distance meets in a shard; rows that a shard is to have.
MEET, SHARD = 0.95, 256
WIDE = 128
#: Documents whose shingles are counted, and how many of the most common are told apart.
SAMPLE, COMMON = 2000, 20_000
#: For products that are whole numbers but for rounding.
SLACK = 1e-6


def shingles(text: str | None, size: int) -> list[bytes]:
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(found) < size:
        return [b" ".join(found)] if found else []
    return list(map(b" ".join, zip(*(found[k:] for k in range(size)))))


def digests(grams: list[bytes]) -> np.ndarray:
    """128 bits of each distinct shingle, as rows of bytes."""
    distinct = list(set(grams))
    return np.frombuffer(b"".join(map(xxhash.xxh128_digest, distinct)), np.uint8).reshape(-1, WIDE // 8)


def hashes(found: np.ndarray) -> np.ndarray:
    """64 bits of each digest, ascending."""
    return np.unique(found.view(np.int64)[:, 0]) if len(found) else np.zeros(0, np.int64)


def majority(found: np.ndarray) -> tuple[int, int]:
    """The bits set in over half of the digests, as two signed words."""
    ones = np.zeros(WIDE, np.int64)
    for at in range(0, len(found), BLOCK):
        ones += np.unpackbits(found[at : at + BLOCK], axis=1).sum(axis=0, dtype=np.int64)
    return tuple(np.packbits(2 * ones > len(found)).view(np.int64).tolist())


def wide_fingerprint(text: str | None, size: int) -> tuple[int, int]:
    """A SimHash of 128 bits over the set of shingles, as two signed words."""
    return majority(digests(shingles(text, size)))


def described(text: str | None, size: int, least: float, names: np.ndarray, often: np.ndarray) -> tuple[int, int, int, int, np.ndarray, np.ndarray]:
    """The fingerprint of `text`, a hash of its set of shingles, their number, the prefix of them that texts of similarity `least` share one of, and parities.

    Parities are of the numbers of shingles in classes, a power of two of them, 64 to a word; those of two sets differ in at
    most as many as the sets do.
    Shingles of `names` (ascending, not empty) come last, by how `often` they occur; all else is ordered by hash.
    """
    found = digests(shingles(text, size))
    grams = hashes(found)
    n = len(grams)
    prefix = grams[: n - math.ceil(least * n - SLACK) + 1]
    if n and len(names):
        at = np.minimum(np.searchsorted(names, grams), len(names) - 1)
        rank = np.where(names[at] == grams, often[at], 0)
        prefix = grams[np.argsort(rank, kind="stable")[: len(prefix)]]
    classes = max(64, 1 << (2 * n - 1).bit_length()) if n else 64
    parity = np.packbits(np.bincount(grams & (classes - 1), minlength=classes).astype(np.uint8) & 1).view(np.int64)
    return *majority(found), xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63), n, prefix, parity


def distance_of(least: float) -> float:
    """The bits in which fingerprints of texts with similarity `least` are expected to differ."""
    return WIDE * math.acos(2 * least / (1 + least)) / math.pi


def runs(n: int, least: float) -> list[tuple[int, int]]:
    """Masks, as two signed words each, of runs of bits in several orders of them.

    A run is as long as makes shards of about `SHARD` of n values, and there are so
    many that pairs at the expected distance agree on one with probability `MEET`.
    """
    length = max(1, min(24, round(math.log2(max(2, n / SHARD)))))
    apart = round(distance_of(least))
    agree = math.prod((WIDE - apart - k) / (WIDE - k) for k in range(length))
    wanted = math.ceil(math.log(1 - MEET) / math.log(1 - agree))
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    out = []
    for step in range(1, WIDE, 2):  # odd steps go through all bits
        for first in range(0, WIDE - length + 1, length):
            mask = sum(1 << (at * step % WIDE) for at in range(first, first + length))
            out.append((signed(mask >> 64), signed(mask & (1 << 64) - 1)))
            if len(out) == wanted:
                return out
    return out


def common_grams(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> dict[int, int]:
    """How often the most common shingles (hashes) occur in a bounded sample; it orders prefixes and decides no link."""

    @python_udf("array<long>")
    def grams(texts: pd.Series) -> pd.Series:
        return pd.Series([hashes(digests(shingles(t, shingle))) for t in texts], dtype=object)

    every = max(1, docs.count() // SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(every)) == 0).select(grams(F.col(text_col)).alias("h"))
    counts = sample.select(F.explode_outer("h").alias("h")).where("h is not null").groupBy("h").count().where("count > 2")
    return {r["h"]: r["count"] for r in counts.orderBy(F.desc("count"), "h").limit(COMMON).collect()}


def checked(docs: DataFrame, nodes: DataFrame, found: DataFrame, id_col: str, text_col: str, shingle: int, least: float) -> DataFrame:
    """The pairs of `found(a, b)` whose whole texts have the similarity."""

    @python_udf("array<long>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([hashes(digests(shingles(t, shingle))) for t in texts], dtype=object)

    ends = found.select("a").union(found.select("b")).distinct().withColumnRenamed("a", "node")
    rows = durable(nodes.join(ends, "node").select("node", F.col("first.row").alias("row")))
    texts = docs.select(row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text")).join(rows, "row")
    known = durable(texts.dropDuplicates(["node"]).select("node", sets(F.col("text")).alias("grams")))
    pairs = found.join(known.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(known.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    out = durable(pairs.where(both + SLACK >= least * (F.size("x") + F.size("y") - both)).select("a", "b"))
    discard(rows, known)
    return out


def prefix_pairs(rooted: DataFrame, least: float) -> DataFrame:
    """Pairs `(a, b)` of `rooted(node, root, n, prefix, parity)` with different roots, among them all of similarity `least`.

    Sets as similar as that share one of the first `n - ceil(least * n) + 1` shingles of
    each in any one order, and sizes and the places of the first one shared bound what they can share, and parities
    bound by how much they differ.
    """
    each = rooted.select("node", "root", "n", F.posexplode_outer("prefix").alias("at", "h")).where("h is not null")
    shared = durable(each.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("h"))
    met = durable(each.join(shared, "h"))
    x, y = (met.select("h", *[F.col(c).alias(f"{side}_{c}") for c in ("node", "root", "n", "at")]) for side in "xy")
    sizes = F.least("x_n", "y_n") + SLACK >= least * F.greatest("x_n", "y_n")
    places = (1 + least) * F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at")) + SLACK >= least * (F.col("x_n") + F.col("y_n"))
    pairs = x.join(y, "h").where((F.col("x_node") < F.col("y_node")) & (F.col("x_root") != F.col("y_root")) & sizes & places)
    met_pairs = durable(pairs.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct())
    a, b = (rooted.select(F.col("node").alias(side), F.struct("n", "parity").alias(f"of_{side}")) for side in "ab")
    size = F.least(F.size("of_a.parity"), F.size("of_b.parity"))  # the longer is folded; sizes this near differ by a factor of two at most
    word = lambda side, k: F.coalesce(F.get(F.col(f"of_{side}.parity"), k), F.lit(0).cast("long")).bitwiseXOR(F.coalesce(F.get(F.col(f"of_{side}.parity"), k + size), F.lit(0).cast("long")))
    apart = F.aggregate(F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.bit_count(word("a", k).bitwiseXOR(word("b", k)))), F.lit(0), lambda s, x: s + x)
    bounded = met_pairs.join(a, "a").join(b, "b").where((1 + least) * apart <= (1 - least) * (F.col("of_a.n") + F.col("of_b.n")) + SLACK)
    out = durable(bounded.select("a", "b"))
    discard(shared, met, met_pairs)
    return out


def similar(docs: DataFrame, id_col: str, text_col: str, shingle: int, least: float, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """Distinct sets of shingles `(node, ..., first)`, `first` their row with the least id, and `(node, root)` of those with a link."""
    common = common_grams(docs, id_col, text_col, shingle)
    names = np.array(sorted(common), np.int64)
    often = np.array([common[h] for h in names.tolist()], np.int64)

    @python_udf("struct<a: long, b: long, whole: long, n: int, prefix: array<long>, parity: array<long>>")
    def prints(texts: pd.Series) -> pd.DataFrame:
        nothing_held()
        return pd.DataFrame([described(t, shingle, least, names, often) for t in texts], columns=["a", "b", "whole", "n", "prefix", "parity"])

    marked = durable(docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row"), prints(F.col(text_col)).alias("p")).select("id", "row", "p.*"))
    first = F.struct(F.col("id").isNull().alias("unnamed"), "id", "row")
    grouped = marked.groupBy("a", "b", "whole", "n").agg(F.min(first).alias("first"), F.first("prefix").alias("prefix"), F.first("parity").alias("parity"))
    nodes = durable(grouped.select(F.monotonically_increasing_id().alias("node"), "a", "b", "n", "prefix", "parity", "first"))
    discard(marked)
    radius = int(distance_of(least) + 1.5 * math.sqrt(distance_of(least) * (1 - distance_of(least) / WIDE)))
    masks = F.array(*[F.struct(F.col("a").bitwiseAND(F.lit(x)).alias("a"), F.col("b").bitwiseAND(F.lit(y)).alias("b")) for x, y in runs(nodes.count(), least)])
    keyed = nodes.select("node", "a", "b", F.posexplode(masks).alias("mask", "bits")).select(F.xxhash64("mask", "bits").alias("part"), "node", "a", "b")
    found = shards(keyed, shard_rows).mapInPandas(searching(["a", "b"], "node", radius), "a long, b long")
    found = durable(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = checked(docs, nodes, found, id_col, text_col, shingle, least)
    rooted = nodes.select("node", "n", "prefix", "parity").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = prefix_pairs(rooted, least)
    if rest.isEmpty():
        return nodes, components(links)
    return nodes, components(links.union(checked(docs, nodes, rest, id_col, text_col, shingle, least)))


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, shard_rows: int = 4096) -> DataFrame:
    """`docs` with one document of each group of texts whose sets of shingles have a similarity of `least` or more."""
    ship(docs.sparkSession)
    nodes, found = similar(docs, id_col, text_col, shingle, least, shard_rows)
    rooted = nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keepers = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return only(docs, keepers, id_col, text_col)
