"""Many queries against blocks of records in numpy: the same values and order as the Columns of `metric`.

A matrix product in double precision finds which records may be among the best of a
query, with a margin over its rounding; those are scored again, folded from left to
right in the precision asked for, as `metric` does, so equal vectors have equal values.
What the product can't order (nulls, NaN, very large and very small vectors) is always
scored again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillvec.model import COSINE, DOT, L2

#: Records and bytes of vectors in a block, and scores and pairs in memory at a time.
BLOCK_ROWS, BLOCK_BYTES, SCORES, PAIRS = 1 << 15, 32 << 20, 1 << 21, 1 << 21
KINDS = {"f32": np.float32, "f64": np.float64}


@dataclass
class Vectors:
    """Vectors of one length; those that are null, of another length or with nulls inside are not `known`."""

    values: np.ndarray
    known: np.ndarray

    @classmethod
    def of(cls, column: pa.Array | pa.ChunkedArray, dimensions: int, precision: str) -> Vectors:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        known = np.array(pc.fill_null(pc.equal(pc.list_value_length(column), dimensions), False))
        inside = (column if known.all() else column.filter(pa.array(known))).flatten()
        shape = int(known.sum()), dimensions
        numbers = inside.to_numpy(zero_copy_only=False).reshape(shape)
        if inside.null_count:
            holes = np.asarray(inside.is_null()).reshape(shape).any(axis=1)
            known[np.flatnonzero(known)[holes]] = False
            numbers = numbers[~holes]
        values = np.zeros((len(known), dimensions), KINDS[precision])
        with np.errstate(over="ignore"):
            values[known] = numbers
        return cls(values, known)

    def __getitem__(self, chosen) -> Vectors:
        return Vectors(self.values[chosen], self.known[chosen])

    def __len__(self) -> int:
        return len(self.known)

    def norms(self) -> np.ndarray:
        out = np.zeros(len(self), self.values.dtype)
        step = max(1, PAIRS // max(1, self.values.shape[1]))
        with np.errstate(all="ignore"):
            for low in range(0, len(self), step):
                part = self.values[low : low + step]
                out[low : low + step] = np.sqrt(folded(part * part).astype(np.float64))
        return out


def folded(products: np.ndarray) -> np.ndarray:
    """Sums of rows, from left to right, in the products' own precision."""
    if not products.shape[1]:
        return np.zeros(len(products), products.dtype)
    return np.add.accumulate(products, axis=1)[:, -1] + products.dtype.type(0)


def values(metric: str, a: Vectors, b: Vectors, norms_a: np.ndarray, norms_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`metric.value` of pairs of rows, and which of them are null."""
    null = ~(a.known & b.known)
    kind = a.values.dtype.type
    with np.errstate(all="ignore"):
        if metric == L2:
            apart = a.values - b.values
            return np.sqrt(folded(apart * apart).astype(np.float64)).astype(kind), null
        dots = folded(a.values * b.values)
        if metric == DOT:
            return dots, null
        zero = (a.known & (norms_a == 0)) | (b.known & (norms_b == 0))
        cosines = (dots.astype(np.float64) / (norms_a * norms_b).astype(np.float64)).astype(kind)
        return np.where(zero, kind(0), cosines), null & ~zero


def odd(vectors: Vectors) -> np.ndarray:
    """What a product in double precision can't be trusted to order."""
    with np.errstate(all="ignore"):
        size = np.abs(vectors.values.astype(np.float64)).max(axis=1, initial=0.0)
    return ~vectors.known | ~((size == 0) | ((size > 1e-12) & (size < 1e12)))


class Scorer:
    """A query set, ready to meet blocks of records."""

    def __init__(self, queries: Vectors, metric: str, k: int, block: int, probing: np.ndarray | None = None):
        self.queries, self.metric, self.k, self.block, self.probing = queries, metric, k, block, probing
        self.norms, self.odd = queries.norms(), odd(queries)
        self.plain = self.scaled(queries, self.odd)

    def scaled(self, vectors: Vectors, strange: np.ndarray) -> np.ndarray:
        out = np.where(strange[:, None], 0.0, vectors.values.astype(np.float64))
        if self.metric == COSINE:
            size = np.sqrt((out * out).sum(axis=1, keepdims=True))
            out /= np.where(size == 0, 1, size)
        return out

    def best(self, rows: Vectors, ranks: np.ndarray, lists: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query, row, value and whether it is null, of the best `k` rows of every query; `ranks` orders rows by their ids."""
        at = self.distinct(rows, ranks, lists)
        rows, ranks, lists = rows[at], ranks[at], None if lists is None else lists[at]
        strange, norms = odd(rows), rows.norms()
        plain = self.scaled(rows, strange)
        found = []
        for q, r in [(np.arange(len(self.queries)), np.arange(len(rows)))] if lists is None else [(np.flatnonzero(self.probing[:, x]), np.flatnonzero(lists == x)) for x in np.unique(lists)]:
            step = min(self.block, max(1, SCORES // max(1, len(r))))
            for low in range(0, len(q), step):
                found += self.of_cell(q[low : low + step], r, rows, plain, strange, norms, ranks)
        query, row, value, null = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, bool))
        kept = self.first(query, value, null, ranks[row]) if lists is not None else slice(None)
        return query[kept], at[row[kept]], value[kept], null[kept]

    def distinct(self, rows: Vectors, ranks: np.ndarray, lists: np.ndarray | None) -> np.ndarray:
        """Rows without those of which `k` equal vectors come first by id: they are among the best of no query."""
        vectors = np.ascontiguousarray(rows.values)
        if not vectors.shape[1] or len(rows) <= self.k:
            return np.arange(len(rows))
        _, group = np.unique(vectors.view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel(), return_inverse=True)
        keys = [ranks, group, rows.known, *([] if lists is None else [lists])]
        order = np.lexsort(keys)
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in keys[1:]], axis=0)
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        return np.sort(order[place < self.k])

    def of_cell(self, q: np.ndarray, r: np.ndarray, rows: Vectors, plain: np.ndarray, strange: np.ndarray, norms: np.ndarray, ranks: np.ndarray) -> list[tuple]:
        a, b = self.plain[q], plain[r]
        scores = a @ b.T
        eps, wide = np.finfo(rows.values.dtype).eps, 8 * (a.shape[1] + 8)
        if self.metric == L2:
            own, other = (a * a).sum(axis=1), (b * b).sum(axis=1)
            scores *= 2
            scores -= own[:, None]
            scores -= other
            slack = wide * np.finfo(np.float64).eps * (own + other.max(initial=0))
        elif self.metric == DOT:
            slack = wide * eps * np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1).max(initial=0)) + 1e-30
        else:
            slack = np.full(len(q), wide * eps)
        scores[:, strange[r]] = -np.inf
        if len(r) > self.k > 0:
            least = np.partition(scores, len(r) - self.k, axis=1)[:, len(r) - self.k]
            if self.metric == L2:
                slack = slack + wide * eps * np.abs(least) + 1e-30
            least = np.where(self.odd[q], -np.inf, least - slack)
            may = scores >= least[:, None]
        else:
            may = np.full(scores.shape, self.k > 0)
        del scores
        may[:, strange[r]] = self.k > 0
        out = []
        pairs_at, pairs_of = np.nonzero(may)
        bounds, counts = [0], may.sum(axis=1)
        for end, size in zip(np.cumsum(counts), counts):  # whole queries, some pairs at a time
            if end - bounds[-1] > max(PAIRS // max(1, a.shape[1]), size):
                bounds.append(end - size)
        for low, high in zip(bounds, [*bounds[1:], len(pairs_at)]):
            out.append(self.ranked(q[pairs_at[low:high]], r[pairs_of[low:high]], rows, norms, ranks))
        return out

    def ranked(self, query: np.ndarray, row: np.ndarray, rows: Vectors, norms: np.ndarray, ranks: np.ndarray) -> tuple:
        step = max(1, PAIRS // max(1, rows.values.shape[1]))
        parts = [values(self.metric, self.queries[query[x : x + step]], rows[row[x : x + step]], self.norms[query[x : x + step]], norms[row[x : x + step]]) for x in range(0, len(row), step)]
        value, null = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, rows.values.dtype), np.zeros(0, bool))
        kept = self.first(query, value, null, ranks[row])
        return query[kept], row[kept], value[kept], null[kept]

    def first(self, query: np.ndarray, value: np.ndarray, null: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Places of the best `k` of each query, in the order of `metric.order`: nulls are the least and NaN is the greatest."""
        up = 1 if self.metric == L2 else -1
        nan = np.isnan(value) & ~null
        kind = up * np.where(null, -1, np.where(nan, 1, 0))
        number = up * np.where(null | nan, 0, value)
        zero = np.where((value == 0) & np.signbit(value) & ~null, -up, 0)
        order = np.lexsort((rank, zero, number, kind, query))
        own = query[order]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        return order[place < self.k]


def matcher(query_ids: pa.Array, queries: Vectors, metric: str, k: int, precision: str, block: int, names: tuple[str, str, str], probing: np.ndarray | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For `mapInArrow` over `(id, vector[, list])`: the best `k` of each query in every block of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dimensions = queries.values.shape[1]
        rows = max(1024, min(BLOCK_ROWS, BLOCK_BYTES // max(1, 8 * dimensions)))
        scorer = Scorer(queries, metric, k, block, probing)
        for part in blocks(batches, rows):
            ids = part.column("id").combine_chunks()
            ranks = np.empty(len(ids), np.int64)
            ranks[np.asarray(pc.sort_indices(ids, null_placement="at_start"))] = np.arange(len(ids))
            lists = None if probing is None else np.asarray(part.column("list"))
            query, row, value, null = scorer.best(Vectors.of(part.column("vector"), dimensions, precision), ranks, lists)
            yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(query)), ids.take(pa.array(row)), pa.array(value, mask=null, from_pandas=False)], names=list(names))

    return run


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        while n >= rows:
            table = pa.Table.from_batches(held)
            yield table.slice(0, rows)
            held = table.slice(rows).to_batches()
            n -= rows
    if n:
        yield pa.Table.from_batches(held)
