"""Logical lines: physical lines, cut further after sentences and, if asked for, by content.

A passage pasted into running text seldom starts at a line break.  So a line also
ends after one of the characters `after` and a space: sentence marks, or letters,
which cut a sentence at the same words wherever it stands.  Wide sentence marks
need no space.  Lines compare by hashes of their words, lower-cased and joined by
single spaces; a line without a word is the beginning of the next.  A line's weight is its words,
or a tenth of its characters if that is more (scripts without spaces, long codes).
Offsets count code points of the original text.

A batch of texts is laid end to end and split at once in numpy: characters become
64-bit values, whose sums with powers of an odd base, taken between two places,
are the hashes of all lines.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillvec.llm.common import bind, discard, durable, nothing_held, python_udf, row_key, text_or_empty, whole_row

SENTENCES, PIECES = ".!?", ".!?sn"
#: Sentence marks of scripts without spaces.
WIDE = "。！？"
#: Characters that count as one word at least.
WORD_CHARS = 10
#: Code points that are split at a time.
SLAB = 1 << 17
#: Odd numbers: bases of two hashes, and multipliers that spread values over 64 bits.
BASE, SECOND = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
SPREAD, FINAL = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
KINDS = (np.uint64, np.uint64, np.int32, np.int32, np.int32)
#: Words before and after a line that may be told apart, too.
NEAR, FAR = 6, 12


class Lines(NamedTuple):
    """Lines of texts laid end to end; `first`: where a text's lines begin, and the total.

    `around`: 32-bit hashes of the `NEAR` and `FAR` words before a line, and of those after it; 0 where there are fewer.
    """

    first: np.ndarray
    hash: np.ndarray
    second: np.ndarray
    weight: np.ndarray
    end: np.ndarray
    around: np.ndarray

    def sizes(self) -> np.ndarray:
        """Code points of each line, so that their sums are the ends."""
        size = np.diff(self.end, prepend=0)
        begin = self.first[:-1][np.diff(self.first) > 0]
        size[begin] = self.end[begin]
        return size


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(SPREAD)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(FINAL)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def known_powers(base: int, n: int) -> np.ndarray:
    """The first `n` powers, kept up to the size of a slab."""
    if n > 2 * SLAB:
        return powers(base, n)
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = powers(base, max(n, min(SLAB + SLAB // 4, 2 * SLAB)))
    return _POWERS[base][:n]


class Sums:
    """Hashes of stretches of `values`, equal for equal stretches wherever they are."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * known_powers(base, n), out=self.sums[1:])
        self.back = known_powers(pow(base, -1, 1 << 64), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        whole = (self.sums[end] - self.sums[start]) * self.back[start]
        return mixed(whole + (end - start).astype(np.uint64))


def short(hashes: np.ndarray) -> np.ndarray:
    """32 bits of hashes, signed."""
    return (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)


def lower(text: str) -> str:
    """`text` in small letters, place by place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def split_slab(texts: list[str], after: str, second: bool = True) -> Lines:
    joined = "".join(texts)
    points = np.frombuffer(lower(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    n, sizes = len(points), np.array([len(t) for t in texts], np.int64)
    text_end = np.cumsum(sizes)
    space = (points == 32) | (points - np.uint32(9) < 5)
    cut = np.zeros(n, bool)
    cut[text_end[sizes > 0] - 1] = True
    begins = np.zeros(n + 1, bool)
    begins[text_end - sizes] = True
    cut |= points == 10
    if after:
        table = np.zeros(128, bool)
        table[[ord(c) for c in after]] = True
        cut[1:] |= (points[1:] == 32) & table[np.minimum(points[:-1], 127)] & (points[:-1] < 127) & ~begins[1:n]
        wide = points > 0x3000
        if wide.any():
            cut |= wide & np.isin(points, [ord(c) for c in WIDE])
    end = np.flatnonzero(cut) + 1
    start = np.concatenate([[0], end[:-1]]) if len(end) else end
    at = np.flatnonzero(~space)
    opens = np.ones(len(at), bool)
    opens[1:] = at[1:] != at[:-1] + 1
    seen = np.concatenate([[0], np.cumsum(~space, dtype=np.int32)])
    low, high = seen[start], seen[end]
    opens[low[low < high]] = True
    values = points[at].astype(np.uint64)
    values = mixed((values | opens.astype(np.uint64) << np.uint64(21)) + np.uint64(1))
    some = low < high
    low, high, end = low[some], high[some], end[some]
    words = np.add.reduceat(opens, low, dtype=np.int32) if len(low) else low
    weight = np.maximum(words, (high - low + words - 1) // WORD_CHARS)
    text = np.searchsorted(text_end, end, "left")
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    sums = Sums(values, BASE)
    hashes = sums.of(low, high)
    around = np.zeros((len(low), 0), np.int32)
    if second:
        word = np.append(np.flatnonzero(opens), len(at))
        begin, after_it = np.searchsorted(word, low), np.searchsorted(word, high)
        text_word = np.searchsorted(word, seen[np.append(text_end - sizes, n)])
        least, most = text_word[text], text_word[text + 1]
        around = np.zeros((len(low), 4), np.int32)
        for k, size in enumerate((NEAR, FAR)):
            near = np.flatnonzero(begin - size >= least)
            around[near, k] = short(sums.of(word[begin[near] - size], low[near]))
            near = np.flatnonzero(after_it + size <= most)
            around[near, 2 + k] = short(sums.of(high[near], word[after_it[near] + size]))
    return Lines(first, hashes, Sums(values, SECOND).of(low, high) if second else hashes, weight, end - (text_end - sizes)[text], around)


def split(texts: list[str], after: str = SENTENCES, second: bool = True) -> Lines:
    """The lines of all `texts`; without `second` the second hash is the first and nothing is known of what is `around`.

    Texts go through in slabs of about `SLAB` characters; a longer one is cut at line
    breaks, or after sentences, where lines end anyway.
    """
    whole: list[tuple[int, int, str]] = []  # text, offset, part
    for k, text in enumerate(texts):
        at = 0
        while len(text) - at > 2 * SLAB:
            window = text[at : at + SLAB]
            cut = window.rfind("\n") + 1 or max((window.rfind(m + " ") + 2 for m in after), default=1)
            if cut <= 1:
                break  # one line without an end
            whole.append((k, at, window[:cut]))
            at += cut
        whole.append((k, at, text[at:] if at else text))
    found, slab, size = [], [], 0
    counts = np.zeros(len(texts) + 1, np.int64)

    def flush() -> None:
        got = split_slab([p for _, _, p in slab], after, second)
        of = np.diff(got.first)
        np.add.at(counts, [k + 1 for k, _, _ in slab], of)
        shift = np.repeat(np.array([a for _, a, _ in slab], np.int64), of)
        found.append((*got[1:4], got.end + shift, got.around))

    for part in whole:
        slab.append(part)
        size += len(part[2])
        if size >= SLAB:
            flush()
            slab, size = [], 0
    if slab:
        flush()
    columns = [np.concatenate([f[c] for f in found]) if found else np.zeros((0, 4) if c == 4 else 0, np.int64) for c in range(5)]
    return Lines(np.cumsum(counts), *(x.astype(kind) for x, kind in zip(columns, KINDS)))


def listed(first: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    """`values` as one array for each text."""
    return np.split(values.view(np.int64) if values.dtype == np.uint64 else values, first[1:-1]) if len(first) > 1 else []


def arrays_column(text: Column, fields: str, of: Callable[[list[str]], dict[str, list[np.ndarray]]]) -> Column:
    """A struct of arrays, from `of` of a batch of texts."""

    @python_udf(f"struct<{fields}>")
    def column(texts: pd.Series) -> pd.DataFrame:
        nothing_held()
        return pd.DataFrame(of([t or "" for t in texts]))

    return column(text)


def numbered(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """`(id, row, n, ...)`; `n` tells rows apart, once this is written."""
    return docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row"), F.monotonically_increasing_id().alias("n"), *more)


#: Bits of a line's number within its document, in a place; the rest is its document's rank.
PLACE_BITS = 26


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """`(n, rank)` for rows numbered by `n`: ranks from 0 up by `order` and then `n`, without one task seeing all rows."""
    keys = [*order, "n"]
    dealt = durable(rows.select(*keys).repartitionByRange(*keys).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").count()
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*keys))
    out = durable(dealt.withColumn("own", own).join(F.broadcast(before), "part").select("n", (F.col("before") + F.col("own") - 1).alias("rank")))
    discard(dealt)
    return out


def one_each(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """`spans(n, ...)` with `id` and `row`; of rows equal in id and text the first counts."""
    first = lines.groupBy("row").agg(F.min("n").alias("n"))
    return spans.join(first, "n", "left_semi").join(lines.select("id", "row", "n"), "n")


def cut_out(text: Column, spans: Column) -> Column:
    """`text` without `spans`, ascending (start, end) pairs that do not touch."""
    text = text_or_empty(text)
    between = F.transform(spans, lambda x, k: F.struct(F.when(k == 0, 0).otherwise(F.get(spans, k - 1)["end"]).alias("from"), x["start"].alias("to")))
    kept = F.transform(between, lambda r: F.substring(text, r["from"] + 1, r["to"] - r["from"]))
    rest = F.substring(text, F.element_at(spans, -1)["end"] + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(kept, ""), rest)).otherwise(text)


def without(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` with `spans(row, spans)` cut out of their texts; documents that lose every word go."""
    keyed = docs.select(whole_row(docs), row_key(id_col, text_col).alias("row"))
    text = F.col("doc")[text_col]
    cut = F.coalesce(bind(F.col("spans"), lambda s: cut_out(text, s)), text)
    joined = keyed.join(spans, "row", "left").select("doc", cut.alias("cut"), F.col("spans").isNull().alias("whole"))
    kept = joined.where(F.col("whole") | F.col("cut").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(F.col("doc").withField(text_col, F.col("cut")).alias("doc")).select("doc.*")


def stretches(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs [from, to) of marked lines."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def spans_of(marks: np.ndarray, weight: np.ndarray, size: np.ndarray) -> list[dict[str, int]]:
    """Runs of marked lines as offsets, with their weights."""
    ends, sums = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(weight)])
    return [{"start": int(ends[a]), "end": int(ends[b]), "words": int(sums[b] - sums[a])} for a, b in zip(*stretches(marks))]
