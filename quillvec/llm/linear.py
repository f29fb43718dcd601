"""Small sparse linear models, fitted on the driver from a bounded sample."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.llm.common import parts, python_udf


class Rows:
    """Sparse rows: `index[start[k]:start[k + 1]]` and `value[...]` are row k's."""

    def __init__(self, index: list[np.ndarray], value: list[np.ndarray]):
        self.length = np.array([len(x) for x in index], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.index = np.concatenate([*index, np.zeros(0, np.int32)]).astype(np.int32, copy=False)
        self.value = np.concatenate([*value, np.zeros(0, np.float32)]).astype(np.float32, copy=False)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.value * weights.astype(np.float32)[self.index], dtype=np.float64)])
        return sums[self.start + self.length] - sums[self.start]

    def back(self, pull: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index, self.value * np.repeat(pull.astype(np.float32), self.length), size)


def adam(start: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray], steps: int, rate: float) -> np.ndarray:
    """`start` after `steps` of Adam, with a rate that falls to a tenth."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * 0.1 ** (t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def bucket(word: str, buckets: int, kind: int = 0) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"), kind) % buckets


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int, id_col: str, text_col: str) -> DataFrame:
    """At most `sample_rows` labelled rows outside the held-out fold, chosen by a hash of the id.

    `labels` holds one row an id; the result has its columns and `text`, of several texts of an id the least.
    """
    chosen = labels.where(~held_out(F.col(id_col)) & F.col(id_col).isNotNull()).join(docs.select(id_col).distinct(), id_col, "left_semi")
    chosen = chosen.orderBy(F.xxhash64(F.lit("sample"), F.col(id_col)), id_col).limit(sample_rows)
    text = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return text.join(F.broadcast(chosen), id_col).groupBy(*labels.columns).agg(F.min("text").alias("text"))


def features_column(text: Column, rows_of: Callable[[list[str]], Rows]) -> Column:
    @python_udf("struct<index: array<int>, value: array<float>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        index, value = [], []
        for part in parts(texts):
            found = rows_of(part)
            index += np.split(found.index, found.start[1:])
            value += np.split(found.value, found.start[1:])
        return pd.DataFrame({"index": index, "value": value})

    return of(text)
