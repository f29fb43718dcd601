"""Quality grades by ordinal cumulative-link regression.

`P(grade <= k) = sigmoid(threshold[k] - f(text))` with ordered thresholds and one
set of weights over hashed words and word shapes.  A text's expected grade is the
sum of its tail probabilities; the probability of reaching `least_grade` selects.

The fit uses at most `sample_rows` graded rows outside the held-out fold, chosen
by a hash of their ids; scoring covers every whole text.

Null and empty texts are graded from the shape of an empty text; texts of any length
are read whole.  Repeated rows are graded alike; of several grades of an id the
greatest counts and of several texts the least.  A tail probability of exactly one half
selects.  An empty table gives no rows; without any grades every text gets even odds.
Other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.llm.common import held, parts, python_udf
from quillvec.llm.linear import Rows, adam, bucket, features_column, held_out, sigmoid, training_rows

SHIFT = 15
BUCKETS = 1 << SHIFT
#: After the buckets: constant, share of distinct words, share equal to the word before, log length.
EXTRA = 4
REMEMBERED = 100_000
SHAPES = [(regex.compile(r"\p{Lu}+"), "A"), (regex.compile(r"\p{L}+(?<!A)"), "a"), (regex.compile(r"\d+"), "9"), (regex.compile(r"(.)\1+"), r"\1")]


def shape(word: str) -> str:
    """`word` with letters, digits and repeats cut short: "Ruin!!" is "a!" and "RUIN!!" is "A!"."""
    core, tail = (word, "") if word[-1].isalnum() else (word[:-1], word[-1])
    if core.isalpha():  # most words by far
        if not core[-1].isupper():
            return "a" + tail
        if core.isascii() and core.isupper():
            return "A" + tail
    for pattern, by in SHAPES:
        word = pattern.sub(by, word)
    return word[:12]


class Buckets(dict):
    """The two buckets of a word, as one number, remembered for the words met last."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = bucket(word, BUCKETS) | bucket(shape(word), BUCKETS, 1) << SHIFT
        return found


@dataclass
class Seen:
    """Texts laid end to end: buckets of their words and shapes, where texts begin, and `EXTRA` numbers of each."""

    words: np.ndarray
    shapes: np.ndarray
    first: np.ndarray
    extra: np.ndarray

    def value(self, weights: np.ndarray) -> np.ndarray:
        """The weighted features of each text; a bucket counts by its share of the words."""
        sums = np.concatenate([[0.0], np.cumsum(weights[self.words] + 4 * weights[self.shapes])])
        n = np.diff(self.first)
        return (sums[self.first[1:]] - sums[self.first[:-1]]) / np.maximum(1, n) + self.extra @ weights[BUCKETS:]

    def rows(self) -> Rows:
        """The same features as sparse rows."""
        index, value = [], []
        for a, b, extra in zip(self.first[:-1].tolist(), self.first[1:].tolist(), self.extra):
            words, count = np.unique(self.words[a:b], return_counts=True)
            shapes, often = np.unique(self.shapes[a:b], return_counts=True)
            index.append(np.concatenate([words, shapes, BUCKETS + np.arange(EXTRA)]))
            value.append(np.concatenate([count / max(1, b - a), 4 * often / max(1, b - a), extra]))
        return Rows(index, value)


def look(texts: list[str]) -> Seen:
    words = [t.split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    code = np.fromiter(map(held("buckets", Buckets).__getitem__, chain.from_iterable(words)), np.int64, int(first[-1]))
    one, two = code & BUCKETS - 1, code >> SHIFT
    text = np.repeat(np.arange(len(texts)), n)
    again = np.bincount(text[1:][(one[1:] == one[:-1]) & (text[1:] == text[:-1])], minlength=len(texts))
    distinct = np.array([len(set(w)) for w in words], np.int64)
    size = np.maximum(1, n)
    return Seen(one, two, first, np.stack([np.ones(len(texts)), 2 * distinct / size, 4 * again / size, np.log1p(n) / 8], 1))


def cuts(x: np.ndarray, size: int) -> np.ndarray:
    """Thresholds of the parameters after the weights: a start, and steps that are positive, so they stay ordered."""
    return x[size] + np.concatenate([[0.0], np.cumsum(np.exp(x[size + 1 :]))])


def loss(x: np.ndarray, rows: Rows, grades: np.ndarray, size: int, pull: float) -> float:
    """The mean negative log likelihood, and a pull to small weights."""
    cut = np.concatenate([[-np.inf], cuts(x, size), [np.inf]])
    f = rows.dot(x[:size])
    return float(-np.log(sigmoid(cut[grades + 1] - f) - sigmoid(cut[grades] - f)).mean() + pull / 2 * (x[:size] ** 2).sum())


def gradient(x: np.ndarray, rows: Rows, grades: np.ndarray, size: int, pull: float) -> np.ndarray:
    """Of `loss`."""
    n, n_grades = len(grades), len(x) - size + 1
    cut = np.concatenate([[-np.inf], cuts(x, size), [np.inf]])
    f = rows.dot(x[:size])
    high, low = sigmoid(cut[grades + 1] - f), sigmoid(cut[grades] - f)
    p = np.maximum(high - low, 1e-9)
    up, down = high * (1 - high) / p, low * (1 - low) / p
    by_cut = -(np.bincount(grades + 1, up, n_grades + 1) - np.bincount(grades, down, n_grades + 1))[1:n_grades] / n
    later = np.cumsum(by_cut[::-1])[::-1]
    own = np.concatenate([[later[0]], later[1:] * np.exp(x[size + 1 :])])
    return np.concatenate([rows.back(up - down, size) / n + pull * x[:size], own])


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def tails(self, texts: list[str]) -> np.ndarray:
        """For each text P(grade > k) for each threshold k."""
        return sigmoid(look(texts).value(self.weights)[:, None] - self.thresholds)

    @classmethod
    def fit(cls, rows: Rows, grades: np.ndarray, n_grades: int, steps: int = 200, rate: float = 0.2, pull: float = 1e-5) -> Ordinal:
        """Maximum likelihood."""
        size = BUCKETS + EXTRA
        start = np.concatenate([np.zeros(size), [-1.0], np.zeros(n_grades - 2)])
        x = adam(start, lambda x: gradient(x, rows, grades, size, pull), steps, rate)
        return cls(x[:size], cuts(x, size))


def tails_column(text: Column, model: Ordinal) -> Column:
    weights, thresholds = model.weights.astype(np.float32), model.thresholds

    @python_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        model = Ordinal(weights.astype(np.float64), thresholds)
        return pd.Series([row for part in parts(texts) for row in model.tails(part)], dtype=object)

    return of(text)


def fit(docs: DataFrame, grades: DataFrame, n_grades: int, sample_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Ordinal:
    """The model from `grades(id_col, grade_col)`, whole numbers from 0 to n_grades - 1."""
    known = grades.where(F.col(grade_col).between(0, n_grades - 1)).groupBy(id_col).agg(F.max(grade_col).cast("int").alias("_grade"))
    sample = training_rows(docs, known, sample_rows, id_col, text_col)
    shown = features_column(F.col("text"), lambda texts: look(texts).rows())
    taken = sample.select(id_col, "_grade", shown.alias("f")).select(id_col, "_grade", "f.*").toPandas().sort_values(id_col)
    if not len(taken):
        return Ordinal(np.zeros(BUCKETS + EXTRA), np.zeros(n_grades - 1))
    return Ordinal.fit(Rows(list(taken["index"]), list(taken["value"])), taken["_grade"].to_numpy(np.int64), n_grades)


def grade(docs: DataFrame, grades: DataFrame, n_grades: int, least_grade: int = 1, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row a document: `(id_col, held_out, expected_grade, tail_probability, kept)`."""
    model = fit(docs, grades, n_grades, id_col=id_col, text_col=text_col, **options)
    tails = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), tails_column(F.col(text_col), model).alias("_t"))
    return tails.select(
        id_col, "held_out", F.aggregate("_t", F.lit(0.0), lambda a, x: a + x).alias("expected_grade"), F.get("_t", F.lit(least_grade - 1)).alias("tail_probability")
    ).withColumn("kept", F.col("tail_probability") >= 0.5)


def grades_of(labels: DataFrame) -> DataFrame:
    """Grades 0 to 2 from the label table: poor, good but toxic, good."""
    return labels.select("doc_id", (F.col("quality") * (2 - F.coalesce("toxic", F.lit(0)))).alias("grade"))
