"""Substring dedup by hashing lines or paragraphs.

Units (lines, cut after sentences unless told otherwise) are normalised and
hashed to 128 bits; digests are counted over all documents; the earliest unit of a
digest, by (rank, place), stays and later ones are repeats.  A stretch of successive
repeats with `least_words` words or more is removed, and so is a repeat that has as
many together with the words beside it that are the kept copy's as well (`NEAR` or
`FAR` words before, and after): a passage pasted into a sentence has few whole units
between its ends.  Original offsets are kept.  A shorter line that recurs by itself,
like a header, is no passage and stays, unless `least_words` is lowered.

Only digests that occur twice or more leave the first count, so what is joined
and ranked afterwards is the repeated part of the corpus.  A frequent unit is
counted before the shuffle and its rows meet their digest in a join that Spark
may split; nothing gathers the rows of one digest.  A document's marks come
together per document, bounded by its own length.

Null and empty texts have no units.  A text of any length is read whole.  Rows
equal in id and text count as one document.  Null ids rank first; among rows with
equal ranks a hash of the text decides.  An empty table gives no rows; other columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.llm.common import discard, durable
from quillvec.llm.lines import FAR, NEAR, SENTENCES, arrays_column, listed, numbered, one_each, spans_of, split, stretches, without
from quillvec.llm.ship import ship

FIELDS = "hash: array<long>, second: array<long>, weight: array<int>, size: array<int>, b6: array<int>, b12: array<int>, a6: array<int>, a12: array<int>"
AROUND = ["b6", "b12", "a6", "a12"]

def units_of(texts: list[str], sentences: bool = True) -> dict[str, list[np.ndarray]]:
    got = split(texts, SENTENCES if sentences else "")
    columns = {"hash": got.hash, "second": got.second, "weight": got.weight, "size": got.sizes().astype(np.int32)} | {c: np.ascontiguousarray(got.around[:, k]) for k, c in enumerate(AROUND)}
    return {c: listed(got.first, x) for c, x in columns.items()}


def removed(marks: np.ndarray, alone: np.ndarray, weight: np.ndarray, least_words: int) -> np.ndarray:
    """Which of the repeats go: those of long stretches, and those that go `alone`."""
    sums = np.concatenate([[0], np.cumsum(weight)])
    out = alone.copy()
    for a, b in zip(*stretches(marks)):
        if sums[b] - sums[a] >= least_words:
            out[a:b] = True
    return out


def repeats(docs: DataFrame, least_words: int = 25, sentences: bool = True, id_col: str = "doc_id", text_col: str = "text", rank_col: str | None = None) -> DataFrame:
    """Documents with removed passages: `(id, row, n_units, spans)`; spans are (start, end, words)."""
    ship(docs.sparkSession)
    split_up = arrays_column(F.col(text_col), FIELDS, lambda texts: units_of(texts, sentences))
    units = numbered(docs, id_col, text_col, F.col(rank_col or id_col).alias("rank"), F.hash(F.col(text_col)).alias("tie"), split_up.alias("l")).select("id", "row", "n", "rank", "tie", "l.*")
    units = durable(units).where(F.size("hash") > 0)  # a filter before it would split the texts twice
    digest, own = ["hash", "second"], ["weight", *AROUND]
    # an inner explode would bring a filter that zips the arrays a second time
    each = units.select("rank", "tie", "n", F.posexplode_outer(F.arrays_zip(*digest, *own)).alias("k", "u")).where("k is not null")
    twice = durable(each.groupBy(*[F.col(f"u.{c}").alias(c) for c in digest]).count().where("count > 1").select(*digest))
    shared = durable(each.select("rank", "tie", "n", "k", *[f"u.{c}" for c in (*digest, *own)]).join(twice, digest))
    first = durable(shared.groupBy(*digest).agg(F.min(F.struct("rank", "tie", "n", "k", *AROUND)).alias("first")))
    later = shared.join(first, digest).where((F.col("n") != F.col("first.n")) | (F.col("k") != F.col("first.k")))
    same = {c: (F.col(c) != 0) & (F.col(c) == F.col(f"first.{c}")) for c in AROUND}
    beside = [F.when(same[f"{side}12"], FAR).when(same[f"{side}6"], NEAR).otherwise(0) for side in "ba"]
    alone = F.col("weight") + beside[0] + beside[1] >= least_words
    rows = units.join(later.groupBy("n").agg(F.collect_list(2 * F.col("k") + alone.cast("int")).alias("marks")), "n")

    def passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x in batch.itertuples():
                marks, alone = np.zeros((2, len(x.weight)), bool)
                marks[x.marks >> 1] = True
                alone[x.marks[x.marks & 1 == 1] >> 1] = True
                if found := spans_of(removed(marks, alone, x.weight, least_words), x.weight, x.size):
                    out.append((x.n, len(marks), found))
            if out:
                yield pd.DataFrame(out, columns=["n", "n_units", "spans"])

    spans = rows.select("n", "weight", "size", "marks").mapInPandas(passages, "n long, n_units int, spans array<struct<start: int, end: int, words: int>>")
    spans = durable(spans)
    discard(twice, shared, first)
    return one_each(spans, units).select("id", "row", "n_units", "spans")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` without the repeated passages; documents that lose every word go."""
    found = repeats(docs, id_col=id_col, text_col=text_col, **options)
    return without(docs, found.select("row", "spans"), id_col, text_col)
