"""Line dedup by winnowing over line hashes.

Lines are short: they end at line breaks, after sentences and after words with
certain last letters, so that a passage has the same lines wherever it is pasted.
A window is the shortest run of successive lines from a line on that has
`least_words` words.  A gram is the same with `gram_words` words.  A window's
fingerprint is the least hash of the grams inside it.  A repeated window selects the
same gram in all its copies: a fingerprint that occurs once in the corpus cannot be
part of a repeat, and most places end there.

Windows around places whose fingerprint recurs are joined by the hash of their
whole content (128 bits).  The earliest window, by (id, place), stays; the others
are matches.  From a fingerprint a match extends both ways, line by line, over
every neighbouring window that matches as well, whichever earlier documents hold
the parts; what matching windows cover is removed.

Rows of a frequent fingerprint or window are counted before the shuffle and
joined to one row a key, in joins that Spark may split.  What is gathered is one
document's places, bounded by its length.

Null and empty texts have no lines.  A text of any length is read whole.  Rows
equal in id and text count as one document.  Null ids rank first; among rows with
equal ids a hash of the text decides.  An empty table gives no rows; other columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.llm.common import discard, durable
from quillvec.llm.lines import BASE, PIECES, PLACE_BITS, SECOND, Sums, arrays_column, listed, numbered, one_each, ranked, short, spans_of, split, without
from quillvec.llm.ship import ship

FIELDS = "short: array<int>, weight: array<int>, size: array<int>, k: array<int>, hash: array<long>"


def reach(weight: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line of documents laid end to end: where a run of `least` words from it on ends, and whether its document holds it."""
    total = np.concatenate([[0], np.cumsum(weight)])
    to = np.searchsorted(total, total[:-1] + least, "left")
    return to, to <= np.repeat(first[1:], np.diff(first))


def fingerprints(hashes: np.ndarray, weight: np.ndarray, first: np.ndarray, least_words: int, gram_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the grams that windows select, ascending, and their hashes."""
    to, fits = reach(weight, first, least_words)
    gram_to, _ = reach(weight, first, gram_words)
    start = np.flatnonzero(fits)
    last = np.searchsorted(gram_to, to[start], "right") - 1
    grams = Sums(hashes, BASE).of(np.arange(len(hashes)), np.minimum(gram_to, len(hashes)))
    least = start.copy()
    for k in range(1, int((last - start).max(initial=0)) + 1):
        more = np.flatnonzero(start + k <= last)
        lower = more[grams[start[more] + k] < grams[least[more]]]
        least[lower] = start[lower] + k
    least = np.unique(least)
    return least, grams[least]


def windows(lines: np.ndarray, weight: np.ndarray, first: np.ndarray, places: np.ndarray, least_words: int, gram_words: int) -> tuple[np.ndarray, ...]:
    """Windows with a gram at one of `places` inside: starts, ends, and two hashes of the content."""
    to, fits = reach(weight, first, least_words)
    gram_to, _ = reach(weight, first, gram_words)
    next_place = np.searchsorted(places, np.arange(len(weight)))
    near = np.append(places, len(weight))[next_place]
    inside = fits & (np.append(gram_to, len(weight) + 1)[near] <= to)
    start = np.flatnonzero(inside)
    values = lines.view(np.uint32).astype(np.uint64) + np.uint64(1)
    return start, to[start], Sums(values, BASE).of(start, to[start]), Sums(values, SECOND).of(start, to[start])


def lines_of(texts: list[str], least_words: int, gram_words: int, sentences: bool) -> dict[str, list[np.ndarray]]:
    """Lines with 32 bits of their hashes, and the documents' fingerprints."""
    got = split(texts, PIECES if sentences else "", second=False)
    places, hashes = fingerprints(got.hash, got.weight, got.first, least_words, gram_words)
    of = np.searchsorted(places, got.first)
    document = np.searchsorted(got.first, places, "right") - 1
    return {
        "short": listed(got.first, short(got.hash)), "weight": listed(got.first, got.weight), "size": listed(got.first, got.sizes().astype(np.int32)),
        "k": listed(of, (places - got.first[document]).astype(np.int32)), "hash": listed(of, hashes),
    }


def parts(batches: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    """`batches` in parts that take little memory."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


def repeats(docs: DataFrame, least_words: int = 25, gram_words: int = 8, sentences: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with later repeated runs: `(id, row, n_lines, spans)`; spans are (start, end, words)."""
    ship(docs.sparkSession)
    gram_words = min(gram_words, least_words)
    split_up = arrays_column(F.col(text_col), FIELDS, lambda texts: lines_of(texts, least_words, gram_words, sentences))
    lines = numbered(docs, id_col, text_col, F.hash(F.col(text_col)).alias("tie"), split_up.alias("l")).select("id", "row", "n", "tie", "l.*")
    lines = durable(lines).where(F.size("short") > 0)  # a filter before it would split the texts twice
    # an inner explode would bring a filter that zips the arrays a second time
    found = lines.select("n", F.explode_outer(F.arrays_zip("k", "hash")).alias("f")).select("n", "f.k", "f.hash").where("k is not null")
    twice = durable(found.groupBy("hash").count().where("count > 1").select("hash"))
    ranks = ranked(lines, "id", "tie")
    places = found.join(twice, "hash").groupBy("n").agg(F.collect_list("k").alias("places")).join(ranks, "n")

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in parts(batches):
            sizes = batch["weight"].map(len).to_numpy(np.int64)
            first = np.concatenate([[0], np.cumsum(sizes)])
            at = np.concatenate([np.sort(p) + a for p, a in zip(batch["places"], first)]).astype(np.int64)
            start, end, whole, second = windows(np.concatenate(batch["short"].tolist()).astype(np.int32), np.concatenate(batch["weight"].tolist()), first, at, least_words, gram_words)
            row = np.searchsorted(first, start, "right") - 1
            place = (batch["rank"].to_numpy(np.int64)[row] << PLACE_BITS) + start - first[row]
            yield pd.DataFrame({"place": place, "lines": (end - start).astype(np.int32), "whole": whole.view(np.int64), "second": second.view(np.int64)})

    asked = lines.join(places, "n").select("rank", "short", "weight", "places")
    window = durable(asked.mapInPandas(shared, "place long, lines int, whole long, second long"))
    content = ["whole", "second"]
    first = durable(window.groupBy(*content).agg(F.count("*").alias("copies"), F.min("place").alias("first")).where("copies > 1").drop("copies"))
    later = window.join(first, content).where("place <> first")
    of = later.select(F.shiftright("place", PLACE_BITS).alias("rank"), (F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) * (1 << 32) + F.col("lines")).alias("match"))
    marked = of.groupBy("rank").agg(F.collect_list("match").alias("matches")).join(ranks, "rank").drop("rank")

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in parts(batches):
            out = []
            for x in batch.itertuples():
                n = len(x.weight)
                begin = x.matches >> 32
                change = np.bincount(begin, minlength=n + 1) - np.bincount(begin + (x.matches & (1 << 32) - 1), minlength=n + 1)
                out.append((x.n, n, spans_of(np.cumsum(change)[:-1] > 0, x.weight, x.size)))
            if out:
                yield pd.DataFrame(out, columns=["n", "n_lines", "spans"])

    spans = lines.join(marked, "n").select("n", "weight", "size", "matches").mapInPandas(runs, "n long, n_lines int, spans array<struct<start: int, end: int, words: int>>")
    spans = durable(spans)
    discard(twice, ranks, window, first)
    return one_each(spans, lines).select("id", "row", "n_lines", "spans")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` without later repeated runs; documents that lose every word go."""
    found = repeats(docs, id_col=id_col, text_col=text_col, **options)
    return without(docs, found.select("row", "spans"), id_col, text_col)
