"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts become templates: numbers, units of measure and names inside sentences turn
into typed placeholders, other words lose case and punctuation.  Windows of
`window` tokens are hash-joined, every one of an item and every one of a document.
Matches that lie on one diagonal (document place less item place) are one aligned
copy; a word put in or left out moves the rest of a copy to another diagonal, so
diagonals are also taken together with those up to `window`, and up to an item's
length, further on.  A copy counts if its windows cover `cover` of the item's tokens
and the values in its slots are consistent: an item's value always stands for the
same value of the document and the other way round.  That catches questions with
new numbers and names, and lets go of texts that only share a pattern.

A window of placeholders alone has nothing but its values to be known by: it is
joined by its own words, and the items' tokens that only such windows hold need not
be covered.  So long columns of numbers do not meet all items with numbers.

The windows of the benchmark are broadcast only while they take at most
`broadcast_bytes`; a larger benchmark is joined by a shuffle on the hash.  Of the
documents, 8 bytes a window and a row key take part; texts are never shuffled,
and slot values travel only with windows that have slots.

An item shorter than `window` is one window.  Null and empty texts have no windows
and never match; texts of any length are read whole.  Repeated rows and items are
reported once; of several copies of an item in a document the best covered counts, of
equally covered ones the one with fewer steps between diagonals.  Empty tables give no
rows; other columns pass through `remove`.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillvec.llm.common import bind, durable, row_key, text_or_empty, whole_row, words

#: What numbers, units and names become: characters of the private use area.
NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"
#: Units of measure that may follow a number.
UNITS = (
    "km m cm mm mi mile miles meter meters metre metres foot feet ft inch inches yard yards kg g mg lb lbs pound pounds ounce ounces oz ton tons liter liters litre "
    "litres l ml gallon gallons second seconds sec minute minutes min hour hours day days week weeks month months year years dollar dollars cent cents euro euros "
    "percent degrees mph kmh watts volts"
).split()
PLACEHOLDERS = (NUMBER, UNIT, NAME)
ANY = "[" + "".join(PLACEHOLDERS) + "]"
PUNCTUATION = ".,;:!?\"'()[]{}…“”‘’«»*_`~|#$%&<>"


NUMBERS = r"\S*[0-9]\S*"
UNITS_AFTER = NUMBER + r"(\s+)(?:" + "|".join(UNITS) + r")(?=[\s.,;:!?)]|$)"
#: A capital and a small letter, after a word that ends no sentence.
NAMES = r"(?<=[^\s.!?:]\s)[\"'(\[]?\p{Lu}\p{Ll}\S*"


def bare(text: Column) -> Column:
    """Words without case and punctuation; words of punctuation alone vanish."""
    return words(F.translate(F.lower(text), PUNCTUATION, ""))


def templates(texts: DataFrame) -> DataFrame:
    """`texts` with `tokens`, the template, and `raw`, the words they stand for place by place, instead of `text`.

    Placeholders go into the whole text before it is split, so that a word costs no
    expression of its own; in a text without any the words are the tokens, and `raw` is null.  Each
    step is a projection of its own, so nothing is computed twice and all is compiled.
    """
    kept = [c for c in texts.columns if c != "text"]
    text = text_or_empty(F.col("text"))
    plain = texts.select(*kept, F.when(text.rlike(ANY), F.translate(text, "".join(PLACEHOLDERS), "")).otherwise(text).alias("plain"))
    numbers = F.regexp_replace(F.regexp_replace("plain", NUMBERS, NUMBER), f"(?i){UNITS_AFTER}", f"{NUMBER}$1{UNIT}")
    numbered = plain.select(*kept, "plain", F.when(F.col("plain").rlike("[0-9]"), numbers).otherwise(F.col("plain")).alias("numbered"))
    marked = numbered.select(*kept, "plain", F.regexp_replace("numbered", NAMES, NAME).alias("marked"))
    split = marked.select(*kept, "plain", "marked", bare(F.col("marked")).alias("tokens"))
    return split.select(*kept, "tokens", F.when(F.col("marked").rlike(ANY), bare(F.col("plain"))).alias("raw"))


def windows(found: DataFrame, sizes: list[int], bare: bool = False) -> DataFrame:
    """Windows `(size, place, hash, slots)` of `tokens` and `raw`, instead of these; slots: the words behind placeholders, null for other words.

    `bare`: also whether a window holds placeholders alone.  Tokens are hashed in a projection of their own, and what follows has no lambdas:
    so it is compiled, and slots are made for windows that find a partner only.
    With every window goes a copy of its document's hashes, so these have 32 bits,
    and of its words only where there are placeholders.
    """
    kept = [c for c in found.columns if c not in ("tokens", "raw")]
    split = found.select(*kept, "raw", F.transform("tokens", lambda x: F.hash(x)).alias("h"))
    # an inner explode would bring a filter for empty templates, which makes them a second time
    each = split.select(*kept, "raw", "h", F.posexplode_outer("h").alias("place", "_"))
    if len(sizes) > 1:
        each = each.withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    else:
        each = each.withColumn("size", F.lit(sizes[0]))
    each = each.where(F.col("place") + F.col("size") <= F.size("h"))
    at = lambda c, j: F.get(F.col(c), F.col("place") + j)
    known = [F.hash(F.lit(p)) for p in PLACEHOLDERS]
    bare_of = lambda size: reduce(and_, [at("h", j).isin(*known) for j in range(size)])
    hashed = lambda size: F.xxhash64(F.lit(size), *[at("h", j) for j in range(size)])
    own = lambda size: F.xxhash64(F.lit(-size), *[at("raw", j) for j in range(size)])
    by_size = lambda of: reduce(lambda rest, size: F.when(F.col("size") == size, of(size)).otherwise(rest), sizes[1:], of(sizes[0]))
    hashes = by_size(lambda size: F.when(bare_of(size), own(size)).otherwise(hashed(size)))
    inside = lambda j: F.col("size") > j if len(sizes) > 1 else F.lit(True)
    slot = [F.when(inside(j) & at("h", j).isin(*known), at("raw", j)) for j in range(max(sizes))]
    slots = F.when(F.coalesce(*slot).isNotNull(), F.array(*slot))
    return each.select(*kept, "size", "place", hashes.alias("hash"), slots.alias("slots"), *([by_size(bare_of).alias("bare")] if bare else []))


def coverage(places: Column, size: Column) -> Column:
    """Tokens that windows of `size` tokens at the distinct `places` cover."""
    return bind(F.sort_array(places), lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(size, F.coalesce(F.get(p, k + 1) - x, size))), F.lit(0), lambda a, x: a + x))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 8, cover: float = 0.5, broadcast_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Rows `(id_col, row, item_col, covered_tokens, item_tokens, n_slots, altered)`, one a document and item."""
    items = templates(benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))).dropDuplicates()
    items = items.withColumn("item_tokens", F.size("tokens")).where("item_tokens > 0")
    lengths = items.agg(F.max("item_tokens"), F.collect_set(F.when(F.col("item_tokens") < window, F.col("item_tokens")))).first()
    longest, sizes = lengths[0] or 0, [window, *sorted(lengths[1])]
    items = windows(items, sizes, bare=True).where(F.col("size") == F.least(F.lit(window), "item_tokens"))
    # the tokens that must be covered: those in windows with a word of their own, or all if there is no such window
    worded = items.where(~F.col("bare")).groupBy("item", "item_tokens").agg(F.collect_list("place").alias("places"), F.max("size").alias("size"))
    worded = worded.select("item", "item_tokens", coverage(F.col("places"), F.col("size")).alias("worded"))
    items = items.join(worded, ["item", "item_tokens"], "left").select(
        "item", "item_tokens", F.coalesce("worded", "item_tokens").alias("worded"), "size", "hash", F.col("place").alias("item_place"), F.col("slots").alias("item_slots")
    )
    items = durable(items.dropDuplicates())
    long = F.aggregate(F.coalesce("item_slots", F.array()), F.lit(0), lambda a, x: a + 16 + F.coalesce(F.octet_length(x), F.lit(0)))
    if (items.agg(F.sum(80 + long)).first()[0] or 0) <= broadcast_bytes:
        items = F.broadcast(items)
    texts = templates(docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text")))
    found = windows(texts, sizes)
    # one whole number as the key, which is quick to look up; sizes are part of the hash
    hits = found.join(items.withColumnRenamed("size", "item_size"), "hash").where("size = item_size").drop("item_size")
    hits = durable(hits.withColumn("diagonal", F.col("place") - F.col("item_place")))
    pairs = F.filter(F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("doc")), lambda p: p["item"].isNotNull())
    key = ["id", "row", "item", "item_tokens", "worded", "size"]
    line = hits.groupBy(*key, "diagonal").agg(F.collect_set("item_place").alias("places"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
    ahead = F.collect_list(F.struct("diagonal", "places", "pairs")).over(Window.partitionBy(*key).orderBy("diagonal").rangeBetween(0, longest))

    def copy(level: int, reach: Column) -> Column:
        near = F.filter("ahead", lambda x: x["diagonal"] - F.col("diagonal") <= reach)
        return F.struct(F.lit(-level).alias("level"), F.array_distinct(F.flatten(F.transform(near, lambda x: x["places"]))).alias("places"), F.array_distinct(F.flatten(F.transform(near, lambda x: x["pairs"]))).alias("pairs"))

    reaches = (F.lit(0), F.least(F.lit(window), "item_tokens"), F.col("item_tokens"))
    copies = line.withColumn("ahead", ahead).select(*key, F.explode(F.array(*[copy(k, r) for k, r in enumerate(reaches)])).alias("c"))
    distinct = lambda field: F.size(F.array_distinct(F.transform("c.pairs", lambda p: p[field])))
    copies = copies.select(*key, "c.level", coverage(F.col("c.places"), F.col("size")).alias("covered"), F.size("c.pairs").alias("pairs"), distinct("item").alias("left"), distinct("doc").alias("right"), F.exists("c.pairs", lambda p: p["item"] != p["doc"]).alias("altered"))
    consistent = (F.col("pairs") == F.col("left")) & (F.col("pairs") == F.col("right"))
    enough = F.col("covered") >= F.ceil(cover * F.col("worded"))
    best = copies.where(consistent & enough).groupBy("id", "row", "item").agg(F.max(F.struct("covered", "item_tokens", "level", "pairs", "altered")).alias("b"))
    return best.select(
        F.col("id").alias(id_col), "row", F.col("item").alias(item_col), F.col("b.covered").cast("long").alias("covered_tokens"), F.col("b.item_tokens").cast("long").alias("item_tokens"),
        F.col("b.pairs").cast("long").alias("n_slots"), F.col("b.altered").alias("altered"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` without those that hold a benchmark item."""
    found = leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options).select("row").distinct()
    keyed = docs.select(whole_row(docs), row_key(id_col, text_col).alias("row"))
    return keyed.join(found, "row", "left_anti").select("doc.*")
