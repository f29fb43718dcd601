"""Operators against brute force on small corpora."""

import datetime
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillvec.llm import decontamination, line_dedup, lines, packing, pii, quality_classifier, quality_rules, simhash, substring_dedup, token_counts, toxicity

from .conftest import EDGES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(corpus):
    return {r["doc_id"]: r["text"] for r in corpus.collect()}


# --- SimHash ------------------------------------------------------------------------------


def plain_fingerprint(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not found:
        return 0
    grams = [" ".join(found[k : k + 4]) for k in range(max(1, len(found) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius):
    up = {v: v for v in values}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    values = sorted(values)
    for k, a in enumerate(values):
        for b in values[:k]:
            if (a ^ b).bit_count() <= radius:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {v: top(v) for v in values}


def test_fingerprints_and_components(spark, corpus, texts, edges):
    for df, known in ((corpus, list(texts.items())), (edges, EDGES)):
        want = [(i, plain_fingerprint(t)) for i, t in known]
        roots = plain_components({f for _, f in want}, 4)
        least = {}
        for i, f in want:
            if i is not None:
                least[roots[f]] = min(i, least.get(roots[f], i))
        got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(df).collect())
        assert got == Counter((i, f, least.get(roots[f])) for i, f in want)


@pytest.mark.parametrize("shard_rows", [5, 4096])
def test_links_in_dense_and_split_shards(spark, shard_rows):
    """Hundreds of values around a few centres, in shards of a few rows."""
    rng = random.Random(shard_rows)
    values = {0}
    for _ in range(4):
        center = rng.getrandbits(64)
        for _ in range(60):
            v = center
            for b in rng.sample(range(64), rng.randint(0, 5)):
                v ^= 1 << b
            values.add(v)
    want = plain_components(values, 4)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    from quillvec.llm.common import components

    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    edges = simhash.links(df, 4, shard_rows)
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    groups = lambda m: sorted(sorted(v for v in values if m(v) == t) for t in {m(v) for v in values})
    assert groups(lambda v: roots.get(signed(v), signed(v))) == groups(lambda v: want[v])


def test_more_blocks_lose_nothing():
    rng = random.Random(1)
    for n in (1, 10**6, 10**9, 10**12):
        masks = simhash.shard_masks(n, 4)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 4):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60, unique=True), st.integers(0, 20))
@settings(deadline=None, max_examples=40)
def test_bk_tree(values, radius):
    import numpy as np

    tree = simhash.BKTree(np.array(values, np.uint64))
    q, n, d = tree.near(np.array(values, np.uint64), radius)
    assert d.tolist() == [(values[a] ^ values[b]).bit_count() for a, b in zip(q.tolist(), n.tolist())]
    assert sorted(zip(q.tolist(), n.tolist())) == sorted((a, b) for a, x in enumerate(values) for b, y in enumerate(values) if (x ^ y).bit_count() <= radius)


def jaccard(a, b, size=5):
    grams = lambda t: {tuple(w[k : k + size]) for w in [re.findall(r"[^\x20\x09-\x0D]+", t.lower())] for k in range(max(1, len(w) - size + 1)) if w}
    x, y = grams(a), grams(b)
    return len(x & y) / max(1, len(x | y))


def edited_corpus(seed, n=120):
    """Texts and copies of them with more and more words replaced."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7)))
    rows = []
    for _ in range(n):
        first = [word() for _ in range(rng.choice([8, 40, 150, 400]))]
        rows.append(first)
        for share in rng.sample([0, 0.005, 0.01, 0.015, 0.02, 0.03, 0.06], 3):
            rows.append([word() if rng.random() < share else w for w in first])
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("shard_rows", [16, 4096])
def test_similar_texts_against_all_pairs(docs_of, shard_rows):
    """What stays: no two texts of 0.8 or more but for a few, and one of each group that all pairs give."""
    rows = edited_corpus(shard_rows)
    close = [(a, b) for a, x in rows for b, y in rows[:a] if abs(len(x) - len(y)) < 0.3 * len(x) + 9 and jaccard(x, y) >= 0.8]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in close:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    want = {i for i in range(len(rows)) if up[i] == i}
    got = {r["doc_id"] for r in simhash.keep_one_similar(docs_of(rows), shard_rows=shard_rows).collect()}
    assert want <= got and len(got - want) <= 0.05 * (len(rows) - len(want)) and len(rows) - len(want) > 100


def test_links_that_a_forest_leaves_out_are_found(spark, docs_of, monkeypatch):
    """Links that fail when whole texts are read, and fingerprints that never meet, hide no pair of 0.8 or more."""
    rng = random.Random(3)
    rows = []
    for size in [5, 6, 9, 30, 60, 150, 150, 400, 900]:
        first = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        rows.append(" ".join(first))
        for edits in range(1, size // 30 + 2, 1 + size // 200):
            copy = list(first)
            for k in rng.sample(range(size), edits):
                copy[k] = f"v{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
        rows.append(" ".join(first + ["one", "more"] * max(1, size // 40)))
    rows = list(enumerate(rows))
    close = {(b, a) for a, x in rows for b, y in rows[:a] if jaccard(x, y) >= 0.8}
    group = list(range(len(rows)))
    for a, b in close:
        group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    want = {i for i in range(len(rows)) if group[i] == i}
    assert 9 < len(want) < len(rows) - 15
    left = lambda: sorted(r["doc_id"] for r in simhash.keep_one_similar(docs_of(rows)).collect())
    assert left() == sorted(want)
    monkeypatch.setattr(simhash, "runs", lambda n, least: [(-1, -1)])  # only equal fingerprints meet
    assert left() == sorted(want)


def test_prefixes_and_parities_bound_similar_sets():
    rng = random.Random(5)
    names = np.array(sorted(rng.randrange(-(1 << 63), 1 << 63) for _ in range(50)), np.int64)
    for size in [1, 4, 5, 6, 14, 15, 40, 64, 65, 300]:
        for _ in range(20):
            words = [f"w{rng.randrange(10**6)}" for _ in range(size + 4)]
            other = [f"v{k}" if rng.random() < 0.02 else w for k, w in enumerate(words)]
            grams = [simhash.hashes(simhash.digests(simhash.shingles(" ".join(w), 5))) for w in (words, other)]
            common = np.sort(np.concatenate([names, rng.sample(grams[0].tolist(), size // 2)]))
            x, y = (simhash.described(" ".join(w), 5, 0.8, common, np.arange(3, len(common) + 3)) for w in (words, other))
            differ = len(set(grams[0].tolist()) ^ set(grams[1].tolist()))
            if len(x[5]) == len(y[5]):
                assert np.bitwise_count((x[5] ^ y[5]).view(np.uint64)).sum() <= differ
            both = len(set(grams[0].tolist()) & set(grams[1].tolist()))
            if both >= 0.8 * len(set(grams[0].tolist()) | set(grams[1].tolist())):
                assert set(x[4].tolist()) & set(y[4].tolist())


def test_runs_of_bits_cover_a_large_corpus():
    for n in (1, 1000, 10**6, 10**9):
        masks = simhash.runs(n, 0.8)
        assert len(set(masks)) == len(masks) and len(masks) < 400
        rng, met = random.Random(n), 0
        for _ in range(300):
            flipped = sum(1 << b for b in rng.sample(range(128), round(simhash.distance_of(0.8))))
            met += any(not (x % (1 << 64) << 64 | y % (1 << 64)) & flipped for x, y in masks)
        assert met >= 0.9 * 300


def test_components_of_a_long_chain(spark):
    from quillvec.llm.common import components

    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(df).collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}


# --- tokens -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def transducer():
    return token_counts.Transducer(token_counts.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.json")))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


HARD = [
    "", " ", "  ", "a  b", "don't 'tis it''s I'll've 're'd x's's 'sat  's\n's", "a\n\nb\n c \t d", "x<|endoftext|>y <|endoftext|>", "12 34a5", "é ñandú 日本語 😀😀", "   lead", "trail   ",
    "!!'s ?'ll", "-" * 300 + " " + "=" * 200, "a" * 5000, "'l", "'", "x'", "the'r", "aa'll" * 800, " " * 3000 + "x", "\n" * 2000, "  x　y", "<|endoftext|>", "<|endoftext|><|endoftext|>",
]


def test_token_counts_match_the_library(transducer, library, texts):
    some = HARD + list(texts.values())
    assert transducer.counts(some).tolist() == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]


def test_token_counts_when_the_table_is_full(library, texts, monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 2000)
    small = token_counts.Transducer(token_counts.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.json")))
    some = HARD + list(texts.values())[:80]
    assert small.counts(some).tolist() == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]


@given(st.text(alphabet=st.sampled_from(list("abst 'lvermd\n\t1!é日😀 ")), max_size=200))
@settings(deadline=None, max_examples=150)
def test_token_counts_of_any_text(text):
    global _PAIR
    try:
        _PAIR
    except NameError:
        path = public_tokenizers.path("byte_bpe_50k.json")
        _PAIR = token_counts.Transducer(token_counts.Vocabulary.read(path)), Tokenizer.from_file(path)
    assert _PAIR[0].counts([text])[0] == len(_PAIR[1].encode(text, add_special_tokens=False).ids)


# --- repeated lines -----------------------------------------------------------------------


def plain_lines_of(text, after):
    """(words in normal form, weight, start, end) of each line."""
    low, out, start = lines.lower(text), [], 0
    for k, c in enumerate(text):
        if c == "\n" or c in lines.WIDE or c == " " and k and low[k - 1] in after or k == len(text) - 1:
            norm = " ".join(re.findall(r"[^\x20\x09-\x0D]+", low[start : k + 1]))
            if norm:
                out.append((norm, max(norm.count(" ") + 1, len(norm) // lines.WORD_CHARS), start, k + 1))
                start = k + 1
    return out


def spans_of(marks, found):
    out, k = [], 0
    while k < len(marks):
        j = k
        while j < len(marks) and marks[j]:
            j += 1
        if j > k:
            out.append((found[k][2], found[j - 1][3]))
        k = max(j, k + 1)
    return out


def plain_substring(rows, least):
    """Later repeats in a stretch of `least` words, or with so many together with what is beside them."""
    first, out = {}, {}
    for i, t in rows:
        found, all_words = plain_lines_of(t or "", lines.SENTENCES), re.findall(r"[^\x20\x09-\x0D]+", lines.lower(t or ""))
        marks, gone, at = [], [], 0
        for norm, weight, *_ in found:
            n = norm.count(" ") + 1
            around = [all_words[at - k : at] if at >= k else None for k in (6, 12)] + [all_words[at + n : at + n + k] if at + n + k <= len(all_words) else None for k in (6, 12)]
            kept = first.setdefault(norm, (i, at, around))
            marks.append(kept[:2] != (i, at))
            same = [x is not None and x == y for x, y in zip(around, kept[2])]
            gone.append(marks[-1] and weight + (12 if same[1] else 6 * same[0]) + (12 if same[3] else 6 * same[2]) >= least)
            at += n
        for a in range(len(marks)):
            for b in range(a + 1, len(marks) + 1):
                if all(marks[a:b]) and sum(x[1] for x in found[a:b]) >= least:
                    gone[a:b] = [True] * (b - a)
        if spans := spans_of(gone, found):
            out[i] = spans
    return out


def plain_lines(rows, least):
    first, out = {}, {}
    for i, t in rows:
        found = plain_lines_of(t or "", lines.PIECES)
        marks = [False] * len(found)
        for a in range(len(found)):
            b, n = a, 0
            while b < len(found) and n < least:
                n, b = n + found[b][1], b + 1
            if n >= least and first.setdefault(tuple(x[0] for x in found[a:b]), (i, a)) != (i, a):
                marks[a:b] = [True] * (b - a)
        if spans := spans_of(marks, found):
            out[i] = spans
    return out


def repeated_corpus(seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 6))) + rng.choice([".", "!", ""]) for _ in range(30)]
    return [(i, rng.choice(["\n", " "]).join(rng.choice(pool) for _ in range(rng.randint(0, 25)))) for i in range(60)]


@pytest.mark.parametrize("least", [2, 6, 12, 25])
def test_repeats_match_brute_force(spark, docs_of, texts, least):
    for rows in (repeated_corpus(least), sorted(texts.items())[: 200 if least > 2 else 60]):
        df = docs_of(rows)
        for operator, plain, options in ((substring_dedup, plain_substring, {}), (line_dedup, plain_lines, {"gram_words": least // 2})):
            got = {r["id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in operator.repeats(df, least_words=least, **options).collect()}
            assert got == plain(rows, least), operator.__name__
            left = {r["doc_id"]: r["text"] for r in operator.remove(df, least_words=least, **options).collect()}
            for i, t in rows:
                at, kept = 0, ""
                for a, b in got.get(i, []):
                    kept, at = kept + t[at:a], b
                kept += t[at:]
                assert left.get(i) == (kept if kept.split() or i not in got else None)


@pytest.mark.parametrize("after", ["", lines.SENTENCES, lines.PIECES])
@given(texts=st.lists(st.text(alphabet=st.sampled_from(list("abns. \n\t!é。İA")), max_size=120), max_size=12))
@settings(deadline=None, max_examples=60)
def test_lines_of_any_text(after, texts):
    old, lines.SLAB = lines.SLAB, 40
    try:
        got = lines.split(texts, after)
    finally:
        lines.SLAB = old
    norms = {}
    for k, t in enumerate(texts):
        a, b = got.first[k], got.first[k + 1]
        want = plain_lines_of(t, after) if after else [x for x in plain_lines_of(t.replace("。", "c"), "")]
        if after or "。" not in t:
            assert [x[1:2] + x[3:] for x in want] == list(zip(got.weight[a:b].tolist(), got.end[a:b].tolist()))
            for x, *h in zip(want, got.hash[a:b].tolist(), got.second[a:b].tolist()):
                assert norms.setdefault(x[0], h) == h
    assert len({tuple(h) for h in norms.values()}) == len({h[0] for h in norms.values()}) == len(norms)


def test_rows_with_equal_ids(docs_of):
    """Copies of a row count as one document; other texts of the same id are documents of their own."""
    text = lambda c: " ".join(f"{c}{k}." for k in range(40))
    df = docs_of([(1, text("a")), (1, text("a")), (1, text("b") + " " + text("a")), (2, text("b"))])
    for operator in (substring_dedup, line_dedup):
        kept = sorted((r["doc_id"], r["text"].strip()) for r in operator.remove(df).collect())
        assert [x for x in kept if x[1].startswith("a")] in ([(1, text("a"))] * 2, []) and len(kept) in (1, 2, 3)
        assert sum(x[1].count("b5.") for x in kept) == 1 and sum("a5." in x[1] for x in kept) in (1, 2)


def test_pasted_passages_are_found(spark, docs_of):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() + ("." if rng.random() < 0.15 else "") for _ in range(n))
    passage = text(60)
    rows = [(i, f"{text(50)} {passage} {text(50)}" if i % 4 == 1 else text(120)) for i in range(40)]
    for operator in (substring_dedup, line_dedup):
        assert {r["id"] for r in operator.repeats(docs_of(rows)).collect()} == {i for i, _ in rows if i % 4 == 1 and i > 1}
    long = "".join(word() + " " for _ in range(60))  # one sentence, fused with its surroundings at both ends
    rows = [(i, f"{text(50)} {word()} {long}{word()} {text(50)}" if i % 4 == 1 else text(120)) for i in range(40)]
    assert {r["id"] for r in line_dedup.repeats(docs_of(rows)).collect()} == {i for i, _ in rows if i % 4 == 1 and i > 1}


# --- packing ------------------------------------------------------------------------------


def test_packing_rules(spark, corpus, texts):
    rows = packing.pack(corpus, capacity=500, shard_rows=60).toPandas()
    source = {r["doc_id"]: r["source"] for r in corpus.collect()}
    assert rows.groupby("doc_id").n_words.sum().to_dict() == {i: len(t.split()) for i, t in texts.items()}
    for _, b in rows.groupby("bin"):
        assert b.n_words.sum() <= 500 and b.doc_id.map(source).is_unique and b.doc_id.map(lambda i: " ".join(texts[i].lower().split())).is_unique and sorted(b.place) == list(range(len(b)))
    for _, d in rows.groupby("doc_id"):
        d = d.sort_values("piece")
        assert (d.start == d.n_words.cumsum().shift(fill_value=0)).all()


def test_near_copies_go_into_different_bins(spark, tmp_path):
    from quillvec.llm import queries

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(7))
    first = [word() for _ in range(400)]
    texts = {1: first, 2: [*first[:-1], word()], 3: [word() for _ in range(300)]}
    assert 0 < (plain_fingerprint(" ".join(texts[1])) ^ plain_fingerprint(" ".join(texts[2]))).bit_count() <= 4
    rows = [(k, " ".join(t), "en", f"src{k}", 0) for k, t in texts.items()]
    rows += [(4, "É " + " ".join(texts[3]), "en", "src4", 0), (5, "é " + "  ".join(texts[3]), "en", "src5", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = queries.QUERIES["op1_packing"](spark, f"file://{tmp_path}").collect()
    bins = {r["doc_id"]: r["bin"] for r in got}
    assert sorted(r["doc_id"] for r in got) == [1, 2, 3, 4, 5] and bins[1] != bins[2] and len({bins[k] for k in (4, 5)}) == 2


def test_tightest_compatible_bin():
    import numpy as np

    rng = random.Random(2)
    n = 300
    lengths = np.array(sorted((rng.randint(1, 90) for _ in range(n)), reverse=True))
    sources, clusters = np.array([rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]), np.array([rng.randint(0, 150) for _ in range(n)])
    got = packing.pack_shard(lengths, sources, clusters, 100)
    bins = []
    for length, s, c, b in zip(lengths, sources, clusters, got):
        fits = [k for k, x in enumerate(bins) if x["room"] >= length and s not in x["s"] and c not in x["c"]]
        if fits:
            assert bins[b]["room"] == min(bins[k]["room"] for k in fits) and b in fits
        else:
            assert b == len(bins)
            bins.append({"room": 100, "s": set(), "c": set()})
        bins[b]["room"] -= length
        bins[b]["s"].add(s)
        bins[b]["c"].add(c)


# --- rules --------------------------------------------------------------------------------


def test_base_counts(spark, corpus, texts, edges):
    for df, rows in ((corpus, list(texts.items())), (edges, EDGES)):
        want = Counter()
        for i, t in rows:
            t = t or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            grams = Counter(zip(w, w[1:], w[2:]))
            repeated = {p for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for p in (k, k + 1, k + 2)}
            full = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
            want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(repeated), failed] += 1
        got = quality_rules.judge(df).collect()
        assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got) == want
        assert not any(r["kept"] and r["base_failed"] for r in got)


def test_line_rules(spark):
    cases = {
        "Home | About | Contact | Imprint.": True, "CLICK THIS NOW AND WIN BIG!": True, "a# b# c# d#.": True, "Menu": True, "Please enable JavaScript to go on reading here.": True,
        "go go go go go go go go go go go go.": True, "This is a sentence that someone wrote.": False, "Es war einmal ein König, der hatte drei Söhne.": False, "Yes.": False,
        "A line that simply stops and is no sentence at all": True, "Alle Rechte vorbehalten, 2020.": True, "Tous droits réservés.": True, "Consulte la política de privacidad.": True, "これは文です。": False, "هل هذا سؤال؟": False,
        "a first step, then a second one, and so on; see there:": False, "GROSS GESCHRIEBEN IST DIESE GANZE ZEILE.": True, " ".join(["click here is said in a long sentence"] * 6) + " " + " ".join(f"w{k}" for k in range(20)) + ".": False,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", quality_rules.verdicts(F.array("t", F.lit("end.")), F.transform(F.array("t", F.lit("end.")), quality_rules.words))[0]["fails"].alias("f"))
    assert {r["t"]: r["f"] for r in df.collect()} == cases
    last = spark.createDataFrame([("A last line cut off in the midd",), ("Cut off",)], "t string").select(quality_rules.verdicts(F.array("t"), F.array(quality_rules.words(F.col("t"))))[0]["fails"].alias("f"))
    assert [r["f"] for r in last.collect()] == [False, True]


def test_cleaning_keeps_good_lines(spark, docs_of):
    good = "\n".join(" ".join(f"word{k * 9 + j}" for j in range(9)) + "." for k in range(12))
    out = quality_rules.clean(docs_of([(1, good.replace("\n", "\n\n", 1) + "\nHome | About | Contact | News"), (2, "\n".join(["Home | About | Contact | News"] * 30)), (3, None)])).collect()
    assert [(r["doc_id"], r["text"]) for r in out] == [(1, good.replace("\n", "\n\n", 1))]


# --- decontamination ----------------------------------------------------------------------


def test_leaks_match_search(spark, corpus, texts):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r["item_id"]: " ".join(r["text"].split()) for r in benchmark.collect()}
    want = {(i, k) for i, t in texts.items() for k, b in items.items() if b in " ".join(t.split())}
    for limit in (64 << 20, 0):  # broadcast, and joined by a shuffle
        got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(corpus, benchmark, broadcast_bytes=limit).collect()}
        assert want <= got and {i for i, _ in got} == {i for i, _ in want}
    assert {r["doc_id"] for r in decontamination.remove(corpus, benchmark).collect()} == set(texts) - {i for i, _ in want}


def test_templates_and_slots(spark, docs_of):
    item = "if the trader Alice buys 12 apples for 5 dollars each and then sells 12 apples to Robert for 7 dollars each how much does Alice earn"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [
        (1, "before it " + item + " and after"),
        (2, "x y z " + item.replace("12", "31").replace("Alice", "Maria").replace("Robert", "Kim").replace("dollars", "euros").replace("5 euros", "4 euros")),
        (3, item.replace("12 apples for", "31 apples for")),  # one value becomes two: not the same question
        (4, item.upper()), (5, "the trader buys some apples and then sells them"), (6, " ".join(item.split()[:9]) + " nothing else here"),
    ]
    got = {r["doc_id"]: (r["altered"], r["n_slots"] > 0) for r in decontamination.leaks(docs_of(rows), benchmark).collect()}
    assert got[1] == (False, True) and got[2] == (True, True) and set(got) <= {1, 2, 4}


def test_changed_copies_are_leaks(spark, docs_of):
    """Words put in, left out and replaced, parts of an item, items shorter than a window."""
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("aeioulnrst") for _ in range(7 * n))
    words = lambda n: [text(1) for _ in range(n)]
    items = [words(n) for n in (24, 30, 37, 50)]
    short = ["zulu", "yankee", "xray"]
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate([*items, short, ["42"]])], "item_id long, text string")
    rows, want = [], {}
    for k, w in enumerate(items):
        m, n = len(w) // 2, len(w)
        changed = {"in": w[:m] + words(1) + w[m:], "three in": w[:m] + words(3) + w[m:], "many in": w[:m] + words(12) + w[m:], "out": w[:m] + w[m + 1 :], "replaced": w[:m] + words(1) + w[m + 1 :], "first": w[: -(-55 * n // 100)]}
        for kind, part in changed.items():
            for at in range(4):
                want[len(rows)] = k, n if kind.endswith("in") else len(part) if kind == "first" else n - 1
                rows.append((len(rows), " ".join(words(9 + at) + part + words(9))))
    wanted = dict(want)
    for k, w in enumerate(items):
        rows.append((len(rows), " ".join(words(5) + w[: len(w) // 2 - 1] + words(9))))  # under half
    for t, hit in ((" ".join([*words(3), *short, *words(2)]), 4), ("yankee zulu xray", None), ("the 42 of it", 5), ("the 43 of it", None)):
        if hit is not None:
            wanted[len(rows)] = hit, 3 if hit == 4 else 1
        rows.append((len(rows), t))
    for limit in (64 << 20, 0):
        got = {r["doc_id"]: (r["item_id"], r["covered_tokens"]) for r in decontamination.leaks(docs_of(rows), benchmark, broadcast_bytes=limit).collect()}
        assert got == wanted


def plain_leaks(templates, items, window, cover):
    """(document, item, covered) by looking at all pairs of windows; templates and items: id to (tokens, raw)."""
    marks = set(decontamination.PLACEHOLDERS)
    out = set()
    for i, (tokens, raw) in templates.items():
        for k, (of, own) in items.items():
            size, n = min(window, len(of)), len(of)
            hits = {}
            coverable = set()
            for a in range(n - size + 1):
                alone = set(of[a : a + size]) <= marks
                if not alone:
                    coverable |= set(range(a, a + size))
                for b in range(len(tokens) - size + 1):
                    if tokens[b : b + size] == of[a : a + size] and (not alone or raw[b : b + size] == own[a : a + size]):
                        hits.setdefault(b - a, []).append((a, b))
            best = None
            for level, reach in enumerate((0, min(window, n), n)):
                for d in hits:
                    found = [x for e in hits if d <= e <= d + reach for x in hits[e]]
                    covered = {a + j for a, _ in found for j in range(size)}
                    pairs = {(own[a + j], raw[b + j]) for a, b in found for j in range(size) if of[a + j] in marks}
                    if len(covered) >= -(-len(coverable or range(n)) * cover // 1) and len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs}):
                        best = max(best or 0, len(covered))
            if best:
                out.add((i, k, best))
    return out


def test_leaks_match_brute_force(spark, docs_of):
    """Few words, so that windows match by chance, in shifted order and with numbers, units and names."""
    rng = random.Random(12)
    pool = ["red", "blue", "and", "km", "Anna", "Bob", "7", "8", "12,5", "the", "of", "--", "goes."]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(k, text(rng.randint(1, 14))) for k in range(40)] + [(40, "1 2 3 4 5 6"), (41, "9 9 9 9 9")]
    rows = [(i, text(rng.randint(0, 40))) for i in range(60)] + [(60 + i, f"{text(6)} {rng.choice(items)[1]} {text(6)}") for i in range(40)]
    rows += [(100, "0 1 2 3 4 5 6 7"), (101, "1 2 3 4 5 7 6"), (102, "9 " * 30)]
    benchmark, docs = spark.createDataFrame(items, "item_id long, text string"), docs_of(rows)
    for window in (3, 5):
        shown = lambda df, c: {r[c]: (list(r["tokens"]), list(r["raw"] or r["tokens"])) for r in decontamination.templates(df.select(c, "text")).collect()}  # noqa: E731, B023
        want = plain_leaks(shown(docs, "doc_id"), {k: x for k, x in shown(benchmark, "item_id").items() if x[0]}, window, 0.5)
        got = {(r["doc_id"], r["item_id"], r["covered_tokens"]) for r in decontamination.leaks(docs, benchmark, window=window).collect()}
        assert got == want and len(want) > 50


def test_edited_and_reparameterised_copies(spark, docs_of):
    """One word put in anywhere, one in twelve replaced, numbers and names swapped, at any offset; columns of numbers are no leaks."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 9)))
    items, rows, want = [], [], set()
    for k in range(60):
        w = [word() for _ in range(rng.randint(24, 48))]
        for at in range(5, len(w), 6):
            w[at] = rng.choice(["12", "345", "Alice", "Bob", "7.5", "Carla"]) + str(at) * w[at].startswith("1")
        items.append((k, " ".join(w)))
        names = {x: (str(rng.randint(1000, 9999)) if x[0].isdigit() else rng.choice(["Dora", "Emil", "Frida"]) + x.lower()) for x in w if x[0].isdigit() or x[0].isupper()}
        at = rng.randint(1, len(w) - 1)
        for part in (w, [*w[:at], word(), *w[at:]], [word() if j % 12 == at % 12 else x for j, x in enumerate(w)], [names.get(x, x) for x in w]):
            want.add((len(rows), k))
            rows.append((len(rows), " ".join([word() for _ in range(rng.randint(1, 40))] + part + [word() for _ in range(20)])))
    numbers = " ".join(str(rng.randint(0, 10**6)) for _ in range(4000))
    items += [(100 + k, " ".join(str(rng.randint(0, 10**6)) for _ in range(20))) for k in range(50)]
    rows.append((len(rows), numbers))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs_of(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert not got - want and len(got) >= 0.95 * len(want)


# --- pseudonyms ---------------------------------------------------------------------------

PRIVATE = [
    "card 4111 1111 1111 1111 x", "4111-1111-1111-1111", "ssn 123-45-6789 000-12-3456", "born 1990-02-28, 31/12/1999 and 2023-02-30", "ip 10.0.0.1 and 999.1.1.1", "+1 (017) 555-7713 or 555-123-4567",
    'key "B44E15E09FD311C3CF3163B66D5A9875B883D8CE" b44e15e09fd311c3cf3163b66d5a9875b883d8ce', "4845168114407329 4845168114407329 1234567890123456", "nothing 12 here", "1600-01-01", "899-99-9999 001-01-0001",
    "12/25/1990 and 03/04/1990, 31.12.1999 02/30/1990 1.2.3", "+49 30 1234567 or +33 1 23 45 67 89, +891 1 23 45 67 89", "DE89 3704 0044 0532 0130 00, FR1420041010050500013M02606 and DE88370400440532013000", "3782 822463 10005 or 3714-496353-98431",
]


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_round_trip_and_keep_their_format(spark):
    df = spark.createDataFrame(list(enumerate(PRIVATE)), "k int, text string")
    hidden = pii.pseudonymise(df, "secret")
    back = pii.pseudonymise(hidden, "secret", found_col="again", back=True)
    rows = {r["k"]: r for r in hidden.collect()}
    assert {r["k"]: r["text"] for r in back.collect()} == dict(enumerate(PRIVATE))
    shape = lambda t: re.sub(r"[A-F]", "H", re.sub(r"\d", "9", re.sub(r"(?<=[0-9a-f])[a-f](?=[0-9a-f])", "h", t)))
    assert "02/30/1990 1.2.3" in rows[11]["text"] and rows[11]["text"][:10] != "12/25/1990" and int(rows[11]["text"][3:5]) > 12 and rows[12]["text"].endswith("+891 1 23 45 67 89")
    assert rows[13]["pii"] == ["account"] * 2 and rows[13]["text"].endswith("DE88370400440532013000") and iban_ok(rows[13]["text"].split(",")[0]) and rows[14]["pii"] == ["card"] * 2
    for k, text in enumerate(PRIVATE):
        if k not in (4, 6):
            assert shape(rows[k]["text"]) == shape(text)
    assert rows[0]["pii"] == ["card"] and luhn(re.sub(r"\D", "", rows[0]["text"])) and rows[0]["text"] != PRIVATE[0]
    assert re.sub(r"\D", "", rows[0]["text"]) == re.sub(r"\D", "", rows[1]["text"])  # linked across documents
    assert rows[7]["text"].endswith(" 1234567890123456") and len(set(rows[7]["text"].split())) == 2
    assert "000-12-3456" in rows[2]["text"] and "2023-02-30" in rows[3]["text"] and "999.1.1.1" in rows[4]["text"] and rows[8]["text"] == PRIVATE[8] and rows[9]["text"] == PRIVATE[9]
    assert all(0 <= int(p) < 256 for p in re.search(r"\d+\.\d+\.\d+\.\d+", rows[4]["text"]).group().split("."))
    other = {r["k"]: r["text"] for r in pii.pseudonymise(df, "another").collect()}
    assert other[0] != rows[0]["text"]


def plain_feistel(x, a, b, kind, key="secret"):
    left, right = divmod(x, b)
    for k in range(10):
        value = lambda half: int(hashlib.sha256(f"{key}|{kind}|{k}|{half}".encode()).hexdigest()[:15], 16)  # noqa: E731, B023
        if k % 2 == 0:
            left = (left + value(right)) % a
        else:
            right = (right + value(left)) % b
    return left * b + right


def plain_digits(d, kind):
    half = len(d) // 2
    return str(plain_feistel(int(d), 10**half, 10 ** (len(d) - half), kind)).zfill(len(d))


def plain_fill(form, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def plain_date(x):
    form = "%Y-%m-%d" if x[4] == "-" else "%d.%m.%Y" if x[2] == "." else "%d/%m/%Y"
    try:
        day = datetime.datetime.strptime(x, form)
    except ValueError:
        form = "%m/%d/%Y"
        day = datetime.datetime.strptime(x, form)
    first = datetime.datetime(1800, 1, 1)
    n = plain_feistel((day - first).days, 189, 773, "date")
    while form == "%m/%d/%Y" and (first + datetime.timedelta(n)).day <= 12:
        n = plain_feistel(n, 189, 773, "date")
    return (first + datetime.timedelta(n)).strftime(form)


def plain_card(x):
    raw = re.sub(r"\D", "", x)
    body = plain_digits(raw[:-1], "card")
    return plain_fill(x, next(body + c for c in "0123456789" if luhn(body + c)))


def iban_ok(x):
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def plain_account(x):
    raw = x.replace(" ", "")
    d = re.sub(r"\D", "", raw[4:])
    if len(d) <= 18:
        d = plain_digits(d, "account")
    else:
        high, low = d[:18], d[18:]
        high = plain_digits(high, f"account0|{low}")
        low = plain_digits(low, f"account1|{high}")
        d = plain_digits(high, f"account2|{low}") + low
    body = plain_fill(raw[4:], d)
    return plain_fill(x, next(f"{c:02}" for c in range(2, 99) if iban_ok(f"{raw[:2]}{c:02}{body}")) + re.sub(r"\D", "", body))


def plain_address(x):
    n = 0
    for p in x.split("."):
        n = n * 256 + int(p)
    n = plain_feistel(n, 1 << 16, 1 << 16, "address")
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


def plain_social(x):
    area, group, serial = map(int, x.split("-"))
    side = 99 * 9999
    n = plain_feistel((area - 2 if area > 666 else area - 1) * side + (group - 1) * 9999 + serial - 1, 898, side, "social")
    area, rest = divmod(n, side)
    return f"{area + 2 if area >= 665 else area + 1:03}-{rest // 9999 + 1:02}-{rest % 9999 + 1:04}"


def plain_secret(x):
    out = ""
    for k in range(0, len(x), 12):
        part = x[k : k + 12]
        half = len(part) // 2
        out += f"{plain_feistel(int(part, 16), 16**half, 16 ** (len(part) - half), 'secret'):x}".zfill(len(part))
    return out.upper() if x.upper() == x else out


def plain_mail(x):
    name, domain = x.split("@")
    return "u" + hashlib.sha256(f"secret|mail|{name.lower()}|{domain.lower()}".encode()).hexdigest()[:32] + "@" + domain


def test_pseudonyms_match_another_implementation(spark):
    """Every kind against plain Python with its own hash, numbers, dates and check digits."""
    phone = lambda keep: lambda x: plain_fill(x, (d := re.sub(r"\D", "", x))[:keep] + plain_digits(d[keep:], "phone"))
    cases = {
        "1990-02-28": plain_date, "31/12/1999": plain_date, "12/25/1990": plain_date, "02/13/1804": plain_date, "31.12.1999": plain_date, "29/02/2000": plain_date, "03/04/1990": plain_date, "2199-12-31": plain_date,
        "4111 1111 1111 1111": plain_card, "4111-1111-1111-1111": plain_card, "378282246310005": plain_card, "3782 822463 10005": plain_card, "6304 0000 0000 0000 000": plain_card,
        "DE89 3704 0044 0532 0130 00": plain_account, "GB82WEST12345698765432": plain_account, "FR1420041010050500013M02606": plain_account, "ES9121000418450200051332": plain_account, "NO9386011117947": plain_account,
        "10.0.0.1": plain_address, "255.255.255.255": plain_address, "123-45-6789": plain_social, "899-99-9999": plain_social, "667-01-0001": plain_social, "+1 (017) 555-7713": phone(1), "555-123-4567": phone(0),
        "+49 30 1234567": phone(2), "+33 1 23 45 67 89": phone(2), "+353 1 234 5678": phone(3), "B44E15E09FD311C3CF3163B66D5A9875B883D8CE": plain_secret, "b44e15e09fd311c3cf3163b66d5a9875b883d8ce00": plain_secret, "A.b+c@Mail.example.org": plain_mail,
    }
    df = spark.createDataFrame([(k, f"see {x}, then") for k, x in enumerate(cases)], "k int, text string")
    got = {r["k"]: r["text"] for r in pii.pseudonymise(df, "secret").collect()}
    for k, (x, of) in enumerate(cases.items()):
        assert got[k] == f"see {of(x)}, then", x
        assert of(x) != x
    back = {r["k"]: r["text"] for r in pii.pseudonymise(spark.createDataFrame(list(got.items()), "k int, text string"), "secret", back=True).collect()}
    assert all(back[k] == f"see {x}, then" for k, x in enumerate(cases) if "@" not in x)


def test_dates_are_permuted_within_their_form(spark):
    """Month-first dates stay so, and no two dates meet."""
    days = [datetime.date(1990, 1, 1) + datetime.timedelta(k) for k in range(0, 1200, 3)]
    rows = [(k, f.format(d=d)) for k, (d, f) in enumerate((d, f) for d in days for f in ("{d:%Y-%m-%d}", "{d:%d/%m/%Y}", "{d:%m/%d/%Y}") if f != "{d:%m/%d/%Y}" or d.day > 12)]
    got = [r["text"] for r in pii.pseudonymise(spark.createDataFrame(rows, "k int, text string"), "secret").orderBy("k").collect()]
    assert len(set(got)) == len(got) and all((int(a[3:5]) > 12) == (int(b[3:5]) > 12) for (_, a), b in zip(rows, got) if "/" in a)


def test_feistel_is_a_permutation(spark):
    for a, b in ((7, 11), (1, 50), (100, 100)):
        df = spark.range(a * b).select("id", pii.feistel(F.col("id"), F.lit(a).cast("long"), F.lit(b).cast("long"), "k", "t").alias("p"))
        values = [r["p"] for r in df.collect()]
        assert sorted(values) == list(range(a * b))


def test_mail_is_linked(spark):
    df = spark.createDataFrame([(1, "a.b@x.org, A.B@X.org; c@x.org")], "k int, text string")
    found = re.findall(r"\S+@[A-Za-z.]+", pii.pseudonymise(df, "k").first()["text"])
    assert found[0].split("@")[0] == found[1].split("@")[0] != found[2].split("@")[0]


# --- learned ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def large(spark):
    root = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")


def test_toxicity_on_held_out_rows(large):
    docs, labels = large
    scored = toxicity.score(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (scored.held_out == scored.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all() and scored.score.between(0, 1).all()
    clean = scored[scored.toxic == 0]
    assert (clean.predicted == 0).mean() > 0.98 and scored[scored.toxic == 1].predicted.mean() > 0.6


def test_held_out_labels_are_not_used(large):
    docs, labels = large
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.score(docs, x).orderBy("doc_id").toPandas() for x in (labels, flipped))
    pd.testing.assert_series_equal(a.score, b.score)


def test_label_model_recovers_voters():
    import numpy as np

    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.2
    votes = np.zeros(20_000, np.int64)
    for k, (hit, false) in enumerate([(0.8, 0.05), (0.6, 0.1)]):
        votes |= np.where(rng.random(20_000) < np.where(y, hit, false), 1 << k, 0)
    votes |= (votes >> 1 & 1) << 2  # a voter that copies another
    votes = np.where(votes == 0, 1 << toxicity.NONE, votes)
    gold = np.where(rng.random(20_000) < 0.2, y.astype(int), -1)
    patterns, count = np.unique(np.stack([votes, gold], 1), axis=0, return_counts=True)
    model = toxicity.LabelModel.fit(patterns[:, 0], patterns[:, 1], count)
    assert model.prior == pytest.approx(0.2, abs=0.15) and any({1, 2} <= set(c) for c in model.cliques)
    post = model.posterior(votes, np.full(20_000, -1))
    assert post[y].mean() > post[~y].mean() + 0.4


def test_label_model_matches_plain_em():
    """Rows one by one, voters by their definition: prior, tables and posteriors after the same rounds."""
    import numpy as np

    rng = np.random.default_rng(4)
    n, voters = 400, len(toxicity.VOTERS)
    fired = rng.random((n, voters)) < rng.uniform(0.05, 0.4, voters)
    fired[:, toxicity.NONE] = ~fired[:, : toxicity.NONE].any(axis=1)
    gold = rng.choice([-1, -1, 0, 1], n)
    votes = (fired.astype(np.int64) << np.arange(voters)).sum(axis=1)
    patterns, count = np.unique(np.stack([votes, gold], 1), axis=0, return_counts=True)
    model = toxicity.LabelModel.fit(patterns[:, 0], patterns[:, 1], count, rounds=4, tied=9.0)
    q = np.array([abs(g - 0.02) if g >= 0 else 0.05 if f[toxicity.NONE] else 0.8 for f, g in zip(fired, gold)])
    for _ in range(8):
        prior = min(0.5, max(1e-3, q.sum() / n))
        weight = {0: 1 - q, 1: q}
        rate = {(c, v): (sum(w for w, f in zip(weight[c], fired[:, v]) if f) + 0.05) / (weight[c].sum() + 0.1) for c in (0, 1) for v in range(voters)}
        seen = {(c, g): weight[c][gold == g].sum() + 0.05 for c in (0, 1) for g in (-1, 0, 1)}
        labelled = sum(x for (_, g), x in seen.items() if g >= 0) / sum(seen.values())
        likely = {(c, g): 1 - labelled if g < 0 else labelled * seen[c, g] / (seen[c, 0] + seen[c, 1]) for c in (0, 1) for g in (-1, 0, 1)}
        both = [[(prior if c else 1 - prior) * likely[c, g] * np.prod([rate[c, v] if f[v] else 1 - rate[c, v] for v in range(voters)]) for c in (0, 1)] for f, g in zip(fired, gold)]
        q = np.array([b / (a + b) for a, b in both])
    assert model.prior == pytest.approx(prior, rel=1e-6)
    for clique, table in zip(model.cliques, model.tables):
        assert table[:, 1] == pytest.approx([rate[c, clique[0]] for c in (0, 1)], rel=1e-6)
    assert model.posterior(votes, gold) == pytest.approx(q, rel=1e-6)


def test_looking_at_texts_matches_plain_voters():
    """Votes, counts and words of a batch against one text at a time."""
    import numpy as np

    rng = random.Random(8)
    pool = ["you", "idiot", "IDIOT", "Idiot", "trash", "kill", "stupid", "the", "plane", "trapdoor", "x1y", "Müll", "ein", "du"]
    texts = ["", "   ", "you are an idiot", *(" ".join(rng.choice(pool) for _ in range(rng.randint(1, 120))) for _ in range(150))]
    keys = frozenset([zlib.crc32(b"tra") << 4 | 3, zlib.crc32(b"plane") << 4 | toxicity.WHOLE])
    got = toxicity.look(texts, toxicity.Words(keys))
    for k, t in enumerate(texts):
        words = re.findall(r"[^\W\d_]+", t.lower())
        hits, stems = [w for w in words if w in toxicity.OF], [w for w in words if w.startswith("tra") or w == "plane"]
        want = {list(toxicity.LEXICONS)[toxicity.OF[w]] for w in hits}
        if any(w in toxicity.AIMED for j, x in enumerate(words) if x in toxicity.OF for w in words[max(0, j - 3) : j]):
            want.add("aimed")
        want |= {name for name, on in (("several", len(hits) >= 2), ("dense", hits and 50 * len(hits) >= len(words)), ("shouted", any(w.upper() in t for w in hits)), ("varied", len(set(hits)) >= 2)) if on}
        want |= {name for name, on in (("stem", stems), ("stems", len(stems) > 1), ("stem_dense", stems and 200 * len(stems) >= len(words))) if on}
        assert {v for j, v in enumerate(toxicity.VOTERS) if got["votes"][k] >> j & 1} == (want or {"none"})
        assert (got["stemmed"][k], got["n"][k]) == (len(stems), len(words))
        assert set(got["words"][k].tolist()) == {toxicity.bucket(w, toxicity.BUCKETS) for w in words} | {toxicity.bucket(w[:5], toxicity.BUCKETS, 1) for w in words}
    columns = [got[c] for c in ("votes", "stemmed", "n")]
    weights = np.random.default_rng(2).normal(size=1 + len(toxicity.VOTERS) + toxicity.DENSE + toxicity.BUCKETS)
    assert toxicity.scores(weights, *columns, got["words"]) == pytest.approx(toxicity.sigmoid(toxicity.rows_of(*columns, got["words"]).dot(weights)), abs=1e-4)


def test_ordinal_gradient_is_that_of_the_likelihood():
    """The loss from its definition, the gradient by small steps."""
    import numpy as np

    from quillvec.llm.linear import Rows

    rng = np.random.default_rng(3)
    size, n, pull = 6, 40, 0.01
    index = [np.sort(rng.choice(size, 3, replace=False)) for _ in range(n)]
    value = [rng.normal(size=3).astype(np.float32) for _ in range(n)]
    rows, grades = Rows(index, value), rng.integers(0, 4, n)
    x = rng.normal(size=size + 3) * 0.3
    cut = [-np.inf, x[size], x[size] + np.exp(x[size + 1]), x[size] + np.exp(x[size + 1]) + np.exp(x[size + 2]), np.inf]
    s = lambda z: 1 / (1 + np.exp(-z))
    plain = np.mean([-np.log(s(cut[g + 1] - sum(x[i] * v for i, v in zip(ii, vv))) - s(cut[g] - sum(x[i] * v for i, v in zip(ii, vv)))) for ii, vv, g in zip(index, value, grades)]) + pull / 2 * (x[:size] ** 2).sum()
    loss = lambda y: quality_classifier.loss(y, rows, grades, size, pull)
    assert loss(x) == pytest.approx(plain, abs=1e-5)
    steps = np.eye(size + 3) * 1e-2
    assert quality_classifier.gradient(x, rows, grades, size, pull) == pytest.approx([(loss(x + d) - loss(x - d)) / 2e-2 for d in steps], abs=2e-3)


@given(st.text(alphabet=st.sampled_from(list("abAB12.,!!é日-")), min_size=1, max_size=8))
@settings(deadline=None, max_examples=300)
def test_word_shapes(word):
    plain = word
    for pattern, by in quality_classifier.SHAPES:
        plain = pattern.sub(by, plain)
    assert quality_classifier.shape(word) == plain[:12]


def test_scores_of_texts_match_their_sparse_rows():
    import numpy as np

    texts = ["", "one", "Ruin!! ruin ruin RUIN!! 12 34", "a b a b c " * 40]
    seen = quality_classifier.look(texts)
    weights = np.random.default_rng(1).normal(size=quality_classifier.BUCKETS + quality_classifier.EXTRA)
    assert seen.value(weights) == pytest.approx(seen.rows().dot(weights), abs=1e-4)
    words = texts[2].split()
    assert seen.extra[2].tolist() == pytest.approx([1, 2 * len(set(words)) / 6, 4 / 6, np.log1p(6) / 8])


def test_token_count_query(spark, library, edges, tmp_path):
    """The DataFrame, with bytes and limit, for nulls, long words and special strings."""
    from quillvec.llm import queries

    rng = random.Random(9)
    rows = [*EDGES, *((100 + k, t) for k, t in enumerate(HARD)), (300, "".join(rng.choice("abcdefghij") for _ in range(60_000))), (301, "日本" * 20_000)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in queries.QUERIES["op9_token_counts"](spark, f"file://{tmp_path}").select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())
    want = Counter()
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 512] += 1
    assert got == want


@pytest.mark.parametrize("states", [130_000, 1500])
def test_long_words_through_composed_maps(library, monkeypatch, states):
    """Words of many chunks, also where the table of states is dropped on the way."""
    monkeypatch.setattr(token_counts, "MAX_STATES", states)
    own = token_counts.Transducer(token_counts.vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    rng = random.Random(states)
    some = ["".join(rng.choice(alphabet) for _ in range(n)) for alphabet, n in (("abcdefghijklmnopqrstuvwxyz", 9000), ("ab", 20_000), ("aeiou", 5000), ("=-", 7000), ("日本語", 4000), ("the", 30_000))]
    some += ["x " + "a" * 10_000 + " y " + "ab" * 4000, "a" * 511, "a" * 512, "a" * 513, "a" * 1024, " " + "b" * 1023]
    assert own.counts(some).tolist() == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]
    assert own.counts(["".join(rng.choices("abcdefgh", k=2_000_000))])[0] > 0


def test_grades_on_held_out_rows(large):
    docs, labels = large
    got = quality_classifier.grade(docs, quality_classifier.grades_of(labels), 3).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert ((held.tail_probability >= 0.5) == (held.quality == 1)).mean() > 0.95 and got.expected_grade.between(0, 2).all()


def test_ordinal_thresholds_are_ordered():
    import numpy as np

    from quillvec.llm.linear import Rows

    rng = np.random.default_rng(0)
    x = rng.normal(size=600)
    grades = np.digitize(x + rng.normal(size=600) * 0.2, [-0.5, 0.7])
    model = quality_classifier.Ordinal.fit(Rows([np.array([3])] * 600, [np.array([v]) for v in x]), grades, 3, steps=400)
    assert model.thresholds[0] < model.thresholds[1] and model.weights[3] > 1
    assert model.thresholds / model.weights[3] == pytest.approx([-0.5, 0.7], abs=0.15)
