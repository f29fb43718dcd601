"""Toxicity by weak supervision.

Many lexicon and pattern voters look at every text.  Two of them use stems (word
beginnings) induced from labelled rows outside the held-out fold, as no list knows
the words of every language: a greedy cover of the toxic rows of a bounded sample
by stems that other rows hardly have.  A generative label model,
fitted by expectation maximisation to the counts of all vote patterns of the
corpus, estimates how often each voter fires on toxic and other texts.  Voters
that stay correlated given the label are joined into cliques, whose joint votes
are modelled as one.  Known labels (of rows outside the held-out fold) are one
more voter.  The posterior labels of bounded samples of labelled and of unlabelled
documents outside that fold then train a logistic regression on votes and hashed
words, which gives the score.

Every text is looked at once: votes and hashed words are written down, and the fit
and the scores come from what is written.  (`reject` looks at texts again, as it returns them.)

What reaches the driver: one count for each pattern of votes seen (at most
3 * 2 ** len(VOTERS), some hundreds in practice, however many rows there are), at
most `MOST_KEYS` stem keys with their counts, those of them that a toxic row of the
sample has, and `2 * fit_rows` sets of hashed words of at most 2 * BUCKETS bytes each.

Null and empty texts are scored like any text without a vote; texts of any length are
read whole.  Repeated rows are each scored alike.  Of several texts of a labelled id
the least trains, of several labels the greater counts.  An empty table gives no rows;
without labels the label model starts from the voters alone.  Other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.llm.common import discard, durable, held, parts, python_udf
from quillvec.llm.linear import Rows, adam, bucket, held_out, sigmoid, training_rows

LEXICONS: dict[str, frozenset[str]] = {
    name: frozenset(words.split())
    for name, words in {
        "insult": "idiot idiots idiotic moron morons moronic imbecile imbeciles cretin dimwit halfwit fool dunce dumbass jackass jerk clown clowns loser losers stupid dumb dolt nitwit simpleton",
        "degrade": "pathetic worthless disgusting useless revolting repulsive contemptible despicable hideous laughable incompetent",
        "dehumanise": "scum trash garbage filth vermin parasite parasites subhuman subhumans cockroach cockroaches pig pigs rat rats leech leeches lowlife degenerate degenerates",
        "profanity": "fuck fucking fucked fucker shit shitty bullshit bitch bitches bastard bastards asshole assholes arsehole crap damn prick dickhead twat wanker motherfucker cunt slut whore",
        "threat": "kill murder strangle hang lynch exterminate hurt beat stab shoot rape",
        "spanish": "idiota idiotas imbécil imbéciles estúpido estúpida estúpidos basura asqueroso asquerosa escoria inútil payaso perdedor mierda puta pendejo cabrón gilipollas patético patética",
        "french": "idiote idiots imbécile imbéciles stupides ordure ordures dégoûtant dégoûtante salaud salope connard connasse merde crétin pathétique minable abruti bouffon raclure",
        "german": "idioten dummkopf dumm dummer trottel abschaum widerlich erbärmlich wertlos versager arschloch scheiße scheisse hurensohn müll schwachkopf dreck abstoßend",
    }.items()
}
OF = {w: k for k, (_, words) in enumerate(LEXICONS.items()) for w in words}
AIMED = frozenset("you your you're youre yourself u he she they these those such what total complete absolute du ihr sie dieser tu eres usted ustedes este vous ces cet toi".split())
VOTERS = [*LEXICONS, "aimed", "several", "dense", "shouted", "varied", "stem", "stems", "stem_dense", "none"]
NONE = len(VOTERS) - 1
LETTERS = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 14
#: Features that grow with the words that have an induced stem.
DENSE = 2
#: Lengths of stems, and what stands for a whole word.
STEMS, WHOLE = range(3, 9), 15
REMEMBERED = 100_000
#: Other rows that a stem may have, as a share of the toxic ones.
SPARE = 0.15
#: Stem keys of toxic rows that are candidates; the more frequent ones go first.
MOST_KEYS = 1 << 16
#: What is known of a word, in bits: two hash buckets, whether it has a stem, its lexicon and one, whether it points at somebody.
BUCKET_BITS, STEM, LEXICON, POINTS = 14, 28, 29, 33
LOOKED = "votes: long, stemmed: int, n: int, words: array<short>"


def stem_keys(word: str) -> list[int]:
    """`word` and its beginnings, each as crc32 * 16 + length."""
    raw = lambda s: zlib.crc32(s.encode("utf-8", "surrogatepass")) << 4
    return [raw(word) | WHOLE, *(raw(word[:n]) | n for n in STEMS if n <= len(word))]


class Words(dict):
    """By word: the bits above, with stems among `keys`; for the words met last."""

    def __init__(self, keys: frozenset[int] = frozenset()):
        self.keys_in = keys
        self.lengths = sorted({k & 15 for k in keys})

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        stem, size = False, len(word)
        for n in self.lengths:
            if n == WHOLE or n <= size:
                if (zlib.crc32((word if n == WHOLE else word[:n]).encode("utf-8", "surrogatepass")) << 4 | n) in self.keys_in:
                    stem = True
                    break
        found = bucket(word, BUCKETS) | bucket(word[:5], BUCKETS, 1) << BUCKET_BITS | stem << STEM | (OF.get(word, -1) + 1) << LEXICON | (word in AIMED) << POINTS
        self[word] = found
        return found


def known_words(keys: frozenset[int]) -> Words:
    """One for each Python worker, kept from batch to batch."""
    return held(f"words {hash(keys)}", lambda: Words(keys))


def candidates(keys: list[np.ndarray], least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Keys that `least` toxic rows or more have, ascending, and how many do."""
    every, count = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_counts=True)
    return every[count >= least].astype(np.int64), count[count >= least]


def induced(keys: list[np.ndarray], clean: dict[int, int], least: int = 3, spare: float = SPARE) -> frozenset[int]:
    """Stems that cover the toxic rows: each adds `least` rows or more, and has at most `spare` as many other rows (`clean`)."""
    every, count = candidates(keys, least)
    every = every[np.array([clean.get(k, 0) for k in every.tolist()], np.int64) <= spare * count]
    chosen = set()
    open_rows = [r for r in (np.flatnonzero(np.isin(every, k, assume_unique=True)) for k in keys) if len(r)]
    while open_rows:
        gain = np.bincount(np.concatenate(open_rows), minlength=len(every))
        if gain.max() < least:
            break
        ties = np.flatnonzero(gain == gain.max())
        best = ties[np.lexsort((every[ties], -(every[ties] & 15)))[0]]
        chosen.add(int(every[best]))
        open_rows = [r for r in open_rows if best not in r]
    return frozenset(chosen)


def look(texts: list[str], known: Words) -> dict[str, object]:
    """For each text: the votes as a bit mask, how many words have a stem, how many there are, and the buckets of its words."""
    low = [LETTERS.findall(t.lower()) for t in texts]
    n = np.array([len(x) for x in low], np.int64)
    end = np.cumsum(n)
    first = end - n
    code = np.fromiter(map(known.__getitem__, chain.from_iterable(low)), np.int64, int(n.sum()))
    doc = np.repeat(np.arange(len(texts)), n)
    count = lambda where: np.bincount(doc[where], minlength=len(texts))
    stemmed = count(np.flatnonzero(code >> STEM & 1))
    places = np.flatnonzero(code >> LEXICON & 15)
    of, hits, size = (code[places] >> LEXICON & 15) - 1, count(places), len(LEXICONS)
    votes = np.zeros(len(texts), np.int64)
    for k in range(size):
        votes |= (count(places[of == k]) > 0).astype(np.int64) << k
    for back in (1, 2, 3):
        near = places[places - back >= first[doc[places]]]
        votes |= (count(near[code[near - back] >> POINTS & 1 == 1]) > 0).astype(np.int64) << size
    votes |= (hits >= 2).astype(np.int64) << size + 1
    votes |= ((hits > 0) & (50 * hits >= n)).astype(np.int64) << size + 2
    for k in np.flatnonzero(hits).tolist():
        found = {w for w in low[k] if w in OF}
        votes[k] |= any(w.upper() in texts[k] for w in found) << size + 3 | (len(found) >= 2) << size + 4
    votes |= (stemmed > 0).astype(np.int64) << size + 5 | (stemmed > 1).astype(np.int64) << size + 6 | ((stemmed > 0) & (200 * stemmed >= n)).astype(np.int64) << size + 7
    votes[votes == 0] = 1 << NONE
    one, two = code & BUCKETS - 1, code >> BUCKET_BITS & BUCKETS - 1
    seen, words = np.zeros(BUCKETS, bool), []
    for a, b in zip(first.tolist(), end.tolist()):
        seen[one[a:b]] = seen[two[a:b]] = True
        words.append(np.flatnonzero(seen).astype(np.int16))
        seen[words[-1]] = False
    return {"votes": votes, "stemmed": stemmed.astype(np.int32), "n": n.astype(np.int32), "words": words}


def rows_of(votes: np.ndarray, stemmed: np.ndarray, n: np.ndarray, words: list[np.ndarray]) -> Rows:
    """Features: one, the votes at full weight, two that grow with the words that have a stem, then hashed words at a small weight."""
    index, value = [], []
    dense = np.stack([np.log1p(stemmed), np.minimum(1.0, 50 * stemmed / np.maximum(1, n))], 1)
    head = 1 + len(VOTERS) + np.arange(DENSE)
    for v, d, w in zip(votes.tolist(), dense, words):
        own = [0, *(1 + k for k in range(len(VOTERS)) if v >> k & 1)]
        index.append(np.concatenate([own, head, np.asarray(w, np.int64) + 1 + len(VOTERS) + DENSE]).astype(np.int32))
        value.append(np.concatenate([np.ones(len(own)), d, np.full(len(w), 0.3 / max(1, len(w)) ** 0.5)]).astype(np.float32))
    return Rows(index, value)


def scores(weights: np.ndarray, votes: np.ndarray, stemmed: np.ndarray, n: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """The logistic regression on what `look` found."""
    size = np.array([len(w) for w in words], np.int64)
    head = 1 + len(VOTERS)
    total = weights[0] + sum(weights[1 + k] * (votes >> k & 1) for k in range(len(VOTERS)))
    total = total + weights[head] * np.log1p(stemmed) + weights[head + 1] * np.minimum(1.0, 50 * stemmed / np.maximum(1, n))
    sums = np.concatenate([[0.0], np.cumsum(weights[head + DENSE :][np.concatenate([*words, np.zeros(0, np.int16)]).astype(np.int64)])])
    end = np.cumsum(size)
    return sigmoid(total + (sums[end] - sums[end - size]) * 0.3 / np.sqrt(np.maximum(1, size)))


@dataclass
class LabelModel:
    """Class balance, and what each clique of voters does on either class."""

    prior: float
    cliques: list[list[int]]
    tables: list[np.ndarray]  # for each clique: probability of its joint vote by class
    gold: np.ndarray  # by class: no label, 0, 1
    correlation: np.ndarray

    @staticmethod
    def joint(votes: np.ndarray, clique: list[int]) -> np.ndarray:
        return sum(((votes >> v & 1) << k for k, v in enumerate(clique)), np.zeros_like(votes))

    def posterior(self, votes: np.ndarray, gold: np.ndarray) -> np.ndarray:
        logs = np.log([[1 - self.prior], [self.prior]]) + np.log(self.gold[:, gold + 1])
        for clique, table in zip(self.cliques, self.tables):
            logs = logs + np.log(table[:, self.joint(votes, clique)])
        return sigmoid(logs[1] - logs[0])

    def accuracies(self) -> dict[str, float]:
        """How often a voter that fires is right."""
        out = {}
        for clique, table in zip(self.cliques, self.tables):
            for k, v in enumerate(clique):
                fires = (np.arange(table.shape[1]) >> k & 1) == 1
                no, yes = table[0, fires].sum() * (1 - self.prior), table[1, fires].sum() * self.prior
                out[VOTERS[v]] = float(max(no, yes) / (no + yes))
        return out

    @classmethod
    def fit(cls, votes: np.ndarray, gold: np.ndarray, count: np.ndarray, rounds: int = 60, tied: float = 0.5, most: int = 4) -> LabelModel:
        """From pattern counts; gold is -1 without a label.

        Voters whose correlation given the label is over `tied` join a clique of at most `most`.
        """
        q = np.where(gold >= 0, np.abs(gold - 0.02), np.where(votes >> NONE & 1 == 1, 0.05, 0.8))

        def estimate(q: np.ndarray, cliques: list[list[int]]) -> tuple:
            by = np.stack([count * (1 - q), count * q])
            prior = float(np.clip(by[1].sum() / max(by.sum(), 1e-9), 1e-3, 0.5))
            tables = []
            for clique in cliques:
                at = cls.joint(votes, clique)
                t = np.stack([np.bincount(at, b, 1 << len(clique)) for b in by]) + 0.05
                tables.append(t / t.sum(axis=1, keepdims=True))
            g = np.stack([np.bincount(gold + 1, b, 3) for b in by]) + 0.05
            # how often a row is labelled says nothing of its class
            labelled = g[:, 1:].sum() / g.sum()
            g[:, 1:] *= labelled / g[:, 1:].sum(axis=1, keepdims=True)
            g[:, 0] = 1 - labelled
            return prior, tables, g

        cliques = [[k] for k in range(len(VOTERS))]
        correlation = np.zeros((len(VOTERS), len(VOTERS)))
        for phase in range(2):
            for _ in range(rounds):
                prior, tables, g = estimate(q, cliques)
                q = cls(prior, cliques, tables, g, correlation).posterior(votes, gold)
            if phase == 0:
                fired = np.stack([votes >> k & 1 for k in range(len(VOTERS))]).astype(float)
                weight = np.stack([count * (1 - q), count * q])
                mean = (fired @ weight.T) / np.maximum(weight.sum(axis=1), 1e-9)
                left = [(fired - mean[:, [c]]) * np.sqrt(weight[c]) for c in (0, 1)]
                cover = sum(x @ x.T for x in left)
                size = np.sqrt(np.maximum(np.diag(cover), 1e-9))
                correlation = cover / np.outer(size, size)
                for i, j in sorted(zip(*np.triu_indices(len(VOTERS), 1)), key=lambda p: -abs(correlation[p])):
                    a, b = (next(c for c in cliques if v in c) for v in (i, j))
                    if abs(correlation[i, j]) > tied and a is not b and len(a) + len(b) <= most:
                        cliques = [c for c in cliques if c is not a and c is not b] + [sorted(a + b)]
        return cls(prior, cliques, tables, g, correlation)


@dataclass
class Model:
    label_model: LabelModel
    weights: np.ndarray
    stems: frozenset[int]


def stem_keys_column(text: Column, among: np.ndarray | None = None) -> Column:
    """The stem keys of the words of `text`, or those of them that are `among`."""

    @python_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        words = (set(LETTERS.findall((t or "").lower())) for t in texts)
        keys = (np.array(sorted({k for w in ws for k in stem_keys(w)}), np.int64) for ws in words)
        return pd.Series([k if among is None else k[among[np.minimum(np.searchsorted(among, k), len(among) - 1)] == k] for k in keys], dtype=object)

    return of(text)


def induce(sample: DataFrame) -> frozenset[int]:
    """Stems from `sample(gold, text)`; keys are counted on the executors."""
    toxic, clean = sample.where("gold = 1"), sample.where("gold = 0")
    least = max(3, toxic.count() // 100)
    key = F.explode(stem_keys_column(F.col("text"))).alias("key")
    often = toxic.select(key).groupBy("key").count().where(F.col("count") >= least).orderBy(F.desc("count"), "key").limit(MOST_KEYS).toPandas()
    if not len(often):
        return frozenset()
    among = np.sort(often["key"].to_numpy(np.int64))
    others = clean.select(F.explode(stem_keys_column(F.col("text"), among)).alias("key")).groupBy("key").count().toPandas()
    spare = dict(zip(others["key"].tolist(), others["count"].tolist()))
    rare = np.array(sorted(k for k, c in zip(often["key"].tolist(), often["count"].tolist()) if spare.get(k, 0) <= SPARE * c), np.int64)
    if not len(rare):
        return frozenset()
    keys = toxic.select("id", stem_keys_column(F.col("text"), rare).alias("keys")).toPandas().sort_values("id")["keys"]
    return induced([np.asarray(k, np.int64) for k in keys], spare, least)


def looked(docs: DataFrame, stems: frozenset[int], id_col: str, text_col: str) -> DataFrame:
    """`(id, key, ...)`: what `look` finds in every text, written down; `key` orders rows of equal ids."""

    @python_udf(f"struct<{LOOKED}>")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.concat([pd.DataFrame(look(part, known_words(stems))) for part in parts(texts)], ignore_index=True)

    return durable(docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), of(F.col(text_col)).alias("l")).select("id", "key", "l.*"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, fit_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[Model, DataFrame]:
    """The model for `docs`, and what was seen of them; labels of the held-out fold are not looked at."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("gold"))
    known = known.where(~held_out(F.col("id")))
    sample = durable(training_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), known, sample_rows, "id", "text"))
    stems = induce(sample)
    discard(sample)
    seen = looked(docs, stems, id_col, text_col)
    judged = seen.select("id", "key", "votes").join(known, "id", "left").withColumn("gold", F.coalesce("gold", F.lit(-1)))
    counted = judged.groupBy("votes", "gold").count().orderBy("votes", "gold").toPandas()
    label_model = LabelModel.fit(*(counted[c].to_numpy(np.int64) for c in ("votes", "gold", "count")))
    order = [F.xxhash64(F.lit("fit"), "id", "key"), F.col("id"), F.col("key")]
    free = judged.where(~held_out(F.col("id")) & F.col("id").isNotNull()).select("id", "key", "gold")
    part = free.where("gold >= 0").orderBy(*order).limit(fit_rows).unionByName(free.where("gold < 0").orderBy(*order).limit(fit_rows))
    taken = seen.join(F.broadcast(part.distinct()), ["id", "key"]).toPandas().drop_duplicates(["id", "key"]).sort_values(["gold", "id", "key"])
    size = 1 + len(VOTERS) + DENSE + BUCKETS
    if not (taken["gold"] >= 0).any():
        weights = np.zeros(size)
        weights[0], weights[1 + NONE] = 2.0, -4.0
        return Model(label_model, weights, stems), seen
    target = label_model.posterior(taken["votes"].to_numpy(np.int64), taken["gold"].to_numpy(np.int64))
    rows = rows_of(*(taken[c].to_numpy() for c in ("votes", "stemmed", "n")), list(taken["words"]))

    def gradient(w: np.ndarray) -> np.ndarray:
        return rows.back(sigmoid(rows.dot(w)) - target, size) / len(taken) + 1e-4 * w

    return Model(label_model, adam(np.zeros(size), gradient, 200, 0.15), stems), seen


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row a document: `(id_col, held_out, score, predicted)`."""
    model, seen = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    weights = model.weights

    @python_udf("double")
    def of(found: pd.DataFrame) -> pd.Series:
        return pd.Series(scores(weights, *(found[c].to_numpy(np.int64) for c in ("votes", "stemmed", "n")), list(found["words"])))

    scored = seen.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), of(F.struct("votes", "stemmed", "n", "words")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` without those scored 0.5 or more."""
    model, seen = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    discard(seen)
    weights, stems = model.weights, model.stems

    @python_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([scores(weights, **look(part, known_words(stems))) for part in parts(texts)]))

    # written here, where Python workers get small batches, and not in those of whoever writes the result
    return durable(docs.where(of(F.col(text_col)) < 0.5))
