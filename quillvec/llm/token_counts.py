"""Token counts from a compiled finite-state tokenizer.

A byte-level BPE vocabulary is compiled, as far as the texts at hand need it,
into a deterministic transducer over bytes.  Its transitions carry the number of
tokens that the next byte adds to the tokenization of the word so far (which can
be negative: a merge may swallow several).  Two facts make that finite state:

* the tokenization of a prefix is its last token after the tokenization of what
  comes before that token, and
* a token may follow another exactly if the merges leave the two apart.

So a state holds the longest suffix that can still grow into a token, and for
each place in it the last token there and the count relative to now.

Where words begin is decided by a sliding window over character classes (read
off the library's own splitter), so a word start is a place where every entry
state leads to the same state.  Texts are laid end to end and cut into chunks, which
all run in step, one byte each at a time.  What a chunk does is a state map, from
entry states to exit states.  After a word start it is constant; the head before
the first one runs from the exit of the chunk before it, again all in step.  A chunk
inside a word longer than a chunk has no constant map: its map is worked out for the
entry states that are live, which are guesses at first (what the bytes just before
it lead to) and then what the map of the chunk before it yields.  Maps compose by
doubling, chunk pairs first and then spans twice as long, so the exact states at all
places are known after a number of rounds that is logarithmic in the length of the word;
where maps don't meet, the missing entry is worked out and they compose again.

States are dropped when their table is full, which costs time and not exactness.
Null and empty texts have no tokens.  Texts and words of any length are counted
whole.  Repeated rows are counted each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.llm.common import held, python_udf

LETTER, DIGIT, OTHER, BLANK, WHITE = range(5)
#: Bytes in a chunk, and in what is laid end to end at a time.
CHUNK, SLAB = 512, 2 << 20
#: Bytes before a chunk that a guess at its entry state looks at, and rounds in which every live entry is followed.
WARM, ROUNDS = 64, 3
#: Slots of the transition table (8 bytes each), and states (some 400 bytes each) before they are dropped.
SLOT_BITS, MAX_STATES = 21, 130_000
#: Pairs of tokens that are remembered when the states are dropped.
MAX_PAIRS = 130_000
#: An odd number near 2**64 over the golden ratio, which spreads keys over slots.
SPREAD = 0x9E3779B97F4A7C15


def byte_letters() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """What a `tokenizers` file says; a few MB whatever the corpus."""

    name: str
    tokens: dict[bytes, int]
    ranks: dict[tuple[bytes, bytes], int]
    special: list[str]
    classes: list[tuple[int, int]] = field(repr=False)  # runs of code points: first, class

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True) or spec["normalizer"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        to = byte_letters()
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        raw = lambda s: bytes(to[c] for c in s)
        tokens = {raw(s): k for s, k in model["vocab"].items() if s not in special and all(c in to for c in s)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(merges)}
        return cls(path, tokens, ranks, special, classes_of(Tokenizer.from_file(path).pre_tokenizer))


def classes_of(splitter) -> list[tuple[int, int]]:
    """Runs of code points of one class, seen from where the splitter cuts."""
    points = [c for c in range(0x110000) if c != ord(" ") and not 0xD800 <= c < 0xE000]
    starts = [points[span[0]] for _, span in splitter.pre_tokenize_str("".join(map(chr, points)))]
    joined = lambda a, c: len(splitter.pre_tokenize_str(a + chr(c))) == 1
    kind = [next((k for k, a in ((LETTER, "a"), (DIGIT, "1"), (OTHER, "!")) if joined(a, c)), WHITE) for c in starts]
    table = np.full(0x110000, OTHER, np.uint8)
    for c, end, k in zip(starts, [*starts[1:], 0x110000], kind):
        table[c:end] = k
    table[ord(" ")] = BLANK
    first = np.flatnonzero(np.diff(table, prepend=255))
    return list(zip(first.tolist(), table[first].tolist()))


class Transducer:
    """The transducer, compiled as it is asked for transitions."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        first, kind = zip(*vocabulary.classes)
        self.classes = np.repeat(np.array(kind, np.uint8), np.diff([*first, 0x110000]))
        self.tokens = {t: t for t in vocabulary.tokens}
        self.growing = {t[:k] for t in vocabulary.tokens for k in range(len(t))}
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.special))) if vocabulary.special else None
        self.together: dict[tuple[bytes, bytes], bool] = {}
        self.states: list[tuple] = []
        self.forget()

    def forget(self, keep: Sequence[np.ndarray] = ()) -> None:
        """Start a table of states: 1 is nowhere, 2 a word's start; states in the arrays `keep` stay, under new numbers.

        A slot holds state and byte (32 bits), the next state (24) and the count added plus 128 (8); 0: free.
        """
        before = self.states if keep else []
        self.table = np.zeros(1 << SLOT_BITS, np.uint64)
        self.states = [(), (), (b"", (None,), (0,))]
        self.ids = {self.states[2]: 2}
        self.filled = 0
        if len(self.together) > MAX_PAIRS:
            self.together.clear()
        for byte in range(256):
            self.put(256 + byte, 1, 0)
        if keep:
            number = np.zeros(len(before), np.uint64)
            number[1:3] = 1, 2
            for x in np.unique(np.concatenate([a.ravel() for a in keep])).tolist():
                if x > 2:
                    number[x] = self.number(before[x])
            for a in keep:
                a[...] = number[a]

    def number(self, state: tuple) -> int:
        found = self.ids.get(state)
        if found is None:
            found = self.ids[state] = len(self.states)
            self.states.append(state)
        return found

    def full(self) -> bool:
        return len(self.states) > MAX_STATES or self.filled > (1 << SLOT_BITS) // 2

    def put(self, key: int, state: int, adds: int) -> None:
        slot = (key * SPREAD & (1 << 64) - 1) >> (64 - SLOT_BITS)
        while self.table[slot]:
            slot = (slot + 1) & (1 << SLOT_BITS) - 1
        self.filled += 1
        self.table[slot] = key << 32 | state << 8 | adds + 128

    def merged(self, word: bytes) -> list[bytes]:
        """The merges applied to `word`, lowest rank first."""
        parts, ranks = [word[k : k + 1] for k in range(len(word))], self.vocabulary.ranks
        while len(parts) > 1:
            best = min(((ranks.get(p, 1 << 40), k) for k, p in enumerate(zip(parts, parts[1:]))))
            if best[0] == 1 << 40:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def may_follow(self, before: bytes | None, token: bytes) -> bool:
        key = (before or b"", token)
        known = self.together.get(key)
        if known is None:
            known = self.together[key] = self.merged(key[0] + token) == [x for x in key if x]
        return known

    def compile(self, key: int) -> None:
        """Add the transition of state `key >> 8` at byte `key & 255`."""
        suffix, lasts, counts = self.states[key >> 8]
        grown = suffix + bytes([key & 255])
        for k in range(len(grown)):
            token = grown[k:]
            if (token := self.tokens.get(token)) and self.may_follow(lasts[k], token):
                break
        else:
            raise ValueError(f"no token ends {grown!r}")
        adds = counts[k] + 1
        lasts, counts = (*lasts, token), (*counts, adds)
        while grown not in self.growing:
            grown, lasts, counts = grown[1:], lasts[1:], counts[1:]
        # a place matters only if a token may still begin there
        live = [grown[k:] in self.growing for k in range(len(grown))] + [True]
        new = (grown, tuple(x if a else b"" for x, a in zip(lasts, live)), tuple(c - adds if a else 0 for c, a in zip(counts, live)))
        self.put(key, self.number(new), adds)

    def advance(self, states: np.ndarray, data: np.ndarray, *keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`step`, with a new table if the old one is full; the numbers in `keep` change with it."""
        if self.full():
            states = states.copy()
            self.forget([states, *keep])
        return self.step(states, data)

    def step(self, states: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One byte for each of `states`: the next states and the counts added."""
        key = states << np.uint64(8) | data
        slot = key * np.uint64(SPREAD) >> np.uint64(64 - SLOT_BITS)
        found = self.table[slot]
        left = np.flatnonzero(found >> np.uint64(32) != key)
        while left.size:
            if (free := left[found[left] == 0]).size:
                for x in np.unique(key[free]).tolist():
                    self.compile(x)
                found[free] = self.table[slot[free]]
                left = left[found[left] >> np.uint64(32) != key[left]]
            slot[left] = slot[left] + np.uint64(1) & np.uint64((1 << SLOT_BITS) - 1)
            found[left] = self.table[slot[left]]
            left = left[found[left] >> np.uint64(32) != key[left]]
        return found >> np.uint64(8) & np.uint64((1 << 24) - 1), (found & np.uint64(255)).astype(np.int16) - np.int16(128)

    def starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where words start in `points`; `first`: where the parts begin."""
        n = len(points)
        kind = self.classes[points]
        begins = np.zeros(n + 3, bool)
        begins[first], begins[n:] = True, True
        white = kind >= BLANK
        start = np.zeros(n + 3, bool)
        before, was_white = kind[:-1], white[:-1]
        last_white = np.append(~white[1:] & ~begins[1:n], False)[1:]
        start[1:n] = np.where(white[1:], ~was_white | last_white, np.where(was_white, before == WHITE, before != kind[1:]))
        start[first] = True
        if (mark := np.flatnonzero(points == ord("'"))).size:
            own = begins[mark] | (np.append(OTHER, kind)[mark] != OTHER) & (np.append(OTHER, kind)[mark] != BLANK)
            mark = mark[own]
            padded = np.append(points, [0, 0, 0])
            one, two = padded[mark + 1], padded[mark + 2]
            have_one, have_two = ~begins[mark + 1], ~begins[mark + 1] & ~begins[mark + 2]
            short = have_one & np.isin(one, [ord(c) for c in "stmd"])
            long = have_two & ((two == ord("e")) & np.isin(one, [ord("r"), ord("v")]) | (one == ord("l")) & (two == ord("l")))
            start[mark[short] + 1] = start[mark[long] + 1] = False
            start[mark[short] + 2] = start[mark[long] + 3] = True
        return start[:n]

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        parts: list[tuple[int, str]] = []
        size = 0
        for k, text in enumerate(texts):
            pieces = [text]
            if self.special and any(s in text for s in self.vocabulary.special):
                pieces = self.special.split(text)
                out[k] += len(pieces) - 1
            for piece in filter(None, pieces):
                parts.append((k, piece))
                size += len(piece)
                if size >= SLAB:
                    self.slab(parts, out)
                    parts, size = [], 0
        if parts:
            self.slab(parts, out)
        return out

    def slab(self, parts: list[tuple[int, str]], out: np.ndarray) -> None:
        joined = "".join(p for _, p in parts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.array([len(p) for _, p in parts])
        first = np.cumsum(lengths) - lengths
        start = self.starts(points, first)
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        offset = np.cumsum(width, dtype=np.int64) - width
        data = np.frombuffer(joined.encode("utf-8"), np.uint8)
        flags = np.zeros(len(data), bool)
        flags[offset[start]] = True
        added = self.run(data, flags)
        sums = np.add.reduceat(added, offset[first], dtype=np.int64)
        np.add.at(out, [k for k, _ in parts], sums)

    def run(self, data: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """The counts added at each byte; `flags`: where words start."""
        n = len(data)
        lanes = -(-n // CHUNK)
        wide = np.zeros(lanes * CHUNK, np.uint8)
        wide[:n] = data
        reset = np.zeros(lanes * CHUNK, bool)
        reset[:n] = flags
        by_step, resets = np.ascontiguousarray(wide.reshape(lanes, CHUNK).T), reset.reshape(lanes, CHUNK)
        go = np.ascontiguousarray(resets.T)
        added = np.zeros((CHUNK, lanes), np.int8)
        # every chunk from its first word start on: there its state map is constant
        state = np.ones(lanes, np.uint64)
        for t in range(CHUNK):
            state[go[t]] = 2
            state, added[t] = self.advance(state, by_step[t])
        added = np.ascontiguousarray(added.T)
        # the heads: first those after a chunk whose map is constant, all in step
        synced = resets.any(axis=1)
        head = np.where(synced, resets.argmax(axis=1), CHUNK)
        head[-1] = min(head[-1], n - (lanes - 1) * CHUNK)
        ready = np.flatnonzero((head[1:] > 0) & synced[:-1]) + 1
        out, counts = self.heads(ready, state[ready - 1], head, wide, state)
        added[ready] = np.where(np.arange(CHUNK) < head[ready, None], counts, added[ready])
        state[ready[~synced[ready]]] = out[~synced[ready]]
        # then chunks inside a word that is longer than a chunk
        inside = np.flatnonzero((head[1:] > 0) & ~synced[:-1]) + 1
        if inside.size:
            out, counts = self.long_words(inside, state, head, wide)
            added[inside] = np.where(np.arange(CHUNK) < head[inside, None], counts, added[inside])
        return added.reshape(-1)[:n]

    def heads(self, lanes: np.ndarray, entry: np.ndarray, head: np.ndarray, wide: np.ndarray, *keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states of the heads of `lanes` from their `entry` states, and the counts added at their bytes."""
        order = np.argsort(-head[lanes], kind="stable")
        now, length, at = entry[order].copy(), head[lanes][order], lanes[order] * CHUNK
        counts = np.zeros((len(lanes), CHUNK), np.int8)
        for t in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length, -t, "left"))
            moved, counts[order[:live], t] = self.advance(now[:live], wide[at[:live] + t], now, *keep)
            now[:live] = moved
        out = np.empty_like(now)
        out[order] = now
        return out, counts

    def long_words(self, lanes: np.ndarray, state: np.ndarray, head: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `heads`, for chunks each of which follows a chunk without a word start.

        A node is a chunk with an entry state; its successor is the next chunk with
        the node's exit state as entry.  The nodes that the first chunk's known entry
        leads to are found by doubling; nodes that lack a successor get one.
        """
        n = len(lanes)
        opens = np.diff(lanes, prepend=-1) != 1  # runs of chunks within one word
        entry = np.full(n, 2, np.uint64)
        for t in range(CHUNK - WARM, CHUNK):
            entry, _ = self.advance(entry, wide[(lanes - 1) * CHUNK + t], state)
        entry[opens] = state[lanes[opens] - 1]
        lane, out, counts = np.arange(n), np.zeros(n, np.uint64), np.zeros((n, CHUNK), np.int8)
        new, rounds = np.arange(n), 0
        while True:
            found, counts[new] = self.heads(lanes[lane[new]], entry[new], head, wide, state, entry, out)
            out[new] = found
            key = lane.astype(np.uint64) << np.uint64(32) | entry
            order = np.argsort(key)
            goes_on = np.append(~opens[1:], False)[lane]
            wanted = (lane + 1).astype(np.uint64) << np.uint64(32) | out
            place = np.minimum(np.searchsorted(key[order], wanted), len(key) - 1)
            after = np.where(goes_on & (key[order[place]] == wanted), order[place], -1)
            on_path = np.zeros(len(lane), bool)
            on_path[:n][opens] = True
            jump, reached = after, np.flatnonzero(on_path)
            while True:  # jumps of 1, 2, 4 ... chunks
                further = jump[reached]
                further = further[further >= 0]
                if not (~on_path[further]).any() and not (jump >= 0).any():
                    break
                on_path[further] = True
                reached = np.flatnonzero(on_path)
                jump = np.where(jump >= 0, jump[jump], -1)
            missing = goes_on & (after < 0)
            if not (missing & on_path).any():
                break
            rounds += 1
            if rounds > ROUNDS:
                missing &= on_path
            fresh = np.unique(wanted[missing])
            new = np.arange(len(lane), len(lane) + len(fresh))
            lane = np.concatenate([lane, (fresh >> np.uint64(32)).astype(lane.dtype)])
            entry = np.concatenate([entry, fresh & np.uint64((1 << 32) - 1)])
            out = np.concatenate([out, np.zeros(len(fresh), np.uint64)])
            counts = np.concatenate([counts, np.zeros((len(fresh), CHUNK), np.int8)])
        node = np.flatnonzero(on_path)
        node = node[np.argsort(lane[node])]
        return out[node], counts[node]


def compiled(vocabulary: Vocabulary) -> Transducer:
    """One transducer in each Python worker, kept from task to task."""
    return held(f"transducer {vocabulary.name}", lambda: Transducer(vocabulary))


_READ: dict[tuple[str, int], Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The file at `path`, read once as long as it does not change."""
    key = path, os.stat(path).st_mtime_ns
    if key not in _READ:
        _READ.clear()
        _READ[key] = Vocabulary.read(path)
    return _READ[key]


def token_count_column(spark: SparkSession, text: Column, path: str) -> Column:
    """The number of tokens of `text` under the `tokenizers` file at `path`, read on the driver."""
    shared = spark.sparkContext.broadcast(vocabulary(path))

    @python_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(compiled(shared.value).counts([t or "" for t in texts]))

    return count(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: `(id_col, n_bytes, n_tokens, over_limit)`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), token_count_column(docs.sparkSession, text, path).alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)
