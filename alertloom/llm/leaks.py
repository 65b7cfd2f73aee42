"""Evaluation items that stand in documents, wholly or partly (problem 8).

Each shard of documents gets an FM-index over its words: the Burrows-Wheeler
transform in a wavelet matrix, and every few suffix positions. The phrases of
the items are searched backwards, all at once; their occurrences are located,
extended by a banded alignment that lets words be misspelt, left out or put
in, and merged into the spans to be removed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, written_at
from .firm_variants import _lookups, _segments
from .mentions import near

#: Words of a searched phrase: a stretch of 20 words of which three differ still has a run of them.
PHRASE = 4
#: A document holds a stretch of at least so many of an item's words, or the whole item, so much of it alike.
LEAST_WORDS, LEAST_ALIKE = 20, 0.82
#: Of a stretch that goes on less alike, so much of a part of it is alike.
VERBATIM = 0.95
#: Letters from which on a word may have a slip, and may have two; longer words have none.
SHORTEST, LONG, LONGEST = 4, 8, 60
#: Words of a shard; a longer document is a shard of its own.
SHARD_WORDS = 400_000
#: Characters of the items of a block.
BLOCK_CHARS = 8_000_000
SAMPLE = 8
_TOKEN = re.compile(r"[^\W_]+")


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector per binary digit, each with running counts."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.n, self.bits = len(symbols), bits
        self.ones, self.zeros = [], []
        s = symbols
        for k in range(bits - 1, -1, -1):
            bit = (s >> k) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(int(self.n - self.ones[-1][-1]))
            s = np.concatenate((s[bit == 0], s[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        lo, hi = np.zeros_like(at), at
        for level, k in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            bit = (symbol >> k) & 1 == 1
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return hi - lo


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling. Symbol 0 never equals itself: it ends every comparison."""
    n = len(text)
    zero = text == 0
    rank = np.where(zero, np.cumsum(zero) - 1, text.astype(np.int64) + int(zero.sum()))
    k = 1
    while True:
        after = np.concatenate((rank[k:], np.full(min(k, n), -1, np.int64)))[:n]
        key = rank * (int(rank.max()) + 2) + after + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = new
        if int(rank[order[-1]]) == n - 1 or k >= n:
            return order
        k *= 2


class FMIndex:
    """Full-text index of a sequence of symbols; 0 stands for words no phrase has."""

    def __init__(self, text: np.ndarray, size: int) -> None:
        self.text = np.append(text, 0).astype(np.int64)
        sa = suffix_array(self.text)
        before = self.text[sa - 1]
        self.before = before
        self.wavelet = WaveletMatrix(before, max(1, int(size).bit_length()))
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(self.text, minlength=size + 1))))
        # positions after a 0 are sampled too: a walk never crosses one
        self.sampled = (sa % SAMPLE == 0) | (before == 0)
        self.place = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [lo, hi) of the suffixes that begin with each phrase, found from its last symbol to its first."""
        m, width = phrases.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, len(self.text), np.int64)
        live = np.arange(m)
        for j in range(width - 1, -1, -1):
            c = phrases[live, j]
            lo[live] = self.starts[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.starts[c] + self.wavelet.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        hi = np.maximum(hi, lo)
        dead = np.ones(m, bool)
        dead[live] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of suffix rows: walk backwards to a sampled one."""
        rows, out = rows.copy(), np.zeros(len(rows), np.int64)
        steps, live = np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(live):
            here = rows[live]
            done = self.sampled[here]
            hit = live[done]
            out[hit] = self.samples[self.place[rows[hit]]] + steps[hit]
            live = live[~done]
            c = self.before[rows[live]]
            rows[live] = self.starts[c] + self.wavelet.rank(c, rows[live])
            steps[live] += 1
        return out


def words_of(text: str) -> list[str]:
    """The words of a text."""
    return [w.lower() for w in _TOKEN.findall(text)]


class Phrases:
    """The items of a block: their words and all their phrases, numbered by a common vocabulary."""

    def __init__(self, items: list[tuple[int, str]], vocabulary: dict[str, int]) -> None:
        self.ids, self.words, self.places = [], [], []
        where: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for item, text in items:
            words, own, last, n = [], [], 0, -1
            for t in _TOKEN.finditer(text):
                if n < 0 or re.search(r"\s", text[last : t.start()]):
                    n += 1
                last = t.end()
                words.append(t[0].lower())
                own.append(n)
            if not words:
                continue
            k = len(self.ids)
            self.ids.append(item)
            self.words.append(words)
            self.places.append(own)
            nums = [vocabulary[w] for w in words]
            size = min(PHRASE, len(nums))
            for p in range(len(nums) - size + 1):
                where[tuple(nums[p : p + size])].append((k, p))
        groups: dict[int, list] = defaultdict(list)
        for phrase, at in where.items():
            groups[len(phrase)].append((phrase, at))
        self.groups = [(np.array([x for x, _ in own], np.int64), [at for _, at in own]) for own in groups.values()]


class Vocabulary(dict):
    """The numbers of all items' words, and of slips of them: 0 is a word that is like none.

    Words to which another may be alike are found by its segments, cut and
    shifted as two edits need it.
    """

    def __init__(self, words: set[str]) -> None:
        super().__init__((w, n) for n, w in enumerate(sorted(words), 1))
        self.size = len(self)
        self.segments: dict[tuple[int, int, str], list[str]] = defaultdict(list)
        for w in self:
            if len(w) >= SHORTEST and not w[0].isdigit():
                for x in _segments(w, 1 if len(w) < LONG else 2):
                    self.segments[x].append(w)

    def __missing__(self, word: str) -> int:
        if len(self) > self.size + (1 << 20):  # what has been looked up may be looked up again
            for w in list(self)[self.size :]:
                del self[w]
        self[word] = out = self._nearest(word)
        return out

    def _nearest(self, word: str) -> int:
        if not SHORTEST <= len(word) <= LONGEST or any(c.isdigit() for c in word):
            return 0
        found = {w for k in ((1,) if len(word) < LONG else (1, 2)) for x in _lookups(word, k, k) if x in self.segments for w in self.segments[x]}
        near_ones = [w for w in found if alike(word, w)]
        return self[min(near_ones)] if near_ones else 0


@lru_cache(1 << 18)
def _slip(a: str, b: str) -> bool:
    k = 1 if len(a) < LONG else 2
    return near(a, b, k) <= k


def alike(a: str, b: str) -> bool:
    """Equal words, or long ones with a slip of typing."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if n < SHORTEST or m < SHORTEST or abs(n - m) > 2 or a[0].isdigit() or n > LONGEST:
        return False
    return _slip(a, b)


#: The ways past a difference, (words in a, words in b): a replaced word first.
_WAYS = sorted(((x, y) for x in range(4) for y in range(4) if x + y), key=lambda p: (max(p), abs(p[0] - p[1])))
#: A stretch ends where its score has fallen so far below its best.
DROP = 6


def extend(a: list[str], i: int, b: list[str], j: int, step: int, trace: list[tuple[int, int, int]] | None = None) -> tuple[int, int, int, int]:
    """Greedy alignment from (i, j) on: (end in a, end in b, matches, errors) at its best score (a match 1, an error -2).

    ``trace`` gets (word of a, word of b, errors just before) of every match.
    """
    score = best = matches = errors = since = 0
    top = (i, j, 0, 0)
    n, m = len(a), len(b)
    while 0 <= i < n and 0 <= j < m:
        x, y = a[i], b[j]
        if x == y or alike(x, y):
            if trace is not None:
                trace.append((i, j, since))
            i, j, matches, score, since = i + step, j + step, matches + 1, score + 1, 0
            if score > best:
                best, top = score, (i, j, matches, errors)
            continue
        if best - score >= DROP:
            break
        # the cheapest way to two words in a row that agree again
        for x, y in _WAYS:
            p, q = i + x * step, j + y * step
            if 0 <= p < n and 0 <= q < m and alike(a[p], b[q]):
                u, v = p + step, q + step
                if not (0 <= u < n and 0 <= v < m) or alike(a[u], b[v]):
                    lost = max(x, y)
                    i, j, errors, score, since = p, q, errors + lost, score - 2 * lost, since + lost
                    break
        else:
            break
    return top


def verbatim(doc: list[str], item: list[str], places: list[int], p: int, q: int) -> tuple[int, int] | None:
    """The longest part of the stretch around (p, q), of LEAST_WORDS item words or more, of which VERBATIM are alike: (first, end) in the document.

    For stretches that go on, less and less alike, after a passage that was taken over.
    """
    after: list[tuple[int, int, int]] = []
    before: list[tuple[int, int, int]] = []
    extend(doc, p, item, q, 1, after)
    extend(doc, p - 1, item, q - 1, -1, before)
    line = [(i, j) for i, j, _ in reversed(before)] + [(i, j) for i, j, _ in after]
    # errors before each match, read from left to right
    gaps = [0] + [x[2] for x in reversed(before)] + [x[2] for x in after[1:]]
    best, s, lost = None, 0, 0
    for e, (i, j) in enumerate(line):
        lost += gaps[e] if e > s else 0
        while s < e and (e - s + 1) / (e - s + 1 + lost) < VERBATIM:
            s += 1
            lost -= gaps[s]
        if places[j] - places[line[s][1]] + 1 >= LEAST_WORDS and (best is None or i - line[s][0] > best[1] - best[0] - 1):
            best = line[s][0], i + 1
    return best


def leaked(doc: list[str], item: list[str], places: list[int], seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The word spans of a document that hold a stretch of an item, grown from the places where phrases of it stand."""
    spans: list[tuple[int, int]] = []
    seen: set[tuple[int, int]] = set()
    seeds = sorted(seeds)
    for p, q in seeds:
        if (p, q) in seen:
            continue
        e1, f1, m1, x1 = extend(doc, p, item, q, 1)
        s1, g1, m0, x0 = extend(doc, p - 1, item, q - 1, -1)
        # seeds within this stretch have been grown with it
        for k in range(bisect_left(seeds, (p, q)), bisect_left(seeds, (e1, -1))):
            if g1 < seeds[k][1] < f1:
                seen.add(seeds[k])
        first, last = g1 + 1, f1 - 1
        if last < first:
            continue
        held = places[last] - places[first] + 1
        whole = held >= places[-1] + 1
        total = m0 + m1 + x0 + x1
        if (held >= LEAST_WORDS or whole) and total and (m0 + m1) / total >= LEAST_ALIKE:
            spans.append((s1 + 1, e1))
        elif held >= LEAST_WORDS and (part := verbatim(doc, item, places, p, q)):
            spans.append(part)
    return spans


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple[int, str, list[str]]]]:
    shard, size = [], 0
    for pdf in batches:
        for i, text in zip(pdf["doc_id"], pdf["text"]):
            words = words_of(text)
            if shard and size + len(words) > SHARD_WORDS:
                yield shard
                shard, size = [], 0
            shard.append((i, text, words))
            size += len(words) + 1
    if shard:
        yield shard


class Shard:
    """The FM-index of some documents, built once for all blocks of items."""

    def __init__(self, shard: list[tuple[int, str, list[str]]], vocabulary: Vocabulary) -> None:
        self.docs = shard
        starts, numbers = [], []
        for _, _, words in shard:
            starts.append(len(numbers))
            numbers += map(vocabulary.__getitem__, words)
            numbers.append(0)
        self.begin = np.array(starts)
        self.index = FMIndex(np.array(numbers, np.int64), vocabulary.size) if numbers else None

    def search(self, ph: Phrases) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, first, last character) of all leaks of a block's items."""
        if self.index is None:
            return
        seeds: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for phrases, places in ph.groups:
            lo, hi = self.index.search(phrases)
            count = hi - lo
            hit = np.flatnonzero(count)
            if not len(hit):
                continue
            which = np.repeat(hit, count[hit])
            rows = np.arange(len(which)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit]) + lo[which]
            at = self.index.locate(rows)
            docs = np.searchsorted(self.begin, at, "right") - 1
            for k, d, p in zip(which.tolist(), docs.tolist(), (at - self.begin[docs]).tolist()):
                for item, q in places[k]:
                    seeds[d, item].append((p, q))
        for (d, item), found in seeds.items():
            doc_id, text, words = self.docs[d]
            spans = leaked(words, ph.words[item], ph.places[item], found)
            if spans:
                at = [t.span() for t in _TOKEN.finditer(text)]
                for s, e in spans:
                    yield doc_id, ph.ids[item], at[s][0], at[e - 1][1]


def _read(path: str, block: int) -> list[tuple[int, str]]:
    rows = pq.read_table(f"{path}/block={block}", columns=["item_id", "text"], partitioning=None)
    return sorted(zip(rows["item_id"].to_pylist(), rows["text"].to_pylist()))


@lru_cache(1)
def _vocabulary(path: str, blocks: tuple[int, ...]) -> Vocabulary:
    return Vocabulary({w for k in blocks for _, text in _read(path, k) for w in words_of(text)})


@lru_cache(1)
def _phrases(path: str, block: int, blocks: tuple[int, ...]) -> Phrases:
    return Phrases(_read(path, block), _vocabulary(path, blocks))


def leak_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end): the passages of each document that come from an item, overlapping and adjoining ones merged.

    Held are whole items and stretches of 20 of their words or more, of which
    LEAST_ALIKE are alike, or VERBATIM where the stretch goes on less alike.
    The items are written once, in blocks of bounded size, which the executors
    read for themselves one at a time; each shard of documents is read and
    indexed once, however many items there are. Null and empty texts hold
    nothing, items without words are in nothing.
    """
    own = items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    sizes = own.select(F.sum(F.length("text").cast("long")).alias("n")).first()["n"] or 0
    count = 1 + sizes // BLOCK_CHARS
    written = materialise(own.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(count)).cast("int")), "block")
    blocks = tuple(sorted(r["block"] for r in written.select("block").distinct().collect()))
    path = written_at(written)
    docs = documents.select("doc_id", "text").where("text IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in _shards(batches) if blocks else ():
            shard = Shard(own, _vocabulary(path, blocks))
            for k in blocks:
                yield pd.DataFrame(list(shard.search(_phrases(path, k, blocks))), columns=["doc_id", "item_id", "start", "end"])

    out = docs.mapInPandas(run, "doc_id long, item_id long, start int, end int")
    merged = out.groupBy("doc_id", "item_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("s"))
    last = "element_at(acc, -1)"
    merge = f"aggregate(s, cast(array() as array<struct<start:int,end:int>>), (acc, x) -> if(size(acc) > 0 AND x.start <= {last}.end + 1, concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', {last}.start, 'end', greatest({last}.end, x.end)))), concat(acc, array(x))))"
    return merged.select("doc_id", "item_id", F.explode(F.expr(merge)).alias("x")).select("doc_id", "item_id", "x.start", "x.end")


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): the items each document holds."""
    return leak_spans(documents, items).select("doc_id", "item_id").distinct()
