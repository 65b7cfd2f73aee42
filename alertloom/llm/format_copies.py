"""Records that are equal but for their formatting (problem 3).

Code points are streamed through a skip-and-fold table into rolling
polynomial hashes; no canonical string is built for any row. Rows whose hashes
meet are compared once more by two pointers that skip what doesn't count.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

SKIP, DIGIT, LETTER, SPACE, SEPARATOR, DASH = range(6)
#: Punctuation that separates the parts of a name.
SEPARATORS = "()[]{},&+/;:|"
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
POINT = ord(".")


def _class_of(ch: str) -> int:
    if ch in SEPARATORS:
        return SEPARATOR
    kind = unicodedata.category(ch)
    if kind == "Pd":
        return DASH
    if kind == "Nd":
        return DIGIT
    if kind[0] in "LMN":
        return LETTER
    return SPACE if ch.isspace() or kind[0] == "Z" else SKIP


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the basic plane, its folded value and its class; others are letters as they stand."""
    fold, kinds = np.arange(0x10000, dtype=np.uint64), np.zeros(0x10000, dtype=np.uint8)
    for c in range(0x10000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        kinds[c] = _class_of(ch)
        fold[c] = ord(ch.lower()[0])
    return fold, kinds


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _scan(values: list[str]) -> tuple[np.ndarray, ...]:
    """Code points that count, their rows, and where a word and a part begin."""
    fold, kinds = tables()
    lens = np.fromiter(map(len, values), np.int64, len(values))
    points = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    rows = np.repeat(np.arange(len(values)), lens)
    low = np.minimum(points, 0xFFFF)
    kind = np.where(points > 0xFFFF, LETTER, kinds[low])
    value = np.where(points > 0xFFFF, points.astype(np.uint64), fold[low])
    same = lambda a: np.concatenate(([False], a[1:] & (rows[1:] == rows[:-1]))) if len(a) else a
    digit = kind == DIGIT
    after_digit = same(np.concatenate(([False], digit[:-1])) if len(digit) else digit)
    before_digit = np.concatenate((after_digit[:0], digit[1:] & (rows[1:] == rows[:-1]), [False])) if len(digit) else digit
    point = (points == POINT) & after_digit & before_digit
    keep = (kind == LETTER) | digit | point
    spaces = np.concatenate(([0], np.cumsum(kind == SPACE)))
    # a dash parts only where white space stands beside it
    blank = kind == SPACE
    beside = same(np.concatenate(([False], blank[:-1])) if len(blank) else blank) | (np.concatenate((blank[1:] & (rows[1:] == rows[:-1]), [False])) if len(blank) else blank)
    marks = np.concatenate(([0], np.cumsum((kind == SEPARATOR) | (kind == DASH) & beside)))
    at = np.flatnonzero(keep)
    r, v, number = rows[at], value[at], (digit | point)[at]
    if not len(at):
        return r, v, np.zeros(0, bool), at
    first = np.concatenate(([True], r[1:] != r[:-1]))
    mark = np.concatenate(([True], marks[at[1:]] > marks[at[:-1] + 1])) | first
    gap = np.concatenate(([True], spaces[at[1:]] > spaces[at[:-1] + 1]))
    turn = np.concatenate(([True], number[1:] != number[:-1]))
    word = first | mark | gap | turn
    w = np.flatnonzero(word)
    # a word right after a number is its unit: the next word begins a part
    unit = np.concatenate(([False], ~number[w[1:]] & number[w[:-1]] & ~mark[w[1:]]))
    part = mark.copy()
    part[w[1:]] |= unit[:-1] & ~number[w[1:]]
    return r, v, part, at


def _segments(v: np.ndarray, starts: np.ndarray, base: np.uint64) -> np.ndarray:
    """The rolling polynomial hash of each segment."""
    bounds = np.append(starts, len(v))
    pos = np.arange(len(v)) - np.repeat(starts, np.diff(bounds))
    size = 1 << int(max(8, int(pos.max()).bit_length() + 1))
    terms = (v + np.uint64(1)) * _powers(int(base), size)[pos]
    return _mix(np.add.reduceat(terms, starts) + np.diff(bounds).astype(np.uint64))


def hashes(values: list[str], parts: bool) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes per string; with parts, their order doesn't count."""
    r, v, part, _ = _scan(values)
    out = []
    for base in BASES:
        h = np.zeros(len(values), np.uint64)
        if len(v):
            first = np.concatenate(([True], r[1:] != r[:-1]))
            starts = np.flatnonzero(part if parts else first)
            seg = _segments(v, starts, base)
            own = r[starts]
            sums = np.concatenate(([np.uint64(0)], np.cumsum(seg, dtype=np.uint64)))
            lo, hi = np.searchsorted(own, np.arange(len(values))), np.searchsorted(own, np.arange(len(values)), "right")
            h = _mix(sums[hi] - sums[lo])
        out.append(h.view(np.int64))
    return out[0], out[1]


def _spans(text: str, parts: bool) -> list[list[int]]:
    """The kept code points of a text as positions, part by part."""
    _, _, part, at = _scan([text])
    if not parts:
        return [at.tolist()]
    return [x.tolist() for x in np.split(at, np.flatnonzero(part)[1:])] if len(at) else []


def _same(a: str, x: list[int], b: str, y: list[int]) -> bool:
    return len(x) == len(y) and all(a[i].lower()[0] == b[j].lower()[0] for i, j in zip(x, y))


def same_text(a: str, b: str, parts: bool) -> bool:
    """Two pointers over both texts, skipping what doesn't count; parts may stand in any order."""
    if a == b:
        return True
    x, y = _spans(a, parts), _spans(b, parts)
    if len(x) != len(y):
        return False
    if all(_same(a, p, b, q) for p, q in zip(x, y)):
        return True
    left = list(y)
    for p in x:
        hit = next((k for k, q in enumerate(left) if _same(a, p, b, q)), None)
        if hit is None:
            return False
        left.pop(hit)
    return True


def canonical(text: str, parts: bool) -> str:
    """Only for rows whose hashes met by chance."""
    return "\x1f".join(sorted("".join(text[i].lower()[0] for i in p) for p in _spans(text, parts)))


_PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _hash_udf(parts: bool):  # noqa: ANN202
    @F.pandas_udf(_PAIR)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            a, b = hashes(s.fillna("").tolist(), parts)
            yield pd.DataFrame({"a": a, "b": b})

    return run


@F.pandas_udf(T.BooleanType())
def _verify(drug_a: pd.Series, drug_b: pd.Series, batch_a: pd.Series, batch_b: pd.Series) -> pd.Series:
    return pd.Series([same_text(a, b, False) and same_text(x, y, True) for x, y, a, b in zip(drug_a, drug_b, batch_a, batch_b)], dtype=bool)


@F.pandas_udf(T.StringType())
def _canonical(drug: pd.Series, batch: pd.Series) -> pd.Series:
    return pd.Series([canonical(x, True) + "\x1e" + canonical(y, False) for x, y in zip(drug, batch)], dtype=object)


def format_copies(df: DataFrame, key: str, exact: list[str], sequence: str, parted: str) -> DataFrame:
    """(keep_id, copy_id): the smallest key of each set of copies with each other key.

    Copies agree exactly in ``exact`` (nulls equal), in ``sequence`` but for
    formatting, and in ``parted`` but for formatting and the order of its
    parts. Rows with a null in ``sequence`` or ``parted`` have no copies; two
    texts without any letter or digit agree. One row per copy, however often a
    publication occurs: sets are pre-aggregated before the shuffle, never
    gathered. An empty table gives no rows; other columns are not read.
    """
    same = [F.col(c) for c in exact]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in same]) if same else F.lit("")
    rows = df.select(F.col(key).alias("id"), F.col(parted).alias("parted"), F.col(sequence).alias("seq"), F.xxhash64(nulls, *same).alias("x1"), F.xxhash64(F.lit("second"), *reversed(same), nulls).alias("x2")).where("parted IS NOT NULL AND seq IS NOT NULL")
    rows = rows.withColumn("p", _hash_udf(True)("parted")).withColumn("s", _hash_udf(False)("seq"))
    rows = materialise(rows.select("id", "parted", "seq", F.xxhash64("x1", "p.a", "s.a").alias("k1"), F.xxhash64("x2", "p.b", "s.b").alias("k2")))
    groups = rows.groupBy("k1", "k2").agg(F.min(F.struct("id", "parted", "seq")).alias("r"), F.count("*").alias("n")).where("n > 1").select("k1", "k2", F.col("r.id").alias("keep_id"), F.col("r.parted").alias("keep_parted"), F.col("r.seq").alias("keep_seq"))
    met = rows.join(groups, ["k1", "k2"]).where("id <> keep_id").withColumn("ok", _verify("parted", "keep_parted", "seq", "keep_seq"))
    met = materialise(met.select("k1", "k2", "id", "parted", "seq", "keep_id", "ok"))
    good = met.where("ok").select("keep_id", F.col("id").alias("copy_id"))
    # hashes that met by chance: among themselves by their exact canonical texts
    odd = met.where("NOT ok").withColumn("c", _canonical("parted", "seq")).select("k1", "k2", "c", "id")
    least = odd.groupBy("k1", "k2", "c").agg(F.min("id").alias("keep_id"))
    return good.unionByName(odd.join(least, ["k1", "k2", "c"]).where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id")))


def copy_counts(df: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(keep_id, n_copies): one row per publication; those without copies have 1."""
    copies = pairs.groupBy("keep_id").agg((F.count("*") + 1).alias("n"))
    kept = df.select(F.col(key).alias("keep_id")).join(pairs.select(F.col("copy_id").alias("keep_id")), "keep_id", "left_anti")
    return kept.join(copies, "keep_id", "left").select("keep_id", F.coalesce("n", F.lit(1)).cast("long").alias("n_copies"))
