"""Ratios of token strings (E3): similarity by the longest common subsequence, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, one bit of a whole number per letter of ``a``."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common length over both lengths; two empty strings are equal."""
    n = len(a) + len(b)
    return 2 * common_length(a, b) / n if n else 1.0


def token_sort_ratio(a: str, b: str) -> float:
    """The ratio of the words in alphabetical order."""
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the common words and these with the rest of either side; 1 if one side's words are all in the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    one, two = (" ".join(filter(None, (both, " ".join(sorted(s - t))))) for s, t in ((x, y), (y, x)))
    if both and (x <= y or y <= x):
        return 1.0
    return max(ratio(one, two), *(ratio(both, s) for s in (one, two) if both), 0.0)


@F.pandas_udf(T.DoubleType())
def token_sort(a: pd.Series, b: pd.Series) -> pd.Series:
    """token_sort_ratio of two columns; null with null."""
    return pd.Series([None if x is None or y is None else token_sort_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def token_set(a: pd.Series, b: pd.Series) -> pd.Series:
    """token_set_ratio of two columns; null with null."""
    return pd.Series([None if x is None or y is None else token_set_ratio(x, y) for x, y in zip(a, b)], dtype="float64")
