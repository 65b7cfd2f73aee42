"""The FM-index against plain search, and leaks with small changes."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from alertloom.llm import leaks as P


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_index_finds_every_occurrence(text, phrase):
    index = P.FMIndex(np.array(text, np.int64), 4)
    lo, hi = index.search(np.array([phrase]))
    got = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
    assert got == [i for i in range(len(text) - len(phrase) + 1) if text[i : i + len(phrase)] == phrase]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 7), max_size=50), st.integers(0, 7), st.integers(0, 50))
def test_ranks(symbols, c, at):
    at = min(at, len(symbols))
    assert P.WaveletMatrix(np.array(symbols, np.int64), 3).rank(np.array([c]), np.array([at]))[0] == symbols[:at].count(c)


WORDS = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)]


def sentence(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item_id int, start int")
    return sorted(map(tuple, P.leaked_items(d, spark.createDataFrame(items, "item_id long, text string")).collect()))


def test_leaks(spark):
    rng = random.Random(5)
    a, b = sentence(rng, 70), sentence(rng, 40)
    short = sentence(rng, 6)
    around = lambda x: " ".join(sentence(rng, 30) + x + sentence(rng, 30))
    changed = [("X" if i % 11 == 5 else w[:-1] if i % 9 == 4 else w.upper()) for i, w in enumerate(a)]
    half = [w if i % 2 else "other" for i, w in enumerate(a)]
    docs = [
        (1, around(a)), (2, around(a[20:41])), (3, around(a[20:35])), (4, around(changed)), (5, around(half)), (6, ", ".join(b) + "!"), (7, " ".join(a[:30]) + " " + " ".join(b[5:40])), (8, None), (9, ""), (10, "?"),
        (11, around(short)), (12, around(short[:4])), (13, around(a[:10] + sentence(rng, 15) + a[30:40])), (1, around(b)),
    ]
    items = [(1, " ".join(a)), (2, "\n".join(b)), (3, " ".join(short)), (4, None), (5, ""), (6, "--")]
    assert run(spark, docs, items) == [(1, 1), (1, 2), (2, 1), (4, 1), (6, 2), (7, 1), (7, 2), (11, 3)]


def test_nothing(spark):
    assert run(spark, [], [(1, "a b c d e")]) == [] and run(spark, [(1, "a b c d")], []) == []


def test_spans_are_merged_and_long_documents_read_whole(spark):
    rng = random.Random(6)
    a = sentence(rng, 30)
    text = " ".join(sentence(rng, 20_000) + a + a + sentence(rng, 10_000))
    (r,) = P.leak_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, " ".join(a))], "item_id long, text string")).collect()
    assert text[r["start"] : r["end"]].split() == a + a


@pytest.mark.parametrize("blocks", [40, 400])
def test_items_in_blocks(spark, monkeypatch, blocks):
    rng = random.Random(7)
    items = [(i, " ".join(sentence(rng, 25))) for i in range(8)]
    monkeypatch.setattr(P, "BLOCK_CHARS", blocks)
    assert run(spark, [(i, t) for i, t in items], items) == [(i, i) for i in range(8)]


def test_slips_in_every_phrase_still_meet(spark):
    rng = random.Random(8)
    a = ["".join(rng.choices("abcdefghij", k=9)) for _ in range(60)]
    slipped = [w[:-1] + "zz" if i % 4 == 3 else w for i, w in enumerate(a[10:35])]
    assert run(spark, [(1, " ".join(sentence(rng, 30) + slipped + sentence(rng, 30)))], [(1, " ".join(a))]) == [(1, 1)]


def test_a_passage_that_goes_on_less_alike(spark):
    rng = random.Random(9)
    a = sentence(rng, 100)
    rest = [w if i % 7 not in (2, 5) else "other" for i, w in enumerate(a[24:94])]
    text = " ".join([*sentence(rng, 20), *a[:24], *rest, *sentence(rng, 20)])
    d, i = spark.createDataFrame([(1, text), (2, " ".join(a[:15] + rest))], "doc_id long, text string"), spark.createDataFrame([(1, " ".join(a))], "item_id long, text string")
    (r,) = P.leak_spans(d, i).collect()
    assert r["doc_id"] == 1 and text[r["start"] : r["end"]].split()[:24] == a[:24] and len(text[r["start"] : r["end"]].split()) < 40
