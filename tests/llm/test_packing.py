"""Packing: nothing lost, nothing over capacity, hardly anything unused."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from alertloom.llm import packing as P


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(0, 4), max_size=6), st.integers(1, 20))
def test_fullest_is_the_fullest(counts, room):
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
    got = P.fullest({n: c for n, c in counts.items() if c}, room)
    assert sum(got) == max(sums) and all(got.count(n) <= counts[n] for n in got)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 50), max_size=12))
def test_histogram_is_packed_whole(histogram):
    patterns = P.pack_histogram(histogram, 30)
    used = {}
    for p in patterns:
        assert sum(p.lengths) <= 30
        for n in p.lengths:
            used[n] = used.get(n, 0) + p.times
    assert used == histogram
    assert [p.first for p in patterns] == [sum(q.times for q in patterns[:i]) for i in range(len(patterns))]


@pytest.mark.parametrize("hot", [False, True])
def test_pack(spark, hot):
    rng = random.Random(2)
    rows = [(i, 7 if hot and i % 3 == 0 else rng.choice([0, 1, 5, 40, 99, 100, 101, 250, 1000])) for i in range(900)] + [(1, 5), (1, 5)]
    out = P.pack(spark.createDataFrame(rows, "doc_id long, n long"), 100).collect()
    load, pieces = {}, {}
    for r in out:
        load[r["container"]] = load.get(r["container"], 0) + r["n"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["n"]))
    assert max(load.values()) <= 100 and set(load) == set(range(len(load)))
    assert sum(load.values()) == sum(n for _, n in rows)
    for i, n in rows:
        if i != 1 and n:
            own = sorted(pieces[i])
            assert len(own) == -(-n // 100) and own == [(k * 100, min(100, n - k * 100)) for k in range(len(own))]
    assert len(load) <= sum(n for _, n in rows) / 100 * 1.02 + 1


def test_nothing(spark):
    empty = P.pack(spark.createDataFrame([], "doc_id long, n long"))
    assert empty.count() == 0 and P.container_fill(empty).first()["containers"] == 0


def test_tokens(spark):
    docs = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (4, "<|endoftext|>", "x"), (5, "a " * 30_000, "x")], "doc_id long, text string, n string")
    got = {r["doc_id"]: r["n"] for r in P.count_tokens(docs).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] >= 30_000
