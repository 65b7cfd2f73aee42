"""Consolidated matches against a union-find."""

import random

from alertloom.llm.match_groups import company_groups, group_ids, linked_pairs

LOG = "log_seq long, ts string, kind string, pair_id string, decision string, a string, b string, note string"


def roots(spark, edges):
    return dict(map(tuple, group_ids(spark.createDataFrame(edges, "a string, b string")).collect()))


def same_partition(got, edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            up[find(a)] = find(b)
    nodes = list(up)
    assert set(got) == set(nodes)
    assert all((got[x] == got[y]) == (find(x) == find(y)) for x in nodes for y in nodes)


def test_shapes(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)]
    hub = [("h", f"s{i}") for i in range(70)] + [("h", "s0"), ("s0", "h")]
    rng = random.Random(1)
    loose = [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(40)]
    edges = chain + hub + loose + [("only", "only"), (None, "x"), ("y", None)]
    same_partition(roots(spark, edges), edges)


def test_nothing(spark):
    assert roots(spark, []) == {}


def test_latest_event_counts(spark):
    log = [
        (1, "2020-01-02", "auto_merge", "p", None, "A", "B", None),
        (2, "2020-01-01", "review_decision", "p", "reject", None, None, None),
        (3, "2020-01-01", "review_decision", "q", "approve", "B", "C", None),
        (4, "2020-01-02", "review_decision", "q", "reject", None, None, None),
        (5, "2020-01-01", "review_decision", "r", "approve", None, None, None),
        (6, "2020-01-03", "spot_check", "r", None, "C", "D", None),
        (6, "2020-01-03", "spot_check", "r", None, "C", "D", None),
        (7, "2020-01-01", "review_decision", "s", None, "E", "F", None),
        (8, "2020-01-01", "auto_merge", "t", None, None, None, None),
        (9, "2020-01-01", "apply", None, None, None, None, None),
    ]
    assert sorted(map(tuple, linked_pairs(spark.createDataFrame(log, LOG)).collect())) == [("A", "B"), ("C", "D")]


def test_companies(spark):
    log = spark.createDataFrame([(1, "2020", "auto_merge", "p", None, "A", "X", None), (2, "2020", "auto_merge", "q", None, "X", "B", None)], LOG)
    rows = [(9, ["A", "A", None]), (4, ["B"]), (5, None), (6, []), (7, ["i4"]), (8, ["C"]), (3, ["C", "D"])]
    companies = spark.createDataFrame([(i, a, "a", "root") for i, a in rows], "id long, known_aliases array<string>, a string, root string")
    assert sorted(map(tuple, company_groups(companies, log).collect())) == [(3, 3), (4, 4), (8, 3), (9, 4)]
    assert company_groups(companies.limit(0), log.limit(0)).count() == 0
