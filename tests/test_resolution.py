"""Components, blocking, scores, clusters and what is made of them."""

import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from alertloom.operators import resolution as R
from alertloom.operators.components import connected_components


def union_find(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    groups = {}
    for x in list(up):
        groups.setdefault(find(x), []).append(x)
    return {x: min(g) for g in groups.values() for x in g}


def components(spark, edges):
    return dict(map(tuple, connected_components(spark.createDataFrame(edges, "a string, b string")).collect()))


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdefghij"), st.sampled_from("abcdefghij")), max_size=12))
def test_components_of_any_graph(spark, edges):
    assert components(spark, edges) == union_find(edges)


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)]
    hub = [("x", f"y{i}") for i in range(60)]
    assert components(spark, chain + hub + [("z", "z"), (None, "q")]) == union_find(chain + hub + [("z", "z")])


def test_no_edges(spark):
    assert components(spark, []) == {}


RECORDS = [
    ("Zee Laboratories Ltd., Baddi, H.P. 173205", "2020-02"),
    ("Zee Laboratories Ltd., Baddi, H.P. 173205", "2020-01"),
    ("M/s Zee Labs Pvt Ltd, Paonta, Uttarakhand 248001", "2019-01"),
    ("Acme Pharma, Goa", None),
    ("ACME PHARMA, Goa", "2021-01"),
    ("Not Mentioned", "2021-01"),
    (None, "2021-01"),
]


def entities(spark):
    return R.entities(spark.createDataFrame(RECORDS, "manufacturer_raw string, alert_month string"))


def test_entities(spark):
    got = {r["raw"]: r for r in entities(spark).collect()}
    assert len(got) == 4
    z = got[RECORDS[0][0]]
    assert (z["norm"], z["core"], z["pins"], z["state"], z["records"], z["first_month"]) == ("zee lab", "zee", ["173205"], "Himachal Pradesh", 2, "2020-01")


def test_pairs_scores_and_companies(spark):
    own = entities(spark)
    scored = R.scored_pairs(own, R.candidate_pairs(R.blocks(own)))
    got = {(r["a"][:4], r["b"][:4]): r for r in scored.collect()}
    acme = got["ACME", "Acme"]
    assert acme["score"] == 1.0 and acme["tier"] == "auto" and acme["signals"] == []
    zee = got["M/s ", "Zee "]
    assert zee["tier"] == "review" and zee["score"] <= 0.86 and [s.split(":")[0] for s in zee["signals"]][:2] == ["state_differs", "pin_differs"]
    grouped = R.clusters(own, scored.where("tier = 'auto'"))
    queue = R.review_queue(own, scored, grouped)
    (q,) = queue.collect()
    assert (q["records_a"] + q["records_b"], q["supporting_pairs"]) == (3, 1)
    assert R.triage(queue).first()["bucket"] == "multi_plant"
    companies = R.numbered(R.companies(own, grouped)).orderBy("id").collect()
    assert [(c["id"], c["canonical_name"], c["total_flags"]) for c in companies] == [(1, "Acme Pharma", 2), (2, "Zee Laboratories Ltd", 2), (3, "Zee Labs Pvt Ltd", 1)]
    log = spark.createDataFrame([("review_decision", q["pair_id"], 1, "reject"), ("review_decision", q["pair_id"], 2, "approve")], "kind string, pair_id string, log_seq long, decision string").selectExpr("*", "'me' AS reviewer")
    merged = R.apply_decisions(own, scored, queue, log)
    assert merged.select("cluster").distinct().count() == 2
    assert R.pending(queue, R.decisions(log)).count() == 0
    records = spark.createDataFrame(RECORDS, "manufacturer_raw string, alert_month string").selectExpr("*", "cast(null as long) AS manufacturer_id")
    filled = R.backfill(records, R.numbered(R.companies(own, merged)))
    assert filled.where("manufacturer_id IS NULL").count() == 2


def test_large_blocks_are_left_out(spark):
    rows = spark.createDataFrame([(f"foo {c}", f"foo {c}", "foo") for c in "abcdef"], "raw string, norm string, core string")
    assert R.candidate_pairs(R.blocks(rows, limit=5)).count() == 0
    assert R.candidate_pairs(R.blocks(rows, limit=None)).count() == 15


def test_spanning_edges_are_those_taken_one_by_one(spark):
    rng = random.Random(3)
    edges = [(a, b, round(rng.choice([0.93, 0.95, 1.0]), 2)) for a, b in itertools.combinations("abcdefgh", 2) if rng.random() < 0.5]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    want = set()
    for a, b, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if find(a) != find(b):
            up[find(a)] = find(b)
            want.add((a, b))
    assert set(map(tuple, R.spanning_edges(spark.createDataFrame(edges, "a string, b string, score double")).collect())) == want


def test_log_entries_are_new_by_pair_and_score(spark):
    s = spark.createDataFrame([("p", 0.95), ("q", 0.95)], "pair_id string, score double")
    log = spark.createDataFrame([("auto_merge", "p", 0.95), ("auto_merge", "q", 0.96)], "kind string, pair_id string, score double")
    assert [r["pair_id"] for r in R.new_log_entries(s, log).collect()] == ["q"]


def test_cohesion(spark):
    own = spark.createDataFrame([("a", "zee lab"), ("b", "zee lab"), ("c", "zee labs x"), ("d", "foo")], "raw string, norm string")
    grouped = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "2")], "raw string, cluster string")
    (r,) = R.cohesion(own, grouped).collect()
    assert (r["cluster"], r["size"]) == ("1", 3) and 0.7 < r["weakest"] < 1
