"""Free-entered values mapped to their lists; the join against brute force."""

import random

import pytest

from alertloom.llm.canonical_values import canonical_values, pigeonhole

LABS = [(1, "State Drug Analysis Laboratory, Bellinkavonagar", "state", "Bellinkavonagar"), (2, "Combined Food and Drug Laboratory, Sovenritawadi", "state", "Sovenritawadi"), (3, "State Drug Analysis Laboratory, Sovenritawadi", "state", "Sovenritawadi"), (4, None, None, None)]
STATES = [(i, s) for i, s in enumerate(["Himachal Pradesh", "Punjab", "Uttar Pradesh", "Uttarakhand", "Goa", "Jammu and Kashmir", "Andhra Pradesh", "Karnataka", "Haryana"])]


def mapped(spark, labs=(), states=()):
    n = max(len(labs), len(states))
    rows = [(str(i), labs[i] if i < len(labs) else None, states[i] if i < len(states) else None, "v") for i in range(n)]
    df = spark.createDataFrame(rows, "id string, testing_lab string, state string, value string")
    out = canonical_values(df, spark.createDataFrame(LABS, "lab_id long, lab_name string, lab_type string, town string"), spark.createDataFrame(STATES, "state_id long, state_name string"))
    return {(r["id"], r["field"]): r["canonical"] for r in out.collect()}


def test_labs(spark):
    b, s, sd = LABS[0][1], LABS[1][1], LABS[2][1]
    values = [
        (b, None), ("SDAL Bellinkavonagar", b), ("s d a l (bellinkavnagar)", b), ("Bellinkavonagar, St. Drg. Analytical Lab.", b), ("THE STATE DRUG ANALYSIS LABORATRY,\nBELLINKAVONAGAR.", b), ("CFDL/Sovenritawadi", s),
        ("Comb. Foods & Drugs Labs Sovneritawadi", s), ("S.D.A.L. Sovenritawadi", sd), ("CFDL Bellinkavonagar", ""), ("SDAL", ""), ("Drugs Inspector, Sovenritawadi", ""), ("State Drug Analysis Laboratory, Elsewhere", ""), ("", ""), ("--", ""), (None, None),
    ]
    got = mapped(spark, [v for v, _ in values])
    assert {i: c for (i, f), c in got.items() if f == "testing_lab"} == {str(i): c for i, (v, c) in enumerate(values) if c is not None}


def test_states(spark):
    values = [
        ("Punjab", None), ("PUNJAB STATE", "Punjab"), ("Pnujab", "Punjab"), ("(H.P.)", "Himachal Pradesh"), ("HimachalP radesh", "Himachal Pradesh"), ("Himachal Pr.", "Himachal Pradesh"), ("Distt. Sometown (Goa)", "Goa"), ("U. P.", "Uttar Pradesh"),
        ("Uttaranchal", "Uttarakhand"), ("J&K", "Jammu and Kashmir"), ("Sometown, Utarakhand - 241804", "Uttarakhand"), ("K'taka", "Karnataka"), ("Hry.", "Haryana"), ("Punjab/Haryana", ""), ("Gujarat or Goa", "Goa"), ("Punjab or Haryana", ""), ("Nepal", ""), ("?", ""), ("India", ""),
    ]
    got = mapped(spark, states=[v for v, _ in values])
    assert {i: c for (i, f), c in got.items()} == {str(i): c for i, (v, c) in enumerate(values) if c is not None}


def test_nothing(spark):
    assert mapped(spark) == {}
    df = spark.createDataFrame([("1", "x", "y")], "id string, testing_lab string, state string")
    labs, states = spark.createDataFrame([], "lab_id long, lab_name string, lab_type string, town string"), spark.createDataFrame([], "state_id long, state_name string")
    assert {r["canonical"] for r in canonical_values(df, labs, states).collect()} == {""}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_finds_all_within_k(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))
    words, entries = {word() for _ in range(80)}, {word() for _ in range(25)}
    got = {tuple(r) for r in pigeonhole(spark, spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(e,) for e in entries], "entry string")).collect()}
    assert got == {(w, e, d) for w in words for e in entries if (d := distance(w, e)) <= min(2, max(0, len(e) - 3))}
