"""Questions, search and export on a few rows, and their answers to nothing."""

from pyspark.sql import functions as F

from alertloom.operators import search
from alertloom.plans import export
from alertloom.plans import questions as Q

SCHEMA = (
    "id string, alert_month string, alert_section string, drug_name_raw string, drug_name_clean string, batch_number string, manufacturer_raw string, manufacturer_id long, label_claim_disputed int, "
    "failure_reason_raw string, failure_category array<string>, testing_lab string, lab_type string, state string, parse_flags array<string>"
)
ROWS = [
    ("a", "2020-01", "central_lab", "Amoxycillin Tabs", "amoxycillin tabs", "TJ 1-2", "Zee Labs", 1, 1, "Assay", ["assay"], "Lab A", "central", "Goa", []),
    ("b", "2020-01", "state_lab", "Paracetamol", "paracetamol", "tj12", "Zee Labs", 1, 0, "NSQ", ["other"], " lab a", "state", None, ["state_ambiguous:Goa/Punjab"]),
    ("c", "2020-02", "state_lab", "Amoxicillin Gel", "amoxicillin gel", "x", "Acme", 2, None, "pH, sterility", ["sterility", "ph"], "Lab B", "state", "Goa", ["alert_section_disputed:x"]),
    ("d", None, None, None, None, None, None, None, None, None, None, None, None, None, None),
]


def records(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def companies(spark):
    return spark.createDataFrame([(1, "Zee Laboratories", ["Zee Labs"], "Goa", 2), (2, "Acme", ["Acme"], None, 1), (3, "Rest", None, None, 1)], "id long, canonical_name string, known_aliases array<string>, state string, total_flags long")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_volume(spark):
    r = records(spark)
    assert rows(Q.by_month(r)) == [("2020-01", 2), ("2020-02", 1)]
    assert rows(Q.by_year(r)) == [("2020", 3, 2)]
    assert tuple(Q.volume_summary(r).first()) == (3, 2, "2020-01", "2020-02", 1)


def test_categories(spark):
    r = records(spark)
    assert ("assay", 1, 25.0) in rows(Q.category_counts(r))
    assert rows(Q.labels_per_record(r)) == [(0, 1), (1, 2), (2, 1)]
    assert tuple(Q.label_unions(r).first()) == (4, 1, 1, 1, 1)


def test_concentration(spark):
    c = companies(spark)
    got = {k: (n, f) for k, n, f, *_ in rows(Q.concentration(c, shares=[1, 2, 9]))}
    assert got == {1: (1, 2), 2: (2, 3), 9: (3, 4)}
    assert tuple(Q.long_tail(c).first()) == (3, 4, 2, 66.7, 1, 2)
    assert [r["name"] for r in Q.top_companies(c).orderBy("rank").collect()] == ["Zee Laboratories", "Acme", "Rest"]


def test_labs(spark):
    r = records(spark)
    assert rows(Q.labs_under_both(r)) == [("lab a", 2, 1, 1, 1)]
    assert tuple(Q.label_disputes(r).first()) == (1, 0, 0)
    assert rows(Q.distribution(r, "lab_type")) == [("central", 1, 25.0), ("missing", 1, 25.0), ("state", 2, 50.0)]
    assert ("assay", 1, 100.0, 0, 0.0, 100.0) in rows(Q.category_profile(r))
    assert Q.divergences(Q.category_profile(r), support=1, k=2).count() == 2


def test_trend_states_classes(spark):
    r = records(spark)
    t = Q.trend(r, "2020-02").first()
    assert (t["mean_before"], t["mean_after"], t["cut_off_count"], t["peak_month"], t["peak_count"], t["growth"]) == (2.0, 1.0, 1, "2020-01", 2, None)
    assert rows(Q.state_counts(r)) == [("Goa", 2, 100.0)] and tuple(Q.state_coverage(r).first()) == (4, 2, 50.0, 1)
    assert rows(Q.why_no_state(r)) == [("state_ambiguous", 1)]
    assert rows(Q.class_counts(r)) == [("antibacterial", 2, 50.0)]
    assert ("-cillin", "antibacterial", "amoxycillin", 1) in rows(Q.stem_audit(r))


def test_no_records(spark):
    r = records(spark, [])
    for f in (Q.by_month, Q.by_year, Q.category_counts, Q.labels_per_record, Q.labs_under_both, Q.category_profile, Q.state_counts, Q.why_no_state, Q.class_counts, Q.stem_audit):
        assert f(r).count() == 0
    assert Q.volume_summary(r).first()["total"] == 0 and Q.state_coverage(r).first()["coverage"] == 0.0
    assert Q.concentration(companies(spark).limit(0)).count() == 0


def test_sets(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in (["a", "b", "b", None], ["b", "c"]))
    assert tuple(Q.reconcile(a, b, "k").first()) == (1, 1, 1, 50.0)
    d = spark.createDataFrame([("110001", "X"), ("110002", "X"), ("121001", "Y"), ("122001", "Z"), ("122002", "Z"), ("123001", "Y"), ("123002", "Z")], "pincode string, statename string")
    assert rows(Q.prefix_states(d, F.col("lo"))) == [("11", "X"), ("121", "Y"), ("122", "Z")]


def test_agreement(spark):
    a = spark.createDataFrame([("k", "Foo Ltd", 1), ("k", "Zoo", 2), ("m", None, 1), ("n", "x", 1)], "k string, name string, n int")
    b = spark.createDataFrame([("k", "foo", 2), ("m", "y", 1)], "k string, name string, n int")
    assert rows(Q.field_agreement(a, b, "k", ["name", "n"])) == [("n", 2, 1), ("name", 2, 1)]


def hits(spark):
    return search.hits(records(spark), companies(spark))


def test_batches_are_exact(spark):
    h = hits(spark)
    assert sorted(r["id"] for r in search.by_batch(h, " tj-12 ").collect()) == ["a", "b"]
    assert search.by_batch(h, "tj1").count() == search.by_batch(h, "--").count() == 0


def test_companies_by_either_name(spark):
    h = hits(spark)
    assert sorted(r["id"] for r in search.by_company(h, "LABORA").collect()) == ["a", "b"]
    assert search.by_company(h, "  ").count() == 0


def test_words_are_ranked(spark):
    h = hits(spark)
    got = search.by_words(h, search.postings(h), "amoxicillin").orderBy(F.desc("score"), "id").collect()
    assert [r["id"] for r in got] == ["c", "a"] and got[0]["score"] > got[1]["score"] > 0
    assert search.by_words(h, search.postings(h), "?!").count() == 0


def test_all_modes_in_order(spark):
    h = hits(spark)
    i = search.postings(h)
    got = search.search(h, i, "acme")
    assert [r["id"] for r in got.orderBy("place").collect()] == ["c"]
    assert search.search(h, i, "tj12").orderBy("place").first()["id"] == "a"
    assert search.search(h, i, " ").count() == 0 and search.page(got, 0).count() == 1 and search.page(got, 1).count() == 0


def test_export(spark, tmp_path):
    r = records(spark).selectExpr("*", *[f"cast(null as string) AS {c}" for c in ("dosage_form", "mfg_date", "expiry_date", "lab_name_canonical", "source_url", "source_type")], "1.0 AS parse_confidence")
    d = export.dataset(r, companies(spark))
    assert len(d.columns) == 23
    got = {x["record_id"]: x for x in d.collect()}
    assert got["c"]["failure_categories"] == "sterility|ph" and got["c"]["manufacturer_canonical"] == "Acme" and got["d"]["label_claim_disputed"] is None
    export.write_csv(d, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4
    assert rows(export.dictionary(r, "manufacturer_raw", ["id"])) == [("Acme", 1), ("Zee Labs", 0)]
    assert rows(export.slugs(companies(spark)))[0][1].startswith("zee-laboratories-")
    s = export.summary(r).first()
    assert s["months"] == ["2020-02", "2020-01"] and s["categories"]["assay"] == 1
    export.write_index(export.index_rows(r, companies(spark)), str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).where("mfr = -1").count() == 1
    assert [x["id"] for x in export.company_page(r, 1).collect()] == ["a", "b"]


def test_spot_check_and_carry_forward(spark):
    c = spark.createDataFrame([(str(i), i / 10) for i in range(10)], "cluster string, weakest double")
    got = export.spot_check(c, 4, 1).collect()
    assert len({r["cluster"] for r in got}) == 4 and {"0", "1"} <= {r["cluster"] for r in got}
    t = spark.createDataFrame([("p", 1, "x"), ("p", 2, None), ("q", 1, None)], "g string, n int, v string")
    assert rows(export.carry_forward(t, ["g"], ["n"], "v")) == [("p", 1, "x"), ("p", 2, "x"), ("q", 1, None)]
