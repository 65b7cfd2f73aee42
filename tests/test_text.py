"""Case tables of the scalar normalisers."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alertloom.functions import similarity
from alertloom.functions import text as X


def run(spark, f, values, *more):
    """The results of a one-column expression for some values, nulls included."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_clean_text(spark):
    assert run(spark, X.clean_text, ["  a \n b\t", "", "   ", None, "ﬁne１"]) == ["a b", None, None, None, "fine1"]


def test_month(spark):
    assert run(spark, X.month, ["JUN-2026", "Sept 2020", "foo-2020", "2020-06", None, "Jan/1999 "]) == ["2026-06", "2020-09", None, None, None, "1999-01"]


@pytest.mark.parametrize(
    ("raw", "value", "flag"),
    [
        ("Jun-2025", "2025-06", None),
        ("06/2025", "2025-06", None),
        ("13/2025", None, "date_unparsed:13/2025"),
        ("12-09-2024", "2024-09-12", None),
        ("32-09-2024", None, "date_unparsed:32-09-2024"),
        ("2024-09-12T00:00", "2024-09-12", None),
        ("2024-99", "2024-99", None),
        ("Feb'16", "2016-02", "date_two_digit_year_assumed_20xx"),
        ("soon", None, "date_unparsed:soon"),
        (None, None, None),
    ],
)
def test_partial_date(spark, raw, value, flag):
    assert tuple(run(spark, X.partial_date, [raw])[0]) == (value, flag)


def test_section(spark):
    assert [tuple(x) for x in run(spark, X.section, ["CDSCO lab", "State Lab", None, "Not applicable"])] == [
        ("central_lab", None), ("state_lab", None), (None, "alert_section_missing"), (None, "alert_section_unrecognised:not applicable"),
    ]


@pytest.mark.parametrize(
    ("reason", "expected"),
    [
        ("Fails in Dissoluti on and Assay", ["dissolution", "assay"]),
        ("Water content", ["water_content"]),
        ("Water-soluble substances", ["other"]),
        ("Loss on drying", ["loss_on_drying"]),
        ("Related Susbtances", ["related_substances"]),
        ("Misbranded, pH", ["description_labelling", "ph"]),
        ("Sterillity; bacterial endotoxins", ["sterility", "bacterial_endotoxins"]),
        ("NSQ", ["other"]),
        (None, ["other"]),
    ],
)
def test_categories(spark, reason, expected):
    assert run(spark, X.categories, [reason])[0]["value"] == expected


def test_category_flags(spark):
    assert [x["flag"] for x in run(spark, X.categories, [None, "odd thing", "assay"])] == ["failure_reason_empty", "failure_category_unmapped:odd thing", None]


def test_spurious_categories(spark):
    df = spark.createDataFrame([(["other"],), (["assay", "dissolution"],)], "c array<string>")
    assert [r[0] for r in df.select(X.spurious_categories(F.col("c"))).collect()] == [["spurious"], ["dissolution", "spurious", "assay"]]


def test_pin(spark):
    assert run(spark, X.pin_of, ["Plot 611612, Town-382445", "999999", "1234567", None, "a 110001 b 000001"]) == ["382445", None, None, None, "110001"]
    states = [tuple(x) for x in run(spark, X.state_of_pin, ["382445", "194101", "160001", "403001", "12", None])]
    assert states == [("Gujarat", "state_derived_from_pin:382445"), (None, "state_ambiguous_pin:194"), (None, "state_ambiguous_pin:160"), ("Goa", "state_derived_from_pin:403001"), (None, None), (None, None)]


@pytest.mark.parametrize(
    ("address", "value", "flag"),
    [
        ("Baddi, H.P. - 382445", "Himachal Pradesh", None),
        ("Orissa and Odisha", "Odisha", None),
        ("Punjab, Haryana 382445", None, "state_ambiguous:Haryana/Punjab"),
        ("Somewhere 382445", "Gujarat", "state_derived_from_pin:382445"),
        ("Nowhere", None, "state_not_derived:no_match"),
        (None, None, "state_not_derived:no_address"),
        ("Under Investigation", None, "state_not_derived:manufacturer_unknown"),
    ],
)
def test_state(spark, address, value, flag):
    assert tuple(run(spark, X.state, [address])[0]) == (value, flag)


def test_explicit_state_comes_first(spark):
    assert run(spark, lambda c: X.state(c, F.lit("Pondicherry")), ["Punjab"])[0]["value"] == "Puducherry"


@pytest.mark.parametrize(
    ("raw", "kind", "basis"),
    [
        ("CDTL-Mumbai", "central", "cdsco_laboratory:cdsco_seven"),
        ("RDTL, Bellary", "state", "state_run_regional_lab:karnataka_rdtl"),
        ("RDTL Guwahati", "central", "cdsco_laboratory:cdsco_seven"),
        ("Drugs Testing Laboratory, Chennai", "state", "state_marker:drugs testing laboratory"),
        ("CDSCO, Sub Zone, Baddi", "central", "cdsco_office"),
        ("DTLBikaner", "state", "state_marker:dtlbikaner"),
        ("West Bengal", "state", "bare_state_name"),
        ("N.A.", "unknown", "not_a_lab_name"),
        ("Elsewhere", "unknown", "unrecognised_lab"),
        (None, "unknown", "not_a_lab_name"),
    ],
)
def test_lab(spark, raw, kind, basis):
    x = run(spark, X.lab, [raw])[0]
    assert (x["type"], x["basis"]) == (kind, basis)


def test_lab_disagrees_with_section(spark):
    assert run(spark, lambda c: X.lab_with_flag(c, F.lit("state_lab")), ["CDL Kolkata"])[0]["flag"] == "alert_section_disputed:published_state_lab_but_cdsco_laboratory:cdsco_seven"


def test_drug_key(spark):
    assert run(spark, X.drug_key, ["“Foo” Tablets (", " .Bar-", "..", None]) == ["foo tablets", "bar", None, None]


def test_company_parts(spark):
    got = [tuple(x) for x in run(spark, X.company_parts, ["M/s. Zee Labs Ltd., Plot 4, Town", "Acme Pharma Plot No. 5 Town", "Acme 7 Road", "Plot", "Foo (WHO GMP Certified) Ltd, X", None])]
    assert got == [("Zee Labs Ltd", "Plot 4, Town"), ("Acme Pharma", "Plot No. 5 Town"), ("Acme", "7 Road"), ("Plot", ""), ("Foo Ltd", "X"), ("", "")]


def test_company_key(spark):
    keys = run(spark, X.company_key, ["Zee Laboratories Pvt. Ltd.", "Deep & Sons Life Sciences R.S.", "Foo Pharmaceuticals India", "Ltd", "A"])
    assert keys == ["zee lab", "deep sons lifescience", "foo pharma", "", ""]
    assert run(spark, X.company_core, ["zee lab", "pharma lab"]) == ["zee", "pharma lab"]


def test_no_company(spark):
    assert run(spark, X.no_company, ["NIL, NIL", "Not Mentioned", "Nilgiri Ltd", "-", None]) == [True, True, False, True, False]


def test_pair_id_is_symmetric(spark):
    import hashlib

    df = spark.createDataFrame([("a", "b"), ("b", "a")], "a string, b string")
    want = hashlib.sha1(b"a\x00b").hexdigest()[:16]
    assert {r[0] for r in df.select(X.pair_id(F.col("a"), F.col("b"))).collect()} == {want}


def test_tiers(spark):
    df = spark.createDataFrame([(0.93,), (0.92,), (0.75,), (0.74,)], "s double")
    assert [r[0] for r in df.select(X.tier(F.col("s"))).collect()] == ["auto", "review", "review", "no_match"]


def test_slug(spark):
    assert run(spark, X.slug, ["Zée & Co. (India)", "—", None, "x" * 80]) == ["ze-e-co-india", "unknown", "unknown", "x" * 60]


def test_stem_classes(spark):
    got = run(spark, X.stem_classes, ["Amoxycillin and Ofloxacin", "Dactinomycin", "Natamycin eye drops", "Ornidazole, Ganciclovir", "Paracetamol", None])
    assert got == [["antibacterial"], [], ["antifungal"], ["antiprotozoal", "antiviral"], [], []]


def test_formats(spark):
    assert run(spark, X.long_month, ["2025-06", "2025-06-02", "2025-13", "x", None]) == ["June 2025", "2 June 2025", "2025-13", "x", None]
    assert run(spark, X.short_month, ["2025-06-12"]) == ["12 Jun 2025"]
    assert run(spark, X.category_label, ["water_content", "ph", None]) == ["Water content", "pH", None]
    assert run(spark, X.batch_key, ["TJ 24-25/A", None]) == ["tj2425a", None]
    assert run(spark, X.reason_only, ["Assay\n[Firm's reply] no", "Assay"]) == ["Assay", "Assay"]
    assert run(spark, X.directory_state, ["JAMMU & KASHMIR", "ORISSA", "UTTAR PRADESH"]) == ["Jammu and Kashmir", "Odisha", "Uttar Pradesh"]


def test_record_id_ignores_case_and_space(spark):
    rows = [("2020-01", "B 1", None), ("2020-01", " b  1 ", None), (None, "b 1", None)]
    df = spark.createDataFrame(rows, "m string, b string, d string")
    got = [r[0] for r in df.select(X.record_id(F.col("m"), F.col("b"), F.col("d"))).collect()]
    assert got[0] == got[1] != got[2] and got[2].startswith("NSQ_unknown_")


def test_disputes(spark):
    df = spark.createDataFrame([("Denied by the firm", None), (None, None), ("ok", None)], "a string, b string")
    got = [tuple(r[0]) for r in df.select(X.disputed(F.col("a"), F.col("b"))).collect()]
    assert got == [(1, None), (0, "dispute_status_unknown:no_firm_reply_or_remarks"), (0, None)]


@settings(max_examples=60, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_ratio_against_a_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            t[i][j] = t[i - 1][j - 1] + 1 if x == y else max(t[i - 1][j], t[i][j - 1])
    assert similarity.common_length(a, b) == t[-1][-1]
    assert 0 <= similarity.token_set_ratio(a, b) <= 1
    assert similarity.token_sort_ratio(a, b) == similarity.token_sort_ratio(b, a)
