"""Envelopes to records, duplicates, checks and confidence."""

import json
import os

import pytest
from pyspark.sql import functions as F

from alertloom.operators import dedupe, quality
from alertloom.plans.normalise import COLUMNS, normalise
from alertloom.sources import envelopes


def body(tab, month, rows, nested=False):
    payload = {"iTotalRecords": len(rows), "aaData": rows}
    return json.dumps({"url": f"u:{tab}:{month}", "tab": tab, "month": month, "fetched_at": "x", "payload": json.dumps(payload) if nested else payload})


def row(**more):
    return {
        "str_product_name": "Foo Tablets", "str_batch_no": "B1", "dt_manufacturing_date": "Jan-2020", "dt_expiry_date": "Dec-2019", "str_manufactured_by": "Acme Ltd., Baddi, H.P.", "str_nsq_result": "Assay",
        "str_reporting_source": "State lab", "str_reported_by_lab_or_state": "CDL Kolkata", "dt_reporting_month_year": "JUN-2021",
    } | more


def records(spark, *bodies):
    return {r["id"]: r for r in normalise(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()}


def test_one_record(spark):
    (r,) = records(spark, body("nsq", "Jun-2021", [row()])).values()
    assert list(r.asDict()) == COLUMNS
    assert (r["alert_month"], r["alert_section"], r["state"], r["lab_type"], r["failure_category"]) == ("2021-06", "state_lab", "Himachal Pradesh", "central", ["assay"])
    assert r["parse_flags"] == ["alert_section_disputed:published_state_lab_but_cdsco_laboratory:cdsco_seven", "expiry_before_mfg:2020-01>2019-12"]
    assert r["parse_confidence"] == 0.8 and r["label_claim_disputed"] is None


def test_duplicates_and_collisions(spark):
    same = [row(), row()]
    differ = [row(str_batch_no="B2"), row(str_batch_no="B2", dt_expiry_date="Jan-2022")]
    got = records(spark, body("nsq", "Jun-2021", same + differ, nested=True), body("nsq", None, [row(str_batch_no="B3")]), "no json", body("nsq", "Jul-2021", []))
    flags = [[f for f in r["parse_flags"] if f.startswith(("dup", "id_"))] for r in got.values()]
    assert sorted(flags) == [["duplicate_source_rows_collapsed:2"], ["id_collision_disambiguated:1of2"], ["id_collision_disambiguated:2of2"]]
    assert sum(k.endswith(("_1", "_2")) for k in got) == 2


def test_spurious(spark):
    one = row(product_name_from_dtl="Bar", str_firm_reply="It was denied", str_nsq_remarks=None, num_id=None)
    two = row(product_name_from_dtl="Baz", str_manufactured_by="Under Investigation", num_id=7, str_nsq_result=None, str_manufacturing_state="Goa", str_dosage_form="Gel")
    got = records(spark, body("spurious", "Jun-2021", [one, two]))
    a = next(r for k, r in got.items() if k != "SPU_7")
    b = got["SPU_7"]
    assert a["id"].startswith("SPU_2021-06_") and a["label_claim_disputed"] == 1 and a["failure_reason_raw"] == "Assay\n[Firm's reply] It was denied" and a["failure_category"] == ["spurious", "assay"]
    assert b["state"] == "Goa" and b["dosage_form"] == "Gel" and b["failure_category"] == ["spurious"] and b["label_claim_disputed"] == 0
    assert b["parse_flags"][:3] == ["manufacturer_unknown_placeholder:Under Investigation", "failure_reason_empty", "dispute_status_unknown:no_firm_reply_or_remarks"]


def test_no_files(spark):
    assert records(spark) == {}


def test_snapshots_and_months(spark, tmp_path):
    (tmp_path / "a.json").write_text(body("nsq", "Jun-2021", [row()]))
    (tmp_path / "b.json").write_text(body("nsq", None, [row()]))
    (tmp_path / "_current.json").write_text(body("nsq", None, [row()]))
    files = envelopes.read_envelopes(spark, str(tmp_path))
    assert files.count() == 2 and envelopes.skipped_snapshots(files).first()[0] == 1
    held = envelopes.portal_rows(files).select("tab", "month")
    assert envelopes.missing_months(envelopes.all_months(spark, ["nsq"], 2021, 2021), held).count() == 11


def test_confidence_is_bounded(spark):
    df = spark.createDataFrame([([],), (["missing_required:x"] * 9,), (["new_kind:1", "state_ambiguous:a/b"],)], "f array<string>")
    assert [r[0] for r in df.select(quality.confidence(F.col("f"))).collect()] == [1.0, 0.3, 0.95]


def test_upsert_and_last_written(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, v string, w int")
    new = spark.createDataFrame([(2, "c"), (3, None)], "id int, v string")
    assert sorted(map(tuple, dedupe.upsert(old, new, "id").collect())) == [(1, "a", 1), (2, "c", None), (3, None, None)]
    log = spark.createDataFrame([("k", 1, "x"), ("k", 2, None), ("l", 1, "y")], "k string, n int, v string")
    assert sorted(map(tuple, dedupe.last_written(log, ["k"], ["n"]).collect())) == [("k", 2, None), ("l", 1, "y")]


def test_guards(spark):
    c = spark.createDataFrame([(1,), (2,)], "id int")
    r = spark.createDataFrame([(1,), (None,)], "manufacturer_id int")
    assert [x[0] for x in quality.guard_used(c, r).collect()] == [2]
    assert quality.guard_unique(r, "manufacturer_id").count() == 0


def test_log_keeps_what_it_has(spark, tmp_path):
    e = spark.createDataFrame([("a",)], "pair_id string")
    envelopes.append_log(e, str(tmp_path / "log"))
    envelopes.append_log(e, str(tmp_path / "log"))
    assert envelopes.read_log(spark, str(tmp_path / "log"), "pair_id string, ts timestamp").count() == 2


@pytest.mark.skipif("ALERTLOOM_ENVELOPES" not in os.environ, reason="no folder of published envelopes")
def test_published_envelopes(spark):
    """Counts that are known for the months in which the published files are complete."""
    r = normalise(envelopes.read_envelopes(spark, os.environ["ALERTLOOM_ENVELOPES"])).cache()
    years = dict(map(tuple, r.where("alert_section <> 'spurious'").groupBy(F.substring("alert_month", 1, 4)).count().collect()))
    assert r.count() == 1836 and years["2019"] == 403 and years["2021"] == 345
    assert r.where("alert_section = 'spurious'").count() == 46 and r.where("label_claim_disputed = 1").count() == 43
