"""Listings, downloads, directories, and the monthly stream."""

import datetime
import hashlib
import json

from pyspark.sql import functions as F

from alertloom.sources import listing
from alertloom.streaming import monthly

PAGE = """<tr><td>x</td><td>NSQ alert</td><td>2025-Jan-01</td><a href="/download_file_division.jsp?n=0"></a></tr><table><tbody>
<tr><td>1</td><td>NSQ  <b>Alert</b></td><td>2025-Jul-18</td><td>185 KB <a href='download_file_division.jsp?n=1'>get</a></td></tr>
<tr><td>2</td><td>Other notice</td><td>2025-Jul-18</td><td><a href="download_file_division.jsp?n=2">get</a></td></tr>
<tr><td>3</td><td>List of spurious drugs</td><td>someday</td><td>1 KB <a href="/download_file_division.jsp?n=3">get</a></td></tr></tbody>"""


def test_listing(spark):
    pages = spark.createDataFrame([("a", PAGE), ("b", PAGE), ("c", None)], "page string, html string")
    got = listing.listed_documents(pages, "https://example.invalid").collect()
    assert [(r["title"], r["release"], r["link"], r["page"]) for r in got] == [
        ("NSQ Alert", datetime.date(2025, 7, 18), "https://example.invalid/download_file_division.jsp?n=1", "a"),
        ("List of spurious drugs", None, "https://example.invalid/download_file_division.jsp?n=3", "a"),
    ]
    name = listing.listed_documents(pages, "https://example.invalid").select(listing.file_name(F.col("title"), F.col("link"), F.col("release"))).first()[0]
    assert name == "2025-07-18_nsq-alert_" + hashlib.sha1(got[0]["link"].encode()).hexdigest()[:6] + ".pdf"


def test_document_link(spark):
    df = spark.createDataFrame([("<iframe src='/a%20b.pdf'>",), ("<!-- /c.pdf -->",), ("none",)], "h string")
    assert [r[0] for r in df.select(listing.document_link(F.col("h"), "https://example.invalid")).collect()] == ["https://example.invalid/a b.pdf", "https://example.invalid/c.pdf", None]


def test_manifest_and_directory(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "d" / "b.pdf").write_bytes(b"<html>")
    got = {r["path"][-5:]: r for r in listing.manifest(spark, str(tmp_path / "d")).collect()}
    assert got["a.pdf"]["status"] == "downloaded" and got["b.pdf"]["status"] == "not-a-pdf" and got["b.pdf"]["sha256"] == hashlib.sha256(b"<html>").hexdigest()
    (tmp_path / "p.csv").write_text("pincode,statename\n110001,delhi\n12,x\n110002,NULL\n")
    assert [tuple(r) for r in listing.pin_directory(spark, str(tmp_path / "p.csv")).collect()] == [("110001", "DELHI")]


def test_monthly_stream(spark, tmp_path):
    from test_records import body, row

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text(body("nsq", "Jun-2021", [row(), row(str_batch_no="B2")]))
    run = lambda: monthly.run_monthly(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (src / "b.json").write_text(body("nsq", "Jul-2021", [row(dt_reporting_month_year="JUL-2021")]))
    run()
    assert spark.read.parquet(str(tmp_path / "out" / "v=1")).count() == 3


def test_windows(spark):
    e = spark.createDataFrame([("2024-01-01 10:00:00", "a"), ("2024-01-01 23:00:00", "a"), ("2024-01-02 01:00:00", "b")], "t string, k string").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted(r["n"] for r in monthly.windowed_counts(e, "t", "k").collect()) == [1, 2]


def test_json_of_rows_is_read_as_text(spark):
    from alertloom.sources.envelopes import portal_rows

    b = json.dumps({"url": "u", "tab": "nsq", "month": "Jun-2021", "payload": {"aaData": [{"num_id": 7, "str_batch_no": "B"}, {}]}})
    assert [(r["num_id"], r["str_batch_no"]) for r in portal_rows(spark.createDataFrame([(b,)], "body string")).orderBy("row_no").collect()] == [("7", "B"), (None, None)]
