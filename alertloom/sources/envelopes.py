"""Envelopes of monthly downloads: {url, tab, month, fetched_at, payload {aaData}}."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import month

ENVELOPE = "url string, tab string, month string, fetched_at string, payload string"
#: Every field that rows of either tab may have; absent ones are null. Numbers come as their text.
ROW = ", ".join(
    f"{name} string"
    for name in (
        "str_product_name str_batch_no dt_manufacturing_date dt_expiry_date str_manufactured_by str_nsq_result str_reporting_source str_reported_by_lab_or_state dt_reporting_month_year "
        "product_name_from_dtl product_name_from_mst str_nsq_remarks str_firm_reply str_spurious_manufactured_by str_spurious_manufacturer_name srno str_dosage_form num_id str_route "
        "str_nsq_category str_manufacturer_name str_manufacturing_state num_spurious_flag dt_spurious_date"
    ).split()
)


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file below a folder: file and the text of its body.

    Files whose names begin with an underscore are snapshots; Spark's file
    sources never list them.
    """
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))


def parse_envelope(body: Column) -> Column:
    """The envelope of a body; a payload that is itself a JSON text is taken as it stands."""
    return F.from_json(body, ENVELOPE)


def portal_rows(files: DataFrame, body: str = "body") -> DataFrame:
    """One row per published row: url, tab, month, month_key, row_no and its fields.

    Snapshots (no month) are skipped, as a month's file has their rows.
    Unreadable bodies and payloads without rows give none. ``month_key`` and
    ``row_no`` keep the order of publication.
    """
    e = files.select(parse_envelope(F.col(body)).alias("e")).select("e.*").where("month IS NOT NULL")
    data = F.from_json("payload", f"aaData array<struct<{ROW.replace(' string', ':string')}>>")["aaData"]
    return e.select("url", "tab", "month", month(F.col("month")).alias("month_key"), F.posexplode(data).alias("row_no", "r")).select("url", "tab", "month", "month_key", "row_no", "r.*")


def skipped_snapshots(files: DataFrame, body: str = "body") -> DataFrame:
    """How many envelopes have no month."""
    return files.select(parse_envelope(F.col(body))["month"].alias("m")).agg(F.sum(F.col("m").isNull().cast("int")).alias("skipped_current_snapshot"))


def missing_months(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """Months to be fetched that aren't held (S3): both have (tab, month)."""
    return wanted.join(held.select("tab", "month").distinct(), ["tab", "month"], "left_anti")


def all_months(spark: SparkSession, tabs: list[str], first: int, last: int) -> DataFrame:
    """(tab, month) of all months of the years, as the source writes them."""
    names = F.array(*[F.lit(m) for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()])
    years = spark.range(first, last + 1).select(F.col("id").alias("y"), F.explode(names).alias("m"))
    return years.select(F.explode(F.array(*[F.lit(t) for t in tabs])).alias("tab"), F.concat_ws("-", "m", "y").alias("month"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only log of JSON lines; blank lines are no entries."""
    return spark.read.schema(schema).json(path)


def append_log(events: DataFrame, path: str) -> None:
    """Add one batch of events, all with the time of the batch (K4)."""
    events.withColumn("ts", F.current_timestamp()).write.mode("append").json(path)
