"""Portal rows to records: one narrow stage and one shuffle on the id (P16, section 1.4 of the survey)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..functions.rules import flags
from ..operators.dedupe import collapse
from ..operators.quality import check_flags, confidence
from ..session import materialise
from ..sources.envelopes import portal_rows

#: The columns of a record, in order.
COLUMNS = [
    "id", "alert_month", "alert_section", "drug_name_raw", "drug_name_clean", "active_ingredients", "dosage_form", "batch_number", "mfg_date", "expiry_date", "manufacturer_raw", "manufacturer_id",
    "label_claim_disputed", "failure_reason_raw", "failure_category", "testing_lab", "lab_type", "lab_name_canonical", "state", "source_url", "source_type", "source_page", "parse_confidence", "parse_flags", "created_at",
]
_ORDER = ["_tab", "_month", "_row"]


def _unread_month(raw: Column, month: Column) -> Column:
    return F.when(month.isNull(), F.concat(F.lit("alert_month_unparsed:"), F.coalesce(raw, F.lit("None"))))


def map_rows(rows: DataFrame) -> DataFrame:
    """Published rows of both tabs as records, not yet deduplicated, in one projection; a tab of another name gives none."""
    c = F.col
    spurious = c("tab") == "spurious"
    only = lambda x: F.when(spurious, x)
    other = lambda x: F.when(~spurious, x)
    fields = {
        "batch_number": "str_batch_no", "manufacturer_raw": "str_manufactured_by", "testing_lab": "str_reported_by_lab_or_state", "_reason": "str_nsq_result", "_reply": "str_firm_reply", "_remarks": "str_nsq_remarks",
        "_made": "dt_manufacturing_date", "_ends": "dt_expiry_date", "_source": "str_reporting_source", "_given_state": "str_manufacturing_state", "_form": "str_dosage_form",
    }
    named = X.clean_text(only(c("product_name_from_dtl")).otherwise(c("str_product_name"))).alias("drug_name_raw")
    clean = rows.where("tab IN ('nsq', 'spurious')").select("tab", "url", "month_key", "row_no", "num_id", "dt_reporting_month_year", named, *[X.clean_text(c(f)).alias(name) for name, f in fields.items()])
    own = clean.withColumns({
        "alert_month": X.month(c("dt_reporting_month_year")),
        "_mfg": X.partial_date(c("_made")),
        "_exp": X.partial_date(c("_ends")),
        "_cats": X.categories(c("_reason")),
        "drug_name_clean": X.drug_key(c("drug_name_raw")),
        "_section": only(F.struct(F.lit("spurious").alias("value"), F.lit(None).cast("string").alias("flag"))).otherwise(X.section(c("_source"))),
        "_state": X.state(c("manufacturer_raw"), only(c("_given_state"))),
        "_disputed": X.disputed(c("_reply"), c("_remarks")),
    })
    own = own.withColumns({"_lab": X.lab_with_flag(c("testing_lab"), c("_section.value")), "_hash": X.record_id(c("alert_month"), c("batch_number"), c("drug_name_raw"), c("manufacturer_raw"), c("testing_lab"), c("_reason"))})
    placeholder = F.when(c("manufacturer_raw").rlike(V.UNKNOWN_MAKER), F.concat(F.lit("manufacturer_unknown_placeholder:"), "manufacturer_raw"))
    set_flags = [
        _unread_month(c("dt_reporting_month_year"), c("alert_month")), other(c("_section.flag")), c("_mfg.flag"), c("_exp.flag"), other(c("_cats.flag")), placeholder, c("_state.flag"),
        only(c("_cats.flag")), only(c("_disputed.flag")), c("_lab.flag"),
    ]
    return own.select(
        only(X.spurious_id(c("num_id"), c("_hash"))).otherwise(c("_hash")).alias("id"),
        "alert_month",
        c("_section.value").alias("alert_section"),
        "drug_name_raw",
        "drug_name_clean",
        F.lit(None).cast("array<string>").alias("active_ingredients"),
        only(c("_form")).alias("dosage_form"),
        "batch_number",
        c("_mfg.value").alias("mfg_date"),
        c("_exp.value").alias("expiry_date"),
        "manufacturer_raw",
        F.lit(None).cast("long").alias("manufacturer_id"),
        only(c("_disputed.value")).alias("label_claim_disputed"),
        only(X.reason_with_replies(c("_reason"), c("_reply"), c("_remarks"))).otherwise(c("_reason")).alias("failure_reason_raw"),
        only(X.spurious_categories(c("_cats.value"))).otherwise(c("_cats.value")).alias("failure_category"),
        "testing_lab",
        c("_lab.type").alias("lab_type"),
        c("_lab.canonical").alias("lab_name_canonical"),
        c("_state.value").alias("state"),
        c("url").alias("source_url"),
        F.lit("portal_json").alias("source_type"),
        F.lit(None).cast("int").alias("source_page"),
        flags(*set_flags).alias("parse_flags"),
        only(F.lit(1)).otherwise(F.lit(0)).alias("_tab"),
        c("month_key").alias("_month"),
        c("row_no").alias("_row"),
    )


def normalise(files: DataFrame) -> DataFrame:
    """Records of all envelopes (a column ``body``), each id once, with its flags and confidence.

    Uncertainty becomes a flag; no row is dropped for it, none is guessed
    right. The time of the run is the only column that differs between runs.
    """
    # bodies are parsed and rows mapped once for all that is made of them
    mapped = materialise(map_rows(portal_rows(files)))
    records = collapse(mapped, "id", _ORDER, ["created_at"], "parse_flags").drop(*_ORDER)
    records = records.withColumn("parse_flags", F.concat("parse_flags", check_flags()))
    return records.withColumns({"parse_confidence": confidence(F.col("parse_flags")), "created_at": F.current_timestamp()}).select(*COLUMNS)
