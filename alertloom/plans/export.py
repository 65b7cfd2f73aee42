"""What is published: the data set, the columnar index, the summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lab_code, members_hash, slug
from ..operators.numbering import carry_forward, number_rows  # noqa: F401

#: Columns of the data set and where they come from.
DATASET = [
    ("record_id", "id"), ("alert_month", "alert_month"), ("alert_section", "alert_section"), ("drug_name", "drug_name_raw"), ("dosage_form", "dosage_form"), ("batch_number", "batch_number"), ("mfg_date", "mfg_date"),
    ("expiry_date", "expiry_date"), ("manufacturer_raw", "manufacturer_raw"), ("manufacturer_id", "manufacturer_id"), ("manufacturer_canonical", "m.canonical_name"), ("manufacturer_state", "m.state"), ("state", "r.state"),
    ("failure_reason", "failure_reason_raw"), ("failure_categories", "failure_category"), ("label_claim_disputed", "label_claim_disputed"), ("testing_lab", "testing_lab"), ("lab_type", "lab_type"),
    ("lab_name_canonical", "lab_name_canonical"), ("source_url", "source_url"), ("source_type", "source_type"), ("parse_confidence", "parse_confidence"), ("parse_flags", "parse_flags"),
]


def dataset(records: DataFrame, companies: DataFrame) -> DataFrame:
    """The records with their companies' names, arrays joined by pipes; a dispute not published stays empty."""
    m = companies.select(F.col("id").alias("_id"), "canonical_name", "state").alias("m")
    both = records.alias("r").join(m, F.col("r.manufacturer_id") == F.col("m._id"), "left")
    joined = {"failure_categories", "parse_flags"}
    return both.select(*[(F.array_join(F.coalesce(c, F.array().cast("array<string>")), "|") if name in joined else F.col(c)).alias(name) for name, c in DATASET])


def write_csv(df: DataFrame, path: str) -> None:
    """K6: newest month first; written in parallel, in order of the parts."""
    df.orderBy(F.desc("alert_month"), "record_id").write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def dictionary(values: DataFrame, value: str, order: list[str]) -> DataFrame:
    """(value, code): codes from 0 in order of first appearance; distinct values are reduced before they are numbered."""
    first = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.min(F.struct(*order)).alias("first"))
    return number_rows(first, ["first", "value"], "n").select("value", (F.col("n") - 1).alias("code"))


def index_rows(records: DataFrame, companies: DataFrame) -> DataFrame:
    """K8: the rows of the search index, manufacturers as codes; -1 where none is resolved."""
    names = dictionary(records, "manufacturer_raw", ["manufacturer_raw"])
    coded = records.join(names, records.manufacturer_raw == names.value, "left")
    known = companies.select(F.col("id").alias("manufacturer_id"), F.concat(slug(F.col("canonical_name")), F.lit("-"), members_hash(F.coalesce("known_aliases", F.array().cast("array<string>")))).alias("slug"))
    return coded.join(known, "manufacturer_id", "left").select(
        "id", F.coalesce("drug_name_raw", F.lit("")).alias("drug"), F.coalesce("batch_number", F.lit("")).alias("batch"), F.coalesce("alert_month", F.lit("")).alias("month"), F.coalesce("alert_section", F.lit("")).alias("section"),
        F.coalesce("code", F.lit(-1).cast("long")).alias("mfr"), F.coalesce("slug", F.lit("")).alias("slug"), lab_code(F.col("lab_type")).alias("lab"), F.coalesce("label_claim_disputed", F.lit(0)).alias("disputed"),
    )


def write_index(rows: DataFrame, path: str) -> None:
    """K8, K9: the index as columnar files, sorted by id within them."""
    rows.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(path)


def slugs(companies: DataFrame) -> DataFrame:
    """(id, slug): a readable address for each company that depends on its own members only."""
    return companies.select("id", F.concat(slug(F.col("canonical_name")), F.lit("-"), members_hash(F.coalesce("known_aliases", F.array().cast("array<string>")))).alias("slug"))


def summary(records: DataFrame) -> DataFrame:
    """One row: records, months newest first, disputed, and the counts of categories as a map."""
    months = records.agg(F.sort_array(F.collect_set("alert_month"), False).alias("months"), F.count("*").alias("records"), F.count_if(F.col("label_claim_disputed") == 1).alias("disputed"))
    cats = records.select(F.explode("failure_category").alias("c")).groupBy("c").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("c", "n")))))
    return months.withColumn("categories", cats.scalar())


def company_page(records: DataFrame, company: int) -> DataFrame:
    """A company's records, newest first."""
    return records.where(F.col("manufacturer_id") == company).orderBy(F.desc("alert_month"), "id")


def spot_check(clusters: DataFrame, size: int, seed: int) -> DataFrame:
    """Half the weakest clusters, half drawn by a seeded hash from the rest; without replacement."""
    weak = clusters.orderBy("weakest", "cluster").limit(size // 2)
    rest = clusters.join(weak.select("cluster"), "cluster", "left_anti")
    return weak.withColumn("why", F.lit("weakest")).unionByName(rest.orderBy(F.xxhash64(F.lit(seed), "cluster"), "cluster").limit(size - size // 2).withColumn("why", F.lit("drawn")))
