"""The queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.schema_drift import field_values
from ..session import table
from .abuse import present, score_documents, source_rates
from .canonical_values import canonical_values
from .firm_variants import firm_groups, firm_pairs
from .format_copies import copy_counts, format_copies
from .leaks import leak_spans, leaked_items
from .match_groups import company_groups
from .packing import container_fill, count_tokens, pack
from .places import place_pairs, same_places

Query = Callable[[SparkSession, str], DataFrame]

_FOLD = "regexp_replace(regexp_replace({0}, '([0-9])\\.([0-9])', '\\1q7q\\2', 'g'), '[^a-z0-9]', '', 'g')"
_PARTS = (
    "array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(lower(drug_name_raw), '[​  \\s]+', ' ', 'g'), '([0-9] ?[a-z]+) ([a-z])', '\\1,\\2', 'g'),"
    " '[][(){},&+/;:|]| [-–] '), lambda x: " + _FOLD.format("x") + "), lambda x: x <> '')), '|')"
)
P3_SQL = f"""
WITH k AS (SELECT id, min(id) OVER (PARTITION BY alert_month, manufacturer_raw, mfg_date, expiry_date, failure_reason_raw, {_FOLD.format("lower(batch_number)")}, {_PARTS}) AS keep_id
           FROM nsq_records WHERE drug_name_raw IS NOT NULL AND batch_number IS NOT NULL)
SELECT keep_id, id AS copy_id FROM k WHERE id <> keep_id
"""
P3_COUNTS_SQL = f"""
WITH p AS ({P3_SQL})
SELECT id AS keep_id, 1 + (SELECT count(*) FROM p WHERE p.keep_id = r.id) AS n_copies FROM nsq_records r WHERE id NOT IN (SELECT copy_id FROM p)
"""


P2_SQL = """
WITH RECURSIVE w AS (SELECT pair_id, arg_max(kind = 'auto_merge' OR coalesce(decision = 'approve', false), (ts, log_seq)) FILTER (kind IN ('auto_merge', 'review_decision')) AS links, max((a, b)) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n
    FROM manufacturer_merge_log WHERE pair_id IS NOT NULL GROUP BY 1),
e AS (SELECT 'i' || id AS u, 's' || unnest(known_aliases) AS v FROM manufacturers UNION SELECT 's' || n[1], 's' || n[2] FROM w WHERE links AND n IS NOT NULL),
s AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT 'i' || id AS node, 'i' || id AS x FROM manufacturers UNION SELECT node, v FROM r JOIN s ON x = u),
g AS (SELECT node[2:]::BIGINT AS id, min(x[2:]::BIGINT) AS group_id, count(*) AS n FROM r WHERE x LIKE 'i%' GROUP BY 1)
SELECT id, group_id FROM g WHERE n > 1
"""


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_copies(table(spark, sf_dir, "nsq_records"), "id", ["alert_month", "manufacturer_raw", "mfg_date", "expiry_date", "failure_reason_raw"], "batch_number", "drug_name_raw")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies that share a group, with the smallest id of the group."""
    return company_groups(table(spark, sf_dir, "manufacturers"), table(spark, sf_dir, "manufacturer_merge_log"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a publication that differ in their formatting only."""
    return _copies(spark, sf_dir)


def p3_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per publication with its number of copies."""
    return copy_counts(table(spark, sf_dir, "nsq_records"), _copies(spark, sf_dir), "id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The laboratory or state each free-entered value stands for."""
    return canonical_values(table(spark, sf_dir, "nsq_records"), table(spark, sf_dir, "lab_reference"), table(spark, sf_dir, "state_reference"))


def _firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "nsq_records").select(F.col("manufacturer_raw").alias("name"))
    portal = field_values(table(spark, sf_dir, "portal_files"), "str_manufactured_by").select(F.col("value").alias("name"))
    return firm_groups(records.distinct().unionByName(portal.distinct()))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of strings that name the same organisation."""
    return firm_pairs(_firms(spark, sf_dir))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each string that names an organisation, with its group."""
    return _firms(spark, sf_dir)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of mentions of one place, at least one of them a company's address."""
    return place_pairs(same_places(table(spark, sf_dir, "nsq_records"), table(spark, sf_dir, "manufacturers")))


def p6_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mention of a place with its group."""
    return same_places(table(spark, sf_dir, "nsq_records"), table(spark, sf_dir, "manufacturers"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every text with its container of 2,048 tokens."""
    return pack(count_tokens(table(spark, sf_dir, "documents")))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers there are, and how much of them is unused."""
    return container_fill(p7_packed(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the evaluation items they hold."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages to be removed."""
    return leak_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that use abusive, hateful or sexual language themselves."""
    return present(_scored(spark, sf_dir))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of every document."""
    return _scored(spark, sf_dir)


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each source's documents with such language."""
    return source_rates(_scored(spark, sf_dir))


def queries() -> dict[str, Query]:
    """All queries of the subpackage."""
    return {"p2_found": p2_found, "p3_found": p3_found, "p3_publications": p3_publications, "p4_found": p4_found, "p5_found": p5_found, "p5_groups": p5_groups, "p6_found": p6_found, "p6_places": p6_places, "p7_packed": p7_packed, "p7_fill": p7_fill, "p8_found": p8_found, "p8_spans": p8_spans, "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}


def oracle_sql() -> dict[str, str]:
    """The SQL of those that SQL can express."""
    return {"p2_found": P2_SQL, "p3_found": P3_SQL, "p3_publications": P3_COUNTS_SQL}
