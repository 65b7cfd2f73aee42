"""Registers every query of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import dedupe, quality, resolution, search
from ..operators.components import connected_components
from ..operators.schema_drift import one_table, schema_changes
from ..session import materialise, table
from ..sources import envelopes, listing
from . import export, normalise, oracle, questions
from .registry import query

NSQ, COMPANIES, LOG, FILES = "nsq_records", "manufacturers", "manufacturer_merge_log", "portal_files"
TOTAL = "(SELECT count(*) FROM nsq_records)"
CUT_OFF = "2021-01"
#: What the lookups look for.
BATCH, COMPANY, DRUG = "tj 24253669-S", "venkaro", "rubicilin tab"


def _over_records(name: str, f, sql: str | None = None) -> None:  # noqa: ANN001
    query(name, sql)(lambda spark, sf_dir: f(table(spark, sf_dir, NSQ)))


def _over_companies(name: str, f, sql: str | None = None) -> None:  # noqa: ANN001
    query(name, sql)(lambda spark, sf_dir: f(table(spark, sf_dir, COMPANIES)))


# --- the seven questions -------------------------------------------------------
_over_records("monthly_volume", questions.by_month, "SELECT alert_month AS month, count(*) AS n FROM nsq_records WHERE alert_month IS NOT NULL GROUP BY 1")
_over_records("yearly_volume", questions.by_year, "SELECT alert_month[1:4] AS year, count(*) AS n, count(DISTINCT alert_month) AS months FROM nsq_records WHERE alert_month IS NOT NULL GROUP BY 1")
_over_records("volume_summary", questions.volume_summary, "SELECT count(alert_month) AS total, count(DISTINCT alert_month) AS month_count, min(alert_month) AS first_month, max(alert_month) AS last_month, count(*) FILTER (alert_month IS NULL) AS no_alert_month FROM nsq_records")
_over_records("category_counts", questions.category_counts, f"SELECT category, count(*) AS records, {oracle.share('count(*)', TOTAL)} AS share FROM (SELECT unnest(failure_category) AS category FROM nsq_records) GROUP BY 1")
_over_records("labels_per_record", questions.labels_per_record, "SELECT coalesce(len(failure_category), 0)::INT AS labels, count(*) AS records FROM nsq_records GROUP BY 1")
_over_records(
    "label_unions",
    questions.label_unions,
    f"""SELECT count(*) AS records, count(*) FILTER (list_has_any(failure_category, {questions.POTENCY})) AS potency_related, count(*) FILTER (list_has_any(failure_category, {questions.CONTAMINATION})) AS contamination_related,
    count(*) FILTER (len(failure_category) > 1) AS multi_category_records, count(*) FILTER (list_contains(failure_category, 'other') AND regexp_matches(trim(failure_reason_raw, ' '), {oracle.quote(V.NO_TEST)})) AS other_naming_no_test FROM nsq_records""",
)
_over_companies(
    "top_companies",
    questions.top_companies,
    """SELECT row_number() OVER (ORDER BY flags DESC NULLS LAST, name, id)::INT AS rank, name, state, flags, spellings FROM (
    SELECT id, canonical_name AS name, state, total_flags AS flags, coalesce(len(known_aliases), 0)::INT AS spellings FROM manufacturers ORDER BY flags DESC NULLS LAST, name, id LIMIT 20)""",
)
_over_companies(
    "concentration",
    questions.concentration,
    f"""WITH r AS (SELECT total_flags AS f, row_number() OVER (ORDER BY total_flags DESC) AS i FROM manufacturers WHERE total_flags IS NOT NULL), t AS (SELECT count(*) AS n, sum(f) AS s FROM r),
    k AS (SELECT unnest({questions.TOP_SHARES}) AS k)
    SELECT k::INT AS k, least(k, n)::BIGINT AS manufacturers, (SELECT sum(f) FROM r WHERE i <= k)::BIGINT AS flags, {oracle.share('least(k, n)', 'n')} AS share_of_manufacturers, {oracle.share('(SELECT sum(f) FROM r WHERE i <= k)', 's')} AS share_of_flags FROM k, t""",
)
_over_companies(
    "long_tail",
    questions.long_tail,
    f"""WITH r AS (SELECT total_flags AS f, row_number() OVER (ORDER BY total_flags) - 1 AS i, count(*) OVER () AS n FROM manufacturers WHERE total_flags IS NOT NULL)
    SELECT count(*) AS manufacturers, sum(f)::BIGINT AS flags, count(*) FILTER (f = 1) AS single_flag_manufacturers, {oracle.share('count(*) FILTER (f = 1)', 'count(*)')} AS single_flag_share, max(f) FILTER (i = n // 2) AS median_flags, max(f) AS max_flags FROM r""",
)
for _name, _column in (("section_distribution", "alert_section"), ("lab_type_distribution", "lab_type")):
    _over_records(_name, lambda r, c=_column: questions.distribution(r, c), f"SELECT coalesce(nullif({_column}, ''), 'missing') AS value, count(*) AS records, {oracle.share('count(*)', TOTAL)} AS share FROM nsq_records GROUP BY 1")
_over_records(
    "labs_under_both",
    questions.labs_under_both,
    """SELECT *, least(central_lab, state_lab) AS minority_records FROM (SELECT lower(trim(testing_lab, ' ')) AS lab, count(*) AS records, count(*) FILTER (alert_section = 'central_lab') AS central_lab,
    count(*) FILTER (alert_section = 'state_lab') AS state_lab FROM nsq_records WHERE testing_lab IS NOT NULL GROUP BY 1) WHERE central_lab > 0 AND state_lab > 0""",
)
_over_records(
    "label_disputes",
    questions.label_disputes,
    """SELECT count(*) FILTER (len(list_filter(parse_flags, lambda f: f LIKE 'alert_section_disputed%')) > 0) AS disputed, count(*) FILTER (lab_type = 'central' AND alert_section = 'state_lab') AS state_to_central,
    count(*) FILTER (lab_type = 'state' AND alert_section = 'central_lab') AS central_to_state FROM nsq_records""",
)
_PROFILE = f"""WITH o AS (SELECT lab_type, failure_category FROM nsq_records WHERE lab_type IN ('central', 'state')), t AS (SELECT count(*) FILTER (lab_type = 'central') AS c, count(*) FILTER (lab_type = 'state') AS s FROM o),
n AS (SELECT category, count(*) FILTER (lab_type = 'central') AS central_records, count(*) FILTER (lab_type = 'state') AS state_records FROM (SELECT lab_type, unnest(list_distinct(failure_category)) AS category FROM o) GROUP BY 1),
p AS (SELECT category, central_records, {oracle.share('central_records', 'c')} AS central_share, state_records, {oracle.share('state_records', 's')} AS state_share FROM n, t)
SELECT *, round(central_share - state_share, 1) AS difference_pp FROM p"""
_over_records("category_profile", questions.category_profile, _PROFILE)
_over_records("divergences", lambda r: questions.divergences(questions.category_profile(r)), f"SELECT * FROM ({_PROFILE}) WHERE greatest(central_records, state_records) >= 50 ORDER BY abs(difference_pp) DESC, category LIMIT 8")
_over_records(
    "trend",
    lambda r: questions.trend(r, CUT_OFF),
    f"""WITH m AS (SELECT alert_month AS month, count(*) AS n FROM nsq_records WHERE alert_month IS NOT NULL GROUP BY 1), y AS (SELECT month[1:4] AS year, sum(n) AS n FROM m GROUP BY 1 HAVING count(*) = 12)
    SELECT round((SELECT avg(n) FROM (SELECT n FROM m WHERE month < '{CUT_OFF}' ORDER BY month DESC LIMIT 12)), 1) AS mean_before, round((SELECT avg(n) FROM (SELECT n FROM m WHERE month >= '{CUT_OFF}' ORDER BY month LIMIT 12)), 1) AS mean_after,
    (SELECT n FROM m WHERE month = '{CUT_OFF}') AS cut_off_count, (SELECT month FROM m ORDER BY n DESC, month LIMIT 1) AS peak_month, (SELECT max(n) FROM m) AS peak_count, round((SELECT arg_max(n, year) / arg_min(n, year) FROM y), 2) AS growth""",
)
_over_records("state_counts", questions.state_counts, f"SELECT state, count(*) AS records, {oracle.share('count(*)', '(SELECT count(*) FROM nsq_records WHERE state <> ' + chr(39) * 2 + ')')} AS share FROM nsq_records WHERE state <> '' GROUP BY 1")
_over_records("state_coverage", questions.state_coverage, f"SELECT count(*) AS records, count(nullif(state, '')) AS with_state, {oracle.share('count(nullif(state, ' + chr(39) * 2 + '))', 'count(*)')} AS coverage, count(DISTINCT nullif(state, '')) AS distinct_states FROM nsq_records")
_over_records("why_no_state", questions.why_no_state, "SELECT split_part(f, ':', 1) AS reason, count(*) AS records FROM (SELECT unnest(parse_flags) AS f FROM nsq_records WHERE state IS NULL) WHERE f LIKE 'state\\_%' ESCAPE '\\' GROUP BY 1")
_NAMES = "WITH names AS (SELECT drug_name_clean AS name, id, 1 AS n FROM nsq_records WHERE drug_name_clean IS NOT NULL)"
_OWN_CLASS = "CASE word WHEN 'natamycin' THEN 'antifungal' WHEN 'dactinomycin' THEN NULL ELSE class END"
_over_records("class_counts", questions.class_counts, f"{_NAMES}, w AS ({oracle.stems('name', 'id')}), c AS (SELECT DISTINCT id, {_OWN_CLASS} AS class FROM w) SELECT class, count(*) AS records, {oracle.share('count(*)', TOTAL)} AS share FROM c WHERE class IS NOT NULL GROUP BY 1")
_over_records("stem_audit", questions.stem_audit, f"{_NAMES}, w AS ({oracle.stems('name', 'id')}) SELECT stem, class, word, count(*) AS hits FROM w GROUP BY ALL")
_over_records(
    "record_counts",
    questions.record_counts,
    """SELECT count(*) AS records, count(DISTINCT alert_month) AS months, min(alert_month) AS first_month, max(alert_month) AS last_month, count(DISTINCT manufacturer_raw) AS spellings, count(*) FILTER (label_claim_disputed = 1) AS disputed,
    count(*) FILTER (len(parse_flags) > 0) AS flagged, count(*) FILTER (lab_type = 'central') AS central, count(*) FILTER (lab_type = 'state') AS state_lab FROM nsq_records""",
)

# --- scalar normalisers over whole columns ----------------------------------------


@query("categorised_reasons", f"SELECT DISTINCT failure_reason_raw AS reason, CASE WHEN len(c) = 0 THEN ['other'] ELSE c END AS categories FROM (SELECT failure_reason_raw, {oracle.categories('s')} AS c FROM (SELECT failure_reason_raw, lower(coalesce({oracle.clean('failure_reason_raw')}, '')) AS s FROM nsq_records))")
def categorised_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5 over every distinct reason."""
    reasons = table(spark, sf_dir, NSQ).select(F.col("failure_reason_raw").alias("reason")).distinct()
    return reasons.withColumn("text", X.clean_text(F.col("reason"))).select("reason", X.categories(F.col("text"))["value"].alias("categories"))


@query("derived_states", oracle.state("manufacturer_raw"))
def derived_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7, P17, P18 over every distinct manufacturer."""
    values = table(spark, sf_dir, NSQ).select(F.col("manufacturer_raw").alias("value")).distinct()
    return values.withColumn("text", X.clean_text(F.col("value"))).withColumn("x", X.state(F.col("text"))).select("value", F.col("x.value").alias("state"), F.col("x.flag").alias("flag"))


_over_records("lab_audit", lambda r: questions.lab_audit(r, X.lab), oracle.labs())


@query(
    "record_ids",
    "SELECT id, 'NSQ_' || coalesce(alert_month, 'unknown') || '_' || sha256(array_to_string(["
    + ", ".join(f"regexp_replace(trim(lower(coalesce({c}, '')), ' '), '{oracle.BLANK}+', ' ', 'g')" for c in ("alert_month", "batch_number", "drug_name_raw", "manufacturer_raw", "testing_lab", "failure_reason_raw"))
    + "], '|'))[1:12] AS hashed FROM nsq_records",
)
def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12 over every record."""
    c = F.col
    return table(spark, sf_dir, NSQ).select("id", X.record_id(c("alert_month"), c("batch_number"), c("drug_name_raw"), c("manufacturer_raw"), c("testing_lab"), c("failure_reason_raw")).alias("hashed"))


@query("quality_flags", f"SELECT id, flags, {oracle.confidence('list_concat(coalesce(parse_flags, []), flags)')} AS confidence FROM (SELECT id, parse_flags, {oracle.check_flags()} AS flags FROM nsq_records)")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1-V5 over every record."""
    own = table(spark, sf_dir, NSQ).select("id", "parse_flags", quality.check_flags().alias("flags"))
    return own.select("id", "flags", quality.confidence(F.concat(F.coalesce("parse_flags", F.array().cast("array<string>")), "flags")).alias("confidence"))


_over_records("flag_statistics", quality.flag_statistics, "SELECT split_part(f, ':', 1) AS kind, count(*) AS n FROM (SELECT unnest(parse_flags) AS f FROM nsq_records) GROUP BY 1")
_over_records(
    "shown_values",
    lambda r: r.select("id", X.long_month(F.col("alert_month")).alias("month"), X.short_month(F.col("expiry_date")).alias("expires"), X.confidence_label(F.col("parse_confidence")).alias("confidence"), F.array_sort(X.flag_texts(F.col("parse_flags"))).alias("notes"), F.transform("failure_category", X.category_label).alias("categories"), X.pin_from_flags(F.col("parse_flags")).alias("pin"), X.missing(F.col("batch_number")).alias("no_batch"), X.lab_code(F.col("lab_type")).alias("lab")),
    f"""SELECT id, coalesce(strftime(try_strptime(alert_month || '-01', '%Y-%m-%d'), '%B %Y'), alert_month) AS month,
    coalesce(CASE len(expiry_date) WHEN 7 THEN strftime(try_strptime(expiry_date || '-01', '%Y-%m-%d'), '%b %Y') WHEN 10 THEN strftime(try_strptime(expiry_date, '%Y-%m-%d'), '%-d %b %Y') END, expiry_date) AS expires,
    CASE WHEN parse_confidence >= 0.95 THEN 'high' WHEN parse_confidence IS NULL OR parse_confidence >= 0.8 THEN 'medium' ELSE 'low' END AS confidence,
    list_sort(list_distinct(list_filter(list_transform(parse_flags, lambda f: ({oracle.mapping(V.FLAG_TEXTS)})[split_part(f, ':', 1)]), lambda x: x IS NOT NULL))) AS notes,
    list_transform(failure_category, lambda c: CASE WHEN c = 'ph' THEN 'pH' ELSE upper(c[1]) || replace(c, '_', ' ')[2:] END) AS categories,
    split_part(list_filter(parse_flags, lambda f: f LIKE 'state\\_derived\\_from\\_pin:%' ESCAPE '\\')[1], ':', 2) AS pin, coalesce(batch_number, '') = '' AS no_batch,
    CASE lab_type WHEN 'central' THEN 0 WHEN 'state' THEN 1 ELSE 2 END AS lab FROM nsq_records""",
)

# --- sources -----------------------------------------------------------------------

_PAYLOAD = "CASE json_type(body, '$.payload') WHEN 'VARCHAR' THEN (body->>'$.payload')::JSON ELSE body->'$.payload' END"


@query(
    "portal_rows",
    f"""WITH f AS (SELECT body->>'$.url' AS url, body->>'$.month' AS month, from_json({_PAYLOAD}->'$.aaData', '["JSON"]') AS rows FROM portal_files WHERE body->>'$.month' IS NOT NULL),
    r AS (SELECT url, month, unnest(rows) AS r, generate_subscripts(rows, 1) - 1 AS row_no FROM f)
    SELECT url, month, row_no::INT AS row_no, {oracle.month("month")} AS month_key, r->>'$.str_batch_no' AS batch, r->>'$.dt_expiry_date' AS expires, r->>'$.str_product_name' AS product, r->>'$.product_name_from_dtl' AS spurious_product,
    r->>'$.str_manufactured_by' AS maker, r->>'$.str_reported_by_lab_or_state' AS lab, r->>'$.str_firm_reply' AS reply, r->>'$.num_id' AS number FROM r""",
)
def portal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all envelopes that have a month."""
    return envelopes.portal_rows(table(spark, sf_dir, FILES)).select(
        "url", "month", "row_no", "month_key", F.col("str_batch_no").alias("batch"), F.col("dt_expiry_date").alias("expires"), F.col("str_product_name").alias("product"), F.col("product_name_from_dtl").alias("spurious_product"),
        F.col("str_manufactured_by").alias("maker"), F.col("str_reported_by_lab_or_state").alias("lab"), F.col("str_firm_reply").alias("reply"), F.col("num_id").alias("number"),
    )


query("skipped_snapshots", "SELECT count(*) FILTER (body->>'$.month' IS NULL)::BIGINT AS skipped_current_snapshot FROM portal_files")(lambda spark, sf_dir: envelopes.skipped_snapshots(table(spark, sf_dir, FILES)))
_PORTAL = f"""WITH f AS (SELECT body->>'$.url' AS url, body->>'$.tab' AS tab, body->>'$.month' AS month, from_json({_PAYLOAD}->'$.aaData', '["JSON"]') AS rows FROM portal_files WHERE body->>'$.month' IS NOT NULL),
    r AS (SELECT url, tab, month, unnest(rows) AS r, generate_subscripts(rows, 1) - 1 AS row_no FROM f)"""


def _cleaned(field: str) -> str:
    return oracle.clean(f"r->>'$.{field}'")


@query(
    "portal_dates",
    f"""{_PORTAL}, c AS (SELECT url, row_no, r->>'$.dt_reporting_month_year' AS p, {_cleaned("dt_manufacturing_date")} AS m, {_cleaned("dt_expiry_date")} AS e FROM r), v AS (SELECT url, row_no, {oracle.month("p")} AS alert_month, m, {oracle.partial_date("m")} AS made, e, {oracle.partial_date("e")} AS ends FROM c)
    SELECT url, row_no::INT AS row_no, alert_month, made, ends, m IS NOT NULL AND made IS NULL AS made_unread, e IS NOT NULL AND ends IS NULL AS ends_unread FROM v""",
)
def portal_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2, P3 over all portal rows."""
    rows = envelopes.portal_rows(table(spark, sf_dir, FILES))
    clean = rows.select("url", "row_no", "dt_reporting_month_year", X.clean_text(F.col("dt_manufacturing_date")).alias("made"), X.clean_text(F.col("dt_expiry_date")).alias("ends"))
    own = clean.select("url", "row_no", X.month(F.col("dt_reporting_month_year")).alias("alert_month"), X.partial_date(F.col("made")).alias("m"), X.partial_date(F.col("ends")).alias("e"))
    unread = lambda x: F.coalesce(F.startswith(F.col(f"{x}.flag"), F.lit("date_unparsed:")), F.lit(False))
    return own.select("url", "row_no", "alert_month", F.col("m.value").alias("made"), F.col("e.value").alias("ends"), unread("m").alias("made_unread"), unread("e").alias("ends_unread"))


@query(
    "portal_replies",
    f"""{_PORTAL}, c AS (SELECT url, row_no, {_cleaned("str_nsq_result")} AS reason, {_cleaned("str_firm_reply")} AS reply, {_cleaned("str_nsq_remarks")} AS remarks, coalesce(lower({_cleaned("str_reporting_source")}), '') AS s, r->>'$.num_id' AS num FROM r)
    SELECT url, row_no::INT AS row_no, CASE WHEN contains(s, 'cdsco') OR contains(s, 'central') THEN 'central_lab' WHEN contains(s, 'state') THEN 'state_lab' END AS section,
    CASE WHEN contains(s, 'cdsco') OR contains(s, 'central') OR contains(s, 'state') THEN NULL WHEN s = '' THEN 'alert_section_missing' ELSE 'alert_section_unrecognised:' || s[1:40] END AS section_flag,
    regexp_matches(concat_ws(' ', reply, remarks), {oracle.quote(V.DISPUTE)})::INT AS disputed, nullif(concat_ws(chr(10), reason, '[Firm''s reply] ' || reply, '[Remarks] ' || remarks), '') AS reason, reason AS reason_only,
    'SPU_' || num AS numbered FROM c""",
)
def portal_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4, P13, P14, P15, P41 over all portal rows."""
    c = F.col
    rows = envelopes.portal_rows(table(spark, sf_dir, FILES))
    clean = rows.select("url", "row_no", "num_id", *[X.clean_text(c(f)).alias(n) for n, f in (("reason", "str_nsq_result"), ("reply", "str_firm_reply"), ("remarks", "str_nsq_remarks"), ("source", "str_reporting_source"))])
    own = clean.withColumns({"s": X.section(c("source")), "all": X.reason_with_replies(c("reason"), c("reply"), c("remarks"))})
    numbered = X.spurious_id(c("num_id"), F.lit(None).cast("string"))
    return own.select("url", "row_no", c("s.value").alias("section"), c("s.flag").alias("section_flag"), X.disputed(c("reply"), c("remarks"))["value"].alias("disputed"), c("all").alias("reason"), F.nullif(X.reason_only(c("all")), F.lit("")).alias("reason_only"), numbered.alias("numbered"))


query("portal_records")(lambda spark, sf_dir: normalise.normalise(table(spark, sf_dir, FILES)).drop("created_at"))


@query(
    "missing_months",
    """SELECT t.tab, m || '-' || y AS month FROM (SELECT unnest(['nsq', 'spurious']) AS tab) t, (SELECT unnest(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']) AS m), (SELECT unnest(range(2017, 2027)) AS y)
    WHERE NOT EXISTS (FROM portal_files p WHERE p.tab = t.tab AND p.month = m || '-' || y)""",
)
def missing_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months not held."""
    return envelopes.missing_months(envelopes.all_months(spark, ["nsq", "spurious"], 2017, 2026), table(spark, sf_dir, FILES))


@query(
    "prefix_states",
    """WITH d AS (SELECT unnest(regexp_extract_all(address_raw, '\\b(\\d{6})\\b')) AS p, upper(state) AS s FROM manufacturers WHERE state <> ''), two AS (SELECT p[1:2] AS prefix, min(s) AS lo, max(s) AS hi FROM d GROUP BY 1),
    three AS (SELECT p[1:3] AS prefix, min(s) AS lo, max(s) AS hi FROM d GROUP BY 1)
    SELECT prefix, lo AS state FROM two WHERE lo = hi UNION ALL SELECT prefix, lo FROM three WHERE lo = hi AND prefix[1:2] IN (SELECT prefix FROM two WHERE lo <> hi)""",
)
def prefix_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which beginnings of PIN codes lie in one state."""
    rows = table(spark, sf_dir, COMPANIES).select(F.explode(X.pins_of(F.col("address_raw"))).alias("pincode"), F.col("state").alias("statename"))
    return questions.prefix_states(listing.directory_rows(rows), F.col("lo"))


# --- duplicates, logs, sets -----------------------------------------------------------

_KEYED = "SELECT id, coalesce(alert_month, '') || '|' || coalesce(batch_number, '') AS k, md5(to_json([drug_name_raw, manufacturer_raw, failure_reason_raw])) AS p FROM nsq_records"


@query(
    "collapsed_records",
    f"""WITH r AS ({_KEYED}), g AS (SELECT k, p, min(id) AS id, count(*) AS n FROM r GROUP BY 1, 2), s AS (SELECT k, count(*) AS kinds FROM g GROUP BY 1)
    SELECT g.id, g.k AS key, CASE WHEN n > 1 THEN ['duplicate_source_rows_collapsed:' || n] ELSE [] END AS flags FROM g JOIN s USING (k) WHERE kinds = 1
    UNION ALL SELECT id, k || '_' || i, ['id_collision_disambiguated:' || i || 'of' || n] FROM (SELECT id, k, row_number() OVER (PARTITION BY k ORDER BY id) AS i, count(*) OVER (PARTITION BY k) AS n FROM r WHERE k IN (SELECT k FROM s WHERE kinds > 1))""",
)
def collapsed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U5, D1, W5 over the records, by month and batch."""
    own = table(spark, sf_dir, NSQ).select(
        F.concat_ws("|", F.coalesce("alert_month", F.lit("")), F.coalesce("batch_number", F.lit(""))).alias("key"), "id", "drug_name_raw", "manufacturer_raw", "failure_reason_raw", F.array().cast("array<string>").alias("flags")
    )
    return dedupe.collapse(own, "key", ["id"], [], "flags").select("id", "key", "flags")


@query("last_decisions", "SELECT pair_id, max(log_seq) AS log_seq, arg_max(coalesce(decision, ''), log_seq) AS decision FROM manufacturer_merge_log WHERE kind = 'review_decision' AND pair_id IS NOT NULL GROUP BY 1")
def last_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was decided last, by place in the log."""
    return resolution.decisions(table(spark, sf_dir, LOG)).select("pair_id", "log_seq", F.coalesce("decision", F.lit("")).alias("decision"))


@query("undecided_pairs", "SELECT DISTINCT pair_id FROM manufacturer_merge_log WHERE pair_id IS NOT NULL AND pair_id NOT IN (SELECT pair_id FROM manufacturer_merge_log WHERE kind = 'review_decision' AND pair_id IS NOT NULL)")
def undecided_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in the log that nobody has decided."""
    log = table(spark, sf_dir, LOG)
    return resolution.pending(log.where("pair_id IS NOT NULL").select("pair_id").distinct(), resolution.decisions(log))


query("last_apply", "SELECT arg_max(note, log_seq) AS last_apply FROM manufacturer_merge_log WHERE kind = 'apply' AND note IS NOT NULL")(lambda spark, sf_dir: questions.pending_reviews(table(spark, sf_dir, LOG)))


@query(
    "merge_components",
    """WITH RECURSIVE e AS (SELECT a, b FROM manufacturer_merge_log WHERE kind = 'auto_merge' AND a IS NOT NULL AND b IS NOT NULL), s AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
    r AS (SELECT u AS node, u AS x FROM s UNION SELECT node, v FROM r JOIN s ON x = u) SELECT node, min(x) AS component FROM r GROUP BY 1""",
)
def merge_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5 over the log's automatic merges."""
    return connected_components(table(spark, sf_dir, LOG).where("kind = 'auto_merge'"))


_DECIDED = """WITH RECURSIVE d AS (SELECT pair_id, arg_max(coalesce(decision, ''), log_seq) AS decision FROM manufacturer_merge_log WHERE kind = 'review_decision' AND pair_id IS NOT NULL GROUP BY 1),
    q AS (SELECT DISTINCT pair_id, a, b FROM manufacturer_merge_log WHERE pair_id IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
    e AS (SELECT a, b FROM manufacturer_merge_log WHERE kind = 'auto_merge' AND a IS NOT NULL AND b IS NOT NULL UNION SELECT a, b FROM q JOIN d USING (pair_id) WHERE decision = 'approve'),
    s AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM q UNION SELECT b, b FROM q),
    r AS (SELECT u AS node, v AS x FROM s UNION SELECT node, v FROM r JOIN s ON x = u), c AS (SELECT node, min(x) AS component FROM r GROUP BY 1)"""


def _logged(log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The spellings, the automatic merges and all pairs of a log."""
    named = log.where("pair_id IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL")
    return named.select(F.col("a").alias("raw")).union(named.select("b")).distinct(), log.where("kind = 'auto_merge' AND a IS NOT NULL AND b IS NOT NULL").withColumn("tier", F.lit("auto")), named.select("pair_id", "a", "b").distinct()


@query("decided_clusters", _DECIDED + " SELECT node AS raw, component AS cluster FROM c")
def decided_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the log's spellings by its automatic merges and what was approved last."""
    log = table(spark, sf_dir, LOG)
    of, auto, queue = _logged(log)
    return resolution.apply_decisions(of, auto, queue, log)


@query(
    "spanning_forest",
    """WITH RECURSIVE p AS (SELECT a, b, max(score) AS score FROM manufacturer_merge_log WHERE kind = 'auto_merge' AND a <> b AND score IS NOT NULL GROUP BY 1, 2), s AS (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p),
    r AS (SELECT u AS node, u AS x FROM s UNION SELECT node, v FROM r JOIN s ON x = u), c AS (SELECT node, min(x) AS component FROM r GROUP BY 1)
    SELECT component, count(*) - 1 AS edges FROM c GROUP BY 1""",
)
def spanning_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many edges the best forest of the log's automatic merges has in each component: one less than nodes, so all are joined and none in a circle."""
    scored = materialise(table(spark, sf_dir, LOG).where("kind = 'auto_merge' AND a <> b AND score IS NOT NULL").groupBy("a", "b").agg(F.max("score").alias("score")))
    forest = materialise(resolution.spanning_edges(scored))
    parts = connected_components(forest)
    return forest.join(parts, forest.a == parts.node).groupBy("component").agg(F.count("*").alias("edges"))


@query(
    "unlogged_merges",
    f"""WITH l AS (SELECT * FROM manufacturer_merge_log WHERE ts < (SELECT max(ts) FROM manufacturer_merge_log WHERE kind = 'build_summary')), n AS (SELECT DISTINCT pair_id, score FROM manufacturer_merge_log WHERE kind = 'auto_merge' AND pair_id IS NOT NULL AND score IS NOT NULL)
    SELECT pair_id, score FROM n WHERE NOT EXISTS (FROM l WHERE l.kind = 'auto_merge' AND l.pair_id = n.pair_id AND l.score = n.score)""",
)
def unlogged_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The automatic merges that the log before its last build had not."""
    log = table(spark, sf_dir, LOG)
    last = log.where("kind = 'build_summary'").agg(F.max("ts")).scalar()
    merges = log.where("kind = 'auto_merge' AND pair_id IS NOT NULL AND score IS NOT NULL").select("pair_id", "score").distinct()
    return resolution.new_log_entries(merges, log.where(F.col("ts") < last))


@query("backfilled_records", "WITH i AS (SELECT id AS manufacturer_id, unnest(known_aliases) AS raw FROM manufacturers) SELECT r.id, i.manufacturer_id FROM nsq_records r LEFT JOIN i ON i.raw = r.manufacturer_raw")
def backfilled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with each company that has its spelling; none for the others."""
    return resolution.backfill(table(spark, sf_dir, NSQ), table(spark, sf_dir, COMPANIES)).select("id", "manufacturer_id")


_AGREED = "drug_name_raw IS NOT NULL AND testing_lab IS NOT NULL AND manufacturer_raw IS NOT NULL"


@query(
    "field_agreement",
    f"""WITH l AS (SELECT manufacturer_raw AS k, min((drug_name_raw, testing_lab)) AS l FROM nsq_records WHERE alert_section = 'central_lab' AND {_AGREED} GROUP BY 1), r AS (SELECT manufacturer_raw AS k, min((drug_name_raw, testing_lab)) AS r FROM nsq_records WHERE alert_section <> 'central_lab' AND {_AGREED} GROUP BY 1),
    x AS (SELECT 'drug_name_raw' AS field, lower(l[1]) AS a, lower(r[1]) AS b FROM l JOIN r USING (k) UNION ALL SELECT 'testing_lab', lower(l[2]), lower(r[2]) FROM l JOIN r USING (k))
    SELECT field, count(*) AS compared, count(*) FILTER (starts_with(a, b) OR starts_with(b, a)) AS agree FROM x GROUP BY 1""",
)
def field_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two sources agree on the first record of a manufacturer: central laboratories and all others."""
    own = table(spark, sf_dir, NSQ).where(_AGREED)
    return questions.field_agreement(own.where("alert_section = 'central_lab'"), own.where("alert_section <> 'central_lab'"), "manufacturer_raw", ["drug_name_raw", "testing_lab"])


@query(
    "reconciled_makers",
    f"""WITH l AS (SELECT DISTINCT manufacturer_raw AS k FROM nsq_records WHERE alert_month < '{CUT_OFF}' AND manufacturer_raw IS NOT NULL), r AS (SELECT DISTINCT manufacturer_raw AS k FROM nsq_records WHERE alert_month >= '{CUT_OFF}' AND manufacturer_raw IS NOT NULL),
    c AS (SELECT (SELECT count(*) FROM l WHERE k IN (FROM r)) AS b, (SELECT count(*) FROM l) AS n, (SELECT count(*) FROM r) AS m) SELECT b AS both, n - b AS left_only, m - b AS right_only, {oracle.share('b', 'n')} AS recall FROM c""",
)
def reconciled_makers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manufacturers before and from a cut-off month on."""
    r = table(spark, sf_dir, NSQ)
    return questions.reconcile(r.where(F.col("alert_month") < CUT_OFF), r.where(F.col("alert_month") >= CUT_OFF), "manufacturer_raw")


_OPEN = "SELECT o_custkey AS c_custkey, 'open orders' AS c_name FROM orders WHERE o_orderstatus = 'O' GROUP BY 1"


@query("upserted_customers", f"WITH n AS ({_OPEN}) SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 0 AND c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT c_custkey, c_name, NULL FROM n")
def upserted_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: new rows (customers with open orders) take the place of old ones (without debts) or come to them; columns that they lack are null."""
    old = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select("c_custkey", "c_name", "c_acctbal")
    new = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"), F.lit("open orders").alias("c_name")).distinct()
    return dedupe.upsert(old, new, "c_custkey")


@query("carried_forward", "SELECT id, last_value(lab_name_canonical IGNORE NULLS) OVER (PARTITION BY manufacturer_raw ORDER BY alert_month NULLS FIRST, id ROWS UNBOUNDED PRECEDING) AS lab FROM nsq_records")
def carried_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last laboratory known for a manufacturer."""
    own = table(spark, sf_dir, NSQ).select("id", "manufacturer_raw", "alert_month", F.col("lab_name_canonical").alias("lab"))
    return export.carry_forward(own, ["manufacturer_raw"], ["alert_month", "id"], "lab").select("id", "lab")


# --- resolution of companies -----------------------------------------------------------


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.entities(table(spark, sf_dir, NSQ))


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entities and scored pairs, written once for all that is made of them."""
    own = materialise(_entities(spark, sf_dir))
    return own, materialise(resolution.scored_pairs(own, resolution.candidate_pairs(resolution.blocks(own))))


query("entities")(_entities)
query("scored_pairs")(lambda spark, sf_dir: _scored(spark, sf_dir)[1])


@query("resolved_companies")
def resolved_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1-E10 from records to companies, without anyone's decisions."""
    own, scored = _scored(spark, sf_dir)
    grouped = resolution.clusters(own, scored.where("tier = 'auto'"))
    return resolution.numbered(resolution.companies(own, grouped)).drop("cluster")


@query("review_triage")
def review_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs left to be decided, in reading order."""
    own, scored = _scored(spark, sf_dir)
    return resolution.triage(resolution.review_queue(own, scored, resolution.clusters(own, scored.where("tier = 'auto'"))))


@query(
    "blocked_parts",
    f"""WITH p AS (SELECT DISTINCT p_name AS raw, split_part(p_name, ' ', 1) AS f, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS s FROM part), k AS (SELECT 'token' AS kind, f AS key, raw FROM p UNION ALL SELECT 'prefix', f[1:4], raw FROM p UNION ALL SELECT 'sorted', s, raw FROM p),
    b AS (SELECT kind, key FROM k GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND {V.LARGEST_BLOCK}) SELECT DISTINCT x.raw AS a, y.raw AS b FROM k x JOIN b USING (kind, key) JOIN k y USING (kind, key) WHERE x.raw < y.raw""",
)
def blocked_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2, J3, F8 over the names of parts."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("raw"), F.col("p_name").alias("norm"), F.col("p_name").alias("core")).distinct()
    return resolution.candidate_pairs(resolution.blocks(names))


_PART_KEYS = """WITH p AS (SELECT DISTINCT p_name AS raw, split_part(p_name, ' ', 1) AS f, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS s FROM part),
    k AS (SELECT 'token' AS kind, f AS key, raw FROM p UNION ALL SELECT 'prefix', f[1:4], raw FROM p UNION ALL SELECT 'sorted', s, raw FROM p)"""


def _part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("raw"), F.col("p_name").alias("norm"), F.col("p_name").alias("core")).distinct()


@query("all_blocked_parts", f"{_PART_KEYS} SELECT DISTINCT x.raw AS a, y.raw AS b FROM k x JOIN k y USING (kind, key) WHERE x.raw < y.raw")
def all_blocked_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2, J3 without the reference's bound: every pair that shares a block of any size."""
    return resolution.candidate_pairs(resolution.blocks(_part_names(spark, sf_dir), None))


@query("skipped_blocks", f"{_PART_KEYS} SELECT kind, key, count(DISTINCT raw) AS members, count(DISTINCT raw) * (count(DISTINCT raw) - 1) // 2 AS pairs FROM k GROUP BY 1, 2 HAVING count(DISTINCT raw) > 2")
def skipped_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: what a bound on blocks leaves out: each block with more than two members, and its pairs."""
    return resolution.skipped(_part_names(spark, sf_dir), 2)


# --- search and export --------------------------------------------------------------------


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hits(table(spark, sf_dir, NSQ), table(spark, sf_dir, COMPANIES))


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What is searched and its index, written once, in order of the terms."""
    own = materialise(_hits(spark, sf_dir))
    return own, materialise(search.postings(own).repartitionByRange("term").sortWithinPartitions("term"))


query("batch_lookup", f"SELECT id FROM nsq_records WHERE regexp_replace(lower(batch_number), '[^a-z0-9]', '', 'g') = regexp_replace(lower('{BATCH}'), '[^a-z0-9]', '', 'g')")(lambda s, d: search.by_batch(_hits(s, d), BATCH).select("id"))
query("company_lookup", f"SELECT r.id FROM nsq_records r LEFT JOIN manufacturers m ON m.id = r.manufacturer_id WHERE contains(lower(coalesce(manufacturer_raw, '')), '{COMPANY}') OR contains(lower(coalesce(canonical_name, '')), '{COMPANY}')")(
    lambda s, d: search.by_company(_hits(s, d), COMPANY).select("id")
)
_TERM = " OR ".join(f"t LIKE '{q}%' OR levenshtein(t, '{q}') <= {round(search.FUZZINESS * len(q))}" for q in search.query_words(DRUG))


@query(
    "drug_lookup",
    f"""WITH w AS (SELECT r.id, unnest(regexp_extract_all(lower(concat_ws(' ', drug_name_raw, manufacturer_raw, canonical_name)), '[\\p{{L}}\\p{{N}}]+')) AS t FROM nsq_records r LEFT JOIN manufacturers m ON m.id = r.manufacturer_id)
    SELECT DISTINCT id FROM w WHERE {_TERM}""",
)
def drug_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: which records have a word of the query, one that begins with it, or one close to it."""
    return search.by_words(*_indexed(spark, sf_dir), DRUG).select("id")


_WORDS = ", ".join(f"({oracle.quote(q)}, {max(0, round(search.FUZZINESS * len(q)))})" for q in search.query_words(DRUG))
_SCORED = f"""WITH h AS (SELECT r.id, coalesce(drug_name_raw, '') AS drug, coalesce(batch_number, '') AS batch, coalesce(manufacturer_raw, '') AS manufacturer, coalesce(canonical_name, '') AS canonical FROM nsq_records r LEFT JOIN manufacturers m ON m.id = r.manufacturer_id),
    f AS ({" UNION ALL ".join(f"SELECT id, '{f}' AS field, {b} AS boost, regexp_extract_all(lower({f}), '[\\p{{L}}\\p{{N}}]+') AS w FROM h" for f, b in search.FIELDS.items())}),
    p AS (SELECT term, field, boost, id, count(*) AS tf, max(n) AS len FROM (SELECT id, field, boost, len(w) AS n, unnest(w) AS term FROM f) GROUP BY ALL),
    t AS (SELECT field, count(DISTINCT id) AS docs, sum(tf) / count(DISTINCT id) AS mean FROM p GROUP BY 1),
    q AS (SELECT col0 AS q, col1 AS k FROM (VALUES {_WORDS})),
    m AS (SELECT term, q, CASE WHEN term = q THEN 1.0 WHEN starts_with(term, q) THEN {search.PREFIX_WEIGHT}::DOUBLE * len(term) / (len(term) + 0.3::DOUBLE * (len(term) - len(q))) WHEN levenshtein(term, q) <= k THEN {search.FUZZY_WEIGHT}::DOUBLE * len(term) / (len(term) + levenshtein(term, q)) END AS weight
        FROM (SELECT DISTINCT term FROM p), q),
    x AS (SELECT * FROM m JOIN p USING (term) WHERE weight IS NOT NULL), d AS (SELECT term, field, count(DISTINCT id) AS df FROM x GROUP BY 1, 2),
    w AS (SELECT id, round(sum(weight * boost * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * {search.K1 + 1} / (tf + {search.K1}::DOUBLE * (1 - {search.B}::DOUBLE + {search.B}::DOUBLE * len / mean))), 6) AS score FROM x JOIN d USING (term, field) JOIN t USING (field) GROUP BY 1)"""
_RANKED = f"""{_SCORED}, ways AS (SELECT id, 0 AS way, 0.0 AS s FROM h WHERE regexp_replace(lower(batch), '[^a-z0-9]', '', 'g') = regexp_replace('{DRUG}', '[^a-z0-9]', '', 'g') UNION ALL SELECT id, 1, -score FROM w
    UNION ALL SELECT id, 2, 0.0 FROM h WHERE contains(lower(manufacturer), '{DRUG}') OR contains(lower(canonical), '{DRUG}')), best AS (SELECT id, min((way, s)) AS x FROM ways GROUP BY 1)
    SELECT row_number() OVER (ORDER BY x, id)::INT AS place, id FROM best ORDER BY place LIMIT 100"""


@query("word_scores", f"{_SCORED} SELECT id, round(score, 4) AS score FROM w")
def word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: every record with a word of the query and its score."""
    return search.by_words(*_indexed(spark, sf_dir), DRUG).select("id", F.round("score", 4).alias("score"))


@query("search_totals", f"{_RANKED.rpartition(chr(10))[0]} SELECT count(*) AS found, count(*) FILTER (x[1] = 1) AS by_words FROM best")
def search_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: how many records are found in all before the first hundred are shown."""
    return search.totals(*_indexed(spark, sf_dir), DRUG)


@query("ranked_search", _RANKED)
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: the first hundred records of all modes."""
    return search.search(*_indexed(spark, sf_dir), DRUG)


_EXPORTED = ", ".join(
    f"array_to_string(coalesce({c}, []), '|') AS {name}" if name in ("failure_categories", "parse_flags") else f"{c if '.' in c else 'r.' + c} AS {name}" for name, c in export.DATASET
)
query("exported_dataset", f"SELECT {_EXPORTED} FROM nsq_records r LEFT JOIN manufacturers m ON m.id = r.manufacturer_id")(lambda s, d: export.dataset(table(s, d, NSQ), table(s, d, COMPANIES)))
_SLUG = "coalesce(nullif(trim(trim(regexp_replace(lower(coalesce(canonical_name, '')), '[^a-z0-9]+', '-', 'g'), '-')[1:60], '-'), ''), 'unknown') || '-' || sha1(array_to_string(list_sort(coalesce(known_aliases, [])), chr(10)))[1:8]"
_over_companies(
    "company_slugs",
    export.slugs,
    f"SELECT id, {_SLUG} AS slug FROM manufacturers",
)
query("shared_slugs", "SELECT slug, count(*) AS n FROM (SELECT sha1(array_to_string(list_sort(coalesce(known_aliases, [])), chr(10)))[1:8] AS slug FROM manufacturers) GROUP BY 1 HAVING count(*) > 1")(
    lambda s, d: quality.guard_unique(table(s, d, COMPANIES).select(X.members_hash(F.coalesce("known_aliases", F.array().cast("array<string>"))).alias("slug")), "slug")
)
query("unused_companies", "SELECT id FROM manufacturers WHERE id NOT IN (SELECT manufacturer_id FROM nsq_records WHERE manufacturer_id IS NOT NULL)")(lambda s, d: quality.guard_used(table(s, d, COMPANIES), table(s, d, NSQ)).select("id"))
_over_records("maker_codes", lambda r: export.dictionary(r, "manufacturer_raw", ["id"]), "SELECT manufacturer_raw AS value, row_number() OVER (ORDER BY min(id)) - 1 AS code FROM nsq_records WHERE manufacturer_raw IS NOT NULL GROUP BY 1")
query(
    "index_rows",
    f"""WITH c AS (SELECT manufacturer_raw AS v, row_number() OVER (ORDER BY manufacturer_raw) - 1 AS code FROM (SELECT DISTINCT manufacturer_raw FROM nsq_records WHERE manufacturer_raw IS NOT NULL))
    SELECT r.id, coalesce(drug_name_raw, '') AS drug, coalesce(batch_number, '') AS batch, coalesce(alert_month, '') AS month, coalesce(alert_section, '') AS section, coalesce(code, -1) AS mfr,
    CASE WHEN m.id IS NULL THEN '' ELSE {_SLUG} END AS slug, CASE lab_type WHEN 'central' THEN 0 WHEN 'state' THEN 1 ELSE 2 END AS lab, coalesce(label_claim_disputed, 0) AS disputed
    FROM nsq_records r LEFT JOIN c ON c.v = r.manufacturer_raw LEFT JOIN manufacturers m ON m.id = r.manufacturer_id""",
)(lambda s, d: export.index_rows(table(s, d, NSQ), table(s, d, COMPANIES)))
_over_records(
    "published_summary",
    lambda r: export.summary(r).withColumn("categories", F.transform(F.map_entries("categories"), lambda x: F.concat_ws(":", x["key"], x["value"]))),
    """SELECT list_sort(list(DISTINCT alert_month) FILTER (alert_month IS NOT NULL), 'DESC') AS months, count(*) AS records, count(*) FILTER (label_claim_disputed = 1) AS disputed,
    (SELECT list(c || ':' || n ORDER BY c) FROM (SELECT c, count(*) AS n FROM (SELECT unnest(failure_category) AS c FROM nsq_records) GROUP BY 1)) AS categories FROM nsq_records""",
)


# --- schemas that drift between files ---------------------------------------------------------


@query("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of row fields between the monthly files of a feed."""
    return schema_changes(table(spark, sf_dir, FILES))


@query("p1_script")
def p1_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole edit scripts, nested paths and moves included."""
    return schema_changes(table(spark, sf_dir, FILES), nested=True)


@query("p1_table")
def p1_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All portal rows in one table under the first names of their fields."""
    return one_table(table(spark, sf_dir, FILES))


_LEAF = "t.type <> 'NULL' AND (t.type <> 'OBJECT' OR t.value::VARCHAR = '{}') AND NOT contains(t.fullkey, '[')"


@query(
    "p1_values",
    f"""WITH f AS (SELECT file_id, unnest(from_json({_PAYLOAD}->'$.aaData', '["JSON"]')) AS r FROM portal_files)
    SELECT file_id, count(DISTINCT f.n)::BIGINT AS n_rows, count(t.id) FILTER ({_LEAF})::BIGINT AS n_values FROM (SELECT file_id, r, row_number() OVER () AS n FROM f) f, json_tree(f.r) t GROUP BY 1""",
)
def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows and values of each file are in the one table: all that its body has."""
    own = p1_table(spark, sf_dir)
    columns = [F.col(f"`{c}`") for c in own.columns if c not in ("file_id", "row_no")]
    filled = [c.isNotNull().cast("long") for c in columns]
    return own.groupBy("file_id").agg(F.count("*").alias("n_rows"), F.sum(sum(filled[1:], filled[0]) if filled else F.lit(0)).cast("long").alias("n_values"))
