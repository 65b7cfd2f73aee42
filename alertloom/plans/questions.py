"""The seven questions asked of the records, each answer a tidy frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import percent, stem_classes
from ..operators.quality import flag_kind

POTENCY = ["assay", "dissolution"]
CONTAMINATION = ["sterility", "microbial_contamination", "bacterial_endotoxins", "particulate_matter"]
TOP_SHARES = [1, 5, 10, 25, 50, 100, 250]


def _total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def _with_total(counts: DataFrame, total: DataFrame, share: str) -> DataFrame:
    """Counts with their share of a total, which is a scalar subquery."""
    return counts.withColumn(share, percent(F.col("records"), total.scalar()))


def _beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """A frame with the columns of another that has one row, taken by a scalar subquery."""
    return df.withColumn("_one", one_row.select(F.struct(*one_row.columns)).scalar()).select(*df.columns, "_one.*")


def by_month(records: DataFrame) -> DataFrame:
    """A3: (month, n) of the records that have a month."""
    return records.where("alert_month IS NOT NULL").groupBy(F.col("alert_month").alias("month")).agg(F.count("*").alias("n"))


def by_year(records: DataFrame) -> DataFrame:
    """A3: (year, n, months): a year with fewer than twelve months is partial."""
    return by_month(records).groupBy(F.substring("month", 1, 4).alias("year")).agg(F.sum("n").alias("n"), F.count("*").alias("months"))


def volume_summary(records: DataFrame) -> DataFrame:
    """A3: one row: total, month_count, first_month, last_month, no_alert_month."""
    m = F.col("alert_month")
    return records.agg(F.count(m).alias("total"), F.countDistinct(m).alias("month_count"), F.min(m).alias("first_month"), F.max(m).alias("last_month"), F.count_if(m.isNull()).alias("no_alert_month"))


def category_counts(records: DataFrame, labels: str = "failure_category") -> DataFrame:
    """A4: (category, records, share): a record counts once for each of its labels."""
    counts = records.select(F.explode(labels).alias("category")).groupBy("category").agg(F.count("*").alias("records"))
    return _with_total(counts, _total(records), "share")


def labels_per_record(records: DataFrame, labels: str = "failure_category") -> DataFrame:
    """A4: (labels, records): how many labels records have."""
    return records.groupBy(F.coalesce(F.size(labels), F.lit(0)).alias("labels")).agg(F.count("*").alias("records"))


def label_unions(records: DataFrame, labels: str = "failure_category") -> DataFrame:
    """A5: one row: records, and those with any of several labels; they aren't the sum of the labels' counts."""
    any_of = lambda group: F.count_if(F.coalesce(F.arrays_overlap(labels, F.array(*map(F.lit, group))), F.lit(False)))
    no_test = F.array_contains(labels, "other") & F.trim("failure_reason_raw").rlike(V.NO_TEST)
    return records.agg(F.count("*").alias("records"), any_of(POTENCY).alias("potency_related"), any_of(CONTAMINATION).alias("contamination_related"), F.count_if(F.size(labels) > 1).alias("multi_category_records"), F.count_if(no_test).alias("other_naming_no_test"))


def top_companies(companies: DataFrame, k: int = 20) -> DataFrame:
    """(rank, name, state, flags, spellings) of the k companies with the most records."""
    top = companies.select(F.col("canonical_name").alias("name"), "state", F.col("total_flags").alias("flags"), F.coalesce(F.size("known_aliases"), F.lit(0)).alias("spellings"), "id").orderBy(F.desc("flags"), "name", "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("flags"), "name", "id"))).select("rank", "name", "state", "flags", "spellings")


def _by_flags(companies: DataFrame, flags: str) -> DataFrame:
    """How many companies have each number of records: few rows, whatever the number of companies."""
    return companies.groupBy(F.col(flags).alias("flags")).agg(F.count("*").alias("n"))


def concentration(companies: DataFrame, flags: str = "total_flags", shares: list[int] = TOP_SHARES) -> DataFrame:
    """(k, manufacturers, flags, share_of_manufacturers, share_of_flags) of the top k, k being the number of companies at most.

    Sums run over the distinct numbers of records, not over companies.
    """
    per = _by_flags(companies.where(F.col(flags).isNotNull()), flags)
    w = Window.orderBy(F.desc("flags")).rowsBetween(Window.unboundedPreceding, -1)
    run = per.select("flags", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"), F.coalesce(F.sum(F.col("n") * F.col("flags")).over(w), F.lit(0)).alias("sum_before"))
    totals = per.agg(F.sum("n").alias("all_n"), F.sum(F.col("n") * F.col("flags")).alias("all_flags"))
    ks = F.explode(F.array(*map(F.lit, shares))).alias("k")
    at = _beside(run, totals).select("*", ks).withColumn("take", F.least(F.col("k").cast("long"), F.col("all_n")))
    hit = at.where((F.col("before") < F.col("take")) & (F.col("take") <= F.col("before") + F.col("n")))
    top = F.col("sum_before") + (F.col("take") - F.col("before")) * F.col("flags")
    return hit.select("k", F.col("take").alias("manufacturers"), top.alias("flags"), percent(F.col("take"), F.col("all_n")).alias("share_of_manufacturers"), percent(top, F.col("all_flags")).alias("share_of_flags"))


def long_tail(companies: DataFrame, flags: str = "total_flags") -> DataFrame:
    """One row: manufacturers, flags, singles, single_share, upper median and maximum."""
    per = _by_flags(companies.where(F.col(flags).isNotNull()), flags)
    run = per.withColumn("upto", F.sum("n").over(Window.orderBy("flags").rowsBetween(Window.unboundedPreceding, 0)))
    totals = per.agg(F.sum("n").alias("all_n"), F.sum(F.col("n") * F.col("flags")).alias("all_flags"))
    at = _beside(run, totals)
    middle = F.when(F.col("upto") > F.floor(F.col("all_n") / 2), F.col("flags"))
    single = F.sum(F.when(F.col("flags") == 1, F.col("n")).otherwise(0))
    return at.agg(F.max("all_n").alias("manufacturers"), F.max("all_flags").alias("flags"), single.alias("single_flag_manufacturers"), percent(single, F.max("all_n")).alias("single_flag_share"), F.min(middle).alias("median_flags"), F.max("flags").alias("max_flags"))


def pending_reviews(log: DataFrame) -> DataFrame:
    """One row: the note of the last run that applied decisions; null without any."""
    return log.where("kind = 'apply'").agg(F.max_by("note", "log_seq").alias("last_apply"))


def distribution(records: DataFrame, column: str) -> DataFrame:
    """(value, records, share), null as missing."""
    counts = records.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("missing")).alias("value")).agg(F.count("*").alias("records"))
    return _with_total(counts, _total(records), "share")


def labs_under_both(records: DataFrame) -> DataFrame:
    """(lab, records, central_lab, state_lab, minority_records) of the laboratories published under both labels."""
    own = records.where("testing_lab IS NOT NULL").groupBy(F.lower(F.trim("testing_lab")).alias("lab")).agg(
        F.count("*").alias("records"), F.count_if(F.col("alert_section") == "central_lab").alias("central_lab"), F.count_if(F.col("alert_section") == "state_lab").alias("state_lab")
    )
    return own.where("central_lab > 0 AND state_lab > 0").withColumn("minority_records", F.least("central_lab", "state_lab"))


def label_disputes(records: DataFrame) -> DataFrame:
    """One row: records whose published section disagrees with the laboratory, and those moved either way."""
    flagged = F.exists("parse_flags", lambda f: F.startswith(f, F.lit("alert_section_disputed")))
    moved = lambda kind, was: F.count_if((F.col("lab_type") == kind) & (F.col("alert_section") == was))
    return records.agg(F.count_if(flagged).alias("disputed"), moved("central", "state_lab").alias("state_to_central"), moved("state", "central_lab").alias("central_to_state"))


def category_profile(records: DataFrame, labels: str = "failure_category", kind: str = "lab_type") -> DataFrame:
    """(category, central_records, central_share, state_records, state_share, difference_pp) by kind of laboratory."""
    own = records.where(F.col(kind).isin("central", "state"))
    totals = own.agg(F.count_if(F.col(kind) == "central").alias("c"), F.count_if(F.col(kind) == "state").alias("s"))
    counts = own.select(kind, F.explode(F.array_distinct(labels)).alias("category")).groupBy("category").agg(F.count_if(F.col(kind) == "central").alias("central_records"), F.count_if(F.col(kind) == "state").alias("state_records"))
    at = _beside(counts, totals).withColumns({"central_share": percent(F.col("central_records"), F.col("c")), "state_share": percent(F.col("state_records"), F.col("s"))})
    return at.select("category", "central_records", "central_share", "state_records", "state_share", F.round(F.col("central_share") - F.col("state_share"), 1).alias("difference_pp"))


def divergences(profile: DataFrame, support: int = 50, k: int = 8) -> DataFrame:
    """The categories in which the kinds of laboratory differ most, rare ones left out."""
    return profile.where(F.greatest("central_records", "state_records") >= support).orderBy(F.desc(F.abs("difference_pp")), "category").limit(k)


def trend(records: DataFrame, cut: str, window: int = 12) -> DataFrame:
    """One row: means of up to ``window`` months before and from a cut-off month on, the cut-off's count, the peak and the growth over complete years."""
    months = by_month(records)
    early = months.where(F.col("month") < cut).orderBy(F.desc("month")).limit(window).agg(F.round(F.avg("n"), 1).alias("mean_before"))
    late = months.where(F.col("month") >= cut).orderBy("month").limit(window).agg(F.round(F.avg("n"), 1).alias("mean_after"))
    peak = months.agg(F.min(F.struct((-F.col("n")).alias("n"), "month")).alias("p"), F.max(F.when(F.col("month") == cut, F.col("n"))).alias("cut_off_count"))
    years = by_year(records).where("months = 12").agg(F.min_by("n", "year").alias("f"), F.max_by("n", "year").alias("l"))
    out = _beside(_beside(_beside(peak, early), late), years)
    return out.select("mean_before", "mean_after", "cut_off_count", F.col("p.month").alias("peak_month"), (-F.col("p.n")).alias("peak_count"), F.round(F.col("l") / F.col("f"), 2).alias("growth"))


def state_counts(records: DataFrame) -> DataFrame:
    """(state, records, share): the share is of the records that have a state."""
    known = records.where("state IS NOT NULL AND state <> ''")
    return _with_total(known.groupBy("state").agg(F.count("*").alias("records")), _total(known), "share")


def state_coverage(records: DataFrame) -> DataFrame:
    """One row: records, with_state, coverage, distinct_states."""
    known = F.coalesce(F.col("state"), F.lit("")) != ""
    return records.agg(F.count("*").alias("records"), F.count_if(known).alias("with_state"), percent(F.count_if(known), F.count("*")).alias("coverage"), F.countDistinct(F.when(known, F.col("state"))).alias("distinct_states"))


def why_no_state(records: DataFrame) -> DataFrame:
    """(reason, records): the flags about the state of records that have none."""
    flags = records.where("state IS NULL").select(F.explode("parse_flags").alias("f")).where(F.startswith("f", F.lit("state_")))
    return flags.groupBy(flag_kind(F.col("f")).alias("reason")).agg(F.count("*").alias("records"))


def class_counts(records: DataFrame, name: str = "drug_name_clean") -> DataFrame:
    """A10: (class, records, share) of the records whose name has a stem; names are classified once each."""
    names = records.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"))
    counts = names.select("n", F.explode(stem_classes(F.col("name"))).alias("class")).groupBy("class").agg(F.sum("n").alias("records"))
    return _with_total(counts, _total(records), "share")


def stem_audit(records: DataFrame, name: str = "drug_name_clean") -> DataFrame:
    """(stem, class, word, records, hits): every word a stem was found in, to be looked through."""
    names = records.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"))
    each = F.array(*[F.struct(F.lit(s).alias("stem"), F.lit(c).alias("class"), F.regexp_extract_all("name", F.lit("(?iU)" + p), F.lit(0)).alias("words")) for p, c, s in V.STEMS])
    words = names.select("n", F.explode(each).alias("x")).select("n", "x.stem", "x.class", F.explode("x.words").alias("word"))
    return words.groupBy("stem", "class", F.lower("word").alias("word")).agg(F.sum("n").alias("hits"))


def lab_audit(records: DataFrame, classify) -> DataFrame:  # noqa: ANN001
    """(lab, type, basis, records): every distinct laboratory classified once."""
    labs = records.where("testing_lab IS NOT NULL").groupBy(F.col("testing_lab").alias("lab")).agg(F.count("*").alias("records"))
    x: Column = classify(F.col("lab"))
    return labs.withColumn("x", x).select("lab", F.col("x.type").alias("type"), F.col("x.basis").alias("basis"), "records")


def record_counts(records: DataFrame) -> DataFrame:
    """One row: records, months, spellings, disputed, flagged, by kind of laboratory, in one pass."""
    return records.agg(
        F.count("*").alias("records"), F.countDistinct("alert_month").alias("months"), F.min("alert_month").alias("first_month"), F.max("alert_month").alias("last_month"), F.countDistinct("manufacturer_raw").alias("spellings"),
        F.count_if(F.col("label_claim_disputed") == 1).alias("disputed"), F.count_if(F.size("parse_flags") > 0).alias("flagged"), F.count_if(F.col("lab_type") == "central").alias("central"), F.count_if(F.col("lab_type") == "state").alias("state_lab"),
    )


def prefix_states(directory: DataFrame, alone: Column) -> DataFrame:
    """(prefix, state): two-digit beginnings that lie in one state, else three-digit ones; mixed ones are left out."""
    def uniform(n: int) -> DataFrame:
        return directory.groupBy(F.substring("pincode", 1, n).alias("prefix")).agg(F.min("statename").alias("lo"), F.max("statename").alias("hi"))

    two, three = uniform(2), uniform(3)
    mixed = two.where("lo <> hi").select(F.col("prefix").alias("p2"))
    deeper = three.where("lo = hi").join(mixed, F.substring("prefix", 1, 2) == F.col("p2"), "left_semi")
    return two.where("lo = hi").unionByName(deeper).select("prefix", alone.alias("state"))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys on both sides, on either only, and the share of the left found on the right."""
    l, r = left.select(key).where(F.col(key).isNotNull()).distinct().withColumn("l", F.lit(1)), right.select(key).where(F.col(key).isNotNull()).distinct().withColumn("r", F.lit(1))
    both, only_l, only_r = F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()), F.count_if(F.col("r").isNull()), F.count_if(F.col("l").isNull())
    return l.join(r, key, "full").agg(both.alias("both"), only_l.alias("left_only"), only_r.alias("right_only"), percent(both, both + only_l).alias("recall"))


def field_agreement(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, compared, agree): of the keys on both sides, how often a field of one begins the other's.

    Of several rows of a key the first in order counts; nulls agree with nothing.
    """
    first = lambda df, x: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*fields)).alias(x))
    both = first(left, "l").join(first(right, "r"), key)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.col(f"l.{f}").cast("string")).alias("a"), F.lower(F.col(f"r.{f}").cast("string")).alias("b")) for f in fields])
    each = both.select(F.explode(pairs).alias("x")).select("x.*")
    return each.groupBy("field").agg(F.count("*").alias("compared"), F.count_if(F.startswith("a", F.col("b")) | F.startswith("b", F.col("a"))).alias("agree"))
