"""Checks of normalised records, their confidence, and counts of flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.rules import flags, lookup


def check_flags() -> Column:
    """V1-V4: the flags of a record's fields, in a fixed order."""
    def lacking(f: str) -> Column:
        return F.when(F.coalesce(F.col(f), F.lit("")) == "", F.lit(f"missing_required:{f}"))

    def implausible(f: str) -> Column:
        year = F.nullif(F.regexp_extract(F.col(f), r"^(\d{4})", 1), F.lit("")).cast("int")
        return F.when(~year.between(*V.YEARS), F.concat(F.lit(f"date_implausible:{f}="), F.col(f)))

    mfg, exp, batch = F.col("mfg_date"), F.col("expiry_date"), F.trim("batch_number")
    late = (F.length(mfg) >= 7) & (F.length(exp) >= 7) & (F.substring(exp, 1, 7) < F.substring(mfg, 1, 7))
    odd = (batch != "") & ((F.length(batch) > V.LONGEST_BATCH) | ~batch.rlike("[A-Za-z0-9]"))
    return flags(
        *map(lacking, V.REQUIRED_FIELDS),
        F.when(late, F.concat(F.lit("expiry_before_mfg:"), mfg, F.lit(">"), exp)),
        implausible("mfg_date"),
        implausible("expiry_date"),
        F.when(odd, F.concat(F.lit("batch_number_implausible:"), F.substring(batch, 1, 30))),
    )


def flag_kind(flag: Column) -> Column:
    """A flag without its details."""
    return F.substring_index(flag, ":", 1)


def confidence(of: Column) -> Column:
    """V5: 1 less what each flag takes off, not under the floor. Thousandths are summed as whole numbers."""
    take = lambda f: F.coalesce(lookup({k: round(v * 1000) for k, v in V.DEDUCTIONS.items()}, flag_kind(f)), F.lit(round(V.DEFAULT_DEDUCTION * 1000)))
    left = F.aggregate(of, F.lit(1000), lambda acc, f: acc - take(f))
    return F.greatest(left, F.lit(round(V.LEAST_CONFIDENCE * 1000))) / 1000.0


def flag_statistics(records: DataFrame, column: str = "parse_flags") -> DataFrame:
    """(kind, n): how often each kind of flag is set (V6)."""
    return records.select(F.explode(column).alias("flag")).groupBy(flag_kind(F.col("flag")).alias("kind")).agg(F.count("*").alias("n"))


def guard_unique(df: DataFrame, column: str) -> DataFrame:
    """The values of a column that more than one row has."""
    return df.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def guard_used(companies: DataFrame, records: DataFrame) -> DataFrame:
    """The companies without any record."""
    return companies.join(records.select(F.col("manufacturer_id").alias("id")).where("id IS NOT NULL").distinct(), "id", "left_anti")
