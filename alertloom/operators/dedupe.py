"""Records with one id: identical ones collapsed, others told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import number_within


def fingerprint(columns: list[str]) -> Column:
    """A hash of all fields of a row, nulls told from empty ones."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def collapse(records: DataFrame, key: str, order: list[str], apart: list[str], flags: str) -> DataFrame:
    """One row for identical rows of a key; rows of one key that differ are all kept, numbered in order.

    ``apart``: columns that don't count for being identical. The kept row of
    identical ones has a flag with their number. A key's rows are reduced to
    distinct fingerprints before they are numbered, so very many identical
    rows of one key meet in partial aggregates only; rows of keys that really
    collide are numbered range by range, so one key may have any share of them.
    """
    own = [c for c in records.columns if c not in {key, flags, *apart, *order}]
    marked = records.withColumn("_print", fingerprint(own))
    groups = marked.groupBy(key, "_print").agg(F.min(F.struct(*order, *[c for c in records.columns if c not in order])).alias("_row"), F.count("*").alias("_copies"))
    keys = groups.groupBy(key).agg(F.count("*").alias("_kinds"), F.sum("_copies").alias("_n"))
    alone = groups.join(keys.where("_kinds = 1"), key).select("_row.*", "_copies")
    collapsed = alone.withColumn(flags, F.when(F.col("_copies") > 1, F.concat(flags, F.array(F.concat(F.lit("duplicate_source_rows_collapsed:"), F.col("_copies").cast("string"))))).otherwise(F.col(flags))).drop("_copies")
    several = number_within(records.join(keys.where("_kinds > 1").select(key, "_n"), key), [key], order, "_i")
    told = several.withColumns({x: F.col(x).cast("string") for x in ("_i", "_n")})
    told = told.withColumn(flags, F.concat(flags, F.array(F.concat(F.lit("id_collision_disambiguated:"), "_i", F.lit("of"), "_n")))).withColumn(key, F.concat_ws("_", key, "_i"))
    return collapsed.select(*records.columns).unionByName(told.select(*records.columns))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """K2: the old rows whose key isn't among the new ones, and the new ones. A column that one side lacks is null there."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def last_written(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; maxima are combined before the shuffle."""
    rest = [c for c in log.columns if c not in [*keys, *order]]
    return log.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_x")).select(*keys, "_x.*").select(*log.columns)
