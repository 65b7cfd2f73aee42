"""Consecutive numbers and carried values in a total order, without one task for all rows or for a group."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def number_within(df: DataFrame, within: list[str], order: list[str], name: str) -> DataFrame:
    """Rows of each group numbered from 1 in order, a group of any size being split over ranges. A null is a group of its own."""
    numbered = number_rows(df, [*within, *order], "_place")
    keys = [F.col(c).alias(f"_key{k}") for k, c in enumerate(within)]
    first = numbered.groupBy(*keys).agg(F.min("_place").alias("_first"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_key{k}")) for k, c in enumerate(within)])
    return numbered.join(first, same).withColumn(name, F.col("_place") - F.col("_first") + 1).drop("_place", "_first", *[f"_key{k}" for k in range(len(within))])


def carry_forward(rows: DataFrame, within: list[str], order: list[str], column: str) -> DataFrame:
    """A value stands for the rows of its group after it until the next one; a null is a group of its own.

    Ranges of rows carry their own values in parallel; what a range begins with
    is carried over from the ranges before it, of which a group has as many as
    there are shuffle partitions at most.
    """
    ranged = materialise(rows.repartitionByRange(*within, *order).withColumn("_part", F.spark_partition_id()))
    so_far = Window.partitionBy("_part", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = ranged.groupBy("_part", *within).agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order))).alias("_last"))
    earlier = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.withColumn("_begin", F.last("_last", ignorenulls=True).over(earlier)).where("_begin IS NOT NULL").select("_part", *[F.col(c).alias(f"_key{k}") for k, c in enumerate(within)], "_begin")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_key{k}")) for k, c in enumerate(within)], F.col("_part") == F.col("_p"))
    own = ranged.withColumn("_own", F.last(column, ignorenulls=True).over(so_far)).join(begins.withColumnRenamed("_part", "_p"), same, "left")
    return own.withColumn(column, F.coalesce("_own", "_begin")).select(*rows.columns)


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows numbered from 1 in the order of columns that tell them apart.

    Ranges of rows are numbered in parallel; what comes before each range is
    summed over the ranges, of which there are as many as shuffle partitions.
    """
    ranged = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_i", place).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_i")).cast("long")).drop("_part", "_before", "_i")
