"""Positions and predecessors inside a group, without one task per group.

A window over a whole package or thread puts that group in a single task, and one package
may hold a third of all letters. Here a group is cut into cells of consecutive serials. A
cell holds at most 65,536 rows because serials are unique in a group, and what crosses
cells is one row per cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage, grown

CELL_BITS = 16
AFTER_EVERY_DATE = 2**31 - 1


def _cell(number: str) -> Column:
    return F.shiftright(F.col(number).cast("long"), CELL_BITS)


def number_rows(df: DataFrame, group: list[str], number: str, out: str) -> DataFrame:
    """1-based position of each row in its group, ordered by a unique integer column."""
    celled = df.withColumn("_cell", _cell(number))
    earlier = (
        Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = (
        celled.groupBy(*group, "_cell")
        .count()
        .select(*group, "_cell", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*group, "_cell").orderBy(number)
    return (
        celled.withColumn("_inside", F.row_number().over(inside))
        .join(grown(before), [*group, "_cell"])
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_cell", "_before", "_inside")
    )


def previous_in_order(
    df: DataFrame, group: list[str], day: str, number: str, carried: list[str], out: str
) -> DataFrame:
    """Struct of `carried` from the row before, by (day, undated last, number).

    Three bounded windows: rows of a cell, cells of a day, days of a group.
    """
    item = F.struct(F.col(number).alias("_at"), *carried)
    placed = df.withColumn(
        "_day", F.coalesce(F.unix_date(day), F.lit(AFTER_EVERY_DATE))
    ).withColumn("_cell", _cell(number))
    cells = placed.groupBy(*group, "_day", "_cell").agg(F.max(item).alias("_last"))
    days = cells.groupBy(*group, "_day").agg(F.max("_last").alias("_day_last"))
    day_before = days.select(
        *group,
        "_day",
        F.lag("_day_last").over(Window.partitionBy(*group).orderBy("_day")).alias("_from_day"),
    )
    cell_before = cells.select(
        *group,
        "_day",
        "_cell",
        F.lag("_last").over(Window.partitionBy(*group, "_day").orderBy("_cell")).alias("_from_cell"),
    )
    carry = cell_before.join(grown(day_before), [*group, "_day"]).select(
        *group, "_day", "_cell", F.coalesce("_from_cell", "_from_day").alias("_carry")
    )
    inside = Window.partitionBy(*group, "_day", "_cell").orderBy(number)
    return (
        placed.withColumn("_near", F.lag(item).over(inside))
        .join(grown(carry), [*group, "_day", "_cell"])
        .withColumn(out, F.coalesce("_near", "_carry").dropFields("_at"))
        .drop("_day", "_cell", "_near", "_carry")
    )


def latest_earlier_day(
    df: DataFrame, group: list[str], day: str, number: str, carried: list[str], out: str
) -> DataFrame:
    """Struct of `carried` from the last row of the nearest strictly earlier day of the group.

    Rows are reduced to one per (group, day) before anything is ordered, so the window sees at
    most one row per calendar day however many rows the group has.
    """
    item = F.struct(F.col(number).alias("_at"), *carried)
    days = df.where(F.col(day).isNotNull()).groupBy(*group, day).agg(F.max(item).alias("_last"))
    earlier = days.select(
        *group,
        day,
        F.lag("_last").over(Window.partitionBy(*group).orderBy(day)).dropFields("_at").alias(out),
    )
    return df.join(grown(earlier), [*group, day], "left")


def rank_in_slices(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """1-based position by any order that is total, e.g. one with text in it.

    Range partitioning spreads a large group over many slices. The slice number is kept by a
    checkpoint because a second evaluation could cut at other bounds; per-slice counts then
    give each slice its offset.
    """
    keys = [F.col(g) for g in group]
    sliced = cut_lineage(
        df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id())
    )
    earlier = (
        Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = (
        sliced.groupBy(*group, "_slice")
        .count()
        .select(*group, "_slice", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*group, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_inside", F.row_number().over(inside))
        .join(grown(before), [*group, "_slice"])
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_slice", "_before", "_inside")
    )
