"""Pairs of overlapping number ranges inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import grown

# a range of level k fits into 8 ** k, so it touches at most two buckets of that width
LEVEL_BITS = 3
LEVELS = 22


def _bucket(number: Column, level: Column) -> Column:
    return F.call_function("shiftright", number.cast("long"), (level * LEVEL_BITS).cast("int"))


def _level(lo: str, hi: str) -> Column:
    return F.ceil(F.length(F.bin(F.col(hi).cast("long") - F.col(lo).cast("long"))) / LEVEL_BITS).cast("int")


def overlap_pairs(
    left: DataFrame, right: DataFrame, group: list[str], left_range: tuple[str, str], right_range: tuple[str, str]
) -> DataFrame:
    """Rows of `left` beside the rows of `right` of their group whose ranges overlap, each pair once.

    Both ends belong to a range; a range whose end lies before its begin overlaps nothing, nor does one with a missing end.
    Ranges may be of any length: each is entered in at most two buckets of its own width, and shorter ones look at the widths
    that occur on the other side. Column names other than those of `group` must differ.
    """
    (a, b), (c, d) = left_range, right_range
    lefts = left.where(F.col(a) <= F.col(b)).withColumn("_left_own", _level(a, b))
    rights = right.where(F.col(c) <= F.col(d)).withColumn("_right_own", _level(c, d))
    columns = [*group, *[x for x in left.columns if x not in group], *[x for x in right.columns if x not in group]]

    def entered(rows: DataFrame, lo: str, hi: str, own: str, other: DataFrame, other_own: str) -> DataFrame:
        # one bit for each level of the other side; a group without other side has no pairs
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(other_own))
        levels = other.groupBy(*group).agg(F.bit_or(bit).alias("_levels"))
        wanted = F.filter(
            F.sequence(F.col(own), F.lit(LEVELS)),
            lambda n: (n == F.col(own)) | (F.call_function("shiftright", F.col("_levels"), n) % 2 != 0),
        )
        ends = F.array_distinct(F.array(_bucket(F.col(lo), F.col("_level")), _bucket(F.col(hi), F.col("_level"))))
        placed = rows.join(grown(levels), group).withColumn("_level", F.explode(wanted)).drop("_levels")
        return grown(placed.withColumn("_bucket", F.explode(ends)))

    met = entered(lefts, a, b, "_left_own", rights, "_right_own").join(
        entered(rights, c, d, "_right_own", lefts, "_left_own"), [*group, "_level", "_bucket"]
    )
    # the wider range stays at its own level, the other comes to it
    begins = _bucket(F.greatest(F.col(a), F.col(c)), F.col("_level"))
    return met.where(
        (F.col("_level") == F.greatest("_left_own", "_right_own"))
        & (F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) & (F.col("_bucket") == begins)
    ).select(*columns)
