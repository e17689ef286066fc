"""Pairing records of two tables by nearest time within a tolerance.

Every right-side time owns an interval of the time line: it ends half-way to
its neighbours, and at the tolerance. The intervals of one entity are disjoint,
so a left time lies in one at most. Intervals are indexed by the bins of the
time line that they touch, and the range join is an equi-join on (entity, bin)
with the interval as residual. The partition is a bin, never a whole entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def microseconds(seconds: Column) -> Column:
    """Seconds as whole microseconds; null for null and NaN."""
    return F.when(~F.isnan(seconds), F.bround(seconds * 1_000_000)).cast("bigint")


def intervals(right: DataFrame, keys: Sequence[str], time: str, tolerance: int, bin_width: int) -> DataFrame:
    """``right`` by bin, with the doubled interval ``[lo2, hi2]`` in which its time is the nearest one.

    Doubling keeps the midpoints whole. A row is placed in each bin that its
    tolerance reaches, two at most; a neighbour further off than that can't be
    nearer to any time of the bin, so it is missed without loss. A midpoint
    belongs to the earlier time. ``(keys, time)`` must be unique.
    """
    first, last = F.floor((F.col(time) - tolerance) / F.lit(bin_width)), F.floor((F.col(time) + tolerance) / F.lit(bin_width))
    placed = right.withColumn("_bin", F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*keys, "_bin").orderBy(time)
    return placed.withColumns(
        {
            "_lo2": F.greatest(F.col(time) * 2 - 2 * tolerance, F.lag(time).over(w) + F.col(time) + 1),
            "_hi2": F.least(F.col(time) * 2 + 2 * tolerance, F.lead(time).over(w) + F.col(time)),
        }
    )


def nearest_within(left: DataFrame, right: DataFrame, keys: Sequence[str], *, left_id: str, left_time: str, right_id: str, right_time: str, tolerance: int, bin_width: int | None = None) -> DataFrame:
    """``(left_id, right_id, distance)``: each left row with its nearest right row at most ``tolerance`` away.

    Times and tolerance are whole numbers of one unit (microseconds, say). A
    left row without a right row in reach is left out; a right row may serve
    many. Equal right times of an entity count as the one with the smallest id,
    of two equally near the earlier is taken. Rows with a null key or time take
    no part; ids should be unique (a repeated left row gives repeated pairs).
    Only the named columns are read, so others may clash. bin_width is 2
    tolerances unless given, never less.
    """
    width = max(bin_width or 0, 2 * tolerance, 1)
    whole = lambda df, ident, time: df.select(*keys, F.col(ident), F.col(time).cast("bigint").alias("_t")).dropna(subset=[*keys, "_t"])
    r = whole(right, right_id, right_time).groupBy(*keys, "_t").agg(F.min(right_id).alias("_right"))
    r = intervals(r, keys, "_t", tolerance, width).withColumnRenamed("_t", "_s")
    spread = whole(left, left_id, left_time).withColumn("_bin", F.floor(F.col("_t") / F.lit(width))).withColumnRenamed(left_id, "_left")
    inside = (F.col("_t") * 2 >= F.col("_lo2")) & (F.col("_t") * 2 <= F.col("_hi2"))
    met = spread.join(r, [*keys, "_bin"]).where(inside)
    return met.select(F.col("_left").alias(left_id), F.col("_right").alias(right_id if right_id != left_id else f"{right_id}_right"), F.abs(F.col("_t") - F.col("_s")).alias("distance"))
