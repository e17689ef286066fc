"""Seeded choice of an exact number of rows per group, without a task for the group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded

_BITS = 12


def pick(df: DataFrame, group: Sequence[str], ident: str, wanted: str, seed: int) -> DataFrame:
    """``df`` plus boolean ``picked``: true for ``wanted`` rows of each group, chosen by a seeded hash of ``ident``.

    Groups are cut into 4096 parts by the hash; whole parts are taken in turn
    and rows are ranked only in the part where the number is reached. A wanted
    number above the group's size picks all, null or zero none. ``ident`` should
    be unique in a group; equal ones are told apart in no defined order. Null
    group keys form a group. Work columns begin with an underscore.
    """
    keys = [f"_g{i}" for i in range(len(group))]
    rows = df.withColumns({k: F.coalesce(F.col(g).cast("string"), F.lit("\x00")) for k, g in zip(keys, group)})
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), F.col(ident))).withColumn("_b", F.shiftrightunsigned("_h", 64 - _BITS))
    parts = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"), F.max(wanted).alias("_w"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_before", F.coalesce(before, F.lit(0)))
    left = F.coalesce(F.col("_w"), F.lit(0)) - F.col("_before")
    parts = parts.select(*keys, "_b", F.greatest(F.least(left, F.col("_n")), F.lit(0)).alias("_take"), "_n")
    rows = rows.join(bounded(parts), [*keys, "_b"])
    whole = rows.where("_take = 0 or _take = _n").withColumn("picked", F.col("_take") > 0)
    rank = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h", ident))
    some = rows.where("_take > 0 and _take < _n").withColumn("picked", rank <= F.col("_take"))
    return whole.unionByName(some).drop(*keys, "_h", "_b", "_take", "_n")
