"""Exact quantiles of groups of any size, without gathering a group."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded, cut

_PARTS = 4096


def lower_quantile(df: DataFrame, keys: Sequence[str], value: str, share: float = 0.5) -> DataFrame:
    """``(keys, q)``: the least value with ``share`` of the key's values at or below it.

    A key's range is cut into 4096 parts, which are counted; the part that
    holds the rank is cut again, from its least to its greatest value, until
    they are one. Counts are combined before the shuffle, so a hot key is as
    good as any. Null values are left out; keys must not be null. Runs jobs when
    called, two to five rounds as a rule.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    spans = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.ceil(F.count(F.lit(1)) * F.lit(share)).alias("_rank"))
    done = cut(spans)
    along = Window.partitionBy(*keys).orderBy("_part")
    settled = []
    while True:
        settled.append(done.where("_lo = _hi").select(*keys, F.col("_lo").alias("q")))
        left = done.where("_lo < _hi")
        if left.isEmpty():
            break
        part = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * _PARTS), F.lit(_PARTS - 1))
        met = rows.join(bounded(left), list(keys)).where("_v between _lo and _hi").withColumn("_part", part)
        parts = met.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.max("_rank").alias("_rank"))
        parts = parts.withColumn("_before", F.sum("_n").over(along) - F.col("_n"))
        held = parts.where("_before < _rank and _rank <= _before + _n")
        done = cut(held.select(*keys, "_lo", "_hi", (F.col("_rank") - F.col("_before")).alias("_rank")))
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    return found


def lower_index(n, share: float = 0.5):
    """0-based place of the same quantile among ``n`` sorted values."""
    return -(-n // 2) - 1 if share == 0.5 else math.ceil(n * share) - 1
