"""Heart-rate variability of periods from heartbeat times."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hypnogram import runs
from .windows import fill_gaps


def beats_in_periods(beats: DataFrame, periods: DataFrame, keys: Sequence[str], t: str, start: str, duration: str, width: float = 60.0) -> DataFrame:
    """``periods`` joined to the beats with ``start <= t < start + duration``.

    An equi-join on buckets of ``width`` seconds; a period is placed in each
    bucket it touches. Null times take no part.
    """
    bucket = lambda c: F.floor(c / width)
    end = F.col(start) + F.col(duration)
    p = periods.where(F.col(start).isNotNull() & (F.col(duration) > 0)).withColumn("_b", F.explode(F.sequence(bucket(F.col(start)), bucket(end))))
    b = beats.where(F.col(t).isNotNull()).select(*keys, F.col(t).alias("beat"), bucket(F.col(t)).alias("_b"))
    return p.join(b, [*keys, "_b"]).where((F.col("beat") >= F.col(start)) & (F.col("beat") < end)).drop("_b")


def number_periods(periods: DataFrame, keys: Sequence[str], stage: str, start: str) -> DataFrame:
    """``periods`` plus epoch: the 0-based number within a stage by start."""
    return periods.withColumn("epoch", F.row_number().over(Window.partitionBy(*keys, stage).orderBy(start)) - 1)


def variability(beats: DataFrame, period: Sequence[str], t: str = "beat", rr_limit: tuple[float, float] = (400, 2000), duration: str = "duration", limit: int = 10) -> DataFrame:
    """``(period, n_beats, hr_mean, hr_std, hrv_rmssd)`` of each period from its beats.

    Intervals outside ``rr_limit`` (ms) are interpolated, ten in a row at most
    from either side; a period with any left, or with fewer than 30 beats a
    minute, has null values. hr_std has n - 1.
    """
    w = Window.partitionBy(*period).orderBy(t)
    rows = beats.withColumn("_raw", (F.col(t) - F.lag(t).over(w)) * 1000.0)
    rows = rows.withColumn("_i", F.row_number().over(w)).withColumn("_rr", F.when(F.col("_raw").between(*rr_limit), F.col("_raw")))
    counts = rows.groupBy(*period).agg(F.count(F.lit(1)).alias("n_beats"), F.max(duration).alias("_d"))
    inner = rows.where("_i > 1")
    inner = inner.withColumn("_rr", fill_gaps(inner, period, "_i", "_rr", limit))
    inner = inner.withColumn("_dd", F.col("_rr") - F.lag("_rr").over(Window.partitionBy(*period).orderBy("_i")))
    hr = 60000.0 / F.col("_rr")
    stats = inner.groupBy(*period).agg(F.count_if(F.col("_rr").isNull()).alias("_bad"), F.avg(hr).alias("hr_mean"), F.stddev_samp(hr).alias("hr_std"), F.sqrt(F.avg(F.col("_dd") * F.col("_dd"))).alias("hrv_rmssd"))
    ok = (F.col("_bad") == 0) & (60 * F.col("n_beats") / F.col("_d") >= 30)
    met = counts.join(stats, list(period), "left")
    return met.select(*period, "n_beats", *[F.when(ok, F.col(c)).alias(c) for c in ("hr_mean", "hr_std", "hrv_rmssd")])


def by_stage(hyp: DataFrame, beats: DataFrame, keys: Sequence[str], epoch_sec: float, t: str = "beat", include: Sequence[int] = (2, 3, 4), threshold: float = 120.0, equal_length: bool = False, rr_limit: tuple[float, float] = (400, 2000)) -> DataFrame:
    """``(keys, stage, epoch, start, duration, n_beats, hr_mean, hr_std, hrv_rmssd)`` of each period of an included stage.

    hyp: ``(keys, epoch, code)``, epochs of ``epoch_sec`` seconds. A period is a
    run of one stage of ``threshold`` seconds or more (``equal_length``: pieces
    of just that); epoch numbers those of a stage. A period without beats keeps
    its row, with null values.
    """
    least = max(math.ceil(threshold / epoch_sec), 1)
    found = runs(hyp, keys, least, equal_length).where(F.col("value").isin(*include))
    periods = found.select(*keys, F.col("value").alias("stage"), (F.col("start") * float(epoch_sec)).alias("start"), (F.col("length") * float(epoch_sec)).alias("duration"))
    periods = number_periods(periods, keys, "stage", "start")
    ident = [*keys, "stage", "epoch"]
    measured = variability(beats_in_periods(beats, periods, keys, t, "start", "duration"), ident, rr_limit=rr_limit)
    return periods.join(measured, ident, "left").select(*ident, "start", "duration", F.coalesce("n_beats", F.lit(0)).alias("n_beats"), "hr_mean", "hr_std", "hrv_rmssd")
