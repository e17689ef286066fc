"""Event tables: summaries, masks, event-locked epochs, matching, coincidence.

An event is a row with a recording, a channel and times in seconds. Interval
and tolerance joins are equi-joins on exploded or bucketed keys, never nested
loops. Null times take no part in joins. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGG = {"mean": F.avg, "median": F.median, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum, "first": F.first}


def circular_mean(angle: Column | str) -> Column:
    """Mean direction in (-pi, pi] of angles in radians; null without any."""
    return F.atan2(F.sum(F.sin(angle)), F.sum(F.cos(angle)))


def summary(events: DataFrame, by: Sequence[str], columns: Sequence[str], agg: str | Callable = "mean", circular: Sequence[str] = (), mask: Column | None = None) -> DataFrame:
    """``(by, Count, columns)``: events per group and the aggregate of each column (mean, median, std, min, max, sum).

    circular: columns of angles, averaged on the circle whatever ``agg`` is.
    agg may be a function of a pandas Series to a number; such a group's values
    go to one Python task, the rest is joined to them. Null group keys are groups.
    """
    rows = events if mask is None else events.where(mask)
    if not by:
        return rows
    if callable(agg):

        def reduced_value(v: pd.Series) -> float:
            return float(agg(v))

        reduce_ = F.pandas_udf(reduced_value, "double")
        keys = [F.coalesce(F.col(b).cast("string"), F.lit("\x00")).alias(f"_g{i}") for i, b in enumerate(by)]
        on = [f"_g{i}" for i in range(len(by))]
        own = [c for c in columns if c not in circular]
        keyed = rows.select("*", *keys)
        counted = keyed.groupBy(*on).agg(*[F.first(b).alias(b) for b in by], F.count(F.lit(1)).alias("Count"), *[circular_mean(c).alias(c) for c in columns if c in circular])
        reduced = keyed.groupBy(*on).agg(*[reduce_(F.col(c).cast("double")).alias(c) for c in own]) if own else keyed.select(*on).distinct()
        return counted.join(reduced, on).select(*by, "Count", *columns)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("Count"), *[(circular_mean(c) if c in circular else _AGG[agg](c)).alias(c) for c in columns])


def density(summarised: DataFrame, minutes: DataFrame, on: Sequence[str]) -> DataFrame:
    """``summarised`` plus Density: Count per minute of the stage, null where the stage has no minutes."""
    return summarised.join(minutes, list(on), "left").withColumn("Density", F.try_divide("Count", "minutes")).drop("minutes")


def drop_repeated(events: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Every member of a group with equal ``(by, column)`` dropped, for one column after the other; nulls are equal."""
    for c in columns:
        events = events.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by, c))).where("_n = 1").drop("_n")
    return events


def on_several(events: DataFrame, by: Sequence[str], start: str, end: Column) -> DataFrame:
    """Events whose start or end, rounded half to even to a second, another event of ``by`` shares."""
    rows = events.withColumns({"_s": F.bround(F.col(start)), "_e": F.bround(end)})
    rows = rows.withColumns({"_ns": F.count(F.lit(1)).over(Window.partitionBy(*by, "_s")), "_ne": F.count(F.lit(1)).over(Window.partitionBy(*by, "_e"))})
    return rows.where("_ns > 1 or _ne > 1").drop("_s", "_e", "_ns", "_ne")


def merge_close(points: DataFrame, by: Sequence[str], sample: str, distance: float) -> DataFrame:
    """``(by, start, stop)``: spans of ordered samples, gaps below ``distance`` samples filled."""
    w = Window.partitionBy(*by).orderBy(sample)
    step = F.col(sample) - F.lag(sample).over(w)
    rows = points.withColumn("_g", F.sum(F.when((step > 1) & (step >= distance), 1).otherwise(0)).over(w))
    return rows.groupBy(*by, "_g").agg(F.min(sample).alias("start"), F.max(sample).alias("stop")).drop("_g")


def samples_of(events: DataFrame, by: Sequence[str], start: Column, end: Column, sf: Column | float) -> DataFrame:
    """``(by, sample)``: every sample from start to end, both included, truncated like an integer cast; once each."""
    at = lambda t: F.floor(t * sf).cast("bigint")
    rows = events.where(start.isNotNull() & end.isNotNull() & (end >= start))
    return rows.select(*by, F.explode(F.sequence(at(start), at(end))).alias("sample")).distinct()


def locked(events: DataFrame, samples: DataFrame, by: Sequence[str], ident: str, center: Column, sf: float, before: float, after: float, value: str, bounds: DataFrame | None = None) -> DataFrame:
    """``(by, ident, offset, value)``: samples around each event's centre; events whose window leaves the data are dropped.

    bounds: ``(by, lo, hi)`` for a sparse signal, whose missing samples from lo
    to hi are 0; it need not be filled up for this.
    """
    nb, na = int(before * sf), int(after * sf)
    grid = events.where(center.isNotNull()).select(*by, ident, F.floor(center * sf).cast("bigint").alias("_c"))
    if bounds is not None:
        grid = grid.join(bounds, list(by)).where((F.col("_c") - nb >= F.col("lo")) & (F.col("_c") + na <= F.col("hi"))).drop("lo", "hi")
    grid = grid.withColumn("offset", F.explode(F.sequence(F.lit(-nb), F.lit(na)))).withColumn("sample", F.col("_c") + F.col("offset"))
    met = grid.join(samples.select(*by, "sample", value), [*by, "sample"], "inner" if bounds is None else "left")
    if bounds is not None:
        return met.select(*by, ident, "offset", F.coalesce(value, F.lit(0)).alias(value))
    n = F.count(F.lit(1)).over(Window.partitionBy(*by, ident, "_c"))
    return met.withColumn("_n", n).where(F.col("_n") == nb + na + 1).select(*by, ident, "offset", value)


def template(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Average event: ``(by, offset, n, value)``."""
    return rows.groupBy(*by, "offset").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias(value))


def matches(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, distance: int) -> DataFrame:
    """``left`` with boolean ``matched``: some ``right`` of the same ``by`` lies within ``distance`` (whole numbers)."""
    near = right.where(F.col(at).isNotNull()).select(*by, F.explode(F.sequence(F.col(at) - distance, F.col(at) + distance)).alias(at)).distinct()
    return left.join(near.withColumn("_hit", F.lit(True)), [*by, at], "left").withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit")


def compare(detected: DataFrame, truth: DataFrame, by: Sequence[str], at: str, distance: int = 0) -> DataFrame:
    """``(by, tp, fp, fn, precision, recall, f1)`` of two sets of whole-number times per group.

    Repeated times count once. A side without events, or a 0/0, gives 0.
    """
    d, t = (x.where(F.col(at).isNotNull()).select(*by, at).distinct() for x in (detected, truth))
    a = matches(d, t, by, at, distance).groupBy(*by).agg(F.count_if("matched").alias("tp"), F.count_if(~F.col("matched")).alias("fp"))
    b = matches(t, d, by, at, distance).groupBy(*by).agg(F.count_if(~F.col("matched")).alias("fn"), F.count_if("matched").alias("_hit"))
    both = a.join(b, list(by), "full_outer").fillna(0, ["tp", "fp", "fn", "_hit"])
    # precision over the detected; recall over hits and misses, as the F1 of the counts
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    both = both.withColumns({"precision": F.coalesce(p, F.lit(0.0)), "recall": F.coalesce(r, F.lit(0.0))})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return both.withColumn("f1", f1).drop("_hit")


def deciseconds(time: Column) -> Column:
    """Tenths of a second, rounded half to even; null for null."""
    return F.bround(time * 10).cast("bigint")


def compare_channels(events: DataFrame, by: Sequence[str], channel: str, at: str, distance: int = 0) -> DataFrame:
    """Agreement of every ordered pair of channels, rows as truth: ``(by, truth, detected, tp, fp, fn, precision, recall, f1)``.

    Pairs come from an equi-join on the (exploded) time, so only times that
    meet are multiplied, and the marginal counts complete the matrix.
    """
    e = events.where(F.col(at).isNotNull()).select(*by, F.col(channel).alias("c"), at).distinct()
    n = e.groupBy(*by, "c").agg(F.count(F.lit(1)).alias("n"))
    near = e.select(*by, F.col("c").alias("truth"), F.explode(F.sequence(F.col(at) - distance, F.col(at) + distance)).alias(at), F.col(at).alias("_t"))
    met = near.join(e.withColumnRenamed("c", "detected"), [*by, at])
    hits = met.groupBy(*by, "truth", "detected").agg(F.countDistinct(at).alias("tp"), F.countDistinct("_t").alias("_found"))
    grid = n.select(*by, F.col("c").alias("truth"), F.col("n").alias("_nt")).join(n.select(*by, F.col("c").alias("detected"), F.col("n").alias("_nd")), list(by))
    m = grid.join(hits, [*by, "truth", "detected"], "left").fillna(0, ["tp", "_found"])
    m = m.withColumns({"fp": F.col("_nd") - F.col("tp"), "fn": F.col("_nt") - F.col("_found")})
    m = m.withColumns({"precision": F.coalesce(F.try_divide("tp", "_nd"), F.lit(0.0)), "recall": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return m.withColumn("f1", f1).select(*by, "truth", "detected", "tp", "fp", "fn", "precision", "recall", "f1")


def spans_of(events: DataFrame, by: Sequence[str], start: Column, end: Column, sf: Column | float) -> DataFrame:
    """``(by, first, last)``: the same samples as :func:`samples_of`, as disjoint spans that don't touch."""
    at = lambda t: F.floor(t * sf).cast("bigint")
    rows = events.where(start.isNotNull() & end.isNotNull() & (end >= start)).select(*by, at(start).alias("first"), at(end).alias("last"))
    w = Window.partitionBy(*by).orderBy("first", "last")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_g", F.when(F.col("first") <= reach + 1, 0).otherwise(1))
    rows = rows.withColumn("_g", F.sum("_g").over(w))
    return rows.groupBy(*by, "_g").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_g")


def coincidence(spans: DataFrame, by: Sequence[str], channel: str, scaled: bool = False, width: int = 4096) -> DataFrame:
    """``(by, c1, c2, value)``: samples in which two channels both have an event.

    spans: ``(by, channel, first, last)`` of samples, disjoint within a channel
    (:func:`spans_of`). Spans meet in bins of ``width`` samples and overlaps are
    summed, so rows follow the events, not their samples. scaled: divided by
    the product of both channels' samples, 1 on the diagonal.
    """
    s = spans.select(*by, F.col(channel).alias("c1"), "first", "last")
    bins = s.withColumn("_b", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))
    bins = bins.select(*by, "c1", "_b", F.greatest("first", F.col("_b") * width).alias("f1"), F.least("last", F.col("_b") * width + (width - 1)).alias("l1"))
    met = bins.join(bins.withColumnsRenamed({"c1": "c2", "f1": "f2", "l1": "l2"}), [*by, "_b"])
    shared = F.least("l1", "l2") - F.greatest("f1", "f2") + 1
    both = met.where(shared > 0).groupBy(*by, "c1", "c2").agg(F.sum(shared).alias("both"))
    n = s.groupBy(*by, "c1").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n1"))
    grid = n.join(n.withColumnsRenamed({"c1": "c2", "n1": "n2"}), list(by)).join(both, [*by, "c1", "c2"], "left").fillna(0, ["both"])
    value = F.when(F.col("c1") == F.col("c2"), F.lit(1.0)).otherwise(F.try_divide(F.col("both").cast("double"), F.col("n1") * F.col("n2"))) if scaled else F.col("both").cast("double")
    return grid.select(*by, "c1", "c2", value.alias("value"))


def cooccurring(waves: DataFrame, spindles: DataFrame, by: Sequence[str], ident: str, wave_at: str, peak: str, rank: str, lookaround: float = 1.2) -> DataFrame:
    """``waves`` plus the spindle peak strictly within ``lookaround`` seconds, the one last in table order (``rank``).

    Adds Cooccurring (boolean), CooccurringPeak and DistanceToWave (peak less
    wave, seconds); null without a spindle.
    """
    bucket = lambda c, k=0: F.floor(F.col(c) / lookaround) + k
    s = spindles.where(F.col(peak).isNotNull()).select(*by, F.col(peak).alias("_p"), F.col(rank).alias("_r"), F.explode(F.array(*[bucket(peak, k) for k in (-1, 0, 1)])).alias("_b"))
    w = waves.where(F.col(wave_at).isNotNull()).select(*by, ident, F.col(wave_at).alias("_t"), bucket(wave_at).alias("_b"))
    met = w.join(s, [*by, "_b"]).where((F.col("_p") > F.col("_t") - lookaround) & (F.col("_p") < F.col("_t") + lookaround))
    last = met.groupBy(ident).agg(F.max_by(F.struct("_p", "_t"), "_r").alias("_m"))
    return waves.join(last, ident, "left").withColumns({"Cooccurring": F.col("_m").isNotNull(), "CooccurringPeak": F.col("_m._p"), "DistanceToWave": F.col("_m._p") - F.col("_m._t")}).drop("_m")


def at_stage(events: DataFrame, hyp: DataFrame, on: Sequence[str], time: Column, freq: Column | float) -> DataFrame:
    """``events`` plus ``code``, the stage of the epoch ``time`` falls in; -2 outside the hypnogram."""
    rows = events.withColumn("_e", F.floor(time / freq).cast("int"))
    return rows.join(hyp.select(*on, F.col("epoch").alias("_e"), "code"), [*on, "_e"], "left").withColumn("code", F.coalesce("code", F.lit(-2))).drop("_e")


def following(points: DataFrame, by: Sequence[str], time: str, kind: str, wanted: str, strict: bool = False) -> Column:
    """Window column: the first ``wanted`` time at or after (after, if strict) each row of a union of point kinds."""
    w = Window.partitionBy(*by).orderBy(time, kind).rowsBetween(1 if strict else 0, Window.unboundedFollowing)
    return F.first(F.when(F.col(kind) == wanted, F.col(time)), ignorenulls=True).over(w)


def preceding(points: DataFrame, by: Sequence[str], time: str, kind: str, wanted: str) -> Column:
    """Window column: the last ``wanted`` time before each row."""
    w = Window.partitionBy(*by).orderBy(time, kind).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(F.col(kind) == wanted, F.col(time)), ignorenulls=True).over(w)


def edf_annotations(events: DataFrame, start: str, duration: str, label: Column) -> DataFrame:
    """``onset, label, duration`` rows in the layout of annotation files."""
    return events.select(F.col(start).alias("onset"), label.alias("label"), F.col(duration).alias("duration"))


def aggregates(names: Mapping[str, str]) -> list[Column]:
    """Columns of named aggregates, ``{column: aggregate}``."""
    return [_AGG[a](c).alias(f"{c}_{a}") for c, a in names.items()]
