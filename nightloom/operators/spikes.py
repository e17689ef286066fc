"""Readings that cannot be right for their source.

Peaks over threshold: each reading's residual from its season's level is
divided by the source's scatter; beyond a high quantile a generalised Pareto
tail is fitted per source, and its quantile at a fixed risk is the source's
cutoff. A season is a stage, and a stretch of the night in it; its level is
drawn towards the next wider one by its number of readings. Cutoffs are drawn the
same way to that of all sources, so a short recording has the tail of its field
and a long one its own.
Readings of a plausibility table and long runs of equal values are flagged
beside it and left aside in every estimate.

A source of bounded length is one stretch of a task's rows and is worked in
NumPy, with one shuffle for all steps. Longer ones are never gathered: their
runs are found in slices, their quantiles by counting, and the few figures of a
source are joined back. Both give the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded, cut
from .quantiles import lower_index, lower_quantile
from .sequence import equal_runs, whole_groups

#: Width of the histogram's bins, in scales.
STEP = 1 / 16
#: Readings that a source counts for at most among all sources.
VOICE = 1000
#: Rows up to which a source may be one stretch of a task.
WHOLE = 200_000


def readings(df: DataFrame, ident: str, source: str, time: str, season: str, fields: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Long form ``(ident, source, time, season, field, value, implausible)`` of the non-null readings; NaN counts as null."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for f, (lo, hi) in fields.items()])
    long = df.select(F.col(ident).alias("ident"), F.col(source).alias("source"), F.col(time).cast("double").alias("time"), F.col(season).alias("season"), F.explode(each).alias("r"))
    long = long.where(F.col("r.value").isNotNull() & ~F.isnan("r.value"))
    return long.select("ident", "source", "time", "season", "r.field", "r.value", ((F.col("r.value") < F.col("r.lo")) | (F.col("r.value") > F.col("r.hi"))).alias("implausible"))


def _cutoffs(counts: np.ndarray, risk: float, share: float) -> np.ndarray:
    """Quantile at ``risk`` of the tail of each histogram ``[rows, bins]``."""
    mid = (np.arange(counts.shape[1]) + 0.5) * STEP
    n = counts.sum(1)
    beyond = counts[:, ::-1].cumsum(1)[:, ::-1] / n[:, None]
    at = np.minimum((beyond > share).sum(1), counts.shape[1] - 1)
    tail = counts * (np.arange(counts.shape[1]) >= at[:, None])
    peaks = tail.sum(1)
    mean = (tail * mid).sum(1) / peaks - at * STEP
    spread = (tail * (mid - (at * STEP + mean)[:, None]) ** 2).sum(1) / peaks
    shape = np.clip(0.5 * (1 - mean * mean / np.maximum(spread, 1e-12)), 0.0, 0.5)
    scale, often = mean * (1 - shape), np.maximum(peaks / n / risk, 1.0)
    safe = np.maximum(shape, 1e-9)
    return at * STEP + np.where(shape < 1e-6, scale * np.log(often), scale / safe * (often**safe - 1))


def tail_cutoffs(own: np.ndarray, all_sources: np.ndarray, risk: float, share: float, prior: float) -> np.ndarray:
    """Cutoff of each row of ``own [sources, bins]`` at ``risk``; NaN where no source has a reading.

    A source's own cutoff is drawn to that of ``all_sources`` with the weight of
    ``prior`` readings. Every histogram gets 100 readings of a standard normal,
    so that a few readings still have a tail. The threshold is the first bin edge
    beyond which at most ``share`` of the readings lie. Shape and scale follow
    from mean and variance of the excesses; the shape is kept between 0 and
    0.5, as a tail taken for bounded would end at the largest reading seen.
    """
    mid = (np.arange(own.shape[1]) + 0.5) * STEP
    normal = np.exp(-0.5 * mid * mid)
    normal *= 100 / normal.sum()
    n = own.sum(1)
    cutoff = (n * _cutoffs(own + normal, risk, share) + prior * _cutoffs((all_sources + normal)[None], risk, share)) / (n + prior)
    return np.where(all_sources.sum() > 0, cutoff, np.nan)


def _median(values: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower median (NaN without values) and count of each of ``n`` groups."""
    order = np.lexsort((values, group))
    count = np.bincount(group, minlength=n)
    start = np.cumsum(count) - count
    out = np.full(n, np.nan)
    some = count > 0
    out[some] = values[order][(start + lower_index(count))[some]]
    return out, count


def _towards(wide: np.ndarray, level: np.ndarray, count: np.ndarray, pull: float) -> np.ndarray:
    return wide + (np.where(count > 0, level, wide) - wide) * count / (count + pull)


_KEPT = ["run_length", "level", "scale", "residual", "implausible", "stuck"]


def _sized(rows: DataFrame, fields: Mapping[str, tuple[float, float]], stuck_runs: int, stretch: float, window: float, pull: float) -> DataFrame:
    """Residuals of sources that each fit into a task: ``(ident, source, time, season, field, value)`` and :data:`_KEPT`."""
    head = ["ident", "source", "time", "season"]
    types = dict(rows.dtypes)

    def work(batch: pa.RecordBatch, entity: np.ndarray) -> Iterator[pa.RecordBatch]:
        time = pc.fill_null(batch.column("time"), -np.inf).to_numpy(zero_copy_only=False)
        block = np.where(np.isfinite(time), np.floor(time / stretch), -1)
        season = pc.fill_null(batch.column("_s").dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        for field, (lo, hi) in fields.items():
            value = pc.fill_null(batch.column(field), np.nan).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(~np.isnan(value))
            if not len(at):
                continue
            v, e = value[at], entity[at]
            n = int(entity[-1]) + 1
            new = np.ones(len(v), bool)
            new[1:] = (v[1:] != v[:-1]) | (e[1:] != e[:-1])
            run = np.cumsum(new) - 1
            length = np.bincount(run)[run]
            implausible, stuck = (v < lo) | (v > hi), length >= stuck_runs
            usable = ~implausible & ~stuck
            level, _ = _median(v[usable], e[usable], n)
            off = np.abs(v - level[e])
            mid, count = _median(off[usable], e[usable], n)
            mean = np.bincount(e[usable], weights=off[usable], minlength=n) / np.maximum(count, 1)
            scale = np.where(mid > 0, mid * 1.4826, mean * 1.2533)
            near = usable & (off <= window * scale[e])
            _, stage = np.unique(np.stack([e, season[at]], 1), axis=0, return_inverse=True)
            _, cell = np.unique(np.stack([stage, block[at].astype(np.int64)], 1), axis=0, return_inverse=True)
            by_stage = _towards(level[e], *(x[stage] for x in _median(v[near], stage[near], int(stage.max()) + 1)), pull)
            seasonal = _towards(by_stage, *(x[cell] for x in _median(v[near], cell[near], int(cell.max()) + 1)), pull)
            with np.errstate(divide="ignore", invalid="ignore"):
                residual = np.where(scale[e] > 0, (v - seasonal) / scale[e], np.nan)
            known = lambda x: pa.array(x, mask=np.isnan(x))
            rest = [pa.array(length.astype(np.int64)), known(level[e]), known(scale[e]), known(residual), pa.array(implausible), pa.array(stuck)]
            taken = batch.select(head).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array([field] * len(v)), pa.array(v), *rest], names=[*head, "field", "value", *_KEPT])

    schema = ", ".join(f"{c} {types[c]}" for c in head) + ", field string, value double, run_length bigint, level double, scale double, residual double, implausible boolean, stuck boolean"
    laid = rows.withColumn("_s", F.col("season").cast("string")).repartition("source").sortWithinPartitions("source", "time", "ident")
    return laid.mapInArrow(lambda batches: whole_groups(batches, ["source"], work), schema)


def _long(rows: DataFrame, stuck_runs: int, stretch: float, window: float, pull: float, slice_width: float) -> DataFrame:
    """The same of sources of any length, from :func:`readings`."""
    rows = equal_runs(rows, ["source", "field"], ["time", "ident"], "value", F.coalesce(F.floor(F.col("time") / slice_width), F.lit(-(1 << 62))))
    rows = rows.withColumn("stuck", F.col("run_length") >= stuck_runs)
    rows = rows.withColumns(
        {
            "usable": ~F.col("stuck") & ~F.col("implausible"),
            "_k": F.coalesce(F.col("source").cast("string"), F.lit("\x00")),
            "_s": F.coalesce(F.col("season").cast("string"), F.lit("\x00")),
            "_b": F.coalesce(F.floor(F.col("time") / stretch), F.lit(-1)),
        }
    )
    rows = cut(rows)
    key = ["_k", "field"]
    rows = rows.join(bounded(cut(lower_quantile(rows.where("usable"), key, "value").withColumnRenamed("q", "level"))), key, "left")
    rows = rows.withColumn("off", F.abs(F.col("value") - F.col("level")))
    mean = rows.where("usable").groupBy(*key).agg(F.avg("off").alias("oa"))
    scales = lower_quantile(rows.where("usable"), key, "off").join(mean, key)
    scales = scales.select(*key, F.when(F.col("q") > 0, F.col("q") * 1.4826).otherwise(F.col("oa") * 1.2533).alias("scale"))
    rows = cut(rows.join(bounded(cut(scales)), key, "left"))
    near = rows.where(F.col("usable") & (F.col("off") <= window * F.col("scale")))
    for name, cell, wide in (("_m", [*key, "_s"], "level"), ("_c", [*key, "_s", "_b"], "_m")):
        count = near.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
        levels = cut(lower_quantile(near, cell, "value").join(count, cell))
        rows = rows.join(bounded(levels), cell, "left")
        rows = rows.withColumn(name, F.col(wide) + (F.coalesce("q", F.col(wide)) - F.col(wide)) * F.coalesce("_n", F.lit(0)) / (F.coalesce("_n", F.lit(0)) + pull)).drop("q", "_n")
    rows = rows.withColumn("residual", F.when(F.col("scale") > 0, (F.col("value") - F.col("_c")) / F.col("scale")))
    return rows.select("ident", "source", "time", "season", "field", "value", *_KEPT)


def flag(
    df: DataFrame,
    *,
    ident: str,
    source: str,
    time: str,
    season: str,
    fields: Mapping[str, tuple[float, float]],
    risk: float = 2e-6,
    share: float = 0.004,
    window: float = 6.0,
    prior: float = 3000.0,
    pull: float = 40.0,
    stuck_runs: int = 5,
    stretch: float = 7200.0,
    slice_width: float = 1_000_000.0,
    whole: int = WHOLE,
    sizing: DataFrame | None = None,
) -> DataFrame:
    """One row per non-null reading with what is wrong with it.

    Columns: ident, source, time, season, field, value, run_length, level,
    scale, residual (in scales), cutoff and the booleans implausible, stuck,
    extreme.

    fields: plausible range of each field, ends included. stuck: a run of
    ``stuck_runs`` or more equal successive readings in order of time, then
    ident (missing ones skipped). extreme: the residual's size exceeds the
    source's tail cutoff, which an ordinary reading passes with ``risk``.

    level is the source's lower median and scale 1.4826 times the median
    distance from it, or 1.2533 times the mean one where that is zero. A stage
    has the median of its readings within ``window`` scales, drawn to the level
    with the weight of ``pull`` readings; a ``stretch`` of time in it likewise,
    drawn to the stage. The tail is fitted to the residuals within ``window``
    scales: what lies further off never teaches it. It begins where ``share``
    of them is left, and is drawn to that of all sources with the weight of
    ``prior`` readings, in which no source counts for more than
    :data:`VOICE` of its own (see :func:`tail_cutoffs`).

    A null source is a source, a null time comes first, nulls and NaN are no
    readings; a source whose usable readings are all equal has no extremes. An
    empty table gives an empty one. Runs jobs when called. Sources of more than
    ``whole`` rows aren't gathered into a task; ``slice_width`` then bounds the
    rows sorted in one (time units). sizing: a table that holds a source at
    least as often as ``df`` and is cheaper to count, such as the one ``df`` was
    made from.
    """
    kept = df.select(F.col(ident).alias("ident"), F.col(source).alias("source"), F.col(time).cast("double").alias("time"), F.col(season).alias("season"), *[F.col(f).cast("double").alias(f) for f in fields])
    counted = (df if sizing is None else sizing).groupBy(F.col(source).alias("_hot")).agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.where(F.col("n") > whole).select("_hot", F.lit(True).alias("_is"))
    sizes = cut(sizes)
    apart = not sizes.isEmpty()
    told = [stuck_runs, stretch, window, pull]
    large = None
    if apart:
        marked = cut(kept.join(bounded(sizes), F.col("source").eqNullSafe(F.col("_hot")), "left"))
        small = cut(_sized(marked.where("_is is null").drop("_hot", "_is"), fields, *told))
        large = cut(_long(readings(marked.where("_is"), "ident", "source", "time", "season", fields), *told, slice_width))
    else:
        small = cut(_sized(kept, fields, *told))

    bins = round(window / STEP)
    bin_of = F.floor(F.abs("residual") / STEP)
    teaches = ~F.col("implausible") & ~F.col("stuck") & (bin_of < bins)

    def own_tails(batch: pa.RecordBatch, group: np.ndarray) -> np.ndarray:
        """Histogram ``[groups, bins]`` of the residuals that teach."""
        y = np.abs(pc.fill_null(batch.column("residual"), np.nan).to_numpy(zero_copy_only=False))
        no = pc.or_(batch.column("implausible"), batch.column("stuck")).to_numpy(zero_copy_only=False)
        with np.errstate(invalid="ignore"):
            use = ~no & (y < window)
        place = group[use] * bins + (y[use] / STEP).astype(np.int64)
        return np.bincount(place, minlength=(int(group[-1]) + 1) * bins).reshape(-1, bins).astype(float)

    def voices(batch: pa.RecordBatch, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = own_tails(batch, group)
        own *= np.minimum(1.0, VOICE / np.maximum(own.sum(1), 1.0))[:, None]
        field = batch.column("field").to_numpy(zero_copy_only=False)[np.flatnonzero(np.diff(group, prepend=-1))]
        for f in fields:
            total = own[field == f].sum(0)
            at = np.flatnonzero(total)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([f] * len(at)), pa.array(at), pa.array(total[at])], names=["field", "bin", "n"])

    told = small.select("source", "field", "residual", "implausible", "stuck").mapInArrow(lambda batches: whole_groups(batches, ["source", "field"], voices), "field string, bin bigint, n double")
    if apart:
        large = large.withColumn("_k", F.coalesce(F.col("source").cast("string"), F.lit("\x00")))
        binned = cut(large.where(teaches).groupBy("_k", "field", bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n")))
        heard = binned.withColumn("_all", F.sum("n").over(Window.partitionBy("_k", "field")))
        told = told.unionByName(heard.select("field", "bin", (F.col("n") * F.least(F.lit(1.0), VOICE / F.col("_all"))).alias("n")))
    pooled = {f: np.zeros(bins) for f in fields}
    for r in told.groupBy("field", "bin").agg(F.sum("n").alias("n")).collect():  # fields times bins
        pooled[r.field][r.bin] = r.n
    columns = ["ident", "source", "time", "season", "field", "value", "run_length", "level", "scale", "residual", "cutoff", "implausible", "stuck", "extreme"]
    types = dict(small.dtypes) | {"cutoff": "double", "extreme": "boolean"}

    def judge(batch: pa.RecordBatch, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        y = np.abs(pc.fill_null(batch.column("residual"), np.nan).to_numpy(zero_copy_only=False))
        no = pc.or_(batch.column("implausible"), batch.column("stuck")).to_numpy(zero_copy_only=False)
        field = batch.column("field").to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.diff(group, prepend=-1))
        own = own_tails(batch, group)
        cutoff = np.full(len(first), np.nan)
        for f, all_sources in pooled.items():
            mine = field[first] == f
            if mine.any():
                cutoff[mine] = tail_cutoffs(own[mine], all_sources, risk, share, prior)
        limit = cutoff[group]
        with np.errstate(invalid="ignore"):
            extreme = ~no & (y > limit)
        rest = {"cutoff": pa.array(limit, mask=np.isnan(limit)), "extreme": pa.array(extreme)}
        yield pa.RecordBatch.from_arrays([rest[c] if c in rest else batch.column(c) for c in columns], names=columns)

    judged = small.mapInArrow(lambda batches: whole_groups(batches, ["source", "field"], judge), ", ".join(f"{c} {types[c]}" for c in columns))
    if not apart:
        return judged

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = np.zeros((len(pdf), bins))
            for i, counts in enumerate(pdf["counts"]):
                for c in counts:
                    own[i, c["bin"]] = c["n"]
            limits = [tail_cutoffs(own[i : i + 1], pooled[f], risk, share, prior)[0] for i, f in enumerate(pdf["field"])]
            yield pdf[["_k", "field"]].assign(cutoff=[None if np.isnan(x) else x for x in limits])

    tails = binned.groupBy("_k", "field").agg(F.collect_list(F.struct("bin", "n")).alias("counts")).mapInPandas(fit, "_k string, field string, cutoff double")
    far = large.join(bounded(cut(tails)), ["_k", "field"], "left")
    extreme = F.coalesce(~F.col("implausible") & ~F.col("stuck") & (F.abs("residual") > F.col("cutoff")), F.lit(False))
    return judged.unionByName(far.withColumn("extreme", extreme).select(*columns))
