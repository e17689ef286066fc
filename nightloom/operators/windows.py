"""Windows over regular samples, and per-epoch features, as DataFrame expressions.

Long form: ``(keys..., sample, value)`` with whole-number samples. Array form:
``(keys..., values array<double>)``. Null and NaN samples are skipped by the
aggregates of the long form; array forms expect plain numbers. Windows without
enough samples give null. Every window carries its keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once, also where ``f`` uses it inside another lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def epochs(samples: DataFrame, keys: Sequence[str], sample: str, value: str, width: int) -> DataFrame:
    """``(keys, epoch, values)``: tumbling windows of exactly ``width`` samples; a partial one is dropped."""
    rows = samples.withColumn("epoch", F.floor(F.col(sample) / width))
    g = rows.groupBy(*keys, "epoch").agg(F.sort_array(F.collect_list(F.struct(sample, value))).alias("_s"))
    return g.where(F.size("_s") == width).select(*keys, "epoch", F.transform("_s", lambda s: s[value]).alias("values"))


def sliding(samples: DataFrame, keys: Sequence[str], sample: str, width: int, step: int, last: str) -> DataFrame:
    """``samples`` by every window they are in: adds ``window`` (0-based) of ``width`` samples every ``step``.

    last: column with the number of samples of the sequence; windows that leave
    the data are dropped. Each row appears in ceil(width / step) windows at most.
    """
    first = F.greatest(F.lit(0), F.floor((F.col(sample) - width) / step) + 1)
    final = F.least(F.floor(F.col(sample) / step), F.floor((F.col(last) - width) / step))
    return samples.withColumns({"_a": first.cast("bigint"), "_b": final.cast("bigint")}).where("_a <= _b").withColumn("window", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")


def sliding_arrays(values: Column, width: int, step: int) -> Column:
    """All whole windows of an array column; empty if it is shorter."""
    n = F.floor((F.size(values) - width) / step).cast("int")
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(values, i * step + 1, width))).otherwise(F.array().cast("array<array<double>>"))


MOVING = ("mean", "min", "max", "ptp", "rms", "prop_above_zero", "slope", "covar", "corr")


def moving(samples: DataFrame, keys: Sequence[str], sample: str, x: str, last: str, sf: float, window: float, step: float, method: str, y: str | None = None) -> DataFrame:
    """``(keys, window, t, value)``: a statistic in centred windows every ``step`` seconds, clipped to the data.

    method: one of :data:`MOVING`; covar and corr need ``y``. Window k is
    centred at k * step; its bounds in samples are truncated, the end is left
    out, and t is the middle of the clipped bounds in seconds. last: column
    with the number of samples. Fewer than two samples give null for slope,
    covar and corr.
    """
    half = window / 2
    centre = lambda k: k * step
    begin = lambda k: F.greatest(F.lit(0), ((centre(k) - half) * sf).cast("bigint"))
    end = lambda k: F.least(F.col(last), ((centre(k) + half) * sf).cast("bigint"))
    at = F.col(sample) / sf
    low, high = F.greatest(F.floor((at - half) / step) - 1, F.lit(0)), F.floor((at + half) / step) + 1
    rows = samples.withColumn("window", F.explode(F.sequence(low.cast("bigint"), high.cast("bigint"))))
    k = F.col("window")
    rows = rows.where((k * step < F.col(last) / sf) & (F.col(sample) >= begin(k)) & (F.col(sample) < end(k)))
    v = F.col(x)
    enough = lambda c: F.when(F.count(v) > 1, c)
    stat = {
        "mean": lambda: F.avg(v),
        "min": lambda: F.min(v),
        "max": lambda: F.max(v),
        "ptp": lambda: F.max(v) - F.min(v),
        "rms": lambda: F.sqrt(F.avg(v * v)),
        "prop_above_zero": lambda: F.avg((v >= 0).cast("double")),
        "slope": lambda: enough(F.regr_slope(v, F.col(sample) / sf)),
        "covar": lambda: enough(F.covar_samp(v, F.col(y))),
        "corr": lambda: enough(F.try_divide(F.covar_pop(v, F.col(y)), F.stddev_pop(v) * F.stddev_pop(F.col(y)))),
    }[method]()
    g = rows.groupBy(*keys, "window").agg(F.max(last).alias(last), stat.alias("value"))
    return g.select(*keys, "window", ((begin(k) + end(k)) / 2 / sf).alias("t"), "value")


def interpolated(points: DataFrame, samples: DataFrame, keys: Sequence[str], t: str, value: str, sample: str, sf: float) -> DataFrame:
    """``(keys, sample, value)``: straight lines between points at the samples' times, 0 before the first and after the last."""
    p = points.where(F.col(value).isNotNull()).select(*keys, F.col(t).alias("_t"), F.col(value).alias("_v"), F.lit(None).cast("bigint").alias(sample))
    s = samples.select(*keys, (F.col(sample) / sf).alias("_t"), F.lit(None).cast("double").alias("_v"), F.col(sample).cast("bigint").alias(sample))
    u = p.unionByName(s)
    w = Window.partitionBy(*keys).orderBy("_t", F.col(sample).asc_nulls_first())
    point = F.when(F.col(sample).isNull(), F.struct("_t", "_v"))
    u = u.withColumns({"_p": F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_q": F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    line = F.col("_p._v") + (F.col("_q._v") - F.col("_p._v")) * F.coalesce(F.try_divide(F.col("_t") - F.col("_p._t"), F.col("_q._t") - F.col("_p._t")), F.lit(0.0))
    on = F.when(F.col("_p._t") == F.col("_t"), F.col("_p._v")).otherwise(line)
    return u.where(F.col(sample).isNotNull()).select(*keys, sample, F.coalesce(on, F.lit(0.0)).alias(value))


def fill_gaps(df: DataFrame, keys: Sequence[str], order: str, value: str, limit: int = 10) -> Column:
    """Window column: nulls interpolated by row number, at most ``limit`` from a known value on either side; ends repeat the nearest."""
    w = Window.partitionBy(*keys).orderBy(order)
    i = F.row_number().over(w)
    known = F.when(F.col(value).isNotNull(), F.struct(i.alias("i"), F.col(value).alias("v")))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    a, b = before["v"], after["v"]
    inner = a + (b - a) * (i - before["i"]) / (after["i"] - before["i"])
    near = (i - before["i"] <= limit) | (after["i"] - i <= limit)
    guess = F.when(before.isNull(), b).when(after.isNull(), a).otherwise(inner)
    return F.when(F.col(value).isNotNull(), F.col(value)).when(F.coalesce(near, F.lit(False)), guess)


def triangular(value: str, keys: Sequence[str], order: str, half: int = 7) -> Column:
    """Centred triangular rolling mean over ``2 * half + 1`` rows, weighted over the rows that have a value."""
    w = Window.partitionBy(*keys).orderBy(order)
    total, weight = F.lit(0.0), F.lit(0.0)
    for k in range(-half, half + 1):
        c = F.lag(value, -k).over(w)
        share = (half + 1 - abs(k)) / (half + 1)
        total += F.coalesce(c * share, F.lit(0.0))
        weight += F.when(c.isNotNull(), share).otherwise(0.0)
    return F.try_divide(total, weight)


def trailing(value: str, keys: Sequence[str], order: str, rows: int = 4) -> Column:
    """Mean of this row and the ``rows - 1`` before it."""
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0))


def boxcar(value: str, keys: Sequence[str], order: str, width: int) -> Column:
    """Moving average of ``width`` rows, zeros beyond the ends; an even width reaches one row further back."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width // 2), (width - 1) // 2)
    return F.coalesce(F.sum(value).over(w), F.lit(0.0)) / width


def robust_scale(df: DataFrame, keys: Sequence[str], columns: Sequence[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Columns less their median over the distance of two quantiles, per key; a zero distance counts as 1."""
    stats = df.groupBy(*keys).agg(*[F.percentile(c, F.array(F.lit(low), F.lit(0.5), F.lit(high))).alias(f"_q_{c}") for c in columns])
    rows = df.join(stats, list(keys))
    for c in columns:
        q = F.col(f"_q_{c}")
        spread = q[2] - q[0]
        rows = rows.withColumn(c, (F.col(c) - q[1]) / F.when(spread == 0, 1.0).otherwise(spread))
    return rows.drop(*[f"_q_{c}" for c in columns])


def trimmed_sd(values: Column, cut: float = 0.1) -> Column:
    """SD (n - 1) of an array without its ``int(cut * n)`` lowest and highest numbers; null below two left."""
    n = F.size(values)
    k = F.floor(n * cut).cast("int")
    kept = F.slice(F.array_sort(values), k + 1, F.greatest(n - 2 * k, F.lit(0)))
    ss = lambda xs: let(_total(xs) / F.size(xs), lambda m: F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))
    return F.when(n - 2 * k > 1, let(kept, lambda xs: F.sqrt(ss(xs) / (F.size(xs) - 1))))


def zero_crossings(values: Column) -> Column:
    """0-based positions before a change of sign; zero counts as not positive."""
    return F.filter(F.sequence(F.lit(0), F.size(values) - 2), lambda i: (F.get(values, i) > 0) != (F.get(values, i + 1) > 0))


def local_peaks(values: Column, low: float, high: float) -> Column:
    """0-based positions of strict local maxima with a value in [low, high]; of a plateau the middle (rounded down)."""
    n = F.size(values)

    def right_end(i: Column) -> Column:
        return F.aggregate(F.sequence(i, n - 1), F.struct(i.alias("e"), F.lit(True).alias("on")), lambda a, j: F.struct(F.when(a["on"] & (F.get(values, j) == F.get(values, i)), j).otherwise(a["e"]).alias("e"), (a["on"] & (F.get(values, j) == F.get(values, i))).alias("on")))["e"]

    starts = F.filter(F.sequence(F.lit(1), n - 2), lambda i: (F.get(values, i) > F.get(values, i - 1)) & (F.get(values, i) >= low) & (F.get(values, i) <= high) & (F.get(values, i) >= F.get(values, i + 1)))
    ends = F.transform(starts, lambda i: F.struct(i.alias("i"), right_end(i).alias("e")))
    kept = F.filter(ends, lambda s: (s["e"] < n - 1) & (F.get(values, s["e"] + 1) < F.get(values, s["i"])))
    return F.when(n >= 3, F.transform(kept, lambda s: F.floor((s["i"] + s["e"]) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))


def simpson(values: Column, dx: float, n: int) -> Column:
    """Composite Simpson integral of ``n`` equally spaced values, with the usual correction of the last interval for even ``n``."""
    return F.aggregate(F.zip_with(values, F.array(*[F.lit(w) for w in simpson_weights(n, dx)]), lambda v, w: v * w), F.lit(0.0), lambda a, x: a + x)


def simpson_weights(n: int, dx: float) -> list[float]:
    """Weights of that rule; the trapezoid for two values, 0 for one."""
    if n < 3:
        return [dx / 2] * n if n == 2 else [0.0] * n
    odd = n if n % 2 else n - 1
    w = [0.0] * n
    for i in range(0, odd - 2, 2):
        for j, f in enumerate((1, 4, 1)):
            w[i + j] += f * dx / 3
    if n % 2 == 0:
        for j, f in ((-1, 5 / 12), (-2, 2 / 3), (-3, -1 / 12)):
            w[j] += f * dx
    return w


def band_power(spectra: DataFrame, keys: Sequence[str], freqs: str, psd: str, bands: Sequence[tuple[float, float, str]], grid: Sequence[float], relative: bool = True) -> DataFrame:
    """``(keys, band columns, TotalAbsPow, FreqRes)``: Simpson power per band, over the power between the lowest and highest band edge if relative.

    grid: the frequencies that every row's ``freqs`` holds (known from the
    spectral estimate), which fixes the weights when planning. Bounds belong to
    both bands.
    """
    dx = grid[1] - grid[0]
    low, high = min(b[0] for b in bands), max(b[1] for b in bands)

    def power(a: float, b: float) -> Column:
        inside = [i for i, f in enumerate(grid) if a <= f <= b]
        return simpson(F.slice(psd, inside[0] + 1, len(inside)), dx, len(inside)) if inside else F.lit(None).cast("double")

    total = power(low, high)
    cols = [(F.try_divide(power(a, b), total) if relative else power(a, b)).alias(name) for a, b, name in bands]
    return spectra.select(*keys, *cols, total.alias("TotalAbsPow"), F.lit(float(dx)).alias("FreqRes"), F.lit(relative).alias("Relative"))


def describe(values: Column) -> dict[str, Column]:
    """Per-epoch features of an array: std, iqr, skew, kurt, nzc, hmob, hcomp, petrosian."""
    n = F.size(values).cast("double")
    centred = let(_total(values) / n, lambda m: F.transform(values, lambda x: x - m))
    power = lambda xs, k: _total(F.transform(xs, lambda x: F.pow(x, F.lit(float(k))))) / n
    diff = lambda xs: F.zip_with(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))), lambda a, b: a - b)
    var = lambda xs: let(_total(xs) / F.size(xs), lambda m: F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))) / F.size(xs)
    v0, v1, v2 = var(values), var(diff(values)), let(diff(values), lambda d: var(diff(d)))

    def quantile(s: Column, q: float) -> Column:
        at = (n - 1) * q
        lo = F.floor(at).cast("int")
        return F.get(s, lo) + (F.get(s, F.least(lo + 1, n.cast("int") - 1)) - F.get(s, lo)) * (at - lo)

    mobility = F.sqrt(F.try_divide(v1, v0))
    turns = let(diff(values), lambda d: F.size(F.filter(F.sequence(F.lit(1), F.size(d) - 1), lambda i: F.get(d, i) * F.get(d, i - 1) < 0)))
    return {
        "std": let(centred, lambda c: F.sqrt(power(c, 2) * n / (n - 1))),
        "iqr": let(F.array_sort(values), lambda s: quantile(s, 0.75) - quantile(s, 0.25)),
        "skew": let(centred, lambda c: F.try_divide(power(c, 3), F.pow(power(c, 2), F.lit(1.5)))),
        "kurt": let(centred, lambda c: F.try_divide(power(c, 4), power(c, 2) * power(c, 2)) - 3),
        "nzc": F.size(zero_crossings(values)),
        "hmob": mobility,
        "hcomp": F.try_divide(F.sqrt(F.try_divide(v2, v1)), mobility),
        "petrosian": F.log10(n) / (F.log10(n) + F.log10(n / (n + 0.4 * turns))),
    }


def ndpac(phase: Column, amplitude: Column, p: float = 0.05) -> Column:
    """Normalised direct phase-amplitude coupling of two arrays; 0 where it isn't significant at ``p``."""
    from ..functions.dist import erfinv

    n = F.size(phase).cast("double")
    centred = let(_total(amplitude) / n, lambda m: F.transform(amplitude, lambda x: x - m))
    scaled = let(centred, lambda c: let(F.sqrt(_total(F.transform(c, lambda x: x * x)) / (n - 1)), lambda sd: F.transform(c, lambda x: F.try_divide(x, sd))))
    part = lambda f: let(scaled, lambda z: _total(F.zip_with(z, phase, lambda a, p: a * f(p))))
    square = F.pow(part(F.cos), F.lit(2.0)) + F.pow(part(F.sin), F.lit(2.0))
    limit = 2 * n * float(erfinv(1 - p) ** 2)
    return let(square, lambda s: F.when(s <= limit, 0.0).otherwise(F.sqrt(s) / n))


def artefacts(epochs_: DataFrame, keys: Sequence[str], channel: str, stage: str, values: str, threshold: float = 3.0, n_chan_reject: int = 1, least_epochs: int = 30) -> DataFrame:
    """``(keys, epoch, stage, n_out, artefact)`` by the spread of each channel: z of log(SD + 1) within stage.

    Channels without any spread are left out; an epoch is flat, and an artefact,
    where half its channels or more don't change. Stages with fewer than
    ``least_epochs`` epochs are not judged.
    """
    v = F.col(values)
    sd = let(_total(v) / F.size(v), lambda m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(v)))
    rows = epochs_.select(*keys, channel, stage, "epoch", sd.alias("_sd"), (F.array_min(v) == F.array_max(v)).alias("_flat"))
    alive = rows.groupBy(*keys, channel).agg(F.max("_sd").alias("_m")).where("_m > 0").select(*keys, channel)
    rows = rows.join(alive, [*keys, channel], "left_semi")
    w = Window.partitionBy(*keys, "epoch")
    rows = rows.withColumn("_flat_epoch", F.avg(F.col("_flat").cast("double")).over(w) >= 0.5)
    good = F.when(~F.col("_flat_epoch"), F.log(F.col("_sd") + 1))
    ws = Window.partitionBy(*keys, channel, stage)
    rows = rows.withColumn("_x", good)
    z = F.try_divide(F.col("_x") - F.avg("_x").over(ws), F.stddev_pop("_x").over(ws))
    rows = rows.withColumns({"_z": z, "_n": F.count("_x").over(ws)})
    g = rows.groupBy(*keys, "epoch", stage).agg(F.count_if((F.abs("_z") > threshold) & (F.col("_n") >= least_epochs)).alias("n_out"), F.max("_flat_epoch").alias("flat"))
    return g.select(*keys, "epoch", stage, "n_out", (F.col("flat") | (F.col("n_out") >= n_chan_reject)).alias("artefact"))
