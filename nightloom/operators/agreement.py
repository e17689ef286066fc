"""Agreement of two scorings, epoch by epoch and on sleep statistics.

Everything is a closed form of grouped counts or moments; only p-values and
bootstrap intervals use NumPy, per statistic. Ratios of nothing are 0 where the
usual definition says so and null otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..session import bounded, cut

METRICS = ("accuracy", "balanced_acc", "kappa", "mcc", "precision", "recall", "f1")


def paired(ref: DataFrame, obs: DataFrame, on: Sequence[str], code: str = "code") -> DataFrame:
    """``(on, ref, obs)``: the epochs that both scored."""
    return ref.select(*on, F.col(code).alias("ref")).join(obs.select(*on, F.col(code).alias("obs")), list(on)).where("ref is not null and obs is not null")


def paired_ends(hyp: DataFrame, session: str, scorer: str, code: str = "code") -> DataFrame:
    """``(session, epoch, ref, obs)`` of each session's first and last scorer by name, sessions with one scorer left out.

    One pass over the epochs, brought together by session, instead of a join of
    two passes.
    """
    w = Window.partitionBy(session)
    rows = hyp.withColumns({"_a": F.min(scorer).over(w), "_b": F.max(scorer).over(w)}).where("_a <> _b")
    pick = lambda c: F.max(F.when(F.col(scorer) == F.col(c), F.col(code)))
    both = rows.groupBy(session, "epoch").agg(pick("_a").alias("ref"), pick("_b").alias("obs"))
    return both.where("ref is not null and obs is not null")


def paired_first(hyp: DataFrame, session: str, scorer: str, code: str = "code") -> DataFrame:
    """``(session, observer, epoch, ref, obs)``: each session's first scorer by name as the reference of every other one."""
    first = F.min(scorer).over(Window.partitionBy(session))
    rows = hyp.withColumn("_a", first).withColumn("ref", F.max(F.when(F.col(scorer) == F.col("_a"), F.col(code))).over(Window.partitionBy(session, "epoch")))
    return rows.where((F.col(scorer) != F.col("_a")) & F.col("ref").isNotNull() & F.col(code).isNotNull()).select(session, F.col(scorer).alias("observer"), "epoch", "ref", F.col(code).alias("obs"))


def confusion(pairs: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """``(by, ref, obs, n)``; cells without epochs are left out. weight: n is its sum instead of the number of epochs."""
    n = F.count(F.lit(1)) if weight is None else F.sum(F.col(weight).cast("double"))
    return pairs.groupBy(*by, "ref", "obs").agg(n.alias("n"))


def full_confusion(pairs: DataFrame, by: Sequence[str], labels: Sequence[int]) -> DataFrame:
    """The same with every cell of ``labels``, empty ones 0."""
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("ref"), F.lit(b).alias("obs")) for a in labels for b in labels]))
    grid = pairs.select(*by).distinct() if by else None
    grid = grid.select(*by, cells.alias("x")).select(*by, "x.ref", "x.obs") if by else pairs.sparkSession.range(1).select(cells.alias("x")).select("x.ref", "x.obs")
    return grid.join(confusion(pairs, by), [*by, "ref", "obs"], "left").fillna(0, ["n"])


def _margins(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per class: ``(by, k, hit, r, c, total)`` with r epochs of the reference and c of the observer."""
    n, zero = F.col("n"), F.col("n") * 0
    row = F.struct(F.col("ref").alias("k"), n.alias("r"), zero.alias("c"), F.when(F.col("ref") == F.col("obs"), n).otherwise(zero).alias("hit"))
    column = F.struct(F.col("obs").alias("k"), zero.alias("r"), n.alias("c"), zero.alias("hit"))
    each = counts.select(*by, F.explode(F.array(row, column)).alias("m"))
    per = each.groupBy(*by, F.col("m.k").alias("k")).agg(F.sum("m.hit").alias("hit"), F.sum("m.r").alias("r"), F.sum("m.c").alias("c"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return per.withColumn("total", F.sum("r").over(whole))


def agreement(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, accuracy, balanced_acc, kappa, mcc, precision, recall, f1)`` from confusion counts; the last three weighted by reference support."""
    m = _margins(counts, by)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    m = m.withColumns({"_p": zero(F.try_divide("hit", "c")), "_r": zero(F.try_divide("hit", "r"))})
    m = m.withColumn("_f", zero(F.try_divide(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r"))))
    d = lambda c: F.col(c).cast("double")
    agg = m.groupBy(*by).agg(
        F.max("total").cast("double").alias("n"), F.sum(d("hit")).alias("h"), F.sum(d("r") * d("c")).alias("rc"), F.sum(d("r") * d("r")).alias("rr"), F.sum(d("c") * d("c")).alias("cc"),
        F.avg(F.when(F.col("r") > 0, F.col("_r"))).alias("balanced_acc"),
        *[F.sum(d("r") * F.col(s)).alias(t) for s, t in (("_p", "wp"), ("_r", "wr"), ("_f", "wf"))],
    )
    c = F.col
    pe = c("rc") / (c("n") * c("n"))
    root = F.sqrt((c("n") * c("n") - c("cc")) * (c("n") * c("n") - c("rr")))
    return agg.select(
        *by, (c("h") / c("n")).alias("accuracy"), "balanced_acc", F.try_divide(c("h") / c("n") - pe, 1 - pe).alias("kappa"),
        F.coalesce(F.try_divide(c("n") * c("h") - c("rc"), root), F.lit(0.0)).alias("mcc"),
        (c("wp") / c("n")).alias("precision"), (c("wr") / c("n")).alias("recall"), (c("wf") / c("n")).alias("f1"),
    )


def agreement_with_total(pairs: DataFrame, by: str) -> DataFrame:
    """Agreement of each ``by`` and of all epochs together (null ``by``), in one pass of grouping sets."""
    counts = pairs.groupBy(F.col(by), "ref", "obs").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("ref", "obs").agg(F.sum("n").alias("n")).select(F.lit(None).cast(dict(pairs.dtypes)[by]).alias(by), "ref", "obs", "n")
    return agreement(counts.unionByName(total), [by])


def agreement_by_stage(counts: DataFrame, by: Sequence[str] = (), beta: float = 1.0) -> DataFrame:
    """``(by, stage, fbeta, npv, precision, recall, specificity, support)`` one against the rest; 0 for 0/0."""
    m = _margins(counts, by)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    tp, fn, fp = F.col("hit"), F.col("r") - F.col("hit"), F.col("c") - F.col("hit")
    tn = F.col("total") - tp - fn - fp
    m = m.withColumns({"precision": zero(F.try_divide(tp, tp + fp)), "recall": zero(F.try_divide(tp, tp + fn)), "specificity": zero(F.try_divide(tn, tn + fp)), "npv": zero(F.try_divide(tn, tn + fn))})
    b = beta * beta
    f = zero(F.try_divide((1 + b) * F.col("precision") * F.col("recall"), b * F.col("precision") + F.col("recall")))
    return m.select(*by, F.col("k").alias("stage"), f.alias("fbeta"), "npv", "precision", "recall", "specificity", F.col("r").alias("support"))


def custom_scores(pairs: DataFrame, by: Sequence[str], scorers: dict) -> DataFrame:
    """``(by, name of each scorer)``: user functions ``f(true, predicted)`` on a group's arrays, one group a task."""
    types = dict(pairs.dtypes)
    schema = ", ".join([*(f"{b} {types[b]}" for b in by), *(f"{n} double" for n in scorers)])

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        true, given = pdf["ref"].to_numpy(), pdf["obs"].to_numpy()
        return pd.DataFrame([{**{b: pdf[b].iloc[0] for b in by}, **{n: float(f(true, given)) for n, f in scorers.items()}}])

    return pairs.groupBy(*by).applyInPandas(score, schema)


def summarise(scores: DataFrame, metrics: Sequence[str] = METRICS, by: Sequence[str] = ()) -> DataFrame:
    """``(by, metric, mean, std, mad, min, median, max)`` across sessions; mad is the mean absolute deviation."""
    long = scores.unpivot([*by], list(metrics), "metric", "value") if by else scores.unpivot([F.lit(0).alias("_z")], list(metrics), "metric", "value").drop("_z")
    keys = [*by, "metric"]
    centred = long.withColumn("_m", F.avg("value").over(Window.partitionBy(*keys)))
    return centred.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.avg(F.abs(F.col("value") - F.col("_m"))).alias("mad"), F.min("value").alias("min"), F.median("value").alias("median"), F.max("value").alias("max"))


# --- sleep statistics of two scorings -------------------------------------------------------


def differences(ref: DataFrame, obs: DataFrame, session: str, stats: Sequence[str]) -> DataFrame:
    """``(sleep_stat, session, ref, obs, difference)`` in long form, statistics on which no session differs left out."""
    long = lambda df, name: df.unpivot([session], list(stats), "sleep_stat", name)
    met = long(ref, "ref").join(long(obs, "obs"), [session, "sleep_stat"]).where("ref is not null and obs is not null")
    met = met.withColumn("difference", F.col("obs") - F.col("ref"))
    differs = met.groupBy("sleep_stat").agg(F.max(F.abs("difference")).alias("_d")).where("_d > 0").select("sleep_stat")
    return met.join(differs, "sleep_stat", "left_semi").select("sleep_stat", session, "ref", "obs", "difference")


def bias_and_limits(diff: DataFrame, agreement_factor: float = 1.96) -> DataFrame:
    """``(sleep_stat, n, bias, sd, lower, upper)``: mean difference and limits of agreement."""
    g = diff.groupBy("sleep_stat").agg(F.count(F.lit(1)).alias("n"), F.avg("difference").alias("bias"), F.stddev_samp("difference").alias("sd"))
    return g.withColumns({"lower": F.col("bias") - agreement_factor * F.col("sd"), "upper": F.col("bias") + agreement_factor * F.col("sd")})


def parametric_intervals(limits: DataFrame, sessions: int, confidence: float = 0.95) -> DataFrame:
    """``limits`` plus confidence intervals of bias and limits (Student t of ``sessions`` - 1)."""
    t = dist.t_quantile(0.5 + confidence / 2, sessions - 1)
    sem = F.col("sd") / F.sqrt("n")
    out = {}
    for name, factor in (("bias", 1.0), ("lower", math.sqrt(3)), ("upper", math.sqrt(3))):
        out[f"{name}_low"], out[f"{name}_high"] = F.col(name) - t * factor * sem, F.col(name) + t * factor * sem
    return limits.withColumns(out)


def _regression(df: DataFrame, y: str, x: str, prefix: str) -> DataFrame:
    g = df.groupBy("sleep_stat").agg(
        F.regr_slope(y, x).alias("b1"), F.regr_intercept(y, x).alias("b0"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.avg(x).alias("mx"), F.count(F.lit(1)).alias("n")
    )
    r = F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy")))
    g = g.withColumn("r", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    stderr = F.when(F.col("n") > 2, F.sqrt(F.try_divide((1 - F.col("r") * F.col("r")) * F.col("syy"), F.col("sxx") * (F.col("n") - 2))))
    g = g.withColumn("se1", stderr).withColumn("se0", F.col("se1") * F.sqrt(F.col("sxx") / F.col("n") + F.col("mx") * F.col("mx")))
    names = {"b0": "intercept", "b1": "slope", "r": "r", "se1": "stderr", "se0": "intercept_stderr"}
    return g.select("sleep_stat", F.col("n").alias(f"{prefix}_n"), *[F.col(k).alias(f"{prefix}_{v}") for k, v in names.items()])


def regressions(diff: DataFrame) -> DataFrame:
    """Bias on reference, and absolute residual of that on reference, per statistic."""
    bias = _regression(diff, "difference", "ref", "bias")
    resid = residuals(diff, bias)
    return bias.join(_regression(resid, "residual_abs", "ref", "loa"), "sleep_stat")


def residuals(diff: DataFrame, bias: DataFrame) -> DataFrame:
    """``diff`` plus residual and residual_abs of the bias regression."""
    rows = diff.join(bias.select("sleep_stat", "bias_slope", "bias_intercept"), "sleep_stat")
    rows = rows.withColumn("residual", F.col("difference") - (F.col("bias_intercept") + F.col("bias_slope") * F.col("ref")))
    return rows.withColumn("residual_abs", F.abs("residual")).drop("bias_slope", "bias_intercept")


def regression_intervals(fit: DataFrame, prefix: str, sessions: int, confidence: float = 0.95) -> DataFrame:
    """``fit`` plus intervals of slope and intercept (Student t of ``sessions`` - 2)."""
    t = dist.t_quantile(0.5 + confidence / 2, sessions - 2)
    out = {}
    for name, se in (("slope", "stderr"), ("intercept", "intercept_stderr")):
        out[f"{prefix}_{name}_low"] = F.col(f"{prefix}_{name}") - t * F.col(f"{prefix}_{se}")
        out[f"{prefix}_{name}_high"] = F.col(f"{prefix}_{name}") + t * F.col(f"{prefix}_{se}")
    return fit.withColumns(out)


def log_limits(diff: DataFrame, agreement_factor: float = 1.96, confidence: float = 0.95, eps: float = 1e-4) -> DataFrame:
    """``(sleep_stat, log_sd, loa_slope, loa_slope_low, loa_slope_high)``: limits proportional to the size, from log ratios.

    Statistics with a negative value in either scoring have null limits.
    """
    ratio = F.log(F.col("obs") + eps) - F.log(F.col("ref") + eps)
    rows = diff.withColumn("_neg", (F.col("obs") < 0) | (F.col("ref") < 0)).withColumn("_ratio", F.when(~F.col("_neg"), ratio))
    g = rows.groupBy("sleep_stat").agg(F.max("_neg").alias("_neg"), F.stddev_samp("_ratio").alias("s"), F.count(F.lit(1)).alias("n"))
    slope = lambda s: 2 * (F.exp(agreement_factor * s) - 1) / (F.exp(agreement_factor * s) + 1)
    t = dist.t_quantile_column(0.5 + confidence / 2, F.col("n") - 1)
    half = t * F.sqrt(3 * F.col("s") * F.col("s") / F.col("n"))
    s = F.when(~F.col("_neg"), F.col("s"))
    return g.select("sleep_stat", s.alias("log_sd"), slope(s).alias("loa_slope"), slope(F.greatest(s - half, F.lit(0.0))).alias("loa_slope_low"), slope(s + half).alias("loa_slope_high"))


def ranked(diff: DataFrame) -> DataFrame:
    """``(sleep_stat, difference, rank)``: the 1-based place of each difference in its statistic's order.

    Rows are sorted over all tasks; a row's rank is its place in its task plus
    what the tasks before hold, so no task holds a statistic.
    """
    laid = cut(diff.select("sleep_stat", F.col("difference").cast("double").alias("difference")).orderBy("sleep_stat", "difference").withColumn("_p", F.spark_partition_id()))
    before = Window.partitionBy("sleep_stat").orderBy("_p")
    held = laid.groupBy("sleep_stat", "_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_o", F.sum("_n").over(before) - F.col("_n"))
    place = F.row_number().over(Window.partitionBy("sleep_stat", "_p").orderBy("difference"))
    return laid.join(bounded(cut(held.drop("_n"))), ["sleep_stat", "_p"]).select("sleep_stat", "difference", (place + F.col("_o")).alias("rank"))


def assumptions(diff: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``(sleep_stat, unbiased, normal, constant_bias, homoscedastic)``, true where the test's p is ``alpha`` or more.

    Student t of the mean difference, Shapiro-Wilk of the differences (true
    below three sessions), and the two regressions' slopes. All are sums over
    the sessions, the normal scores by rank; Python sees a row a statistic.
    """
    of = diff.groupBy("sleep_stat").agg(F.count(F.lit(1)).alias("n"), F.avg("difference").alias("mean"), F.stddev_samp("difference").alias("sd"))
    score = dist.normal_quantile((F.col("rank") - 0.375) / (F.col("n") + 0.25))
    scored = ranked(diff).join(bounded(cut(of)), "sleep_stat").withColumn("m", score)
    at = lambda c, place: F.max(F.when(F.col("rank") == place, F.col(c)))
    places = {"x1": ("difference", F.lit(1)), "x2": ("difference", F.lit(2)), "y2": ("difference", F.col("n") - 1), "y1": ("difference", F.col("n")), "m2": ("m", F.col("n") - 1), "m1": ("m", F.col("n"))}
    sums = scored.groupBy("sleep_stat").agg(F.max("n").alias("n"), F.max("mean").alias("mean"), F.max("sd").alias("sd"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("m") * F.col("difference")).alias("mx"), *[at(c, place).alias(name) for name, (c, place) in places.items()])
    met = sums.join(regressions(diff).select("sleep_stat", "bias_slope", "bias_stderr", "loa_slope", "loa_stderr"), "sleep_stat")

    def slope_p(slope: float, stderr: float, n: int) -> float:
        if np.isnan(slope) or n < 3:
            return math.nan
        if np.isnan(stderr) or stderr == 0:
            return 0.0 if slope else 1.0
        return dist.p_two_sided(slope / stderr, n - 2)

    def test(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        names = ("unbiased", "normal", "constant_bias", "homoscedastic")
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                spread = 0.0 if np.isnan(r.sd) else r.sd
                bias = math.nan if r.n < 2 else float(r.mean == 0) if spread == 0 else dist.p_two_sided(r.mean / (spread / math.sqrt(r.n)), r.n - 1)
                normal = dist.shapiro_from_sums(r.n, r.mm, r.mx, (r.m1, r.m2), (r.x1, r.x2, r.y2, r.y1), spread**2 * (r.n - 1))[1] if r.n > 2 else 1.0
                p = (bias, normal, slope_p(r.bias_slope, r.bias_stderr, r.n), slope_p(r.loa_slope, r.loa_stderr, r.n))
                rows.append({"sleep_stat": r.sleep_stat, **{n: bool(not q < alpha) for n, q in zip(names, p)}})
            if rows:
                yield pd.DataFrame(rows)

    return met.mapInPandas(test, "sleep_stat string, unbiased boolean, normal boolean, constant_bias boolean, homoscedastic boolean")


def auto_methods(assumed: DataFrame, log_transform: bool = False) -> DataFrame:
    """``(sleep_stat, bias, loa, ci)``: which method the assumptions allow."""
    regr = F.lit("log") if log_transform else F.when(F.col("homoscedastic"), "param").otherwise("regr")
    return assumed.select("sleep_stat", F.when(F.col("constant_bias"), "param").otherwise("regr").alias("bias"), regr.alias("loa"), F.when(F.col("normal"), "param").otherwise("boot").alias("ci"))


_BOOT = ("bias", "lower", "upper", "bias_intercept", "bias_slope", "loa_intercept", "loa_slope")
_SUMS = ("n", "d", "dd", "x", "xx", "xd", "e", "xe")
# Cumulated Poisson probabilities of 0, 1, 2, ... at mean 1.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


def _from_sums(m: np.ndarray, d0: float, x0: float, factor: float) -> np.ndarray:
    """The statistics ``[7, ...]`` of :data:`_BOOT` from sums ``[..., 8]`` taken about ``d0`` and ``x0``."""
    n, d, dd, x, xx, xd, e, xe = np.moveaxis(np.asarray(m, float), -1, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean, sd = d0 + d / n, np.sqrt(np.maximum(dd - d * d / n, 0) / (n - 1))
        sxx = xx - x * x / n
        b1, l1 = (xd - x * d / n) / sxx, (xe - x * e / n) / sxx
        middle = x0 + x / n
        return np.stack([mean, mean - factor * sd, mean + factor * sd, mean - b1 * middle, b1, e / n - l1 * middle, l1])


def _weights(key: np.ndarray, first: int, last: int, seed: int) -> np.ndarray:
    """Poisson(1) counts ``[rows, last - first]`` that depend on row and resample alone."""
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64)[:, None] + (np.arange(first, last, dtype=np.uint64) + np.uint64(seed << 32) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    return np.searchsorted(_POISSON, (z >> np.uint64(11)) / 2.0**53, side="right").astype(float)


def bootstrap_intervals(diff: DataFrame, n_resamples: int = 1000, confidence: float = 0.95, agreement_factor: float = 1.96, seed: int = 42) -> DataFrame:
    """``(sleep_stat, statistic, value, low, high)``: bias-corrected accelerated intervals of bias, limits and both regressions.

    A session's count in a resample is a Poisson number of mean 1 that follows
    from a hash of its row, so resamples are sums over any number of tasks and
    no task holds the sessions of a statistic; the jackknife is a sum as well.
    Rows equal in every column are drawn together. Intervals are null where a
    statistic has none (too few sessions, or no spread).
    """
    fit = _regression(diff, "difference", "ref", "bias")
    means = diff.groupBy("sleep_stat").agg(F.avg("difference").alias("d0"), F.avg("ref").alias("x0"))
    rows = diff.withColumn("key", F.xxhash64(*diff.columns)).join(bounded(fit.join(means, "sleep_stat")), "sleep_stat")
    e = F.abs(F.col("difference") - F.coalesce("bias_intercept", "d0") - F.coalesce("bias_slope", F.lit(0.0)) * F.col("ref"))
    rows = cut(rows.select("sleep_stat", "key", "d0", "x0", (F.col("difference") - F.col("d0")).cast("double").alias("d"), (F.col("ref") - F.col("x0")).cast("double").alias("x"), e.cast("double").alias("e")))
    sums = ", ".join(f"{c} double" for c in _SUMS)

    def features(pdf: pd.DataFrame) -> np.ndarray:
        d, x, e = (pdf[c].to_numpy(float) for c in ("d", "x", "e"))
        return np.stack([np.ones(len(d)), d, d * d, x, x * x, x * d, e, x * e], 1)

    def resample(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for pdf in batches:
            for stat, part in pdf.groupby("sleep_stat"):
                own, key = features(part), part["key"].to_numpy(np.int64)
                total = found.setdefault(stat, np.zeros((n_resamples + 1, len(_SUMS))))
                total[-1] += own.sum(0)
                for at in range(0, n_resamples, 64):
                    to = min(at + 64, n_resamples)
                    total[at:to] += _weights(key, at, to, seed).T @ own
        for stat, total in found.items():
            yield pd.DataFrame(total, columns=_SUMS).assign(sleep_stat=stat, resample=np.arange(n_resamples + 1))[["sleep_stat", "resample", *_SUMS]]

    drawn = rows.select("sleep_stat", "key", "d", "x", "e").mapInPandas(resample, f"sleep_stat string, resample int, {sums}")
    drawn = cut(drawn.groupBy("sleep_stat", "resample").agg(*[F.sum(c).alias(c) for c in _SUMS]))
    centres = rows.groupBy("sleep_stat").agg(F.first("d0").alias("d0"), F.first("x0").alias("x0"))
    whole = drawn.where(F.col("resample") == n_resamples).drop("resample").join(centres, "sleep_stat")
    known = {r.sleep_stat: (np.array([r[c] for c in _SUMS]), r.d0, r.x0) for r in whole.collect()}  # a row a statistic

    def jackknife(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            for stat, part in pdf.groupby("sleep_stat"):
                total, d0, x0 = known[stat]
                off = _from_sums(total - features(part), d0, x0, agreement_factor) - _from_sums(total, d0, x0, agreement_factor)[:, None]
                ok = np.isfinite(off)
                off = np.where(ok, off, 0.0)
                yield pd.DataFrame({"sleep_stat": stat, "statistic": _BOOT, "m": ok.sum(1).astype(float), "s1": off.sum(1), "s2": (off**2).sum(1), "s3": (off**3).sum(1)})

    left = rows.select("sleep_stat", "d", "x", "e").mapInPandas(jackknife, "sleep_stat string, statistic string, m double, s1 double, s2 double, s3 double")
    left = left.groupBy("sleep_stat", "statistic").agg(*[F.sum(c).alias(c) for c in ("m", "s1", "s2", "s3")])
    moments = {(r.sleep_stat, r.statistic): r[2:] for r in left.collect()}  # seven rows a statistic

    def intervals(pdf: pd.DataFrame) -> pd.DataFrame:
        stat = pdf["sleep_stat"].iloc[0]
        total, d0, x0 = known[stat]
        value = _from_sums(total, d0, x0, agreement_factor)
        boot = _from_sums(pdf.loc[pdf["resample"] < n_resamples, list(_SUMS)].to_numpy(float), d0, x0, agreement_factor)
        ends = [dist.bca_ends(v, b, *moments[stat, name], confidence) for v, b, name in zip(value, boot, _BOOT)]
        return pd.DataFrame({"sleep_stat": stat, "statistic": _BOOT, "value": value, "low": [a for a, _ in ends], "high": [b for _, b in ends]})

    found = drawn.groupBy("sleep_stat").applyInPandas(intervals, "sleep_stat string, statistic string, value double, low double, high double")
    nan = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c)
    return found.select("sleep_stat", "statistic", nan("value"), nan("low"), nan("high"))


def calibrated(value: Column, method: str, bias: Column, intercept: Column, slope: Column, unbiased: Column | None = None) -> Column:
    """An observed value brought to the reference's scale: less the bias (param) or through the inverted line (regr).

    unbiased: where true the value is left as it is.
    """
    new = value - bias if method == "param" else F.try_divide(value - intercept, 1 + slope)
    return new if unbiased is None else F.when(unbiased, value).otherwise(new)


def calibrate(observed: DataFrame, session: str, stats: Iterable[str], limits: DataFrame, fit: DataFrame, method: str = "param", assumed: DataFrame | None = None) -> DataFrame:
    """``(session, sleep_stat, value, calibrated)`` of new observations; statistics without a fit stay as they are."""
    long = observed.unpivot([session], list(stats), "sleep_stat", "value")
    rows = long.join(limits.select("sleep_stat", "bias"), "sleep_stat", "left").join(fit.select("sleep_stat", "bias_intercept", "bias_slope"), "sleep_stat", "left")
    flag = None
    if assumed is not None:
        rows = rows.join(assumed.select("sleep_stat", "unbiased"), "sleep_stat", "left")
        flag = F.coalesce("unbiased", F.lit(False))
    new = calibrated(F.col("value"), method, F.col("bias"), F.col("bias_intercept"), F.col("bias_slope"), flag)
    return rows.select(session, "sleep_stat", "value", F.coalesce(new, F.col("value")).alias("calibrated"))


def report(limits: DataFrame, fit: DataFrame, methods: DataFrame, agreement_factor: float = 1.96) -> DataFrame:
    """``(sleep_stat, bias_text, loa_text)``: each statistic by its method, regression limits scaled to a normal spread."""
    rows = limits.join(fit, "sleep_stat").join(methods.select("sleep_stat", F.col("bias").alias("_b"), F.col("loa").alias("_l")), "sleep_stat")
    scale = agreement_factor * math.sqrt(math.pi / 2)
    num = lambda c: F.format_string("%.2f", c)
    line = lambda a, b: F.concat(num(a), F.lit(" + "), num(b), F.lit("x"))
    bias = F.when(F.col("_b") == "param", num(F.col("bias"))).otherwise(line(F.col("bias_intercept"), F.col("bias_slope")))
    loa = F.when(F.col("_l") == "param", F.concat(num(F.col("lower")), F.lit(", "), num(F.col("upper")))).otherwise(F.concat(F.lit("Bias +- "), line(F.col("loa_intercept") * scale, F.col("loa_slope") * scale)))
    return rows.select("sleep_stat", bias.alias("bias_text"), loa.alias("loa_text"))
