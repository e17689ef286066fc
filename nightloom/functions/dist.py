"""Distributions and tests in plain NumPy: Student t, normal, Shapiro-Wilk, bootstrap intervals."""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NORMAL = NormalDist()


def beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_fraction(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    """Student t quantile by bisection; nan without degrees of freedom."""
    if df < 1:
        return math.nan
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 2.0
    while t_cdf(high, df) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def t_quantile_column(p: float, df: Column) -> Column:
    """The same of a column of degrees of freedom."""

    def work(v: pd.Series) -> pd.Series:
        return v.map(lambda x: t_quantile(p, float(x)))

    return F.pandas_udf(work, "double")(df.cast("double"))


def p_two_sided(t: float, df: float) -> float:
    return math.nan if df < 1 or math.isnan(t) else beta_fraction(df / 2, 0.5, df / (df + t * t))


def t_test(x: np.ndarray) -> float:
    """p of the hypothesis that the mean is zero; nan below two values, 0 or 1 without spread."""
    n = len(x)
    if n < 2:
        return math.nan
    sd = x.std(ddof=1)
    if sd == 0:
        return 1.0 if x.mean() == 0 else 0.0
    return p_two_sided(x.mean() / (sd / math.sqrt(n)), n - 1)


@dataclass(frozen=True)
class Line:
    slope: float
    intercept: float
    r: float
    p: float
    stderr: float


def linear_fit(x: np.ndarray, y: np.ndarray) -> Line:
    """Least squares with the p-value of its slope; nan without spread in x."""
    n, xc, yc = len(x), x - x.mean(), y - y.mean()
    sxx, syy, sxy = (xc**2).sum(), (yc**2).sum(), (xc * yc).sum()
    if n < 2 or sxx == 0:
        return Line(math.nan, math.nan, math.nan, math.nan, math.nan)
    slope = sxy / sxx
    r = float(np.clip(sxy / math.sqrt(sxx * syy), -1, 1)) if syy > 0 else 0.0
    se = math.sqrt((1 - r * r) * syy / sxx / (n - 2)) if n > 2 else math.nan
    t = slope / se if se > 0 else (math.inf if slope else math.nan)
    p = p_two_sided(t, n - 2) if math.isfinite(t) else (0.0 if t == math.inf else 1.0)
    return Line(slope, y.mean() - slope * x.mean(), r, p, se)


# Wichura's rational approximations (AS 241, 1988) of the normal quantile, highest power first: near the middle, in the tail, far out.
_QUANTILE = (
    ((2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.3871328727963666080),
     (5226.4952788528545610, 28729.085735721942674, 39307.895800092710610, 21213.794301586595867, 5394.1960214247511077, 687.18700749205790830, 42.313330701600911252, 1.0)),
    ((7.7454501427834140764e-4, 0.0227238449892691845833, 0.241780725177450611770, 1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734),
     (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.148103976427480074590, 0.689767334985100004550, 1.67638483018380384940, 2.05319162663775882187, 1.0)),
    ((2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
     (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0)),
)


def normal_quantile(p, sqrt=F.sqrt, log=F.log, least=F.least, either=lambda c, a, b: F.when(c, a).otherwise(b)):
    """The normal quantile of a column, as an expression; the functions can be those of another language."""

    def poly(coefficients, x):
        total = coefficients[0]
        for c in coefficients[1:]:
            total = x * total + c
        return total

    q = p - 0.5
    middle = q * q * -1.0 + 0.180625
    tail = sqrt(log(least(p, p * -1.0 + 1.0)) * -1.0)
    near, out, far = ((top, bottom, x) for (top, bottom), x in zip(_QUANTILE, (middle, tail - 1.6, tail - 5.0)))
    ratio = lambda part: poly(part[0], part[2]) / poly(part[1], part[2])
    outer = either(tail <= 5.0, ratio(out), ratio(far))
    return either(middle >= 0.0, q * ratio(near), either(q < 0.0, outer * -1.0, outer))


def shapiro_from_sums(n: int, mm: float, mx: float, top: tuple[float, float], ends: tuple[float, float, float, float], ss: float) -> tuple[float, float]:
    """Royston's approximation (1995) of W and its p; W 1 and p 1 below three values or without spread.

    mm, mx: sums of squared normal scores, and of scores times values in order;
    top: the two greatest scores, greatest first; ends: the least value, the
    next, the last but one and the greatest; ss: sum of squares about the mean.
    """
    least, second_least, second_greatest, greatest = ends
    if n < 3 or greatest == least or ss <= 0:
        return 1.0, 1.0
    u, c1, c2 = 1 / math.sqrt(n), top[0] / math.sqrt(mm), top[1] / math.sqrt(mm)
    if n == 3:
        total = math.sqrt(0.5) * (greatest - least)
    else:
        # Royston's polynomials for the outermost weights.
        last = float(np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, c1], u))
        total, inner, outer, rest = last * (greatest - least), mm - 2 * top[0] ** 2, 1 - 2 * last**2, mx - top[0] * (greatest - least)
        if n > 5:
            second = float(np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c2], u))
            total += second * (second_greatest - second_least)
            inner -= 2 * top[1] ** 2
            outer -= 2 * second**2
            rest -= top[1] * (second_greatest - second_least)
        total += rest / math.sqrt(inner / outer)
    w = min(1.0, total**2 / ss)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    # Royston's polynomials for the normalising transformation.
    if n <= 11:
        g = 0.459 * n - 2.273
        if w < 1 and math.log1p(-w) >= g:
            return w, 0.0
        mu, sigma = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
        y = -math.log(g - math.log(max(1 - w, 1e-300)))
    else:
        k = math.log(n)
        y = math.log(max(1 - w, 1e-300))
        mu, sigma = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], k), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], k))
    return w, 1 - _NORMAL.cdf((y - mu) / sigma)


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W and p of an array, see :func:`shapiro_from_sums`."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n < 3:
        return 1.0, 1.0
    m = np.array([_NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    return shapiro_from_sums(n, (m**2).sum(), (m * x).sum(), (m[-1], m[-2]), (x[0], x[1], x[-2], x[-1]), ((x - x.mean()) ** 2).sum())


def bca_ends(value: float, resampled: np.ndarray, n: float, s1: float, s2: float, s3: float, confidence: float) -> tuple[float, float]:
    """Ends of the bias-corrected accelerated interval; ``s1``, ``s2``, ``s3`` are power sums of the ``n`` leave-one-out values about any point."""
    boot = np.sort(resampled[np.isfinite(resampled)])
    if not len(boot) or not math.isfinite(value) or not n:
        return math.nan, math.nan
    below = ((boot < value).mean() + (boot <= value).mean()) / 2
    z0 = _NORMAL.inv_cdf(min(max(below, 0.5 / len(boot)), 1 - 0.5 / len(boot)))
    mean = s1 / n
    squares = max(s2 - n * mean * mean, 0.0)
    cubes = s3 - 3 * mean * s2 + 2 * n * mean**3
    acc = -cubes / (6 * squares**1.5) if squares > 0 else 0.0
    ends = []
    for q in (0.5 - confidence / 2, 0.5 + confidence / 2):
        z = z0 + _NORMAL.inv_cdf(q)
        ends.append(float(np.quantile(boot, _NORMAL.cdf(z0 + z / (1 - acc * z)))))
    return ends[0], ends[1]


def erfinv(y: float) -> float:
    """Inverse error function."""
    return _NORMAL.inv_cdf((y + 1) / 2) / math.sqrt(2)
