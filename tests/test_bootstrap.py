"""Bootstrap by sums: against resampling with indices, and whatever the number of tasks."""

import numpy as np
import pytest

from nightloom.functions import dist
from nightloom.operators import agreement as A


def frame(spark, n=60, parts=3):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        for stat, spread in (("SE", 2.0), ("TST", 20.0)):
            x = float(100 + 10 * rng.normal())
            rows.append((stat, f"s{i}", x, x + 1.5 + 0.1 * (x - 100) + spread * float(rng.normal())))
    df = spark.createDataFrame(rows, "sleep_stat string, session_id string, ref double, obs double")
    return df.selectExpr("*", "obs - ref as difference").repartition(parts)


def test_intervals_as_with_indices(spark):
    got = {(r.sleep_stat, r.statistic): r for r in A.bootstrap_intervals(frame(spark), 2000).collect()}
    pdf = frame(spark).toPandas()
    for stat, part in pdf.groupby("sleep_stat"):
        d, x = part["difference"].to_numpy(), part["ref"].to_numpy()
        fit = dist.linear_fit(x, d)
        e = np.abs(d - fit.intercept - fit.slope * x)
        line = dist.linear_fit(x, e)
        want = dict(zip(A._BOOT, (d.mean(), d.mean() - 1.96 * d.std(ddof=1), d.mean() + 1.96 * d.std(ddof=1), fit.intercept, fit.slope, line.intercept, line.slope)))
        pick = np.random.default_rng(1).integers(0, len(d), (4000, len(d)))
        for name, value in want.items():
            r = got[stat, name]
            assert r.value == pytest.approx(value, rel=1e-9)
            assert r.low < r.value < r.high
        spread = d[pick].mean(1)
        low, high = np.quantile(spread, [0.025, 0.975])
        assert got[stat, "bias"].high - got[stat, "bias"].low == pytest.approx(high - low, rel=0.15)
        slopes = np.array([np.polyfit(x[p], d[p], 1)[0] for p in pick[:1000]])
        low, high = np.quantile(slopes, [0.025, 0.975])
        assert got[stat, "bias_slope"].high - got[stat, "bias_slope"].low == pytest.approx(high - low, rel=0.25)


def test_same_for_any_layout(spark):
    one, two = (A.bootstrap_intervals(frame(spark, parts=p), 200).orderBy("sleep_stat", "statistic").toPandas() for p in (1, 7))
    for c in ("value", "low", "high"):
        assert one[c].to_numpy() == pytest.approx(two[c].to_numpy(), rel=1e-9)


def test_acceleration_from_power_sums():
    rng = np.random.default_rng(2)
    x, boot = rng.gamma(2.0, size=50), rng.normal(size=500)
    jack = (x.sum() - x) / 49
    d = jack.mean() - jack
    acc = (d**3).sum() / (6 * (d**2).sum() ** 1.5)
    off = jack - 0.3
    z = [dist._NORMAL.inv_cdf(q) for q in (0.025, 0.975)]
    below = (boot < 0.1).mean()
    z0 = dist._NORMAL.inv_cdf(below)
    want = [np.quantile(boot, dist._NORMAL.cdf(z0 + (z0 + k) / (1 - acc * (z0 + k)))) for k in z]
    assert dist.bca_ends(0.1, boot, 50, off.sum(), (off**2).sum(), (off**3).sum(), 0.95) == pytest.approx(want)


def test_few_sessions(spark):
    df = spark.createDataFrame([("SE", "a", 1.0, 2.0, 1.0)], "sleep_stat string, session_id string, ref double, obs double, difference double")
    got = {r.statistic: r for r in A.bootstrap_intervals(df, 20).collect()}
    assert got["bias"].value == 1.0 and got["upper"].low is None and got["bias_slope"].value is None
    assert A.bootstrap_intervals(df.limit(0), 20).count() == 0
