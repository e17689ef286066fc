"""Assumptions from sums and ranks, against arrays; the normal quantile; any layout."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom.functions import dist
from nightloom.operators import agreement as A


def test_normal_quantile(spark):
    ps = [1e-300, 1e-30, 1e-12, 1e-5, 0.01, 0.074, 0.0751, 0.3, 0.5, 0.77, 0.926, 0.99, 1 - 1e-12]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", dist.normal_quantile(F.col("p")).alias("z")).collect()
    for r in got:
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-12, abs=1e-15)


def cases_of(n):
    rng = np.random.default_rng(n)
    cases = {"normal": rng.normal(size=n), "skewed": rng.gamma(0.6, size=n) - 0.5, "shift": rng.normal(size=n) + 3, "zero": np.zeros(n), "equal": np.full(n, 2.5), "ties": np.round(rng.normal(size=n))}
    x = rng.normal(size=n) * 10 + 50
    cases["slope"] = 0.5 * (x - 50) + rng.normal(size=n)
    return {f"{k}{n}": (x, d) for k, d in cases.items()}


def test_against_arrays(spark):
    cases = {}
    for n in (2, 3, 4, 5, 6, 11, 12, 80):
        cases |= cases_of(n)
    rows = [(k, f"s{i}", float(x[i]), float(d[i])) for k, (x, d) in cases.items() for i in range(len(d))]
    df = spark.createDataFrame(rows, "sleep_stat string, s string, ref double, difference double").repartition(5)
    got = {r.sleep_stat: r for r in A.assumptions(df).collect()}
    assert set(got) == set(cases)
    held = {}
    for r in A.ranked(df).collect():
        held.setdefault(r.sleep_stat, []).append((r["rank"], r.difference))
    for k, (x, d) in cases.items():
        fit = dist.linear_fit(x, d)
        # no test of a line through two points
        ps = {"unbiased": dist.t_test(d), "normal": dist.shapiro_wilk(d)[1], "constant_bias": math.nan if len(d) == 2 else fit.p}
        for name, p in ps.items():
            if math.isnan(p) or abs(p - 0.05) > 1e-6:
                assert got[k][name] == (not p < 0.05), (k, name, p)
        own = sorted(held[k])
        assert [r for r, _ in own] == list(range(1, len(d) + 1)) and [v for _, v in own] == sorted(d.tolist())
