"""Agreement of scorers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom.functions import dist
from nightloom.operators import agreement as A

POOLED = [[871, 483, 29, 71], [303, 4381, 398, 521], [34, 1142, 925, 16], [57, 564, 49, 922]]


def counts(spark, m=POOLED):
    return spark.createDataFrame([(i, j, n) for i, row in enumerate(m) for j, n in enumerate(row)], "ref int, obs int, n bigint")


def test_published_counts(spark):
    by = {r.stage: r for r in A.agreement_by_stage(counts(spark)).collect()}
    assert [round(100 * by[k].recall, 2) for k in range(4)] == [59.90, 78.19, 43.69, 57.91]
    assert [round(100 * by[k].specificity, 2) for k in range(4)] == [95.77, 57.60, 94.50, 93.37]
    r = A.agreement(counts(spark)).first()
    got = [round(r[m], 6) for m in ("accuracy", "kappa", "mcc", "balanced_acc", "precision", "f1")]
    assert got == [0.659391, 0.450568, 0.456104, 0.599256, 0.658965, 0.651876]


def test_paired_ends(spark):
    rows = [("s", "a", 0, 1), ("s", "b", 0, 2), ("s", "c", 0, 3), ("s", "c", 1, 3), ("t", "a", 0, 1), ("s", "a", 2, None), ("s", "c", 2, 4)]
    h = spark.createDataFrame(rows, "s string, who string, epoch int, code int")
    assert [tuple(r) for r in A.paired_ends(h, "s", "who").collect()] == [("s", 0, 1, 3)]
    ref, obs = (h.where(F.col("who") == w) for w in "ac")
    assert A.paired(ref, obs, ["s", "epoch"]).collect() == A.paired_ends(h, "s", "who").collect()
    assert A.paired_ends(h.limit(0), "s", "who").count() == 0


def test_weights(spark):
    p = spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0), (1, 1, 1.0)], "ref int, obs int, w double")
    assert A.agreement(A.confusion(p, weight="w")).first().accuracy == 0.75


def test_one_class(spark):
    r = A.agreement(counts(spark, [[5]])).first()
    assert (r.accuracy, r.kappa, r.mcc) == (1.0, None, 0.0)


def test_confusion_and_total(spark):
    p = spark.createDataFrame([("a", 0, 0), ("a", 0, 2), ("b", 2, 2)], "s string, ref int, obs int")
    assert A.full_confusion(p, ["s"], [0, 2, 3]).count() == 18
    total = {r.s: r.accuracy for r in A.agreement_with_total(p, "s").collect()}
    assert total == {"a": 0.5, "b": 1.0, None: pytest.approx(2 / 3)}
    assert A.custom_scores(p, ["s"], {"n": lambda a, b: len(a)}).count() == 2


def paired(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    ref = rng.normal(100, 20, n)
    obs = 5 + 1.2 * ref + rng.normal(0, 3, n)
    make = lambda v: spark.createDataFrame([(f"s{i}", float(x), 1.0) for i, x in enumerate(v)], "session string, TST double, same double")
    return ref, obs, make(ref), make(obs)


def test_bland_altman(spark):
    ref, obs, r, o = paired(spark)
    diff = A.differences(r, o, "session", ["TST", "same"])
    assert {x.sleep_stat for x in diff.select("sleep_stat").distinct().collect()} == {"TST"}
    lim = A.bias_and_limits(diff).first()
    d = obs - ref
    assert lim.bias == pytest.approx(d.mean()) and lim.upper == pytest.approx(d.mean() + 1.96 * d.std(ddof=1))
    fit = A.regressions(diff).first()
    line = dist.linear_fit(ref, d)
    assert (fit.bias_slope, fit.bias_intercept, fit.bias_stderr) == pytest.approx((line.slope, line.intercept, line.stderr))
    ci = A.parametric_intervals(A.bias_and_limits(diff), 60).first()
    t = dist.t_quantile(0.975, 59)
    assert ci.bias_low == pytest.approx(d.mean() - t * d.std(ddof=1) / 60**0.5)


def test_calibration_inverts(spark):
    ref, obs, r, o = paired(spark)
    diff = A.differences(r, o, "session", ["TST"])
    cal = A.calibrate(o, "session", ["TST"], A.bias_and_limits(diff), A.regressions(diff), "regr").toPandas()
    order = cal.session.str[1:].astype(int).to_numpy()
    assert abs(cal.calibrated.to_numpy() - ref[order]).mean() < 3


def test_assumptions_and_bootstrap(spark):
    _, _, r, o = paired(spark)
    diff = A.differences(r, o, "session", ["TST"])
    a = A.assumptions(diff).first()
    assert (a.unbiased, a.constant_bias, a.normal) == (False, False, True)
    m = A.auto_methods(A.assumptions(diff)).first()
    assert (m.bias, m.ci) == ("regr", "param")
    boot = {x.statistic: x for x in A.bootstrap_intervals(diff, 500).collect()}
    assert boot["bias"].low < boot["bias"].value < boot["bias"].high
    assert A.report(A.bias_and_limits(diff), A.regressions(diff), A.auto_methods(A.assumptions(diff))).first().bias_text.endswith("x")
    assert A.log_limits(diff).first().loa_slope > 0


def test_distributions():
    assert dist.t_quantile(0.975, 9) == pytest.approx(2.262157, abs=1e-6)
    assert dist.p_two_sided(2.262157, 9) == pytest.approx(0.05, abs=1e-6)
    w, p = dist.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]))
    assert w == pytest.approx(0.79, abs=0.002) and p == pytest.approx(0.0067, abs=0.0005)
    assert dist.erfinv(0.95) == pytest.approx(1.3859038, abs=1e-6)
    assert dist.shapiro_wilk(np.ones(5)) == (1.0, 1.0)
    assert np.isnan(dist.t_test(np.array([1.0])))


def test_summary(spark):
    scores = spark.createDataFrame([(0.5,), (0.7,), (0.9,)], "accuracy double")
    r = A.summarise(scores, ["accuracy"]).first()
    assert (round(r["mean"], 6), round(r["mad"], 6), round(r["std"], 6), r["median"]) == (0.7, 0.133333, 0.2, 0.7)
    assert A.summarise(scores.limit(0), ["accuracy"]).count() == 0
    assert A.differences(*(spark.createDataFrame([], "s string, TST double"),) * 2, "s", ["TST"]).agg(F.count("*")).first()[0] == 0
