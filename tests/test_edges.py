"""Empty tables, nulls and ties through the operators that the other tests use on plain data."""

import pytest
from pyspark.sql import functions as F

from nightloom.operators import agreement as A
from nightloom.operators import analysis, heart
from nightloom.operators import events as E
from nightloom.operators import windows as W


def series(spark, xs):
    return spark.createDataFrame([("k", i, None if x is None else float(x), len(xs)) for i, x in enumerate(xs)], "k string, sample bigint, x double, n bigint")


@pytest.mark.parametrize("method", W.MOVING)
def test_moving_edges(spark, method):
    run = lambda xs: [r.value for r in W.moving(series(spark, xs), ["k"], "sample", "x", "n", 1.0, 3.0, 1.0, method, "x").orderBy("window").collect()]
    assert run([]) == []
    one = run([2.0])
    assert len(one) == 1 and (one[0] is None) == (method in ("slope", "covar", "corr"))
    flat = run([1.0, 1.0, 1.0])
    assert flat[1] == {"mean": 1, "min": 1, "max": 1, "ptp": 0, "rms": 1, "prop_above_zero": 1, "slope": 0, "covar": 0, "corr": None}[method]
    assert run([None, None, None])[1] is None


def test_windows_empty(spark):
    s = series(spark, [])
    assert W.epochs(s, ["k"], "sample", "x", 2).count() == 0
    assert W.sliding(s, ["k"], "sample", 2, 1, "n").count() == 0
    assert W.robust_scale(s, ["k"], ["x"]).count() == 0
    assert W.interpolated(s.select("k", "x", F.col("sample").cast("double").alias("t")), s.select("k", "sample"), ["k"], "t", "x", "sample", 1.0).count() == 0
    assert W.sliding(series(spark, [1, 2, 3]), ["k"], "sample", 5, 1, "n").count() == 0


def test_gaps(spark):
    got = lambda xs: [r[0] for r in series(spark, xs).select(W.fill_gaps(series(spark, xs), ["k"], "sample", "x", 2)).collect()]
    assert got([None, 1, None, 3, None]) == [1, 1, 2, 3, 3]
    assert got([None, None]) == [None, None]
    assert got([0, None, None, None, None, None, 6]) == [0, 1, 2, None, 4, 5, 6]


def test_rolling(spark):
    s = series(spark, [4.0, None, 8.0])
    assert [r[0] for r in s.select(W.trailing("x", ["k"], "sample", 2)).collect()] == [4, 4, 8]
    assert [round(r[0], 6) for r in s.select(W.triangular("x", ["k"], "sample", 1)).collect()] == [4, 6, 8]
    assert [r[0] for r in s.select(W.boxcar("x", ["k"], "sample", 2)).collect()] == [2, 2, 4]
    assert [r.x for r in W.robust_scale(series(spark, [5, 5, 5]), ["k"], ["x"]).collect()] == [0, 0, 0]


def test_arrays_of_nothing(spark):
    df = spark.createDataFrame([([],), ([1.0],), ([3.0, 3.0, 3.0],), (None,)], "a array<double>")
    rows = df.where("size(a) > 1").select(*[c.alias(k) for k, c in W.describe(F.col("a")).items()]).collect()
    assert rows[0]["std"] == 0 and rows[0]["skew"] is None and rows[0]["hmob"] is None
    assert [r[0] for r in df.select(W.trimmed_sd(F.col("a"))).collect()] == [None, None, 0.0, None]


def test_periods(spark):
    beats = spark.createDataFrame([("r", float(t)) for t in (0.5, 59.9, 60.0, 119.9, 120.0)] + [("r", None), ("q", 1.0)], "r string, beat double")
    periods = spark.createDataFrame([("r", 1, 0.0, 60.0), ("r", 2, 60.0, 60.0), ("r", 3, None, 60.0), ("r", 4, 5.0, 0.0)], "r string, p int, start double, duration double")
    met = heart.beats_in_periods(beats, periods, ["r"], "beat", "start", "duration", 7.0)
    assert {r.p: r["count"] for r in met.groupBy("p").count().collect()} == {1: 2, 2: 2}
    numbered = heart.number_periods(periods.where("start is not null").withColumn("s", F.lit(2)), ["r"], "s", "start")
    assert sorted(r.epoch for r in numbered.collect()) == [0, 1, 2]


def test_agreement_edges(spark):
    none = spark.createDataFrame([], "s string, ref int, obs int")
    assert A.agreement(A.confusion(none, ["s"]), ["s"]).count() == 0 and A.full_confusion(none, ["s"], [0, 1]).count() == 0
    never = spark.createDataFrame([("a", 0, 1), ("a", 1, 0)], "s string, ref int, obs int")
    r = A.agreement(A.confusion(never, ["s"]), ["s"]).first()
    assert (r.accuracy, r.kappa, r.mcc, r.f1) == (0, -1, -1, 0)
    assert A.paired(never.select("s", F.col("ref").alias("code")), never.limit(0).select("s", F.col("ref").alias("code")), ["s"]).count() == 0
    two = spark.createDataFrame([("TST", "a", 1.0, 2.0, 1.0), ("TST", "b", 1.0, 3.0, 2.0)], "sleep_stat string, s string, ref double, obs double, difference double")
    fit = A.regressions(two).collect()
    assert len(fit) == 1 and fit[0].bias_stderr is None
    assert A.log_limits(two.withColumn("obs", -F.col("obs"))).first().loa_slope is None
    assert A.bias_and_limits(two.limit(1)).first().sd is None


def test_events_edges(spark):
    e = spark.createDataFrame([], "r string, c string, Start double, End double, id int")
    assert E.summary(e, ["r"], ["Start"]).count() == 0 and E.on_several(e, ["r"], "Start", F.col("End")).count() == 0
    assert E.merge_close(e.select("r", F.col("id").alias("s")), ["r"], "s", 3).count() == 0
    assert E.coincidence(E.spans_of(e, ["r", "c"], F.col("Start"), F.col("End"), 10.0), ["r"], "c").count() == 0
    minutes = spark.createDataFrame([("r", 0.0)], "r string, minutes double")
    assert E.density(spark.createDataFrame([("r", 3)], "r string, Count int"), minutes, ["r"]).first().Density is None


def test_stage_of_events(spark):
    hyp = spark.createDataFrame([("r", 0, 2), ("r", 1, 3)], "r string, epoch int, code int")
    e = spark.createDataFrame([("r", 0.0), ("r", 29.99), ("r", 30.0), ("r", 60.0), ("r", None), ("q", 1.0)], "r string, t double")
    assert [r.code for r in E.at_stage(e, hyp, ["r"], F.col("t"), 30.0).orderBy("r", F.col("t").asc_nulls_last()).collect()] == [-2, 2, 2, 3, -2, -2]


def test_rank_ties(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (3, 1, 3, 2)] + [("a", None)], "g string, x double")
    assert sorted(r[0] for r in df.select(analysis.average_rank("x", ["g"])).collect() if r[0] is not None) == [1, 2, 3.5, 3.5]
