"""Handles and workflows."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from nightloom import handles
from nightloom.operators import analysis
from nightloom.plans import simulate

K = ["session_id", "scorer"]


def hyp(spark, stages, scorer="a", **kw):
    df = spark.createDataFrame([("s", scorer, i, x) for i, x in enumerate(stages)], "session_id string, scorer string, epoch int, stage string")
    return handles.Hypnograms.from_spellings(df, **kw)


def codes(h):
    return [r.code for r in h.df.orderBy("epoch").collect()]


def test_lengths():
    assert [handles.seconds(x) for x in (30, "30s", "5min", "1 hour", "2 minutes", "500ms")] == [30, 30, 300, 3600, 120, 0.5]
    with pytest.raises(ValueError):
        handles.seconds("soon")


def test_hypnogram(spark):
    h = hyp(spark, ["W", "n1", "N2", "N3", "R", "uns", None])
    assert codes(h) == [0, 1, 2, 3, 4, -2, -2]
    assert codes(h[1:3]) == [1, 2] and codes(h[-1]) == [-2] and codes(h[0]) == [0]
    assert codes(h.consolidate(3)) == [0, 2, 2, 2, 4, -2, -2] and codes(h.upsample("15s"))[:4] == [0, 0, 1, 1]
    assert codes(h.pad(1, 1, "edge")) == [0, 0, 1, 2, 3, 4, -2, -2, -2]
    assert [r["mask"] for r in h.mask(["N2", "REM"]).orderBy("epoch").collect()] == [False, False, True, False, True, False, False]
    assert h.periods("1min").count() == 1 and h.change_points().count() == 6 and h.length().first().duration == 3.5
    assert h.equals(h).where("equal").count() == 7 and h.violations().count() == 0
    assert {r.stage for r in h.labels().collect()} == {"WAKE", "N1", "N2", "N3", "REM", "UNS"}
    assert [r.code for r in h.as_int({0: 10, 1: 11, 2: 12, 3: 13, 4: 14}).orderBy("epoch").collect()] == [10, 11, 12, 13, 14, -2, -2]
    assert h.as_events().orderBy("epoch").collect()[2].onset == 60
    for bad in (lambda: h.periods("45s"), lambda: h.mask(["LIGHT"]), lambda: h[::2], lambda: h.upsample(40), lambda: h.consolidate(5), lambda: h.periods(0, True)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(PySparkException):
        hyp(spark, ["LIGHT"]).df.collect()
    with pytest.raises(PySparkException):
        h.as_int({0: 1}).collect()


def test_time(spark):
    h = hyp(spark, ["W", "N1", "N2", "N3"])
    u = 1_000_000
    starts = spark.createDataFrame([("s", "a", 1000 * u)], "session_id string, scorer string, start_us bigint")
    assert codes(h.crop_time(starts, 1030 * u, 1060 * u)) == [1, 2]
    assert codes(h.crop_time(starts, 0, 1030 * u)) == [0, 1]
    assert codes(h.pad_time(starts, 925 * u)) == [-2, -2, 0, 1, 2, 3] and codes(h.pad_time(starts, 2000 * u)) == [0, 1, 2, 3]


def test_agreement(spark):
    ref = handles.Hypnograms(simulate.simulate(spark, 12, 120).withColumn("scorer", F.lit("a")))
    obs = handles.Hypnograms(ref.df.withColumn("code", F.when(F.col("epoch") % 9 == 0, 2).otherwise(F.col("code"))).withColumn("scorer", F.lit("b")))
    e = ref.evaluate(obs)
    assert e.unpaired().count() == 0 and e.agreement().count() == 12 and e.agreement(True).first().accuracy > 0.85
    assert e.summary().count() == 7 and e.summary(True).count() > 5 and e.confusion(True).agg(F.sum("n")).first()[0] == 12 * 240
    s = handles.StatsAgreement(*e.statistics(), ("TST", "N2", "SE"))
    assert s.summary().count() == 3 and s.report().count() == 3 and s.plot_data().count() == 36
    assert s.summary("boot").count() == 21 and s.calibrate(s.obs).count() == 36 and s.n_sessions() == 12
    with pytest.raises(ValueError):
        handles.StatsAgreement(ref.df, obs.df, (), confidence=2)
    with pytest.raises(ValueError):
        ref.evaluate(obs.upsample(15))


def test_events(spark):
    rows = [("r", "C3", 1, 1.0, 1.4, 2.0, 2, 1.0), ("r", "C3", 2, 5.0, 5.5, 6.0, 2, 2.0), ("r", "C4", 3, 1.1, 1.5, 2.0, 3, 3.0)]
    df = spark.createDataFrame(rows, "recording_id string, channel string, event_id int, Start double, Peak double, End double, Stage int, Duration double")
    e = handles.Events(df, "spindle", 10.0)
    assert e.summary(grp_chan=True, grp_stage=True).count() == 2
    minutes = spark.createDataFrame([("r", 2, 4.0)], "recording_id string, Stage int, minutes double")
    assert [r.Density for r in e.summary(grp_stage=True, minutes=minutes).collect()] == [0.5, None]
    assert e.compare_channels(0.1).count() == 4 and e.compare_detection(e).where("f1 = 1").count() == 2
    assert e.coincidence().count() == 4 and e.on_several_channels().df.count() == 2
    samples = spark.range(100).select(F.lit("r").alias("recording_id"), F.lit("C3").alias("channel"), F.col("id").alias("sample"), F.col("id").cast("double").alias("value"))
    assert e.average(samples).count() == 21
    w = handles.Events(df.withColumn("NegPeak", F.col("Start")), "slow_wave", 10.0)
    assert w.cooccurring(e).where("Cooccurring").count() == 3


def test_workflows(spark):
    h = spark.createDataFrame([("a", i, 2) for i in range(3)], "k string, epoch int, code int")
    art = spark.createDataFrame([("a", i, i == 7) for i in range(18)], "k string, epoch int, artefact boolean")
    assert [r.code for r in analysis.merge_artefacts(h, art, ["k"], 5.0, 30.0).orderBy("epoch").collect()] == [2, -1, 2]
    df = spark.createDataFrame([("a", 1.0, 10.0), ("a", 2.0, 30.0), ("a", 2.0, 20.0), ("a", 4.0, 40.0), ("a", None, 1.0), ("b", 1.0, 1.0)], "g string, x double, y double")
    rho = {r.g: r.rho for r in analysis.spearman(df, "x", "y", ["g"]).collect()}
    assert rho["a"] == pytest.approx(0.9486833) and rho["b"] is None
    f = spark.createDataFrame([("p", 1.0, 1.0), ("p", 2.0, 5.0), ("q", 5.0, 2.0), ("q", 6.0, 4.0)], "l string, a double, b double")
    ranked = analysis.anova_f(f, "l", ["a", "b"]).collect()
    assert ranked[0].feature == "a" and ranked[0].f == pytest.approx(32.0) and ranked[1].f == pytest.approx(0.0)
    assert analysis.quantile_limits(f, ["l"], ["a"], 0.0, 0.5).count() == 2
    assert analysis.zscored(f, ["l"], ["a"]).where("abs(a) = 1").count() == 4
    p = spark.createDataFrame([("a", 0, {"N2": 0.3, "W": 0.7})], "k string, epoch int, proba map<string,double>")
    assert analysis.proba_violations(p, ["k"]).count() == 0
    q = spark.createDataFrame([("a", 0, {"N2": 0.3, "W": 0.6}), ("a", 1, {"N2": -0.1, "W": 1.1})], p.schema)
    assert analysis.proba_violations(q, ["k"]).count() == 2
    assert [round(r.cumulative, 6) for r in analysis.density(p, ["k"]).orderBy("label").collect()] == [0.3, 1.0]
