"""Event tables."""

import pytest
from pyspark.sql import functions as F

from nightloom.operators import events as E


def times(spark, xs, c="x"):
    return spark.createDataFrame([("r", c, t) for t in xs], "r string, c string, t bigint")


DET, GT = [5, 12, 20, 34, 41, 57, 63], [5, 12, 18, 26, 34, 41, 55, 63, 68]


def test_compare(spark):
    r = E.compare(times(spark, DET + [5]), times(spark, GT[::-1]), ["r"], "t").first()
    assert (r.tp, r.fp, r.fn) == (5, 2, 4)
    assert r.precision == pytest.approx(5 / 7) and r.recall == pytest.approx(5 / 9)
    r = E.compare(times(spark, DET), times(spark, GT), ["r"], "t", 2).first()
    assert (r.fp, r.fn, r.precision) == (0, 2, 1.0)
    assert r.recall == pytest.approx(7 / 9)


def test_compare_empty(spark):
    r = E.compare(times(spark, []), times(spark, GT), ["r"], "t").first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (0, 0, 9, 0, 0, 0)
    r = E.compare(times(spark, DET), times(spark, []), ["r"], "t").first()
    assert (r.fp, r.fn, r.f1) == (7, 0, 0)
    assert E.compare(times(spark, []), times(spark, []), ["r"], "t").count() == 0


def test_channels(spark):
    e = times(spark, DET).unionByName(times(spark, GT, "y")).unionByName(times(spark, [None], "z"))
    m = {(r.truth, r.detected): r for r in E.compare_channels(e, ["r"], "c", "t").collect()}
    assert m["x", "x"].f1 == 1 and m["y", "y"].f1 == 1
    assert (m["y", "x"].tp, m["y", "x"].fp, m["y", "x"].fn) == (5, 2, 4)


def test_merge_and_samples(spark):
    p = times(spark, [4, 5, 6, 7, 10, 11, 12, 13, 20, 21, 22, 100, 102])
    assert sorted((r.start, r.stop) for r in E.merge_close(p, ["r"], "t", 10).collect()) == [(4, 22), (100, 102)]
    e = spark.createDataFrame([("r", 3.0, 6.0), ("r", 8.0, 12.0), ("r", None, 1.0)], "r string, a double, b double")
    got = sorted(r.sample for r in E.samples_of(e, ["r"], F.col("a"), F.col("b"), 1.0).collect())
    assert got == [3, 4, 5, 6, 8, 9, 10, 11, 12]


def test_locked(spark):
    samples = spark.createDataFrame([("r", i, float(i)) for i in range(100)], "r string, sample bigint, value double")
    ev = spark.createDataFrame([("r", k, float(t) if t is not None else None) for k, t in enumerate([1, 10, 20, 30, 50, 102, None])], "r string, id int, t double")
    rows = E.locked(ev, samples, ["r"], "id", F.col("t"), 1.0, 3, 2, "value")
    assert sorted({r.id for r in rows.collect()}) == [1, 2, 3, 4] and rows.count() == 24


def test_duplicates(spark):
    e = spark.createDataFrame([("c", 1.0, 5.0), ("c", 1.0, 6.0), ("c", 2.0, 7.0), ("c", 3.0, 7.0), ("c", 4.0, 8.0)], "c string, s double, e double")
    assert [r.s for r in E.drop_repeated(e, ["c"], ["s", "e"]).collect()] == [4.0]


def test_circular_mean_and_summary(spark):
    e = spark.createDataFrame([("a", 3.1, 1.0), ("a", -3.1, 3.0)], "g string, phase double, x double")
    r = E.summary(e, ["g"], ["phase", "x"], circular=["phase"]).first()
    assert abs(abs(r.phase) - 3.14159265) < 1e-6 and r.x == 2 and r.Count == 2
    assert E.summary(e, ["g"], ["x"], "median", mask=F.col("x") > 2).first().x == 3
    own = E.summary(e.unionByName(spark.createDataFrame([(None, 0.5, 7.0)], e.schema)), ["g"], ["phase", "x"], lambda v: v.max() - v.min(), ["phase"])
    assert {r.g: (r.Count, r.x) for r in own.collect()} == {"a": (2, 2.0), None: (1, 0.0)}


def test_cooccurring(spark):
    w = spark.createDataFrame([(1, "c", 10.0), (2, "c", 50.0), (3, "d", 10.0)], "id int, c string, t double")
    s = spark.createDataFrame([(1, "c", 9.0), (2, "c", 11.0), (3, "c", 51.2)], "k int, c string, p double")
    got = {r.id: (r.Cooccurring, r.CooccurringPeak) for r in E.cooccurring(w, s, ["c"], "id", "t", "p", "k").collect()}
    assert got == {1: (True, 11.0), 2: (False, None), 3: (False, None)}


def test_coincidence(spark):
    s = spark.createDataFrame([("r", "a", 1, 2), ("r", "b", 2, 4)], "r string, c string, first bigint, last bigint")
    raw = {(r.c1, r.c2): r.value for r in E.coincidence(s, ["r"], "c").collect()}
    assert raw == {("a", "a"): 2, ("b", "b"): 3, ("a", "b"): 1, ("b", "a"): 1}
    scaled = {(r.c1, r.c2): r.value for r in E.coincidence(s, ["r"], "c", True).collect()}
    assert scaled["a", "a"] == 1 and scaled["a", "b"] == pytest.approx(1 / 6)


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_coincidence_counts_samples(spark, width):
    rng = __import__("numpy").random.default_rng(4)
    rows = [(r, c, float(rng.integers(-20, 200)) / 10, float(rng.integers(0, 40)) / 10) for r in "xy" for c in "abc" for _ in range(12)] + [("x", "a", None, 1.0), ("x", "b", 3.0, None)]
    events = spark.createDataFrame(rows, "r string, c string, s double, d double")
    end = F.col("s") + F.col("d")
    held = {}
    for r in E.samples_of(events, ["r", "c"], F.col("s"), end, 10.0).collect():
        held.setdefault((r.r, r.c), set()).add(r.sample)
    spans = E.spans_of(events, ["r", "c"], F.col("s"), end, 10.0)
    assert {(x.r, x.c): x.n for x in spans.groupBy("r", "c").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n")).collect()} == {k: len(v) for k, v in held.items()}
    got = {(x.r, x.c1, x.c2): x.value for x in E.coincidence(spans, ["r"], "c", width=width).collect()}
    assert got == {(r, a, b): len(held[r, a] & held[r, b]) for r in "xy" for a in "abc" for b in "abc"}
    assert E.coincidence(spans.limit(0), ["r"], "c").count() == 0


def test_no_nested_loops(spark):
    plan = E.compare(times(spark, DET), times(spark, GT), ["r"], "t", 2)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
