"""Stage sequences against plain Python."""

import itertools
import json
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from nightloom.operators import hypnogram as H
from nightloom.plans import simulate
from nightloom.stages import CODES, code_of, label_of

K = ["s"]


def hyp(spark, codes, s="a"):
    return spark.createDataFrame([(s, i, c) for i, c in enumerate(codes)], "s string, epoch int, code int")


def codes(df):
    return [r.code for r in df.orderBy("epoch").collect()]


def drawn(seed, n=60, stages=(0, 1, 2, 3, 4), stay=0.6):
    """A sequence that often stays in a stage."""
    rng = np.random.default_rng(seed)
    out = [int(rng.choice(stages))]
    while len(out) < n:
        out.append(out[-1] if rng.random() < stay else int(rng.choice(stages)))
    return out


def brute_runs(x):
    found, at = [], 0
    for value, part in itertools.groupby(x):
        size = len(list(part))
        found.append((value, at, size))
        at += size
    return found


@pytest.mark.parametrize("seed,least", [(0, 1), (1, 2), (2, 5)])
def test_runs(spark, seed, least):
    x = drawn(seed)
    found = {tuple(r) for r in H.runs(hyp(spark, x), K, least).select("value", "start", "length").collect()}
    assert found == {r for r in brute_runs(x) if r[2] >= least}


@pytest.mark.parametrize("least", [1, 2, 3])
def test_runs_equal_length(spark, least):
    x = drawn(5, stages=(0, 1))
    found = {tuple(r) for r in H.runs(hyp(spark, x), K, least, True).select("value", "start", "length").collect()}
    assert found == {(v, at + least * k, least) for v, at, size in brute_runs(x) for k in range(size // least)}


def test_transitions(spark):
    x = drawn(7, 80)
    t = H.transitions(hyp(spark, x), K).collect()
    steps = Counter(zip(x, x[1:]))
    assert {(r["from"], r.to): r.n for r in t} == steps
    for r in t:
        assert r.p == pytest.approx(r.n / sum(n for (a, _), n in steps.items() if a == r["from"]))


@pytest.mark.parametrize("seed", [0, 3, 11])
def test_statistics(spark, seed):
    x = [0] * seed + drawn(seed, 90, (0, 1, 2, 3, 4, -1, -2), 0.8) + [0]
    freq = 30.0
    r = H.sleep_statistics(hyp(spark, x).withColumn("freq_sec", F.lit(freq)), K).first().asDict()
    asleep = [i for i, c in enumerate(x) if c > 0]
    first, last, sleep, m = asleep[0], asleep[-1], len(asleep), freq / 60
    want = {"TIB": len(x) * m, "SPT": (last - first + 1) * m, "TST": sleep * m, "SOL": first * m, "WASO": x[first : last + 1].count(0) * m}
    want |= {"WAKE": x.count(0) * m, "ART": x.count(-1) * m, "UNS": x.count(-2) * m, "NREM": sum(x.count(c) for c in (1, 2, 3)) * m, "SE": 100 * sleep / len(x), "SME": 100 * sleep / (last - first + 1)}
    for name, c in (("N1", 1), ("N2", 2), ("N3", 3), ("REM", 4)):
        want |= {name: x.count(c) * m, f"pct_{name}": 100 * x.count(c) / sleep, f"Lat_{name}": x.index(c) * m if c in x else None}
    breaks = sum(a > 0 and b == 0 for a, b in zip(x, x[1:]))
    want |= {"SFI_per_hour": breaks / (sleep * m / 60), "SFI": breaks / (sleep * m / 60) * m}
    spans = [(at, size) for value, at, size in brute_runs([c > 0 for c in x]) if value and size * freq >= 300]
    want["SOL_5min"] = spans[0][0] * m if spans else None
    for name, value in want.items():
        assert (r[name] is None) == (value is None) and (value is None or r[name] == pytest.approx(value, abs=6e-5)), name


def test_statistics_without_sleep(spark):
    r = H.sleep_statistics(hyp(spark, [0] * 41 + [-1] * 6 + [-2] * 13).withColumn("freq_sec", F.lit(30.0)), K).first()
    assert (r.SPT, r.TST, r.N3, r.Lat_REM, r.WASO, r.SME, r.SFI, r.ART, r.UNS) == (0, 0, 0, None, None, None, None, 3, 6.5)


def test_shape_changes(spark):
    h = hyp(spark, [2, 2, 4])
    assert codes(H.pad(h, K, 2, 1)) == [-2, -2, 2, 2, 4, -2]
    assert codes(H.pad(h, K, 1, 2, "edge")) == [2, 2, 2, 4, 4, 4]
    assert codes(H.crop(hyp(spark, range(7)), 1, 4)) == [1, 2, 3, 4]
    assert codes(H.part(hyp(spark, range(7)), K, -3, -1)) == [4, 5]
    assert codes(H.part(hyp(spark, range(7)), K, None, 2)) == [0, 1]
    assert codes(H.upsample(h, 2)) == [2, 2, 2, 2, 4, 4]
    assert codes(H.consolidate(hyp(spark, [0, 1, 2, 3, 4, -1]), 3)) == [0, 2, 2, 2, 4, -1]
    assert codes(H.consolidate(hyp(spark, [0, 1, 2, 3, 4, -2]), 2)) == [0, 1, 1, 1, 1, -2]
    with pytest.raises(ValueError):
        H.crop(h, 3, 2)
    with pytest.raises(ValueError):
        H.upsample(h, 0)


def test_dense_and_violations(spark):
    rows = spark.createDataFrame([("a", 0, 1), ("a", 3, None), ("b", -1, 2), (None, 1, 4)], "s string, epoch int, code int")
    assert codes(H.dense(rows.where("s = 'a'"), K)) == [1, -2, -2, -2]
    found = {r.s: (r.n_gaps, r.n_foreign) for r in H.violations(rows.where("epoch >= 0"), K).collect()}
    assert found["a"] == (2, 1)


def test_alignment(spark):
    u = 1_000_000
    a = spark.range(1).select(H.alignment(F.lit(120 * u), F.lit(0), F.lit(30.0)).alias("a"), H.alignment(F.lit(-30 * u), F.lit(0), F.lit(30.0)).alias("b"), H.alignment(F.lit(45 * u), F.lit(0), F.lit(30.0)).alias("c")).first()
    assert (a.a.offset, a.b.offset, a.c.offset) == (4, -1, 2)
    assert (a.a.off_grid, a.c.off_grid) == (False, True)


def test_stages_of_samples(spark):
    samples = spark.createDataFrame([("a", i) for i in range(8)], "s string, sample int")
    out = H.at_samples(samples, hyp(spark, [2, 3, 4]), K, "sample", 2, F.lit(1)).orderBy("sample").collect()
    assert [r.code for r in out] == [3, 3, 4, 4, -2, -2, -2, -2]


def test_json_round_trip(spark):
    h = hyp(spark, [0, 2, 4])
    ses = spark.createDataFrame([("a", 5, 30.0, "2022-01-01", "me")], "s string, n_stages int, freq_sec double, start string, scorer_name string")
    text = H.as_json(h, K, ses).first().json
    assert json.loads(text) == {"values": ["WAKE", "N2", "REM"], "n_stages": 5, "freq": "30s", "start": "2022-01-01", "scorer": "me", "proba": None}
    back = H.from_json(spark.createDataFrame([("a", text), ("b", "{broken"), ("c", None)], "s string, json string"), "json", K)
    assert [r.label for r in back.orderBy("epoch").collect()] == ["WAKE", "N2", "REM"]


def test_probabilities_round_trip(spark):
    p = [{"WAKE": 0.9, "N2": 0.1}, {"WAKE": 0.25, "N2": 0.7500000004}]
    rows = [("a", i, c, m) for i, (c, m) in enumerate(zip([0, 2], p))] + [("b", 0, 0, None)]
    h = spark.createDataFrame(rows, "s string, epoch int, code int, p map<string,double>")
    ses = spark.createDataFrame([(k, 5, 30.0, None, "me") for k in "ab"], "s string, n_stages int, freq_sec double, start string, scorer_name string")
    docs = H.as_json(h, K, ses, "p")
    told = {r.s: json.loads(r.json) for r in docs.collect()}
    assert told["a"]["proba"] == {"WAKE": [0.9, 0.25], "N2": [0.1, 0.75]} and told["b"]["proba"] is None
    back = {(r.s, r.epoch): r.proba for r in H.from_json(docs, "json", K).collect()}
    assert back == {("a", 0): p[0], ("a", 1): {"WAKE": 0.25, "N2": 0.75}, ("b", 0): None}


def test_spelling(spark):
    rows = spark.createDataFrame([(" n2 ",), ("s4",), ("Mt",), ("-2",), ("",), (None,), ("N9",)], "x string")
    assert [r[0] for r in rows.select(code_of(F.col("x"))).collect()] == [2, 3, -1, -2, None, None, None]
    assert spark.range(1).select(label_of(F.lit(2), 4), label_of(F.lit(1), 3)).first()[:] == ("LIGHT", None)
    assert CODES["R"] == 4


def test_foreign_codes(spark):
    m = {-1: "ART", -2: "UNS", 0: "WAKE", 2: "N2"}
    df = spark.createDataFrame([(-1,), (-2,), (0,), (2,), (None,)], "x int")
    assert [r[0] for r in df.select(H.checked_codes(F.col("x"), m)).collect()] == [-1, -2, 0, 2, None]
    with pytest.raises(PySparkException):
        spark.createDataFrame([(7,)], "x int").select(H.checked_codes(F.col("x"), m)).collect()


# What these seeds must draw.
def test_simulation(spark):
    one = simulate.simulate(spark, 1, 4, first_seed=1)
    assert [r.code for r in one.orderBy("epoch").collect()] == [0, 1, 1, 2, 2, 2, 2, 2]
    night = simulate.simulate(spark, 1, 300, first_seed=1)
    like = simulate.simulate_similar(night, ["session_id"], seed=6, epochs=10)
    assert [r.code for r in like.orderBy("epoch").collect()] == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2]


def test_empty(spark):
    h = hyp(spark, [])
    f = h.withColumn("freq_sec", F.lit(30.0))
    for df in (H.runs(h, K), H.transitions(h, K), H.sleep_statistics(f, K), H.pad(h, K, 1, 1), H.dense(h, K), H.stability(h, K)):
        assert df.count() == 0
