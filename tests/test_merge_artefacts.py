"""Artefacts in hypnograms: counted without joining or broadcasting windows, for every ratio of epoch and window."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from nightloom.operators import analysis
from nightloom.plans import base

FOLDER = "/root/testdata/sf0.001"


def plain(hyp, art, window, share):
    out = {}
    for k, e, code, f in hyp:
        lo = math.floor(e * f / window)
        hi = max(lo, math.ceil((e + 1) * f / window) - 1)
        bad = [b for q, w, b in art if q == k and lo <= w <= hi and b is not None]
        out[k, e] = -1 if bad and sum(bad) / len(bad) > share else code
    return out


@pytest.mark.parametrize("carried", [False, True])
@pytest.mark.parametrize("window", [0.1, 3.0, 5.0, 20.0, 30.0, 70.0])
def test_equals_plain(spark, window, carried):
    rng = np.random.default_rng(int(window * 10))
    lengths = {"a": 30.0, "b": 20.0, "c": 0.3, "d": 7.0, "none": 0.0, "back": -7.0, "tiny": 1e-9}
    hyp = [(k, e, int(rng.integers(-2, 5)), f) for k, f in lengths.items() for e in range(25) if rng.random() < 0.9]
    art = [(k, w, None if rng.random() < 0.1 else bool(rng.random() < 0.5)) for k, f in lengths.items() for w in range(min(-1, math.floor(26 * f / window)), max(0, math.ceil(26 * f / window)) + 1) if rng.random() < 0.8]
    art += art[::7] + [("nobody", 0, True), (None, 0, True)]
    h = spark.createDataFrame([(k, e, c, f, f"{k}{e}") for k, e, c, f in hyp], "k string, epoch int, code int, f double, note string")
    a = spark.createDataFrame(art, "k string, epoch int, artefact boolean")
    if carried:
        last = [(k, f, max(e for q, e, _, _ in hyp if q == k)) for k, f in lengths.items()]
        a = a.join(spark.createDataFrame(last, "k string, f double, last int"), "k", "left")
    for share in (0.0, 0.4):
        got = analysis.merge_artefacts(h, a, ["k"], window, F.col("f"), share, carried)
        assert got.dtypes == h.dtypes
        rows = got.collect()
        assert {(r.k, r.epoch): r.code for r in rows} == plain(hyp, art, window, share) and len(rows) == len(hyp)
        assert all(r.note == f"{r.k}{r.epoch}" and r.f == lengths[r.k] for r in rows)


@pytest.mark.parametrize("parts", [None, 13])
def test_epochs_are_shuffled_once(spark, monkeypatch, parts):
    monkeypatch.setattr(base, "parts", lambda *_: parts)
    df = __spark_entry__.queries()["hyp_merge_artefacts"](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    assert not [x for x in plan if "Broadcast" in x or "SortMergeJoin" in x]
    spread = [x for x in plan if "Exchange hashpartitioning" in x]
    assert spread and not [x for x in spread if "epoch" in x or "_w" in x]  # by hypnogram only
    top = next(i for i, x in enumerate(plan) if "Union" in x)
    assert not [x for x in plan[:top] if "Exchange" in x]
    hyp = base.hypnograms(spark, FOLDER).join(base.sessions(spark, FOLDER), base.KEYS)
    assert df.count() == hyp.count()


def test_parts(spark):
    assert base.parts(spark, FOLDER) is None
    rows = spark.read.parquet(f"{FOLDER}/hypnogram.parquet").count()
    assert base.parts(spark, FOLDER, 100) == min(rows // 100, 2000)
