"""Nearest-time pairs against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom.llm import nearest as N


def brute(left, right, tol):
    out = set()
    for lid, k, t in left:
        best = None
        for rid, q, s in right:
            if None in (k, t, q, s) or k != q or abs(t - s) > tol:
                continue
            best = min(best or (abs(t - s), s, rid), (abs(t - s), s, rid))
        if best:
            out.add((lid, best[2], best[0]))
    return out


def run(spark, left, right, tol, **kw):
    left_df = spark.createDataFrame(left, "lid int, k string, t bigint")
    right_df = spark.createDataFrame(right, "rid int, k string, t bigint")
    got = N.nearest_within(left_df, right_df, ["k"], left_id="lid", left_time="t", right_id="rid", right_time="t", tolerance=tol, **kw)
    rows = [(r.lid, r.rid, r.distance) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed,span,tol,width", [(0, 1000, 10, None), (1, 300, 25, 60), (2, 5000, 7, 14), (3, 50, 100, None), (4, 400, 0, None)])
def test_brute_force(spark, seed, span, tol, width):
    rng = np.random.default_rng(seed)
    make = lambda n, first: [(first + i, None if rng.random() < 0.03 else "abc"[rng.integers(3)], None if rng.random() < 0.05 else int(rng.integers(-span, span))) for i in range(n)]
    left, right = make(200, 0), make(150, 1000)
    assert run(spark, left, right, tol, **({"bin_width": width} if width else {})) == brute(left, right, tol)


def test_ties_bounds_and_repeats(spark):
    right = [(1, "a", 0), (2, "a", 10), (3, "a", 10), (4, "b", 5)]
    assert run(spark, [(1, "a", 5)], right, 5) == {(1, 1, 5)}
    assert run(spark, [(1, "a", 16)], right, 5) == set()
    assert run(spark, [(1, "a", 15)], right, 5) == {(1, 2, 5)}
    assert run(spark, [], right, 5) == set() and run(spark, [(1, "a", 5)], [], 5) == set()


def test_clashing_columns_and_hot_key(spark):
    left = spark.range(3000).select(F.lit("hot").alias("k"), F.col("id"), (F.col("id") * 100).alias("t"), F.lit(1).alias("_bin"), F.lit(2).alias("_lo2"))
    right = spark.range(3000).select(F.lit("hot").alias("k"), (F.col("id") + 5000).alias("id"), (F.col("id") * 100 + 7).alias("t"), F.lit(1).alias("_bin"))
    got = N.nearest_within(left, right, ["k"], left_id="id", left_time="t", right_id="id", right_time="t", tolerance=10)
    assert got.columns == ["id", "id_right", "distance"] and got.where("id_right = id + 5000 and distance = 7").count() == 3000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_microseconds(spark):
    df = spark.createDataFrame([(1.2,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in df.select(N.microseconds(F.col("x"))).collect()] == [1_200_000, None, None]
