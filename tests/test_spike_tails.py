"""Tail cutoffs decide; long sources give what short ones give; exact quantiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom.operators import quantiles, spikes

FIELDS = {"hr": (20, 250), "rm": (1, 1000)}


def rows_of(source, values, start):
    return [(start + i, source, float(i * 60), 2 + i % 3, v, None if i % 7 == 0 else 2 * v) for i, v in enumerate(values)]


def flagged(df, **kw):
    return spikes.flag(df, ident="id", source="src", time="t", season="stage", fields=FIELDS, **kw)


def framed(spark, rows):
    return spark.createDataFrame(rows, "id bigint, src string, t double, stage int, hr double, rm double")


def test_long_sources_as_short_ones(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k, source in enumerate(("a", "b", None)):
        values = np.round(60 + rng.normal(size=500) * (k + 1) + 2 * (np.arange(500) % 3), 2)
        values[rng.integers(0, 500, 4)] += 40
        values[100:107] = values[100]
        rows += rows_of(source, values.tolist(), 1000 * k)
    rows += rows_of("flat", [70.0, 71.0, 70.0, 71.0, 300.0], 9000)
    df = framed(spark, rows).withColumn("level", F.lit(1))
    for whole in (0, 400):
        one = flagged(df).orderBy("field", "ident").toPandas()
        two = flagged(df, whole=whole, slice_width=3000.0).orderBy("field", "ident").toPandas()
        assert (one.drop(columns=["level", "scale", "residual", "cutoff"]).fillna("-") == two.drop(columns=["level", "scale", "residual", "cutoff"]).fillna("-")).all().all()
        for c in ("level", "scale", "residual", "cutoff"):
            assert two[c].to_numpy(float) == pytest.approx(one[c].to_numpy(float), abs=1e-9, nan_ok=True)
    assert one.extreme.sum() >= 12


def test_the_tail_decides(spark):
    """A reading six and a half scales off is extreme where tails are light, and is not where readings often lie five off."""
    rng = np.random.default_rng(3)
    light = rng.normal(size=6000).clip(-3.2, 3.2)
    heavy = light.copy()
    heavy[rng.choice(6000, 300, replace=False)] = rng.choice([-1, 1], 300) * rng.uniform(3.5, 5.8, 300)
    found = {}
    for name, z in (("light", light), ("heavy", heavy)):
        z[3000] = 6.5
        df = framed(spark, [(i, "s", float(i), 2, 100 + 5 * x, None) for i, x in enumerate(z.tolist())])
        got = flagged(df)
        found[name] = ({r.ident for r in got.where("extreme").collect()}, got.first().cutoff)
    assert found["light"][0] == {3000} and found["heavy"][0] == set()
    assert found["light"][1] < 5.5 and found["heavy"][1] > 6.4


def test_cutoffs_are_drawn_to_all_sources():
    bins = 96
    common = np.zeros(bins)
    common[: bins // 2] = 1000.0
    few, many = np.zeros((1, bins)), np.zeros((1, bins))
    few[0, 80:] = 1
    many[0, 80:] = 1e6
    at = lambda own: spikes.tail_cutoffs(own, common, 5e-5, 0.01, 3000.0)[0]
    none = at(np.zeros((1, bins)))
    assert none < at(few)
    assert at(many) == pytest.approx(spikes.tail_cutoffs(many, many[0], 5e-5, 0.01, 3000.0)[0], rel=0.01)
    assert np.isnan(spikes.tail_cutoffs(few, np.zeros(bins), 5e-5, 0.01, 3000.0)).all()


def test_lower_quantile(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(v)) for k, n in (("a", 1), ("b", 2), ("c", 999), ("d", 40)) for v in rng.choice([rng.normal() * 10.0 ** rng.integers(-300, 300), 0.0, 1.0, 1.0 + 2e-16], n)]
    df = spark.createDataFrame([*rows, ("a", None), ("e", None)], "k string, v double")
    for share in (0.5, 0.9):
        got = {r.k: r.q for r in quantiles.lower_quantile(df, ["k"], "v", share).collect()}
        want = {k: sorted(v for j, v in rows if j == k) for k in "abcd"}
        assert got == {k: v[int(np.ceil(len(v) * share)) - 1] for k, v in want.items()}
    assert quantiles.lower_quantile(df.limit(0), ["k"], "v").count() == 0


def test_a_long_source_does_not_drown_the_others(spark):
    """A source of light tails with most of all readings leaves the cutoff of the others where it was."""
    rng = np.random.default_rng(9)
    rows, start = [], 0
    for k in range(40):
        z = rng.normal(size=100).clip(-3.2, 3.2)
        z[rng.choice(100, 2, replace=False)] = rng.choice([-1, 1], 2) * rng.uniform(4.0, 5.6, 2)
        rows += [(start + i, f"s{k}", float(i), 2, 100 + 5 * x, None) for i, x in enumerate(z.tolist())]
        start += 100
    hot = [(start + i, "hot", float(i), 2, 100 + 5 * x, None) for i, x in enumerate(rng.normal(size=9000).clip(-3.2, 3.2).tolist())]
    cut = lambda df, **kw: {r.source: r.cutoff for r in flagged(df, **kw).select("source", "cutoff").distinct().collect()}
    alone, beside, apart = cut(framed(spark, rows)), cut(framed(spark, rows + hot)), cut(framed(spark, rows + hot), whole=5000)
    assert max(abs(alone[s] - beside[s]) for s in alone) < 0.7 and beside["hot"] < 5.5 < min(alone.values())
    assert beside == pytest.approx(apart, abs=1e-9)
