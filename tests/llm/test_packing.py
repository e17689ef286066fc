"""Token counts, packing and mixing."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nightloom.llm import mixing as M
from nightloom.llm import packing as P
from nightloom.llm import picking, tokens


def docs(spark, sizes, first=0):
    return spark.createDataFrame([(first + i, None if s is None else int(s)) for i, s in enumerate(sizes)], "doc bigint, n int")


def kinds(spark, *rows):
    return spark.createDataFrame(list(rows), "container string, capacity_tokens int")


def checked(got, sizes, capacity):
    """No bin overfull, places and offsets without gaps, every document whole."""
    bins, seen = {}, {}
    for r in got:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
            seen.setdefault(r.doc, []).append(r)
    for rows in bins.values():
        rows.sort(key=lambda r: r.place)
        at = 0
        for k, r in enumerate(rows):
            assert r.place == k and r.offset == at
            at += r.n_tokens
        assert at <= capacity
    for i, s in enumerate(sizes):
        if s:
            rows = sorted(seen[i], key=lambda r: r.piece)
            assert sum(r.n_tokens for r in rows) == s and [r.piece for r in rows] == list(range(len(rows)))
            assert len(rows) == (1 if s <= capacity else -(-s // capacity))
            assert [r.piece_start for r in rows] == [capacity * k for k in range(len(rows))]
    return len(bins)


def test_pack(spark):
    rng = np.random.default_rng(0)
    sizes = rng.integers(20, 900, 700).tolist() + [0, None, 512, 513, 5000]
    got = P.pack(docs(spark, sizes), kinds(spark, ("s", 512), ("m", 2048), ("none", 0), (None, 9)), ident="doc", size="n", shard_items=200, epochs=2)
    rows = got.collect()
    for name, cap in (("s", 512), ("m", 2048)):
        mine = [r for r in rows if r.container == name]
        n = checked(mine, [s or 0 for s in sizes], cap)
        assert {r.doc for r in mine if r.bin_id is None} == {700, 701}
        least = -(-sum(s or 0 for s in sizes) // cap)
        assert n <= least * 1.1 + 4
    assert {r.container for r in rows} == {"s", "m"}
    told = {r.container: r for r in P.filling(got, kinds(spark, ("s", 512), ("m", 2048))).collect()}
    assert told["m"].fill > 0.96 and told["s"].tokens == sum(s or 0 for s in sizes)


def test_pack_is_repeatable_and_defined_at_the_edges(spark):
    d = docs(spark, [5, 5, 5, 3, 2])
    one = P.pack(d.unionByName(d), kinds(spark, ("a", 10)), ident="doc", size="n").orderBy("doc").collect()
    assert one == P.pack(d, kinds(spark, ("a", 10)), ident="doc", size="n").orderBy("doc").collect()
    assert checked(one, [5, 5, 5, 3, 2], 10) == 2
    assert P.pack(d.limit(0), kinds(spark, ("a", 10)), ident="doc", size="n").count() == 0
    assert P.pack(d, kinds(spark).limit(0), ident="doc", size="n").count() == 0
    assert P.pack(docs(spark, [None]), kinds(spark, ("a", 10)), ident="doc", size="n").first().bin_id is None


def test_bins_migrate_between_shards(spark):
    """Shards of few items leave half-filled bins; together they are filled, and never worse than apart."""
    rng = np.random.default_rng(5)
    d = docs(spark, rng.integers(20, 45, 600).tolist())
    used = {}
    for loose in (0.0, 0.95):
        got = P.pack(d, kinds(spark, ("c", 100)), ident="doc", size="n", shard_items=12, epochs=1, generations=4, loose=loose)
        rows = got.collect()
        used[loose] = checked(rows, [r.n for r in sorted(d.collect())], 100)
    assert used[0.95] < used[0.0]


def test_any_number_of_kinds(spark, monkeypatch):
    monkeypatch.setattr(P, "_KINDS", 2)
    got = P.pack(docs(spark, [5, 3, 9]), kinds(spark, *((f"k{i}", 10 + i) for i in range(5))), ident="doc", size="n")
    assert {(r.container, r.n) for r in got.groupBy("container").agg(F.sum("n_tokens").alias("n")).collect()} == {(f"k{i}", 17) for i in range(5)}


def test_breeding_improves():
    rng = np.random.default_rng(1)
    sizes = rng.integers(200, 501, 120)
    first = P.founders(sizes, 1000, 6, rng)
    bred = P.evolve(sizes, 1000, first, 200, rng)
    assert P.fitness(sizes, 1000, bred[0]) >= max(P.fitness(sizes, 1000, b) for b in first)
    for b in bred:
        assert np.bincount(b, weights=sizes).max() <= 1000 and b.min() == 0 and len(np.unique(b)) == b.max() + 1
    child = P.crossover(sizes, 1000, bred[0], bred[1], rng)
    assert np.bincount(child, weights=sizes).max() <= 1000 and (child >= 0).all()


def brute_sum(lengths, counts, goal):
    best = {0}
    for size, n in zip(lengths, counts):
        best |= {b + size * k for b in best for k in range(n + 1) if b + size * k <= goal}
    return max(best)


@pytest.mark.parametrize("seed", range(8))
def test_subset_sum(seed):
    rng = np.random.default_rng(seed)
    lengths, counts, goal = rng.integers(1, 60, 8), rng.integers(0, 4, 8), int(rng.integers(0, 300))
    take = M.subset_sum(lengths, counts, goal)
    assert (take <= counts).all() and (take >= 0).all()
    assert int((take * lengths).sum()) == brute_sum(lengths.tolist(), counts.tolist(), goal)


def test_fit_budget():
    rng = np.random.default_rng(2)
    lengths, counts = np.arange(50, 900), rng.integers(1, 40, 850)
    for budget in (0, 100, 54_321, 1_000_000, int((lengths * counts).sum()) + 5):
        take = M.fit_budget(lengths, counts, budget, 7, 20_000)
        assert (take <= counts).all() and (take >= 0).all()
        assert int((take * lengths).sum()) == min(budget, int((lengths * counts).sum()))


def test_mix(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "big" if i < 800 else "small" if i < 860 else "tiny" if i < 863 else None if i < 870 else "other", int(rng.integers(50, 400))) for i in range(900)]
    rows += [(900, "big", 0), (901, "big", None), (None, "big", 5), (0, "big", rows[0][2])]
    df = spark.createDataFrame(rows, "doc bigint, src string, n int").withColumn("passes", F.lit(1))
    target = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 4), ("tiny", 0.15, 2), ("gone", 0.05, 3), ("big", 0.1, 1)], "source string, target_share double, max_repeat int")
    got = M.mix(df, target, ident="doc", source="src", size="n", total=100_000)
    picks, shares = got.picks.collect(), {r.source: r for r in got.shares.collect()}
    sums = {}
    for r in picks:
        sums[r.source] = sums.get(r.source, 0) + r.n_tokens * r.copies
    assert len({r.doc for r in picks}) == len(picks) and {r.source for r in picks} == {"big", "small", "tiny"}
    assert sums["big"] == 50_000 and sums["small"] == 30_000
    assert all(r.copies <= {"big": 1, "small": 4, "tiny": 2}[r.source] for r in picks)
    assert {r.copies for r in picks if r.source == "tiny"} == {2} and shares["tiny"].missing_tokens > 0
    assert {s: shares[s].mixed_tokens for s in sums} == sums and shares["gone"].mixed_tokens == 0
    assert sum(r.actual_share for r in shares.values()) == pytest.approx(1)
    assert shares["small"].copies == sum(r.copies for r in picks if r.source == "small")
    again = M.mix(df, target, ident="doc", source="src", size="n", total=100_000).picks.collect()
    assert sorted(again) == sorted(picks)


def test_mix_shrinks(spark):
    """With a source that can't fill its budget the total shrinks to where shares hold."""
    rows = [(i, "a", 10) for i in range(100)] + [(1000 + i, "b", 10) for i in range(5)]
    d = spark.createDataFrame(rows, "doc bigint, source string, n bigint")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2), ("none", 0.1, 3)], "source string, target_share double, max_repeat int")
    shares = {f: {r.source: r for r in M.mix(d, t, ident="doc", source="source", size="n", fill=f).shares.collect()} for f in ("gap", "shrink")}
    assert (shares["gap"]["a"].mixed_tokens, shares["gap"]["b"].missing_tokens) == (520, 320)
    assert (shares["shrink"]["a"].mixed_tokens, shares["shrink"]["b"].mixed_tokens, shares["shrink"]["b"].missing_tokens) == (120, 100, 0)
    with pytest.raises(ValueError):
        M.mix(d, t, ident="doc", source="source", size="n", fill="x")


def test_mix_empty(spark):
    df = spark.createDataFrame([], "doc bigint, src string, n int")
    target = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeat int")
    got = M.mix(df, target, ident="doc", source="src", size="n")
    assert got.picks.count() == 0 and got.shares.first().actual_share is None
    assert M.mix(df, target.limit(0), ident="doc", source="src", size="n").shares.count() == 0


def test_pick(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") < 15_000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("g"))
    df = df.withColumn("w", F.when(F.col("g") == "hot", 7001).when(F.col("g") == "k1", 0).when(F.col("g") == "k2", None).when(F.col("g") == "k3", 10_000).otherwise(5))
    n = {r.g: (r.n, r.p) for r in picking.pick(df, ["g"], "id", "w", 1).groupBy("g").agg(F.count("*").alias("n"), F.count_if("picked").alias("p")).collect()}
    assert n["hot"] == (15_000, 7001) and n["k1"] == (100, 0) and n["k2"] == (100, 0) and n["k3"] == (100, 100) and n["k4"] == (100, 5)


def test_tokens(spark):
    text = "Judgment of 5 June.\nΑπόφαση  of\n\n the суд\n" * 3
    n = tokens.count_tokens(text)
    assert n > 20 and tokens.count_tokens("") == tokens.count_tokens(None) == 0
    long = (text + "ab " * 50 + "\n") * 3000
    whole = len(tokens._encoding(tokens.VOCABULARY).encode_ordinary(long))
    assert len(long) > 200_000 and tokens.count_tokens(long) == whole
    got = tokens.with_token_counts(spark.createDataFrame([(text,), (None,), ("",)], "text string"), "text").collect()
    assert [r.n_tokens for r in got] == [n, 0, 0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Word", " ", "  ", "\n", "\n\n", "\r\n", "\t", " ", " ", " ", "\x0b", "\x85", "1", "23", "'s", "'ll", ".", "§ 5", "é", "é", "Я", "λ", "​", "-\n", "\n-"]), max_size=40).map("".join))
def test_tokens_line_by_line(text):
    """Long texts are counted in pieces; however odd their white space, that changes no count."""
    whole = tokens.count_tokens(text)
    pieces = [p for p in tokens._SEAM.split(text)] if text else []
    assert sum(tokens.count_tokens(p) for p in pieces) == whole
