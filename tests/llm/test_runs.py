"""Run collapsing against brute force."""

import numpy as np
import pytest

from nightloom.llm import runs as R


def brute(rows, gap=1):
    out, by = set(), {}
    for k, i, v in rows:
        if i is not None:
            by.setdefault(k, []).append((i, v))
    for k, seq in by.items():
        run = None
        for i, v in sorted(seq):
            if v is None or v < 0:
                run = None
                continue
            if run and run[3] == v and i - run[1] <= gap:
                out.discard((k, *run))
                run = (run[0], i, run[2] + 1, v)
            else:
                run = (i, i, 1, v)
            out.add((k, *run))
    return out


def collapse(spark, rows, **kw):
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = [(r.k, r["first"], r["last"], r.n, r.label) for r in R.collapse_runs(df, ["k"], "i", "v", **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed,gap,width", [(0, 1, 4096), (1, 1, 7), (2, 3, 16), (3, 5, 4), (4, 1, 1)])
def test_brute_force(spark, seed, gap, width):
    rng = np.random.default_rng(seed)
    rows = []
    for k in ("a", "b", None):
        for i in range(-20, 200):
            if rng.random() > 0.1:
                rows.append((k, i, None if rng.random() < 0.05 else -1 if rng.random() < 0.05 else int(rng.integers(0, 2))))
    rows = [rows[i] for i in rng.permutation(len(rows))]
    assert collapse(spark, rows, gap=gap, slice_width=width) == brute(rows, gap)


def test_edges(spark):
    assert collapse(spark, []) == set()
    assert collapse(spark, [("a", 3, 1)]) == {("a", 3, 3, 1, 1)}
    assert collapse(spark, [("a", None, 1), ("a", 1, None)]) == set()
    long = [("a", i, 2) for i in range(20_000)]
    assert collapse(spark, long, slice_width=1000) == {("a", 0, 19_999, 20_000, 2)}
    df = spark.createDataFrame([("a", 1, 1, 9, 9)], "k string, i int, v int, first int, _part int")
    assert R.collapse_runs(df, ["k"], "i", "v").columns == ["k", "first", "last", "n", "label"]


def test_similar_labels(spark):
    """The most similar pair merges first, the larger part gives the label, and gaps stop it."""
    like = {(2, 3): 0.8, (3, 2): 0.8, (1, 2): 0.6, (2, 1): 0.6}
    rows = [("a", i, v) for i, v in enumerate([1, 1, 2, 2, 2, 3, 3, 0])] + [("b", 0, 2), ("b", 1, 3), ("b", 9, 3)]
    got = collapse(spark, rows, least=0.7, similar=like)
    assert got == {("a", 0, 1, 2, 1), ("a", 2, 6, 5, 2), ("a", 7, 7, 1, 0), ("b", 0, 1, 2, 2), ("b", 9, 9, 1, 3)}
    assert collapse(spark, rows, least=0.7, similar=like, slice_width=2) == got
    assert ("a", 0, 6, 7, 2) in collapse(spark, rows, least=0.5, similar=like)


def test_priority():
    """With a chain 0-1-2 where 1-2 is more alike, 1 and 2 merge before 0 and 1."""
    arr = np.arange(3)
    keep, last, n, label = R.agglomerate(np.zeros(3, int), arr, arr, np.array([1, 1, 2]), np.array([0, 1, 2]), least=0.5, similar={(0, 1): 0.6, (1, 2): 0.9, (0, 2): 0.0})
    assert keep.tolist() == [0, 1] and n.tolist() == [1, 3]


def greedy(rows, least, gap, similar):
    """One entity's list, merged pair by pair as the definition says, without queue or slices."""
    runs = [[i, i, 1, v] for i, v in sorted(rows) if v is not None and v >= 0]
    blocked = [i for i, v in rows if v is None or v < 0]
    while True:
        pairs = []
        for a, b in zip(runs, runs[1:]):
            likeness = 1.0 if a[3] == b[3] else similar.get((a[3], b[3]), 0.0)
            space = b[0] - a[1]
            if likeness >= least and space <= gap and not any(a[1] < x < b[0] for x in blocked):
                pairs.append((-likeness, space, a[0], a, b))
        if not pairs:
            return {tuple(r) for r in runs}
        _, _, _, a, b = min(pairs, key=lambda p: p[:3])
        a[:] = [a[0], b[1], a[2] + b[2], b[3] if b[2] > a[2] else a[3]]
        runs.remove(b)


@pytest.mark.parametrize("seed,gap,width", [(0, 1, 4096), (1, 2, 7), (2, 3, 16), (3, 2, 1)])
def test_near_identical_against_brute_force(spark, seed, gap, width):
    rng = np.random.default_rng(seed)
    like = {(1, 2): 0.8, (2, 1): 0.7, (2, 3): 0.9, (3, 2): 0.9, (4, 0): 0.4}
    rows, want = [], set()
    for k in ("a", "b", None):
        own = [(i, None if rng.random() < 0.06 else int(rng.integers(0, 5))) for i in range(-30, 150) if rng.random() > 0.15]
        rows += [(k, *r) for r in own]
        want |= {(k, *r) for r in greedy(own, 0.65, gap, like)}
    assert collapse(spark, [rows[i] for i in rng.permutation(len(rows))], gap=gap, slice_width=width, least=0.65, similar=like) == want


def test_equal_neighbours_come_from_the_queue(spark, monkeypatch):
    """With equal labels only, as in p5_found, every merge is a pair taken from the queue."""
    rows = [("a", i, v) for i, v in enumerate([2, 2, 2, 0, 0, 1, 2, 2, -1, -1, 3, 3])] + [("b", i, 1) for i in range(5)] + [("c", 0, 1), ("c", 7, 1)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    given, taken = [], []
    with monkeypatch.context() as m:
        plain = type(df).mapInArrow
        m.setattr(type(df), "mapInArrow", lambda d, f, schema: given.append((d, f)) or plain(d, f, schema))
        R.collapse_runs(df, ["k"], "i", "v")
    pop = R.heapq.heappop
    monkeypatch.setattr(R.heapq, "heappop", lambda q: taken.append(q[0]) or pop(q))
    (laid, work), = given
    got = [r for batch in work(iter(laid.coalesce(1).toArrow().combine_chunks().to_batches())) for r in batch.to_pylist()]
    events = sum(v >= 0 for _, _, v in rows)
    assert {(r["_k0"], r["first"], r["last"], r["n"], r["label"]) for r in got} == brute(rows)
    assert len(taken) == events - len(got) == 9


@pytest.mark.parametrize("seed,gap,width", [(0, 1, 4096), (1, 2, 7), (2, 3, 16)])
def test_unlike_labels_as_alike_as_equal_ones(spark, seed, gap, width):
    """Among pairs alike in full the smaller gap and then the earlier goes first, whether labels are equal or not."""
    like = {(1, 2): 1.0, (2, 1): 1.0, (2, 3): 0.9000001, (3, 2): 0.9}
    assert collapse(spark, [("a", 0, 1), ("a", 1, 2), ("a", 2, 2)], least=0.8, similar=like, gap=gap, slice_width=width) == {("a", 0, 2, 3, 1)}
    rng = np.random.default_rng(seed)
    own = [(i, None if rng.random() < 0.06 else int(rng.integers(0, 4))) for i in range(-30, 120) if rng.random() > 0.15]
    for least in (0.8, 1.0):
        assert collapse(spark, [("a", *r) for r in own], least=least, similar=like, gap=gap, slice_width=width) == {("a", *r) for r in greedy(own, least, gap, like)}


def test_versions_and_repeats(spark):
    rows = [("a", 1, "2020-01-01", 1), ("a", 1, "2021-01-01", 2), ("a", 2, None, 1), ("a", 2, "2020-01-01", 2), ("a", 3, "2020-01-01", 2), ("a", 3, "2021-01-01", None), ("a", 4, "2020-01-01", 0), ("a", 4, "2020-01-01", 2)]
    df = spark.createDataFrame(rows, "k string, i int, at string, v int").selectExpr("k", "i", "cast(at as timestamp_ntz) at", "v")
    of = lambda d: sorted(tuple(r) for r in d.collect())
    assert of(R.collapse_runs(df, ["k"], "i", "v", version="at")) == [("a", 1, 2, 2, 2), ("a", 4, 4, 1, 2)]
    assert of(R.collapse_runs(df, ["k"], "i", "v")) == [("a", 1, 4, 4, 2)]


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(R.F, "xxhash64", lambda *_: R.F.lit(5).cast("bigint"))
    rng = np.random.default_rng(7)
    rows = [(k, i, int(rng.integers(0, 2))) for k in ("a", "b", None) for i in range(90)]
    for width in (4096, 10):
        assert collapse(spark, rows, slice_width=width) == brute(rows)
