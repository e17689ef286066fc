"""Consensus labels against planted truth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom.llm import consensus as C


def planted(spark, n=600, seed=0):
    """Five annotators: three good, a spammer, and one who calls 3 always 2."""
    rng = np.random.default_rng(seed)
    truth = rng.choice(5, n, p=[0.2, 0.1, 0.4, 0.15, 0.15])
    rows = []
    for i, t in enumerate(truth.tolist()):
        for a, p in (("g1", 0.9), ("g2", 0.9), ("g3", 0.75)):
            rows.append((i, a, t if rng.random() < p else int(rng.integers(5))))
        rows.append((i, "spam", int(rng.choice(5, p=[0.1, 0.1, 0.6, 0.1, 0.1]))))
        rows.append((i, "mixes", 2 if t == 3 else (t if rng.random() < 0.85 else int(rng.integers(5)))))
    return truth, spark.createDataFrame(rows, "item int, who string, label int")


def test_beats_majority(spark):
    truth, votes = planted(spark)
    got = C.consensus(votes, ["item"], "who", "label", 5)
    items = got.items.toPandas().set_index("item").label.sort_index().to_numpy()
    counts = np.zeros((len(truth), 5))
    for r in votes.collect():
        counts[r.item, r.label] += 1
    majority = (counts.argmax(1) == truth).mean()
    assert (items == truth).mean() > max(0.93, majority)
    three = truth == 3
    assert (items[three] == 3).mean() > (counts.argmax(1)[three] == 3).mean()
    who = {r.who: r for r in got.annotators.collect()}
    assert who["g1"].accuracy > 0.85 > who["spam"].accuracy and who["spam"].accuracy < 0.5
    assert who["g1"].n_votes == len(truth) and len(who["g1"].guesses) == 25


@pytest.mark.parametrize("listed", [20_000, 2])
def test_equals_plain_em(spark, listed):
    """Both layouts, parameters in the tasks and parameters joined, give what EM over single votes in NumPy gives."""
    truth, votes = planted(spark, 150, 3)
    got = C.consensus(votes, ["item"], "who", "label", 5, plain_rounds=3, rounds=6, tolerance=0.0, listed=listed)
    pdf = votes.toPandas()
    names = sorted(pdf.who.unique())
    a, item, lab = pdf.who.map(names.index).to_numpy(), pdf.item.to_numpy(), pdf.label.to_numpy()
    theta, guess, prior = np.full(5, 0.7), np.full((5, 5, 5), 0.2), np.full(5, 0.2)

    def post():
        p = (1 - theta)[:, None, None] * guess
        p[:, range(5), range(5)] += theta[:, None]
        s = np.tile(np.log(prior), (len(truth), 1))
        np.add.at(s, item, np.log(p[a, :, lab]))
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    for k in range(1, 7):
        q = post()
        counts = np.zeros((5, 5, 5))
        np.add.at(counts, (a, slice(None), lab), q[item])
        theta, guess = C.mixture_step(counts, theta, guess, None if k <= 3 else 30.0)
        prior = (q.sum(0) + 0.5) / (q.sum(0) + 0.5).sum()
    q = post()
    items = got.items.toPandas().set_index("item").sort_index()
    assert items.confidence.to_numpy() == pytest.approx(q.max(1), abs=1e-6)
    assert (items.label.to_numpy() == q.argmax(1)).all()


@pytest.mark.parametrize("listed", [20_000, 1])
def test_last_version_counts(spark, listed):
    s = "item int, who string, at string, label int"
    rows = [(1, "a", "2020-01-01", 2), (1, "a", "2021-01-01", 3), (1, "b", None, 4), (1, "b", "1999-01-01", 0), (2, "a", "2020-01-01", 1), (2, "a", "2021-01-01", None), (2, "b", "2020-01-01", 1), (2, "b", "2020-01-01", 2)]
    votes = spark.createDataFrame(rows, s).withColumn("at", F.to_timestamp_ntz("at"))
    got = C.consensus(votes, ["item"], "who", "label", 5, version="at", rounds=2, plain_rounds=1, listed=listed, tolerance=1.0)
    items = {r.item: r for r in got.items.collect()}
    assert (items[1].n_votes, items[1].n_labels) == (2, 2) and items[1].label in (0, 3)
    assert (items[2].n_votes, items[2].label) == (1, 2)
    unversioned = {r.item: r for r in C.consensus(votes, ["item"], "who", "label", 5, rounds=2, plain_rounds=1, listed=listed, tolerance=1.0).items.collect()}
    assert (unversioned[1].n_votes, unversioned[2].n_votes) == (4, 3)


def test_plain_mixture_has_one_guess_distribution(spark):
    _, votes = planted(spark, 200, 5)
    for r in C.consensus(votes, ["item"], "who", "label", 5, habits=None).annotators.collect():
        g = np.array(r.guesses).reshape(5, 5)
        assert np.allclose(g, g[0])


@pytest.mark.parametrize("listed", [20_000, 0])
def test_edges(spark, listed):
    s = "item int, x string, who string, label int"
    rows = [(1, None, "a", 2), (1, None, "b", 2), (2, "k", "a", 0), (3, "k", None, 1), (3, "k", "a", None), (3, "k", "b", 9), (4, "k", "a", 1), (4, "k", "b", 3)]
    got = C.consensus(spark.createDataFrame(rows, s), ["item", "x"], "who", "label", 5, listed=listed)
    items = {r.item: r for r in got.items.collect()}
    assert set(items) == {1, 2, 4}
    assert (items[1].label, items[1].agreement, items[1].n_labels) == (2, 1.0, 1)
    assert (items[2].label, items[2].agreement, items[2].confidence) == (0, None, None)
    assert items[4].agreement == 0.0 and items[4].label in (1, 3)
    empty = C.consensus(spark.createDataFrame([], s), ["item"], "who", "label", 5, listed=listed)
    assert empty.items.count() == 0 and empty.annotators.count() == 0
    single = C.consensus(spark.createDataFrame([(1, "k", "a", 2)], s), ["item"], "who", "label", 5, listed=listed)
    assert single.items.first().label == 2 and single.annotators.first().accuracy is None
    extra = C.consensus(spark.createDataFrame(rows, s).withColumn("_a", F.lit(1)).withColumn("fp1", F.lit(2)), ["item"], "who", "label", 5, listed=listed)
    assert extra.items.count() == 3
