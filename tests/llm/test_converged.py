"""Consensus run until nothing moves: what very many plain rounds of EM give, and a warning where it was stopped."""

import numpy as np
import pytest

from nightloom.llm import consensus as C

from .test_consensus import planted


def test_converged(spark):
    truth, votes = planted(spark, 150, 3)
    got = C.consensus(votes, ["item"], "who", "label", 5)
    assert got.converged and got.rounds < 200
    pdf = votes.toPandas()
    names = sorted(pdf.who.unique())
    a, item, lab = pdf.who.map(names.index).to_numpy(), pdf.item.to_numpy(), pdf.label.to_numpy()
    theta, guess, prior = np.full(5, 0.7), np.full((5, 5, 5), 0.2), np.full(5, 0.2)
    for k in range(1, 3002):
        p = (1 - theta)[:, None, None] * guess
        p[:, range(5), range(5)] += theta[:, None]
        s = np.tile(np.log(prior), (len(truth), 1))
        np.add.at(s, item, np.log(p[a, :, lab]))
        q = np.exp(s - s.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        counts = np.zeros((5, 5, 5))
        np.add.at(counts, (a, slice(None), lab), q[item])
        theta, guess = C.mixture_step(counts, theta, guess, None if k <= 6 else 30.0)
        prior = (q.sum(0) + 0.5) / (q.sum(0) + 0.5).sum()
    items = got.items.toPandas().set_index("item").sort_index()
    assert items.confidence.to_numpy() == pytest.approx(q.max(1), abs=2e-3)
    assert (items.label.to_numpy() == q.argmax(1)).all()


def test_stopped_is_told(spark):
    _, votes = planted(spark, 60, 1)
    with pytest.warns(UserWarning, match="not converged"):
        assert not C.consensus(votes, ["item"], "who", "label", 5, rounds=3).converged
