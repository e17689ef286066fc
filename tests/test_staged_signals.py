"""Hypnograms on signals: late channels, gaps in epochs, recordings without one; tapers and resampling of any length."""

import numpy as np
import pytest

from nightloom.functions import dsp
from nightloom.plans import detect

SF = 100.0


def night(seconds=60, at=(19, 49), channel="C3", skip=0.0, seed=0):
    """Chunks of a second with 13 Hz bursts of a second; the first ``skip`` seconds are missing."""
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * SF)) / SF
    x = rng.normal(size=len(t)) * 3
    for s in at:
        w = (t >= s) & (t < s + 1)
        x[w] += 60 * np.sin(2 * np.pi * 13 * t[w]) * np.hanning(w.sum())
    step = int(SF)
    return [("r", channel, 0, i, x[i : i + step].tolist()) for i in range(int(skip * SF), len(x), step)]


def signal(spark, rows):
    return spark.createDataFrame(rows, "recording_id string, channel string, ch_idx int, start_sample bigint, values array<double>")


def starts(spark, rows, epochs, **kw):
    stages = None if epochs is None else spark.createDataFrame(epochs, "recording_id string, epoch int, code int")
    return sorted(round(r.Start) for r in detect.spindles(signal(spark, rows), SF, stages, **kw).collect())


def test_stages_reach_late_channels(spark):
    both = starts(spark, night(), None)
    assert both == [19, 49]
    assert starts(spark, night(), [("r", 0, 0), ("r", 1, 0)]) == []
    assert starts(spark, night(skip=3), [("r", 0, 0), ("r", 1, 0)]) == []
    assert starts(spark, night(skip=3), [("r", 0, 2), ("r", 1, 0)]) == [19]


def test_epochs_count_by_number(spark):
    assert starts(spark, night(), [("r", 0, 0), ("r", 1, 2)]) == [49]
    assert starts(spark, night(), [("r", 1, 2)]) == [49]
    assert starts(spark, night(), [("r", 1, 2), ("r", 7, 2), ("r", -1, 2), ("r", 0, None)]) == [49]
    assert starts(spark, night(), [("other", 0, 2), ("other", 1, 2)]) == []
    assert starts(spark, night(), []) == []


def test_power_by_stage(spark):
    rows = night(at=(32, 36, 40, 44))
    stages = spark.createDataFrame([("r", 0, 0), ("r", 1, 2)], "recording_id string, epoch int, code int")
    got = {r.code: r for r in detect.bandpower(signal(spark, rows), SF, [(0.5, 12, "low"), (12, 15, "sigma"), (15, 30, "high")], stages).collect()}
    assert set(got) == {0, 2} and got[2].sigma > 3 * got[0].sigma


@pytest.mark.parametrize("n", [1, 2, 60, 501, 1000])
def test_tapers_are_eigenvectors(n):
    t, k = np.arange(n), min(n, 7)
    m = np.diag(((n - 1 - 2 * t) / 2) ** 2 * np.cos(2 * np.pi * 4.0 / n)) + np.diag(t[1:] * (n - t[1:]) / 2, 1) + np.diag(t[1:] * (n - t[1:]) / 2, -1)
    want = np.linalg.eigh(m)[1][:, ::-1][:, :k].T
    got = dsp.slepian(n, 4.0, k)
    assert got.shape == (k, n) and np.abs(np.abs((got * want).sum(1)) - 1).max() < 1e-9


def test_long_tapers_are_orthonormal_eigenvectors():
    n = 6000
    got = dsp.slepian(n, 4.0, 7)
    assert np.abs(got @ got.T - np.eye(7)).max() < 1e-10
    t = np.arange(n)
    image = ((n - 1 - 2 * t) / 2) ** 2 * np.cos(2 * np.pi * 4.0 / n) * got
    off = t[1:] * (n - t[1:]) / 2
    image[:, 1:] += off * got[:, :-1]
    image[:, :-1] += off * got[:, 1:]
    value = (image * got).sum(1, keepdims=True)
    assert np.abs(image - value * got).max() / np.abs(value).max() < 1e-9


def test_resampled_blocks_join(monkeypatch):
    x = np.random.default_rng(0).normal(size=(2, 997))
    whole = dsp.resample(x, 3, 7)
    monkeypatch.setattr(dsp, "_BLOCK", 50)
    assert np.abs(dsp.resample(x, 3, 7) - whole).max() < 1e-12


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 9, 60, 300])
def test_spline_against_dense_system(n):
    y = np.random.default_rng(n).normal(size=(2, n))
    at = np.linspace(-1, n, 57)
    got = dsp.spline(y, at)
    x = np.clip(at, 0, n - 1)
    if n < 4:
        want = np.stack([np.interp(x, np.arange(n), row) for row in y])
    else:
        a = np.zeros((n, n))
        rhs = np.zeros((n, 2))
        a[0, :3] = a[-1, -3:] = [1, -2, 1]
        for i in range(1, n - 1):
            a[i, i - 1 : i + 2] = [1, 4, 1]
            rhs[i] = 6 * (y[:, i - 1] - 2 * y[:, i] + y[:, i + 1])
        m = np.linalg.solve(a, rhs).T
        i = np.minimum(x.astype(int), n - 2)
        u = x - i
        want = y[:, i] * (1 - u) + y[:, i + 1] * u + ((1 - u) ** 3 - (1 - u)) * m[:, i] / 6 + (u**3 - u) * m[:, i + 1] / 6
    assert np.abs(got - want).max() < 1e-10


def test_stft_at_samples():
    x = np.sin(2 * np.pi * 10 * np.arange(1000) / SF) * np.linspace(0, 5, 1000)
    f, t, coarse = dsp.stft(x, SF)
    _, fine_t, fine = dsp.stft(x, SF, interp=True)
    assert fine.shape == (len(f), 1000) and np.abs(fine[:, ::20] - coarse[:, :50]).max() < 1e-12
    assert np.abs(dsp.stft(x, SF, norm=True, interp=True)[2].sum(0) - 1).max() < 1e-9 and len(fine_t) == 1000
