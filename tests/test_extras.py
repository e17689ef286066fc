"""Coupling of bands, spindle peaks by spatial filters, nonlinear features."""

import math

import numpy as np
import pytest

from nightloom.functions import entropy
from nightloom.plans import detect

SF = 100.0


def signal(spark, channels, recording="r"):
    rows = [(recording, name, k, i, x[i : i + 700].tolist()) for k, (name, x) in enumerate(channels.items()) for i in range(0, len(x), 700)]
    return spark.createDataFrame(rows, "recording_id string, channel string, ch_idx int, start_sample bigint, values array<double>")


def test_comodulogram(spark):
    rng = np.random.default_rng(0)
    t = np.arange(int(90 * SF)) / SF
    slow = np.sin(2 * np.pi * 1.0 * t)
    coupled = 50 * slow + 10 * (1 + slow) * np.sin(2 * np.pi * 13 * t) + rng.normal(size=len(t))
    free = 50 * slow + 10 * np.sin(2 * np.pi * 13 * t) + rng.normal(size=len(t))
    bands = [(0.5, 1.5), (2.5, 3.5)], [(7.0, 9.0), (11.0, 15.0)]
    got = {(r.channel, r.phase_low, r.amp_low): r for r in detect.comodulogram(signal(spark, {"c": coupled, "f": free, "short": t[:100]}), SF, *bands).collect()}
    assert len(got) == 8 and got["c", 0.5, 11.0].windows == 6
    best = max((r for r in got.values() if r.channel == "c"), key=lambda r: r.pac)
    assert (best.phase_low, best.amp_low) == (0.5, 11.0) and best.pac > 0.02 > 10 * got["f", 0.5, 11.0].pac
    stages = spark.createDataFrame([("r", 0, 2), ("r", 1, 0), ("r", 2, 2)], "recording_id string, epoch int, code int")
    some = detect.comodulogram(signal(spark, {"c": coupled}), SF, *bands, stages).collect()
    assert {r.windows for r in some} == {4}


def test_spindle_peaks(spark):
    rng = np.random.default_rng(1)
    t = np.arange(int(200 * SF)) / SF
    burst = lambda f, every: np.sin(2 * np.pi * f * t) * (np.sin(2 * np.pi * t / every) > 0.5)
    a, b = burst(11.0, 7), burst(13.6, 11)
    mix = np.array([[1.0, 0.2], [0.8, 0.5], [0.4, 0.9], [0.1, 1.0]]) * 20
    channels = {f"C{i}": m[0] * a + m[1] * b + 3 * rng.normal(size=len(t)) for i, m in enumerate(mix)}
    r = detect.spindle_peaks(signal(spark, channels), SF, block=7).collect()
    assert len(r) == 1 and abs(r[0].slow_peak - 11.0) <= 0.2 and abs(r[0].fast_peak - 13.6) <= 0.2
    assert r[0].components == 2 and len(r[0].eigenvalues) == 4 and list(r[0].eigenvalues) == sorted(r[0].eigenvalues, reverse=True)
    again = detect.spindle_peaks(signal(spark, channels), SF, block=1000).collect()[0]
    assert again.slow_psd == pytest.approx(r[0].slow_psd, rel=1e-6)
    assert detect.spindle_peaks(signal(spark, {"one": channels["C0"]}), SF).count() == 0
    assert detect.spindle_peaks(signal(spark, {"one": t[:10], "two": t[:10]}), SF).count() == 0


def test_sample_entropy_brute():
    x = np.random.default_rng(0).normal(size=(3, 80))
    for row, got in zip(x, entropy.sample_entropy(x)):
        limit, n = 0.2 * row.std(), len(row)
        count = lambda m: sum(np.abs(row[i : i + m] - row[j : j + m]).max() <= limit for i in range(n - 2) for j in range(i + 1, n - 2))
        assert got == pytest.approx(-math.log(count(3) / count(2)))
    assert np.isnan(entropy.sample_entropy(np.array([[0.0, 50.0, 10.0, 90.0, 30.0]]))).all()


def test_other_entropies():
    rng = np.random.default_rng(2)
    noise, walk, sine = rng.normal(size=2000), np.cumsum(rng.normal(size=2000)), np.sin(np.arange(2000) / 20)
    x = np.stack([noise, walk, sine])
    svd, dfa, katz, lz = entropy.svd_entropy(x), entropy.detrended_fluctuation(x), entropy.katz(x), entropy.lempel_ziv(x)
    assert svd[0] > 0.99 > 0.2 > svd[1:].max()
    assert abs(dfa[0] - 0.5) < 0.15 and abs(dfa[1] - 1.5) < 0.15
    assert katz[0] > katz[2] >= 1.0
    assert abs(lz[0] - 1) < 0.15 and lz[2] < 0.2
    flat = np.ones((1, 100))
    assert np.isnan(entropy.detrended_fluctuation(flat)).all() and np.isnan(entropy.katz(flat)).all()
    assert entropy.lempel_ziv(np.array([[0.0, 1.0] * 8])) == pytest.approx([3 * 4 / 16])
