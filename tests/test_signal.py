"""Kernels and detectors against brute force and planted events."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom.functions import dsp, entropy, forest, riemann
from nightloom.operators import heart
from nightloom.operators import windows as W
from nightloom.plans import detect, staging

SF = 100.0


def pink(n, seed=0, scale=10.0):
    rng = np.random.default_rng(seed)
    f = np.fft.rfftfreq(n, 1 / SF)
    a = np.fft.rfft(rng.normal(size=n))
    a[1:] /= np.maximum(f[1:], 0.5) ** 0.75
    a[0] = 0
    x = np.fft.irfft(a, n)
    return x / x.std() * scale


def signal(spark, channels, rec="r"):
    rows = []
    for i, (name, x) in enumerate(channels.items()):
        rows += [(rec, name, i, s, [float(v) for v in x[s : s + 3000]]) for s in range(0, len(x), 3000)]
    return spark.createDataFrame(rows, "recording_id string, channel string, ch_idx int, start_sample bigint, values array<double>")


def test_filter():
    t = np.arange(6000) / SF
    x = np.sin(2 * np.pi * 13 * t) + np.sin(2 * np.pi * 3 * t)
    assert np.abs(dsp.bandpass(x, SF, 12, 15, 1.5, 1.5) - np.sin(2 * np.pi * 13 * t))[300:-300].max() < 0.01
    half = dsp.bandpass(np.sin(2 * np.pi * 11.25 * t), SF, 12, 15, 1.5, 1.5)
    assert np.abs(half[500:-500]).max() == pytest.approx(0.5, abs=0.01)
    assert dsp.bandpass(x[:50], SF, 12, 15).shape == (50,)


def test_spectra():
    rng = np.random.default_rng(0)
    f, p = dsp.welch(rng.normal(size=60000), SF, 400)
    assert p[5:-5].mean() * SF / 2 == pytest.approx(1, abs=0.03)
    f, p = dsp.welch(rng.normal(size=60000), SF, 400, "mean")
    assert p[5:-5].mean() * SF / 2 == pytest.approx(1, abs=0.03)
    f, t, s = dsp.stft(pink(3000), SF, 4, 1, (11, 16), norm=True)
    assert f[0] == 11 and f[-1] == 16 and f[1] - f[0] == 0.25 and np.allclose(s.sum(0), 1)
    n = 60000
    f, flat, osc = dsp.irasa(pink(n, 3) + 2 * np.sin(2 * np.pi * 10 * np.arange(n) / SF), SF)
    assert dsp.aperiodic_fit(f, flat)[1] == pytest.approx(-1.5, abs=0.1)
    assert f[osc.argmax()] == 10


def test_multitaper(spark):
    tapers = dsp.slepian(500, 4, 7)
    assert np.allclose(tapers @ tapers.T, np.eye(7), atol=1e-9)
    inside = np.abs(np.fft.rfft(tapers[0], 1 << 16)) ** 2
    assert inside[: int(4 / 500 * (1 << 16))].sum() / inside.sum() > 0.999
    f, t, p = dsp.multitaper(np.random.default_rng(0).normal(size=60000), SF, 5.0)
    assert t[0] == 2.5 and p.shape[1] == 120 and p[5:-5].mean() * SF / 2 == pytest.approx(1, abs=0.03)
    assert detect.multitaper_spectrogram(signal(spark, {"a": pink(9000)}), SF).count() == 3
    assert detect.multitaper_spectrogram(signal(spark, {"a": pink(900)}), SF).count() == 0


def test_peaks():
    x = np.array([0, 1, 0, 3, 3, 3, 0, 2, 0, 5], float)
    p, prom, left, right = dsp.find_peaks(x)
    assert p.tolist() == [1, 4, 7] and prom.tolist() == [1, 3, 2]
    assert dsp.find_peaks(x, height=(2, 3))[0].tolist() == [4, 7]
    assert dsp.find_peaks(x, prominence=2.5)[0].tolist() == [4]
    assert dsp.crossings(np.array([4, 2, -1, -3, 1, 2, 3, -2, -5])).tolist() == [1, 3, 6]
    assert dsp.stretches(np.array([4, 5, 6, 7, 10, 11, 12, 13, 20, 21, 22, 100, 102]), 10) == [(4, 22), (100, 102)]


def brute_peaks(x, distance, reach):
    p = [i for i in range(1, len(x) - 1) if x[i - 1] < x[i] > x[i + 1]]
    kept = []
    for i in sorted(p, key=lambda i: -x[i]):
        if all(abs(i - j) >= distance for j in kept):
            kept.append(i)
    out = []
    for i in sorted(kept):
        bases = []
        for step in (-1, 1):
            j, best = i, i
            while 0 <= j + step < len(x) and abs(j + step - i) <= reach // 2 and x[j + step] <= x[i]:
                j += step
                best = j if x[j] < x[best] else best
            bases.append(best)
        out.append((i, x[i] - max(x[b] for b in bases), *bases))
    return out


@pytest.mark.parametrize("distance,reach", [(1, 10_000), (7, 60), (25, 301)])
def test_peaks_against_brute_force(distance, reach):
    x = pink(3000, distance)
    p, prom, left, right = dsp.find_peaks(x, distance=distance, reach=reach)
    got = list(zip(p.tolist(), prom.tolist(), left.tolist(), right.tolist()))
    want = brute_peaks(x, distance, reach)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want]) and [g[2:] for g in got] == [w[2:] for w in want]


def test_entropy_and_outliers():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3, 2000))
    assert np.all(entropy.permutation_entropy(x) > 0.99)
    assert np.all(np.abs(entropy.higuchi(x) - 2) < 0.1)
    line = np.arange(200.0)[None]
    assert entropy.permutation_entropy(line)[0] == pytest.approx(0) and entropy.higuchi(line)[0] == pytest.approx(1)
    cloud = np.vstack([rng.normal(size=(200, 2)), [[12, 12]]])
    assert not forest.inliers(cloud)[-1] and forest.inliers(cloud)[:-1].mean() > 0.6
    assert forest.inliers(cloud[:10]).all()
    c = riemann.covariances(rng.normal(size=(40, 5, 300)))
    c[7] *= 30
    assert riemann.potato(c).argmax() == 7


def test_spindles(spark):
    n, rng = 60 * 100 * 4, np.random.default_rng(5)
    x = pink(n)
    planted = [20.0, 45.0, 90.0, 130.0, 180.0, 210.0]
    for s in planted:
        t = np.arange(int(1.0 * SF)) / SF
        x[int(s * SF) : int(s * SF) + len(t)] += 40 * np.sin(2 * np.pi * 13.3 * t) * np.sin(np.pi * t)
    found = detect.spindles(signal(spark, {"C3": x, "flat": np.zeros(n), "loud": x * 1e6}), SF).toPandas()
    assert set(found.channel) == {"C3"}
    hit = [any(abs(p - s - 0.5) < 0.5 for p in found.Peak) for s in planted]
    assert np.mean(hit) >= 0.8 and len(found) <= len(planted) + 4
    assert found.Frequency.between(12, 15).all() and found.Duration.between(0.5, 2).all()
    stages = spark.createDataFrame([("r", e, 2 if e < 4 else 0) for e in range(8)], "recording_id string, epoch int, code int")
    some = detect.spindles(signal(spark, {"C3": x}), SF, stages).toPandas()
    assert (some.Start < 121).all() and len(some) and (some.Stage == 2).all()
    assert detect.spindles(signal(spark, {"C3": x}).limit(0), SF).count() == 0
    with pytest.raises(ValueError):
        detect.spindles(signal(spark, {"C3": x}), SF, rel_pow=None, corr=None, rms=None)


def test_slow_waves(spark):
    n = 60 * 100 * 3
    x = pink(n, 1, 5.0)
    planted = [15.0, 40.0, 77.0, 120.0, 150.0]
    t = np.arange(int(1.25 * SF)) / SF
    for s in planted:
        x[int(s * SF) : int(s * SF) + len(t)] += -80 * np.sin(2 * np.pi * 0.8 * t)
    found = detect.slow_waves(signal(spark, {"Fz": x}), SF, coupling=True).toPandas()
    hit = [any(abs(p - s - 0.3) < 0.3 for p in found.NegPeak) for s in planted]
    assert np.mean(hit) >= 0.8 and (found.PTP > 75).all()
    assert found.ndPAC.notna().all() and found.SigmaPeak.sub(found.NegPeak).abs().max() <= 1
    assert (found.Start < found.NegPeak).all() and (found.MidCrossing < found.PosPeak).all() and (found.PosPeak < found.End).all()


def test_rems(spark):
    n = 60 * 100 * 2
    loc, roc = pink(n, 2, 4.0), pink(n, 3, 4.0)
    planted = [10.0, 30.0, 55.0, 80.0, 100.0]
    t = np.arange(int(0.6 * SF)) / SF
    for s in planted:
        bump = 120 * np.sin(np.pi * t / 0.6) ** 2
        loc[int(s * SF) : int(s * SF) + len(t)] += bump
        roc[int(s * SF) : int(s * SF) + len(t)] -= bump
    found = detect.rapid_eye_movements(signal(spark, {"LOC": loc, "ROC": roc}), SF).toPandas()
    hit = [any(abs(p - s - 0.3) < 0.3 for p in found.Peak) for s in planted]
    assert np.mean(hit) >= 0.8 and len(found) <= 2 * len(planted)
    assert detect.rapid_eye_movements(signal(spark, {"LOC": loc}), SF).count() == 0


def test_artefacts(spark):
    n = 500 * 60
    data = {f"c{i}": pink(n, 10 + i) for i in range(6)}
    for x in data.values():
        x[500 * 20 : 500 * 21] *= 12
        x[500 * 50 : 500 * 51] = 0
    epochs = detect.epoch_arrays(signal(spark, data), SF, 5.0)
    for method in ("covar", "std"):
        bad = {r.epoch for r in detect.artefacts(epochs, method=method).where("artefact").collect()}
        assert {20, 50} <= bad and len(bad) < 8
    assert detect.epoch_arrays(signal(spark, {"a": pink(300)}), SF, 5.0).count() == 0
    few = epochs.where("ch_idx < 3")
    assert {r.epoch for r in detect.artefacts(few).where("artefact").collect()} >= {20, 50}


def test_heart(spark):
    rr = np.array([800, 810, 790, 805, 5000, 795, 800] * 10)
    beats = np.cumsum(np.concatenate([[0], rr])) / 1000
    df = spark.createDataFrame([("r", float(b)) for b in beats], "r string, beat double").withColumn("duration", F.lit(60.0))
    got = heart.variability(df, ["r"]).first()
    clean = np.where(rr > 2000, np.nan, rr).astype(float)
    clean = np.interp(np.arange(len(rr)), np.flatnonzero(~np.isnan(clean)), clean[~np.isnan(clean)])
    assert got.hrv_rmssd == pytest.approx(np.sqrt((np.diff(clean) ** 2).mean()))
    assert got.hr_std == pytest.approx((60000 / clean).std(ddof=1))
    assert heart.variability(df.where("beat < 1"), ["r"]).first().hr_mean is None
    assert heart.variability(df.limit(0), ["r"]).count() == 0
    ecg = np.zeros(3000)
    at = np.arange(50, 2950, 83)
    for a in at:
        ecg[a - 2 : a + 3] += [100, 400, 900, 350, 80]
    found = [r.beat for r in detect.heartbeats(signal(spark, {"ECG": ecg + pink(3000)}), SF).collect()]
    assert len(found) == pytest.approx(len(at), abs=2)
    assert np.mean([min(abs(f - a / SF) for f in found) < 0.05 for a in at]) > 0.9


def test_bandpower(spark):
    t = np.arange(12000) / SF
    s = signal(spark, {"a": 20 * np.sin(2 * np.pi * 10 * t) + pink(12000, 1, 1.0)})
    bands = [(0.5, 4, "Delta"), (8, 12, "Alpha"), (12, 16, "Sigma")]
    r = detect.bandpower(s, SF, bands).first()
    assert r.Alpha > 0.95
    a = detect.bandpower(s, SF, bands, relative=False).first()
    assert a.Alpha == pytest.approx(r.Alpha * r.TotalAbsPow)
    assert detect.bandpower(s, SF, [(0.5, 30, "all")]).first().all == pytest.approx(1)
    assert detect.aperiodic(s, SF).count() == 1 and detect.spectrogram(s, SF).count() > 100
    assert detect.filtered(s, SF, 8, 12).count() == 1 and detect.resampled(s, 1, 2).count() == 1


def test_moving(spark):
    rng = np.random.default_rng(42)
    x, y = rng.normal(size=200), rng.normal(size=200)
    df = spark.createDataFrame([("a", i, float(p), float(q), 200) for i, (p, q) in enumerate(zip(x, y))], "k string, sample bigint, x double, y double, n bigint")
    centre = np.arange(0, 2, 0.1)
    lo = np.maximum(np.trunc((centre - 0.25) * 100).astype(int), 0)
    hi = np.minimum(np.trunc((centre + 0.25) * 100).astype(int), 200)
    f = {
        "mean": lambda a, b, t: a.mean(), "min": lambda a, b, t: a.min(), "max": lambda a, b, t: a.max(), "ptp": lambda a, b, t: np.ptp(a), "rms": lambda a, b, t: np.sqrt((a**2).mean()),
        "prop_above_zero": lambda a, b, t: (a >= 0).mean(), "slope": lambda a, b, t: np.polyfit(t / 100, a, 1)[0], "covar": lambda a, b, t: np.cov(a, b)[0, 1], "corr": lambda a, b, t: np.corrcoef(a, b)[0, 1],
    }
    for method in W.MOVING:
        got = W.moving(df, ["k"], "sample", "x", "n", 100.0, 0.5, 0.1, method, "y").orderBy("window").collect()
        want = [f[method](x[a:b], y[a:b], np.arange(a, b)) for a, b in zip(lo, hi)]
        assert [r.value for r in got] == pytest.approx(want, rel=1e-6), method
    t, r = dsp.moving(x, 100.0, 0.5, 0.1, "rms")
    assert r == pytest.approx([f["rms"](x[a:b], None, None) for a, b in zip(lo, hi)])


def test_arrays(spark):
    df = spark.createDataFrame([([4.0, 2.0, -1.0, -3.0, 1.0, 2.0, 3.0, -2.0, -5.0],), ([1.0],), ([2.0, 2.0, 2.0],)], "a array<double>")
    assert [r[0] for r in df.select(W.zero_crossings(F.col("a"))).collect()][0] == [1, 3, 6]
    assert [r[0] for r in df.select(W.local_peaks(F.col("a"), 0, 9)).collect()] == [[6], [], []]
    assert df.select(W.trimmed_sd(F.col("a"), 0.2)).first()[0] == pytest.approx(dsp.trimmed_sd(np.array([4.0, 2, -1, -3, 1, 2, 3, -2, -5]), 0.2))
    assert [len(r[0]) for r in df.select(W.sliding_arrays(F.col("a"), 3, 2)).collect()] == [4, 0, 1]
    w = W.simpson_weights(5, 1.0)
    assert sum(c * i**3 for i, c in enumerate(w)) == pytest.approx(64)
    w = W.simpson_weights(4, 1.0)
    assert sum(c * i**2 for i, c in enumerate(w)) == pytest.approx(9)


def test_staging(spark):
    n = 3000 * 20
    s = signal(spark, {"C4": pink(n, 1), "EOG": pink(n, 2), "EMG": pink(n, 3)})
    table = staging.features(s, SF, {"C4": "eeg", "EOG": "eog", "EMG": "emg"}).cache()
    assert len(table.columns) == 2 + 149 and table.count() == 20
    assert table.columns[2:] == staging.feature_names()
    labelled = table.withColumn("code", (F.col("epoch") % 2) * 2)
    model = staging.train(labelled, trees=5)
    p = staging.majority_only(staging.predict(model, table)).collect()
    assert len(p) == 20 and {r.code for r in p} <= {0, 1, 2}
    with pytest.raises(ValueError):
        staging.predict(model, table.drop("eeg_std"))
