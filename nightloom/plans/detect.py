"""Detectors on multichannel signals.

A signal is ``(recording_id, channel, ch_idx, start_sample, values array<double>)``
in chunks of any length (half a minute, say), in microvolts, at one sampling
frequency ``sf`` a call; stages, if given, are ``(recording_id, epoch, code)``
with ``freq_sec`` seconds an epoch. Filters need a channel from end to end, so
the unit of work is one channel of one recording: a night at 200 Hz is 46 MB.
Chunks are put in order and joined inside the kernel; a gap counts as zeros.

Every detector gives event rows, none where the reference would give nothing;
channels without chunks, empty chunks and null values (taken as zeros) are no
error. Stages are taken from the recording's own table by the number of the
epoch and are unscored where it has none; a recording without a hypnogram is
unscored from end to end, if stages are given at all. Channels whose trimmed SD isn't within 0.1 to 1000 are skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dsp, forest, riemann
from ..functions.dist import erfinv

_ID = ["recording_id", "channel", "ch_idx"]


def with_stages(signal: DataFrame, stages: DataFrame | None) -> DataFrame:
    """``signal`` plus ``codes``, and a row a channel that has no samples but the recording's ``epoch, code, epoch, code, ...`` there.

    The samples meet no join: the hypnogram comes as one more row of a channel's
    group. A recording without one has an empty list.
    """
    none = F.lit(None).cast("array<int>")
    parts = signal.select(*_ID, "start_sample", "values", none.alias("codes"))
    if stages is None:
        return parts
    known = stages.where("epoch >= 0").groupBy("recording_id").agg(F.collect_list(F.array(F.col("epoch").cast("int"), F.coalesce(F.col("code").cast("int"), F.lit(-2)))).alias("s"))
    channels = signal.select(*_ID).distinct().join(known, "recording_id", "left")
    codes = F.coalesce(F.flatten("s"), F.array().cast("array<int>"))
    types = dict(parts.dtypes)
    return parts.unionByName(channels.select(*_ID, *[F.lit(None).cast(types[c]).alias(c) for c in ("start_sample", "values")], codes.alias("codes")))


def joined(pdf: pd.DataFrame) -> np.ndarray:
    """One channel's samples in order."""
    pdf = pdf.sort_values("start_sample")
    chunks = [(int(s), np.nan_to_num(np.asarray(v, float))) for s, v in zip(pdf["start_sample"], pdf["values"]) if v is not None and len(v)]
    if not chunks:
        return np.zeros(0)
    x = np.zeros(max(s + len(v) for s, v in chunks))
    for s, v in chunks:
        x[s : s + len(v)] = v
    return x


def stage_at(pdf: pd.DataFrame, n: int, sf: float, freq_sec: float) -> np.ndarray | None:
    """Stage code of each sample by its epoch's number, unscored where the hypnogram has none; null where no stages were given."""
    found = [c for c in pdf["codes"] if c is not None]
    if not found:
        return None
    pairs = np.asarray(found[0], int).reshape(-1, 2)
    epoch = (np.arange(n) / (freq_sec * sf)).astype(int)
    codes = np.full(int(epoch.max(initial=0)) + 1, -2)
    pairs = pairs[pairs[:, 0] < len(codes)]
    codes[pairs[:, 0]] = pairs[:, 1]
    return codes[epoch]


def usable(x: np.ndarray) -> bool:
    return len(x) > 10 and 0.1 < dsp.trimmed_sd(x, 0.05) < 1000


def _per_channel(signal: DataFrame, stages: DataFrame | None, columns: Sequence[str], kernel: Callable, sf: float, freq_sec: float) -> DataFrame:
    """``kernel(x, stage) -> dict of arrays`` on every channel."""
    schema = "recording_id string, channel string, ch_idx int, " + ", ".join(columns)
    names = [c.split()[0] for c in columns]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        x = joined(pdf)
        found = kernel(x, stage_at(pdf, len(x), sf, freq_sec)) if usable(x) else {}
        rows = pd.DataFrame({n: found.get(n, []) for n in names})
        for c in reversed(_ID):
            rows.insert(0, c, pdf[c].iloc[0] if len(rows) else pd.Series(dtype=object))
        return rows

    return with_stages(signal, stages).groupBy(*_ID).applyInPandas(work, schema)


SPINDLE = ["Start double", "Peak double", "End double", "Duration double", "Amplitude double", "AmpFiltered double", "RMS double", "AbsPower double", "RelPower double", "Frequency double", "Oscillations int", "Symmetry double", "Stage int"]


def spindles(
    signal: DataFrame,
    sf: float,
    stages: DataFrame | None = None,
    *,
    freq_sec: float = 30.0,
    include: Sequence[int] = (1, 2, 3),
    band: tuple[float, float] = (12, 15),
    broad: tuple[float, float] = (1, 30),
    duration: tuple[float, float] = (0.5, 2),
    min_distance_ms: float = 500,
    rel_pow: float | None = 0.2,
    corr: float | None = 0.65,
    rms: float | None = 1.5,
    remove_outliers: bool = False,
) -> DataFrame:
    """Sigma bursts where relative sigma power, correlation of the band with the whole and band RMS all cross their thresholds.

    A null threshold is not used; one at least is needed. The RMS threshold is
    its mean plus so many trimmed SD over the included stages, at most 10.
    """
    votes_needed = sum(t is not None for t in (rel_pow, corr, rms))
    if not votes_needed:
        raise ValueError("one threshold at least is needed")

    def kernel(x: np.ndarray, stage: np.ndarray | None) -> dict:
        n = len(x)
        allowed = np.ones(n, bool) if stage is None else np.isin(stage, include)
        if not allowed.any() or n < 2 * sf:
            return {}
        wide = dsp.bandpass(x, sf, *broad)
        sigma = dsp.bandpass(x, sf, *band, 1.5, 1.5)
        wave = dsp.analytic(sigma)
        power = np.abs(wave) ** 2
        freq = sf / (2 * np.pi) * np.diff(np.angle(wave))
        f, t, spectrum = dsp.stft(wide, sf, 2, 0.2, broad, norm=True)
        share = np.nan_to_num(spectrum[(f >= band[0]) & (f <= band[1])].sum(0))

        votes = np.zeros(n)
        if rel_pow is not None:
            votes += dsp.at_samples(t, share, n, sf) >= rel_pow
        if corr is not None:
            tc, r = dsp.moving(sigma, sf, 0.3, 0.1, "corr", wide)
            votes += dsp.at_samples(tc, np.nan_to_num(r), n, sf) >= corr
        if rms is not None:
            tr, level = dsp.moving(sigma, sf, 0.3, 0.1, "rms")
            level = dsp.at_samples(tr, np.nan_to_num(level), n, sf)
            votes += level >= min(10.0, level[allowed].mean() + rms * dsp.trimmed_sd(level[allowed]))
        votes[~allowed] = 0
        w = max(1, int(0.1 * sf))
        soft = np.convolve(votes, np.ones(w) / w, "same")
        spans = dsp.stretches(np.flatnonzero(soft > votes_needed - 1), min_distance_ms / 1000 * sf)
        rows = []
        for a, b in spans:
            length = (b - a) / sf
            if not duration[0] < length < duration[1]:
                continue
            part = dsp.detrend(wide[a : b + 1])
            inside = (t >= a / sf) & (t <= b / sf)
            frames = share[inside] if inside.any() else share[[np.argmin(np.abs(t - (a + b) / 2 / sf))]]
            p, g = power[a : b + 1], freq[a : min(b + 1, n - 1)]
            peaks, prominence, _, _ = dsp.find_peaks(part, distance=0.06 * sf)
            if not len(peaks):
                continue
            top = int(peaks[prominence.argmax()])
            rows.append((a / sf, a / sf + top / sf, b / sf, length, np.ptp(part), np.ptp(sigma[a : b + 1]), np.sqrt((part**2).mean()), np.median(np.log10(p[p > 0])) if (p > 0).any() else np.nan, np.median(frames), np.median(g[g > 0]) if (g > 0).any() else np.nan, len(peaks), top / len(part), 0 if stage is None else stage[a]))
        table = pd.DataFrame(rows, columns=[c.split()[0] for c in SPINDLE])
        if remove_outliers and len(table) >= 50:
            table = table[forest.inliers(table[["Duration", "Amplitude", "RMS", "AbsPower", "RelPower", "Frequency", "Oscillations", "Symmetry"]].to_numpy())]
        return {c: table[c].to_numpy() for c in table}

    return _per_channel(signal, stages, SPINDLE, kernel, sf, freq_sec)


WAVE = ["Start double", "NegPeak double", "MidCrossing double", "PosPeak double", "End double", "Duration double", "ValNegPeak double", "ValPosPeak double", "PTP double", "Slope double", "Frequency double", "SigmaPeak double", "PhaseAtSigmaPeak double", "ndPAC double", "Stage int"]


def slow_waves(
    signal: DataFrame,
    sf: float,
    stages: DataFrame | None = None,
    *,
    freq_sec: float = 30.0,
    include: Sequence[int] = (2, 3),
    band: tuple[float, float] = (0.3, 1.5),
    dur_neg: tuple[float, float] = (0.3, 1.5),
    dur_pos: tuple[float, float] = (0.1, 1.0),
    amp_neg: tuple[float, float] = (40, 200),
    amp_pos: tuple[float, float] = (10, 150),
    amp_ptp: tuple[float, float] = (75, 350),
    coupling: bool = False,
    sigma: tuple[float, float] = (12, 16),
    around: float = 1.0,
    p: float = 0.05,
    remove_outliers: bool = False,
) -> DataFrame:
    """A negative peak and the next positive one, with durations and sizes in range; with ``coupling`` the sigma peak within ``around`` seconds, the wave's phase there and their coupling (else null)."""

    def kernel(x: np.ndarray, stage: np.ndarray | None) -> dict:
        n = len(x)
        allowed = np.ones(n, bool) if stage is None else np.isin(stage, include)
        y = dsp.bandpass(x, sf, *band, 0.2, 0.2)
        tops = dsp.local_maxima(y)
        troughs = dsp.local_maxima(-y)
        pos = tops[(y[tops] >= amp_pos[0]) & (y[tops] <= amp_pos[1]) & allowed[tops]]
        neg = troughs[(-y[troughs] >= amp_neg[0]) & (-y[troughs] <= amp_neg[1]) & allowed[troughs]]
        zero = dsp.crossings(y)
        if not len(neg) or not len(pos) or len(zero) < 3:
            return {}
        nxt = np.searchsorted(pos, neg)
        neg, nxt = neg[nxt < len(pos)], nxt[nxt < len(pos)]
        if not len(neg):
            return {}
        pos = pos[nxt]
        # the wave is bounded by the crossings before the trough and after the peak, and one between
        i, j = np.searchsorted(zero, neg), np.searchsorted(zero, pos)
        inside = (i > 0) & (j > 0) & (i < len(zero)) & (j < len(zero))
        neg, pos, i, j = neg[inside], pos[inside], i[inside], j[inside]
        start, mid, before, end = zero[i - 1], zero[i], zero[j - 1], zero[j]
        below, above = (mid - start) / sf, (end - before) / sf
        whole = np.round((end - start) / sf, 4)
        ptp = -y[neg] + y[pos]
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = -y[neg] / ((mid - neg) / sf)
        good = (ptp > amp_ptp[0]) & (ptp < amp_ptp[1]) & (start < neg) & (mid > neg) & (before < pos) & (end > pos) & (whole == np.round(below + above, 4))
        good &= (whole >= dur_neg[0] + dur_pos[0]) & (whole <= dur_neg[1] + dur_pos[1]) & (below > dur_neg[0]) & (below < dur_neg[1]) & (above > dur_pos[0]) & (above < dur_pos[1])
        good &= (mid > start) & (mid < end) & np.isfinite(slope) & (slope > 0)
        cols = {"Start": start / sf, "NegPeak": neg / sf, "MidCrossing": mid / sf, "PosPeak": pos / sf, "End": end / sf, "Duration": whole, "ValNegPeak": y[neg], "ValPosPeak": y[pos], "PTP": ptp, "Slope": slope, "Frequency": 1 / np.maximum(whole, 1e-9), "Stage": np.zeros(len(neg), int) if stage is None else stage[neg]}
        table = pd.DataFrame(cols)[good]
        centres = neg[good]
        table["SigmaPeak"] = table["PhaseAtSigmaPeak"] = table["ndPAC"] = np.nan
        if coupling and len(table):
            phase, amp = np.angle(dsp.analytic(y)), np.abs(dsp.analytic(dsp.bandpass(x, sf, *sigma, 1.5, 1.5)))
            half = int(around * sf)
            for row, c in zip(table.index, centres):
                if c - half < 0 or c + half >= n:
                    continue
                a, f = amp[c - half : c + half + 1], phase[c - half : c + half + 1]
                k = int(a.argmax())
                z = (a - a.mean()) / max(a.std(ddof=1), 1e-300)
                r = abs((z * np.exp(1j * f)).sum())
                table.loc[row, ["SigmaPeak", "PhaseAtSigmaPeak", "ndPAC"]] = (c - half + k) / sf, f[k], 0.0 if r * r <= 2 * len(a) * erfinv(1 - p) ** 2 else r / len(a)
        for c in ("Start", "End"):
            table = table.drop_duplicates(c, keep=False)
        if remove_outliers and len(table) >= 50:
            table = table[forest.inliers(table[["Duration", "ValNegPeak", "ValPosPeak", "PTP", "Slope", "Frequency"]].to_numpy())]
        return {c: table[c].to_numpy() for c in table}

    return _per_channel(signal, stages, WAVE, kernel, sf, freq_sec)


REM = ["Start double", "Peak double", "End double", "Duration double", "LOCAbsValPeak double", "ROCAbsValPeak double", "LOCAbsRiseSlope double", "ROCAbsRiseSlope double", "LOCAbsFallSlope double", "ROCAbsFallSlope double", "Stage int"]


def rapid_eye_movements(
    signal: DataFrame,
    sf: float,
    stages: DataFrame | None = None,
    *,
    loc: str = "LOC",
    roc: str = "ROC",
    freq_sec: float = 30.0,
    include: Sequence[int] = (4,),
    band: tuple[float, float] = (0.5, 5),
    amplitude: tuple[float, float] = (50, 325),
    duration: tuple[float, float] = (0.3, 1.2),
    relative_prominence: float = 0.8,
    remove_outliers: bool = False,
) -> DataFrame:
    """Opposite deflections of both eyes: peaks of their negative product. Both channels must be usable."""
    names = [c.split()[0] for c in REM]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = (joined(pdf[pdf["channel"] == c]) for c in (loc, roc))
        n = min(len(left), len(right))
        rows = pd.DataFrame(columns=["recording_id", *names])
        if n == 0 or not usable(left[:n]) or not usable(right[:n]):
            return rows
        stage = stage_at(pdf, n, sf, freq_sec)
        allowed = np.ones(n, bool) if stage is None else np.isin(stage, include)
        eyes = dsp.bandpass(np.stack([left[:n], right[:n]]), sf, *band)
        low, high = amplitude[0] ** 2, amplitude[1] ** 2
        peak, _, a, b = dsp.find_peaks(-eyes[0] * eyes[1], (low, high), duration[0] * sf, relative_prominence * low, duration[1] * sf)
        length = (b - a) / sf
        keep = allowed[peak] & (np.sign(eyes[0][peak]) != np.sign(eyes[1][peak])) & (length >= duration[0]) & (length < duration[1])
        peak, a, b, length = peak[keep], a[keep], b[keep], length[keep]
        cols = {"Start": a / sf, "Peak": peak / sf, "End": b / sf, "Duration": length, "Stage": np.zeros(len(peak), int) if stage is None else stage[a]}
        for k, side in enumerate(("LOC", "ROC")):
            e = eyes[k]
            with np.errstate(divide="ignore", invalid="ignore"):
                cols[f"{side}AbsValPeak"] = np.abs(e[peak])
                cols[f"{side}AbsRiseSlope"] = np.abs((e[peak] - e[a]) / ((peak - a) / sf))
                cols[f"{side}AbsFallSlope"] = np.abs((e[b] - e[peak]) / ((b - peak) / sf))
        table = pd.DataFrame(cols)[names]
        if remove_outliers and len(table) >= 50:
            table = table[forest.inliers(table.drop(columns=["Start", "Peak", "End", "Stage"]).to_numpy())]
        table.insert(0, "recording_id", pdf["recording_id"].iloc[0])
        return table

    eyes = with_stages(signal.where(F.col("channel").isin(loc, roc)), stages)
    return eyes.groupBy("recording_id").applyInPandas(work, "recording_id string, " + ", ".join(REM))


def epoch_arrays(signal: DataFrame, sf: float, window: float) -> DataFrame:
    """``(recording_id, channel, ch_idx, epoch, values)``: whole tumbling windows of a channel, cut inside the chunks' group."""
    width = int(round(window * sf))
    schema = "recording_id string, channel string, ch_idx int, epoch int, values array<double>"

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        x = joined(pdf)
        n = len(x) // width
        if not n:
            return pd.DataFrame(columns=[*_ID, "epoch", "values"])
        parts = x[: n * width].reshape(n, width)
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in _ID}, "epoch": np.arange(n, dtype=np.int32), "values": list(parts)})

    return signal.groupBy(*_ID).applyInPandas(work, schema)


def artefacts_covar(epochs: DataFrame, stages: DataFrame | None = None, *, window: float = 5.0, freq_sec: float = 30.0, include: Sequence[int] = (1, 2, 3, 4), threshold: float = 3.0, least_epochs: int = 30, shrinkage: float = 0.1) -> DataFrame:
    """``(recording_id, epoch, code, z, artefact)`` by the distance of an epoch's channel covariance from its stage's mean.

    epochs: as :func:`epoch_arrays`. One task makes an epoch's small matrix;
    another holds the matrices of one recording's stage, not its samples.
    Epochs with half their channels flat are artefacts without a z; epochs that
    lack a channel others have are not judged. Without stages all epochs are
    judged together.
    """

    def matrix(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("ch_idx")["values"].to_numpy())
        flat = float((x == x[:, :1]).all(1).mean()) >= 0.5
        c = riemann.covariances(x[None], shrinkage)[0]
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[:1], "epoch": pdf["epoch"].iloc[:1], "c": [c.ravel()], "flat": flat})

    mats = epochs.groupBy("recording_id", "epoch").applyInPandas(matrix, "recording_id string, epoch int, c array<double>, flat boolean")
    if stages is None:
        mats = mats.withColumn("code", F.lit(-2))
        judged = (-2,)
    else:
        at = stages.select("recording_id", F.col("epoch").alias("_e"), F.col("code").cast("int").alias("code"))
        mats = mats.withColumn("_e", F.floor(F.col("epoch") * window / freq_sec).cast("int")).join(at, ["recording_id", "_e"], "left").drop("_e").withColumn("code", F.coalesce("code", F.lit(-2)))
        judged = tuple(include)

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("epoch", ignore_index=True)
        size = pdf["c"].map(len).to_numpy()
        flat = pdf["flat"].to_numpy()
        good = ~flat & (size == size.max())
        z = np.full(len(pdf), np.nan)
        if pdf["code"].iloc[0] in judged and good.sum() >= least_epochs:
            k = int(round(len(pdf["c"].iloc[0]) ** 0.5))
            z[good] = riemann.potato(np.stack(pdf["c"].to_numpy()[good]).reshape(-1, k, k), threshold)
        return pd.DataFrame({"recording_id": pdf["recording_id"], "epoch": pdf["epoch"], "code": pdf["code"], "z": z, "artefact": flat | (np.nan_to_num(z) > threshold)})

    return mats.groupBy("recording_id", "code").applyInPandas(judge, "recording_id string, epoch int, code int, z double, artefact boolean")


def artefacts(epochs: DataFrame, stages: DataFrame | None = None, *, method: str = "covar", window: float = 5.0, freq_sec: float = 30.0, include: Sequence[int] = (1, 2, 3, 4), threshold: float = 3.0, n_chan_reject: int = 1) -> DataFrame:
    """``(recording_id, epoch, code, artefact)`` by covariance (``covar``) or spread (``std``); recordings of four channels or fewer are judged by spread."""
    from ..operators.windows import artefacts as by_spread

    if method not in ("covar", "std"):
        raise ValueError(method)
    n = epochs.groupBy("recording_id").agg(F.countDistinct("channel").alias("_n"))
    if stages is None:
        coded = epochs.withColumn("code", F.lit(-2))
    else:
        at = stages.select("recording_id", F.col("epoch").alias("_e"), F.col("code").cast("int").alias("code"))
        coded = epochs.withColumn("_e", F.floor(F.col("epoch") * window / freq_sec).cast("int")).join(at, ["recording_id", "_e"], "left").drop("_e").withColumn("code", F.coalesce("code", F.lit(-2)))
        coded = coded.where(F.col("code").isin(*include))
    few = coded if method == "std" else coded.join(n.where("_n <= 4"), "recording_id", "left_semi")
    out = by_spread(few, ["recording_id"], "channel", "code", "values", threshold, n_chan_reject).select("recording_id", "epoch", "code", "artefact")
    if method == "covar":
        many = epochs.join(n.where("_n > 4"), "recording_id", "left_semi")
        out = out.unionByName(artefacts_covar(many, stages, window=window, freq_sec=freq_sec, include=include, threshold=threshold).select("recording_id", "epoch", "code", "artefact"))
    return out


def heartbeats(signal: DataFrame, sf: float) -> DataFrame:
    """``(recording_id, channel, beat)``: R-peak times in seconds of every channel of an ECG.

    Squared slope of the 5-20 Hz band, averaged over 0.15 s; peaks above a
    share of the surrounding level, a quarter of a second apart, set to the
    largest deflection near by.
    """

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        x = joined(pdf)
        rows = pd.DataFrame({"recording_id": pd.Series(dtype=str), "channel": pd.Series(dtype=str), "beat": pd.Series(dtype=float)})
        if len(x) < 2 * sf or x.std() == 0:
            return rows
        y = dsp.bandpass(x, sf, 5, min(20, sf / 2 * 0.8))
        w = max(1, int(0.15 * sf))
        energy = np.convolve(np.gradient(y) ** 2, np.ones(w) / w, "same")
        block = max(1, int(5 * sf))
        top = np.array([energy[i : i + block].max() for i in range(0, len(energy), block)])
        level = np.interp(np.arange(len(energy)), np.arange(len(top)) * block + block / 2, top)
        peaks = dsp.spaced(energy, dsp.local_maxima(energy), int(np.ceil(0.25 * sf)))
        peaks = peaks[energy[peaks] > 0.25 * level[peaks]]
        half = int(0.1 * sf)
        beats = sorted({int(max(0, p - half) + np.abs(y[max(0, p - half) : p + half + 1]).argmax()) for p in peaks})
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[0], "channel": pdf["channel"].iloc[0], "beat": np.array(beats) / sf})

    return signal.groupBy("recording_id", "channel").applyInPandas(work, "recording_id string, channel string, beat double")


def spectra(signal: DataFrame, sf: float, stages: DataFrame | None = None, *, window: float = 4.0, freq_sec: float = 30.0, average: str = "median", include: Sequence[int] | None = None) -> DataFrame:
    """``(recording_id, channel, ch_idx, code, freqs, psd)``: Welch spectrum of each stage's joined samples; all samples under null without stages."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        x = joined(pdf)
        stage = stage_at(pdf, len(x), sf, freq_sec)
        rows = []
        for code in [None] if stage is None else [int(c) for c in np.unique(stage) if include is None or c in include]:
            part = x if code is None else x[stage == code]
            if len(part) < int(window * sf):
                continue
            f, psd = dsp.welch(part, sf, int(window * sf), average)
            rows.append({**{c: pdf[c].iloc[0] for c in _ID}, "code": code, "freqs": f, "psd": psd})
        return pd.DataFrame(rows, columns=[*_ID, "code", "freqs", "psd"])

    return with_stages(signal, stages).groupBy(*_ID).applyInPandas(work, "recording_id string, channel string, ch_idx int, code int, freqs array<double>, psd array<double>")


def bandpower(signal: DataFrame, sf: float, bands: Sequence[tuple[float, float, str]], stages: DataFrame | None = None, *, window: float = 4.0, freq_sec: float = 30.0, relative: bool = True, include: Sequence[int] | None = None) -> DataFrame:
    """Band power of each channel (and stage): the spectrum by a kernel, its integration by Catalyst."""
    from ..operators.windows import band_power

    grid = np.fft.rfftfreq(int(window * sf), 1 / sf).tolist()
    s = spectra(signal, sf, stages, window=window, freq_sec=freq_sec, include=include)
    return band_power(s, [*_ID, "code"], "freqs", "psd", bands, grid, relative)


def aperiodic(signal: DataFrame, sf: float, *, band: tuple[float, float] = (1, 30), window: float = 4.0) -> DataFrame:
    """``(recording_id, channel, ch_idx, freqs, aperiodic, oscillatory, intercept, slope, r2, sd_osc)`` of each channel."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        x = joined(pdf)
        names = ["freqs", "aperiodic", "oscillatory", "intercept", "slope", "r2", "sd_osc"]
        if len(x) < 2 * window * sf:
            return pd.DataFrame(columns=[*_ID, *names])
        f, flat, osc = dsp.irasa(x, sf, band, window=window)
        a, b, r2 = dsp.aperiodic_fit(f, np.maximum(flat, 1e-300))
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in _ID}, **dict(zip(names, (f, flat, osc, a, b, r2, float(osc.std(ddof=1)))))}])

    return signal.groupBy(*_ID).applyInPandas(work, "recording_id string, channel string, ch_idx int, freqs array<double>, aperiodic array<double>, oscillatory array<double>, intercept double, slope double, r2 double, sd_osc double")


def spectrogram(signal: DataFrame, sf: float, *, window: float = 2.0, step: float = 0.2, band: tuple[float, float] = (1, 30), norm: bool = False, interp: bool = False) -> DataFrame:
    """``(recording_id, channel, t, freqs, power)``: one row a frame, or a sample with ``interp``."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        x = joined(pdf)
        if len(x) < window * sf:
            return pd.DataFrame(columns=["recording_id", "channel", "t", "freqs", "power"])
        f, t, p = dsp.stft(x, sf, window, step, band, norm, interp)
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[0], "channel": pdf["channel"].iloc[0], "t": t, "freqs": [f] * len(t), "power": list(p.T)})

    return signal.groupBy("recording_id", "channel").applyInPandas(work, "recording_id string, channel string, t double, freqs array<double>, power array<double>")


def multitaper_spectrogram(signal: DataFrame, sf: float, *, window: float = 30.0, band: tuple[float, float] = (0.5, 25)) -> DataFrame:
    """``(recording_id, channel, t, freqs, decibel)``: the data of a full-night spectrogram, one row a window."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        f, t, p = dsp.multitaper(joined(pdf), sf, window)
        if not len(t):
            return pd.DataFrame(columns=["recording_id", "channel", "t", "freqs", "decibel"])
        keep = (f >= band[0]) & (f <= band[1])
        with np.errstate(divide="ignore"):
            level = 10 * np.log10(p[keep])
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[0], "channel": pdf["channel"].iloc[0], "t": t, "freqs": [f[keep]] * len(t), "decibel": list(level.T)})

    return signal.groupBy("recording_id", "channel").applyInPandas(work, "recording_id string, channel string, t double, freqs array<double>, decibel array<double>")


def filtered(signal: DataFrame, sf: float, low: float, high: float, low_width: float | None = None, high_width: float | None = None) -> DataFrame:
    """``signal`` band-passed, one chunk a channel."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        y = dsp.bandpass(joined(pdf), sf, low, high, low_width, high_width)
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in _ID}, "start_sample": 0, "values": y}])

    return signal.groupBy(*_ID).applyInPandas(work, "recording_id string, channel string, ch_idx int, start_sample bigint, values array<double>")


def resampled(signal: DataFrame, up: int, down: int) -> DataFrame:
    """``signal`` at ``up / down`` times its rate, one chunk a channel."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in _ID}, "start_sample": 0, "values": dsp.resample(joined(pdf), up, down)}])

    return signal.groupBy(*_ID).applyInPandas(work, "recording_id string, channel string, ch_idx int, start_sample bigint, values array<double>")


def comodulogram(signal: DataFrame, sf: float, phase_bands: Sequence[tuple[float, float]], amp_bands: Sequence[tuple[float, float]], stages: DataFrame | None = None, *, freq_sec: float = 30.0, include: Sequence[int] = (2,), window: float = 15.0, bins: int = 18) -> DataFrame:
    """``(recording_id, channel, ch_idx, phase_low, phase_high, amp_low, amp_high, pac, windows)``: phase-amplitude coupling of every pair of bands.

    The included stages' samples are joined and filtered once per band, with
    transitions of half its width; in each whole window the amplitude's mean by bin of the phase is compared with an
    even one (divergence over its greatest value: 0 none, 1 full coupling), and
    windows are averaged. Without stages all samples count; channels shorter
    than a window give no rows.
    """

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        x = joined(pdf)
        stage = stage_at(pdf, len(x), sf, freq_sec)
        x = x if stage is None else x[np.isin(stage, include)]
        width = int(round(window * sf))
        n = len(x) // width
        names = ["phase_low", "phase_high", "amp_low", "amp_high", "pac", "windows"]
        if not n:
            return pd.DataFrame(columns=[*_ID, *names])
        cut = lambda y: y[: n * width].reshape(n, width)
        wave = lambda b: dsp.analytic(dsp.bandpass(x, sf, *b, *[min((b[1] - b[0]) / 2, b[0])] * 2))
        amps = [cut(np.abs(wave(b))) for b in amp_bands]
        rows = []
        for p in phase_bands:
            place = np.clip(np.floor((cut(np.angle(wave(p))) + np.pi) / (2 * np.pi) * bins).astype(int), 0, bins - 1)
            flat = (place + np.arange(n)[:, None] * bins).ravel()
            count = np.bincount(flat, minlength=n * bins).reshape(n, bins)
            for a, amp in zip(amp_bands, amps):
                mean = np.bincount(flat, weights=amp.ravel(), minlength=n * bins).reshape(n, bins) / np.maximum(count, 1)
                share = mean / np.maximum(mean.sum(1, keepdims=True), 1e-300)
                gone = np.where(share > 0, share * np.log(np.maximum(share, 1e-300)), 0.0).sum(1)
                rows.append((*(pdf[c].iloc[0] for c in _ID), *map(float, (*p, *a)), float((1 + gone / np.log(bins)).mean()), n))
        return pd.DataFrame(rows, columns=[*_ID, *names])

    return with_stages(signal, stages).groupBy(*_ID).applyInPandas(work, "recording_id string, channel string, ch_idx int, phase_low double, phase_high double, amp_low double, amp_high double, pac double, windows int")


def spindle_peaks(signal: DataFrame, sf: float, stages: DataFrame | None = None, *, freq_sec: float = 30.0, include: Sequence[int] = (2,), slow: tuple[float, float] = (10, 12), fast: tuple[float, float] = (12.5, 15), band: tuple[float, float] = (10, 15), window: float = 5.0, components: int = 2, block: int = 64) -> DataFrame:
    """``(recording_id, components, slow_peak, fast_peak, freqs, slow_psd, fast_psd, eigenvalues)``: slow and fast spindle frequency by spatial filters.

    Filters are the generalised eigenvectors of the channels' covariance in the
    slow and the fast band; the spectra of the ``components`` most different
    ones either way are averaged, and each peaks where it is greatest. A
    component's spectrum follows from the cross-spectra of the channels, so a
    task holds a channel, or ``block`` windows of all channels, and in the end a
    recording's small matrices. Recordings with one channel, or less than a
    window, give no row; channels that lack a window others have end it there.
    """
    width = int(round(window * sf))
    taper = np.hamming(width)
    freqs = np.fft.rfftfreq(width, 1 / sf)
    kept = np.flatnonzero((freqs >= band[0]) & (freqs <= band[1]))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        x = joined(pdf)
        stage = stage_at(pdf, len(x), sf, freq_sec)
        x = x if stage is None else x[np.isin(stage, include)]
        n = len(x) // width
        if not n:
            return pd.DataFrame(columns=["recording_id", "ch_idx", "w", "raw", "low", "high"])
        parts = [list(y[: n * width].reshape(n, width)) for y in (x, dsp.bandpass(x, sf, *slow, 1.0, 1.0), dsp.bandpass(x, sf, *fast, 1.0, 1.0))]
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[0], "ch_idx": pdf["ch_idx"].iloc[0], "w": np.arange(n), "raw": parts[0], "low": parts[1], "high": parts[2]})

    windows = with_stages(signal, stages).groupBy(*_ID).applyInPandas(split, "recording_id string, ch_idx int, w int, raw array<double>, low array<double>, high array<double>")
    windows = windows.withColumn("b", F.floor(F.col("w") / block))

    def matrices(pdf: pd.DataFrame) -> pd.DataFrame:
        """Sums over a block's windows, one channel order for all."""
        order = np.sort(pdf["ch_idx"].unique())
        cross, low, high, n = 0.0, 0.0, 0.0, 0
        for _, one in pdf.sort_values("ch_idx").groupby("w"):
            if len(one) != len(order):
                continue
            raw, l, h = (np.stack(one[c].to_numpy()) for c in ("raw", "low", "high"))
            z = np.fft.rfft((raw - raw.mean(1, keepdims=True)) * taper)[:, kept]
            cross = cross + np.real(np.einsum("cf,df->fcd", z, z.conj()))
            low, high, n = low + l @ l.T, high + h @ h.T, n + 1
        if not n:
            return pd.DataFrame(columns=["recording_id", "channels", "n", "cross", "low", "high"])
        return pd.DataFrame([{"recording_id": pdf["recording_id"].iloc[0], "channels": order, "n": n, "cross": cross.ravel(), "low": low.ravel(), "high": high.ravel()}])

    sums = windows.groupBy("recording_id", "b").applyInPandas(matrices, "recording_id string, channels array<int>, n int, cross array<double>, low array<double>, high array<double>")

    def peaks(pdf: pd.DataFrame) -> pd.DataFrame:
        names = ["recording_id", "components", "slow_peak", "fast_peak", "freqs", "slow_psd", "fast_psd", "eigenvalues"]
        full = max(pdf["channels"].map(len))
        pdf = pdf[pdf["channels"].map(len) == full]
        if full < 2:
            return pd.DataFrame(columns=names)
        total = lambda c, *shape: np.sum(pdf[c].to_numpy(), axis=0).reshape(*shape, full, full)
        low, high, cross = total("low"), total("high"), total("cross", len(kept))
        # slow against fast: whiten by the fast covariance, then an ordinary eigenproblem
        value, vector = np.linalg.eigh(high)
        white = vector / np.sqrt(np.maximum(value, value.max() * 1e-10))
        gain, turn = np.linalg.eigh(white.T @ low @ white)
        filters = (white @ turn)[:, ::-1]
        psd = np.einsum("ck,fcd,dk->kf", filters, cross, filters)
        k = min(components, full // 2)
        ends = [psd[:k].mean(0), psd[-k:].mean(0)]
        f = freqs[kept]
        return pd.DataFrame([dict(zip(names, (pdf["recording_id"].iloc[0], k, float(f[ends[0].argmax()]), float(f[ends[1].argmax()]), f, ends[0], ends[1], gain[::-1])))])

    return sums.groupBy("recording_id").applyInPandas(peaks, "recording_id string, components int, slow_peak double, fast_peak double, freqs array<double>, slow_psd array<double>, fast_psd array<double>, eigenvalues array<double>")
