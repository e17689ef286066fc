"""Signal kernels in plain NumPy: filters, spectra, envelopes, peaks.

All take arrays whose last axis is time. They run inside grouped Arrow
functions, one recording's channel at a time.
"""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache

import numpy as np

_BLOCK = 1 << 15  # samples resampled at a time


def fast_length(n: int) -> int:
    """The smallest 2-3-5-smooth number not below ``n``, quick for FFTs."""
    best = 1 << max(0, (n - 1).bit_length())
    five = 1
    while five < best:
        three = five
        while three < best:
            quotient = -(-n // three)
            best = min(best, three << max(0, (quotient - 1).bit_length()))
            three *= 3
        five *= 5
    return best


def bandpass_taps(sf: float, low: float, high: float, low_width: float | None = None, high_width: float | None = None) -> np.ndarray:
    """Odd, symmetric Hamming-windowed taps of a band-pass.

    Transition bands default to a quarter of the edge, at least 2 Hz and never
    beyond 0 or the Nyquist frequency; the half-amplitude points lie in their
    middles. The length is 3.3 over the narrower one, in seconds. An edge at or
    below 0, or at or above Nyquist, is left out.
    """
    nyquist = sf / 2
    parts = []
    if low > 0:
        width = low_width or min(max(0.25 * low, 2.0), low)
        parts.append((width, low - width / 2, "high"))
    if high < nyquist:
        width = high_width or min(max(0.25 * high, 2.0), nyquist - high)
        parts.append((width, high + width / 2, "low"))
    if not parts:
        return np.ones(1)
    n = int(np.ceil(max(3.3 / w for w, _, _ in parts) * sf))
    n += 1 - n % 2

    def lowpass(cut: float, width: float) -> np.ndarray:
        size = int(np.ceil(3.3 / width * sf))
        size = min(n, size + 1 - size % 2)
        t = np.arange(size) - size // 2
        h = np.sinc(2 * cut / sf * t) * np.hamming(size)
        out = np.zeros(n)
        out[(n - size) // 2 : (n + size) // 2] = h / h.sum()
        return out

    taps = np.zeros(n)
    taps[n // 2] = 1.0
    for width, cut, kind in parts:
        if kind == "low":
            taps = lowpass(cut, width) if low <= 0 else taps - ((np.arange(n) == n // 2) - lowpass(cut, width))
        else:
            taps = taps - lowpass(cut, width)
    return taps


def zero_phase(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Filtered with symmetric taps without delay; the ends are mirrored about their end points."""
    x = np.asarray(x, float)
    n, half = x.shape[-1], len(taps) // 2
    if half == 0 or n == 0:
        return x * taps[0]
    reach = min(half, n - 1)
    left = 2 * x[..., :1] - x[..., reach:0:-1]
    right = 2 * x[..., -1:] - x[..., -2 : -reach - 2 : -1]
    zeros = np.zeros((*x.shape[:-1], half - reach))
    padded = np.concatenate([zeros, left, x, right, zeros], -1)
    size = fast_length(padded.shape[-1] + len(taps) - 1)
    y = np.fft.irfft(np.fft.rfft(padded, size) * np.fft.rfft(taps, size), size)
    return y[..., 2 * half : 2 * half + n]


def bandpass(x: np.ndarray, sf: float, low: float, high: float, low_width: float | None = None, high_width: float | None = None) -> np.ndarray:
    return zero_phase(x, bandpass_taps(sf, low, high, low_width, high_width))


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal by FFT of a fast length."""
    n = x.shape[-1]
    size = fast_length(n)
    spectrum = np.fft.fft(x, size)
    gain = np.zeros(size)
    gain[0] = 1
    gain[1 : (size + 1) // 2] = 2
    if size % 2 == 0:
        gain[size // 2] = 1
    return np.fft.ifft(spectrum * gain)[..., :n]


def _segments(x: np.ndarray, width: int, step: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, width, axis=-1)[..., ::step, :]


def _periodic_hamming(n: int) -> np.ndarray:
    return np.hamming(n + 1)[:-1]


def median_bias(n: int) -> float:
    """Expected median over mean of ``n`` periodograms."""
    k = np.arange(1, (n - 1) // 2 + 1)
    return 1 + float((1 / (2 * k + 1) - 1 / (2 * k)).sum())


def welch(x: np.ndarray, sf: float, width: int, average: str = "median") -> tuple[np.ndarray, np.ndarray]:
    """One-sided spectral density: Hamming windows half overlapping, mean removed, median (bias corrected) or mean over them."""
    x = np.asarray(x, float)
    width = min(width, x.shape[-1])
    window = _periodic_hamming(width)
    parts = _segments(x, width, width - width // 2)
    parts = (parts - parts.mean(-1, keepdims=True)) * window
    power = np.abs(np.fft.rfft(parts)) ** 2 / (sf * (window**2).sum())
    power[..., 1 : None if width % 2 else -1] *= 2
    psd = np.median(power, -2) / median_bias(power.shape[-2]) if average == "median" else power.mean(-2)
    return np.fft.rfftfreq(width, 1 / sf), psd


def spline(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through equally spaced values (last axis, step 1) at positions clipped to them.

    The third derivative is continuous at the second and last but one point, as
    no other end condition is known. Second derivatives solve a system of rows
    (1, 4, 1), whose inverse is a two-sided geometric series: one short
    convolution, and two terms for the ends. Straight lines below four values.
    """
    y = np.asarray(y, float)
    n = y.shape[-1]
    at = np.clip(np.asarray(at, float), 0, n - 1)
    i = np.minimum(at.astype(int), max(n - 2, 0))
    u = at - i
    line = y[..., i] * (1 - u) + y[..., np.minimum(i + 1, n - 1)] * u
    if n < 4:
        return line
    d = 6 * (y[..., :-2] - 2 * y[..., 1:-1] + y[..., 2:])
    m = np.zeros(y.shape)
    m[..., 1], m[..., -2] = d[..., 0] / 6, d[..., -1] / 6
    b = d[..., 1:-1].copy()
    size = b.shape[-1]
    if size:
        b[..., 0] -= m[..., 1]
        b[..., -1] -= m[..., -2]
        r = np.sqrt(3) - 2
        reach = np.arange(-min(size + 1, 40), min(size + 1, 40) + 1)
        kernel = r ** np.abs(reach) / (2 * np.sqrt(3))
        half = len(kernel) // 2
        full = np.apply_along_axis(np.convolve, -1, b, kernel)[..., half - 1 : half + size + 1]  # one place beyond either end
        far = r ** (size + 1)
        first, last = full[..., :1], full[..., -1:]
        a = (far * last - first) / (1 - far * far)
        z = (far * first - last) / (1 - far * far)
        k = np.arange(1, size + 1)
        m[..., 2:-2] = full[..., 1:-1] + a * r**k + z * r ** (size + 1 - k)
    m[..., 0], m[..., -1] = 2 * m[..., 1] - m[..., 2], 2 * m[..., -2] - m[..., -3]
    return line + ((1 - u) ** 3 - (1 - u)) * m[..., i] / 6 + (u**3 - u) * m[..., i + 1] / 6


def stft(x: np.ndarray, sf: float, window: float = 2.0, step: float = 0.2, band: tuple[float, float] | None = (1, 30), norm: bool = False, interp: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(f, t, power)`` of Hann windows centred every ``step`` seconds, zeros beyond the ends.

    interp: power at every sample, by a cubic spline over time; norm: each time
    sums to 1.
    """
    width = int(window * sf)
    hop = width - int(width - step * sf) if step > 0 else 1
    hann = np.hanning(width + 1)[:-1]
    padded = np.concatenate([np.zeros(width // 2), np.asarray(x, float), np.zeros(width // 2)])
    short = -(len(padded) - width) % hop
    parts = _segments(np.concatenate([padded, np.zeros(short)]), width, hop) * hann / hann.sum()
    f = np.fft.rfftfreq(width, 1 / sf)
    keep = slice(None) if band is None else (f >= band[0]) & (f <= band[1])
    power = (np.abs(np.fft.rfft(parts)[:, keep]) ** 2).T
    t = np.arange(power.shape[1]) * hop / sf
    if interp:
        t = np.arange(len(x)) / sf
        power = spline(power, np.arange(len(x)) / hop)
    if norm:
        total = power.sum(0)
        power = np.divide(power, total, out=np.full_like(power, np.nan), where=total > 0)
    return f[keep], t, power


@lru_cache(maxsize=16)
def slepian(n: int, bandwidth: float, k: int) -> np.ndarray:
    """The first ``k`` Slepian tapers of ``n`` samples for a time-bandwidth product.

    They are eigenvectors of a tridiagonal matrix that turns polynomials into
    ones of two degrees more, so low-degree Legendre polynomials hold them to
    rounding, at any length.
    """
    t = np.arange(n)
    diagonal = ((n - 1 - 2 * t) / 2) ** 2 * np.cos(2 * np.pi * bandwidth / n)
    off = t[1:] * (n - t[1:]) / 2
    degree = min(n, 48 + 8 * int(np.ceil(bandwidth)) + 2 * k)
    basis = np.linalg.qr(np.polynomial.legendre.legvander((2 * t - n + 1) / max(n - 1, 1), degree - 1))[0]
    image = diagonal[:, None] * basis
    image[1:] += off[:, None] * basis[:-1]
    image[:-1] += off[:, None] * basis[1:]
    small = basis.T @ image
    tapers = (basis @ np.linalg.eigh((small + small.T) / 2)[1][:, ::-1][:, :k]).T
    return tapers * np.where(tapers.sum(1) < 0, -1, 1)[:, None]


def multitaper(x: np.ndarray, sf: float, window: float = 30.0, bandwidth: float = 4.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(f, t, psd)`` of tumbling windows, averaged over Slepian tapers; t is the middle of a window."""
    width = int(window * sf)
    parts = _segments(np.asarray(x, float), width, width) if len(x) >= width else np.zeros((0, width))
    parts = parts - parts.mean(-1, keepdims=True)
    tapers = slepian(width, bandwidth, max(1, int(2 * bandwidth) - 1))
    power = (np.abs(np.fft.rfft(parts[:, None, :] * tapers)) ** 2).mean(1) / sf
    power[:, 1 : None if width % 2 else -1] *= 2
    return np.fft.rfftfreq(width, 1 / sf), (np.arange(len(parts)) + 0.5) * window, power.T


def at_samples(t: np.ndarray, v: np.ndarray, n: int, sf: float) -> np.ndarray:
    """Straight lines between ``(t, v)`` at ``n`` samples; 0 before the first and after the last."""
    return np.interp(np.arange(n) / sf, t, v, left=0.0, right=0.0)


def resample_taps(up: int, down: int) -> np.ndarray:
    """Taps of :func:`resample` for coprime factors."""
    longest = max(up, down)
    t = np.arange(-10 * longest, 10 * longest + 1)
    h = np.sinc(t / longest) * np.kaiser(len(t), 5.0)
    return h * (up / h.sum())


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Rational resampling with a Kaiser-windowed low-pass at the lower Nyquist frequency (polyphase, in blocks of output)."""
    g = np.gcd(up, down)
    up, down = up // g, down // g
    if up == down == 1:
        return np.array(x, float)
    h = resample_taps(up, down)
    half = len(h) // 2
    n = x.shape[-1]
    out_n = -(-n * up // down)
    # every output sample meets the input samples that fall on its phase of the taps
    taps = -(-len(h) // up)
    phases = np.zeros((up, taps))
    for p in range(up):
        part = h[p::up]
        phases[p, : len(part)] = part
    x = np.asarray(x, float)
    out = np.empty((*x.shape[:-1], out_n))
    for at in range(0, out_n, _BLOCK):
        k = np.arange(at, min(at + _BLOCK, out_n)) * down + half
        first, phase = k // up, k % up
        reach = first[:, None] - np.arange(taps)
        inside = (reach >= 0) & (reach < n)
        rows = x[..., np.where(inside, reach, 0)]
        out[..., at : at + len(k)] = np.einsum("...ij,ij->...i", rows, phases[phase] * inside)
    return out


def irasa(x: np.ndarray, sf: float, band: tuple[float, float] = (1, 30), factors: np.ndarray | None = None, window: float = 4.0, average: str = "median") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(f, aperiodic, oscillatory)``: the median over factors h of the geometric mean of spectra resampled by h and 1/h."""
    factors = np.round(np.arange(1.1, 1.95, 0.05), 4) if factors is None else factors
    width = int(window * sf)
    f, psd = welch(x, sf, width, average)
    means = []
    for h in factors:
        ratio = Fraction(str(h))
        up = welch(resample(x, ratio.numerator, ratio.denominator), h * sf, width, average)[1]
        down = welch(resample(x, ratio.denominator, ratio.numerator), sf / h, width, average)[1]
        m = min(len(up), len(down), len(psd))
        means.append(np.sqrt(up[..., :m] * down[..., :m]))
    m = min(a.shape[-1] for a in means)
    flat = np.median([a[..., :m] for a in means], axis=0)
    keep = (f[:m] >= band[0]) & (f[:m] <= band[1])
    return f[:m][keep], flat[..., keep], (psd[..., :m] - flat)[..., keep]


def aperiodic_fit(f: np.ndarray, aperiodic: np.ndarray) -> tuple[float, float, float]:
    """``(intercept, slope, r2)`` of log power = a + b log f with b within [-10, 2]."""
    x, y = np.log(f), np.log(aperiodic)
    xc = x - x.mean()
    slope = float(np.clip((xc * (y - y.mean())).sum() / (xc**2).sum(), -10, 2))
    intercept = float(y.mean() - slope * x.mean())
    total = ((y - y.mean()) ** 2).sum()
    return intercept, slope, float(1 - ((y - intercept - slope * x) ** 2).sum() / total) if total > 0 else float("nan")


def moving(x: np.ndarray, sf: float, window: float, step: float, method: str, y: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(t, value)`` of rms or corr in centred windows clipped to the data, from running sums."""
    n = len(x)
    centre = np.arange(0, n / sf, step)
    a = np.maximum(np.trunc((centre - window / 2) * sf).astype(int), 0)
    b = np.minimum(np.trunc((centre + window / 2) * sf).astype(int), n)
    width = (b - a).astype(float)

    def sums(v: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0.0], np.cumsum(v)])
        return run[b] - run[a]

    with np.errstate(divide="ignore", invalid="ignore"):
        if method == "rms":
            out = np.sqrt(np.maximum(sums(x * x), 0) / width)
        else:
            sx, sy = sums(x), sums(y)
            cov, vx, vy = sums(x * y) - sx * sy / width, sums(x * x) - sx * sx / width, sums(y * y) - sy * sy / width
            out = np.where((vx > 0) & (vy > 0), cov / np.sqrt(np.maximum(vx * vy, 0)), np.nan)
            out = np.where(width > 1, out, np.nan)
    return (a + b) / 2 / sf, out


def trimmed_sd(x: np.ndarray, cut: float = 0.1) -> float:
    """SD (n - 1) without the lowest and highest ``int(cut * n)``."""
    k = int(cut * len(x))
    kept = np.sort(x)[k : len(x) - k]
    return float(kept.std(ddof=1)) if len(kept) > 1 else float("nan")


def detrend(x: np.ndarray) -> np.ndarray:
    """Without its least-squares line."""
    t = np.arange(len(x)) - (len(x) - 1) / 2
    return x - x.mean() - t * ((t * x).sum() / max((t * t).sum(), 1e-300))


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Middles (rounded down) of strict local maxima and of plateaus above both neighbours; the ends are none."""
    if len(x) < 3:
        return np.array([], int)
    edge = np.flatnonzero(np.diff(x)) + 1
    starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(x)]]) - 1
    level = x[starts]
    top = np.zeros(len(level), bool)
    top[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    return (starts[top] + ends[top]) // 2


def _to_higher(x: np.ndarray, p: int, stop: int) -> int:
    """Position of the lowest sample between ``p`` and the first higher one towards ``stop`` (not included), searched in growing stretches."""
    step, reach, best = (1 if stop > p else -1), 64, p
    at = p
    while at != stop - step:
        end = at + step * min(reach, abs(stop - step - at))
        part = x[at + step : end + step : step] if step > 0 or end + step >= 0 else x[at + step :: step]
        higher = np.flatnonzero(part > x[p])
        part = part[: higher[0]] if len(higher) else part
        if len(part) and part.min() < x[best]:
            best = at + step * (1 + int(part.argmin()))
        if len(higher):
            break
        at, reach = end, reach * 2
    return best


def prominences(x: np.ndarray, peaks: np.ndarray, reach: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(prominence, left base, right base)``: bases are the lowest points before a higher sample, at most ``reach`` // 2 away."""
    out = np.zeros(len(peaks)), np.zeros(len(peaks), int), np.zeros(len(peaks), int)
    half = len(x) if reach is None else max(1, int(np.ceil(reach))) // 2
    for k, p in enumerate(peaks.tolist()):
        i, j = _to_higher(x, p, max(-1, p - half - 1)), _to_higher(x, p, min(len(x), p + half + 1))
        out[0][k], out[1][k], out[2][k] = x[p] - max(x[i], x[j]), i, j
    return out


def spaced(x: np.ndarray, peaks: np.ndarray, apart: int) -> np.ndarray:
    """Peaks without those nearer than ``apart`` to a higher one that stays (of equal ones the later stays)."""
    keep = np.ones(len(peaks), bool)
    low, high = np.searchsorted(peaks, peaks - apart, "right"), np.searchsorted(peaks, peaks + apart, "left")
    for k in np.argsort(x[peaks], kind="stable")[::-1].tolist():
        if keep[k]:
            keep[low[k] : high[k]] = False
            keep[k] = True
    return peaks[keep]


def find_peaks(x: np.ndarray, height: tuple[float, float] | None = None, distance: float | None = None, prominence: float | None = None, reach: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(peaks, prominence, left, right)`` of local maxima within a height range, at least ``distance`` apart (the higher wins), and prominent enough."""
    p = local_maxima(x)
    if height is not None:
        p = p[(x[p] >= height[0]) & (x[p] <= height[1])]
    if distance is not None and len(p):
        p = spaced(x, p, int(np.ceil(distance)))
    prom, left, right = prominences(x, p, reach)
    if prominence is not None:
        good = prom >= prominence
        p, prom, left, right = p[good], prom[good], left[good], right[good]
    return p, prom, left, right


def crossings(x: np.ndarray) -> np.ndarray:
    """Indices before a change of sign; zero counts as not positive."""
    return np.flatnonzero(np.diff(x > 0))


def stretches(index: np.ndarray, gap: float | None = None) -> list[tuple[int, int]]:
    """``(first, last)`` of runs of sorted indices, runs less than ``gap`` apart joined."""
    if not len(index):
        return []
    step = np.diff(index)
    cut = np.flatnonzero((step > 1) & (step >= (gap or 0))) + 1
    return [(int(part[0]), int(part[-1])) for part in np.split(index, cut)]
