"""Numpy kernels over stacks of traces (n, T); no Spark here."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


def fft_filter(x: np.ndarray, freq: float, btype: str) -> np.ndarray:
    """Keep the frequency bins below (low) or from (high) int(freq * T)."""
    n = x.shape[-1]
    spectrum, cut = np.fft.rfft(x), int(freq * n)
    if btype not in ("low", "high"):
        raise ValueError(f"unknown filter type {btype!r}")
    spectrum[..., cut:] *= btype == "high"
    spectrum[..., :cut] *= btype == "low"
    return np.fft.irfft(spectrum, n)


def butter_coefficients(freq: float, btype: str) -> tuple[np.ndarray, np.ndarray]:
    """Second-order Butterworth by the bilinear transform; freq as a fraction of the Nyquist rate times 2."""
    k = np.tan(np.pi * freq)
    norm = 1 + np.sqrt(2) * k + k * k
    a = np.array([1, 2 * (k * k - 1) / norm, (1 - np.sqrt(2) * k + k * k) / norm])
    b = np.array([k * k, 2 * k * k, k * k]) / norm if btype == "low" else np.array([1.0, -2.0, 1.0]) / norm
    return b, a


def butter_filter(x: np.ndarray, freq: float, btype: str) -> np.ndarray:
    """Causal second-order Butterworth, starting at rest; freq in cycles a sample."""
    b, a = butter_coefficients(freq, btype)
    y = np.zeros(x.shape)
    for t in range(x.shape[-1]):
        y[..., t] = b[0] * x[..., t]
        for lag in (1, 2):
            if t >= lag:
                y[..., t] += b[lag] * x[..., t - lag] - a[lag] * y[..., t - lag]
    return y


def smooth(x: np.ndarray, freq: float, method: str = "fft", btype: str = "low") -> np.ndarray:
    if method == "fft":
        return fft_filter(x, freq, btype)
    if method == "butter":
        return butter_filter(x, freq, btype)
    raise ValueError(f"unknown smoothing method {method!r}")


def _pool(power: np.ndarray, how: str) -> np.ndarray:
    if how == "mean":
        return np.sqrt(power.mean(-1))
    if how == "median":
        return np.sqrt(np.median(power, -1))
    if how == "logmexp":
        return np.sqrt(np.exp(np.log(power + np.finfo(power.dtype).eps).mean(-1)))
    if how == "sum":
        return np.sqrt(power.sum(-1))
    raise ValueError(f"unknown noise method {how!r}")


def noise_fft(x: np.ndarray, band: tuple[float, float] = (0.25, 0.5), how: str = "logmexp") -> np.ndarray:
    """Noise from the power in a band of fractions of the sampling rate."""
    n = x.shape[-1]
    power = np.abs(np.fft.rfft(x)) ** 2 / n
    lo, hi = (int(np.around(f * n)) for f in band)
    return _pool(power[..., lo:hi], how)


def noise_welch(x: np.ndarray, band: tuple[float, float] = (0.25, 0.5), how: str = "logmexp", segment: int = 256) -> np.ndarray:
    """Noise from Welch's density inside the open band: Hann windows, half overlap, means removed."""
    if how == "sum":
        raise ValueError("Welch noise has no sum")
    segment = min(segment, x.shape[-1])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)
    parts = sliding_window_view(x, segment, -1)[..., :: max(1, segment - segment // 2), :]
    parts = (parts - parts.mean(-1, keepdims=True)) * window
    density = np.abs(np.fft.rfft(parts)) ** 2 / (window**2).sum()
    density[..., 1 : (segment + 1) // 2] *= 2
    f = np.fft.rfftfreq(segment)
    return _pool(density.mean(-2)[..., (f > band[0]) & (f < band[1])] / 2, how)


def ptp_q(x: np.ndarray, q: tuple[float, float]) -> np.ndarray:
    lo, hi = np.percentile(x, q, axis=-1)
    return hi - lo


def pnr(x: np.ndarray, freq: float, q: tuple[float, float]) -> np.ndarray:
    """Peak-to-noise ratio: range of the trace over the range of its fast part."""
    return ptp_q(x, q) / ptp_q(fft_filter(x, freq, "high"), q)


def median_baseline(x: np.ndarray, wnd: int) -> np.ndarray:
    """The trace above its running median (reflecting at the ends), at least 0."""
    pad = [(0, 0)] * (x.ndim - 1) + [(wnd // 2, wnd - 1 - wnd // 2)]
    base = np.median(sliding_window_view(np.pad(x, pad, mode="symmetric"), wnd, -1), -1)
    return np.maximum(x - base, 0)


def autocovariance(x: np.ndarray, lags: int) -> np.ndarray:
    d = x - x.mean(-1, keepdims=True)
    n = x.shape[-1]
    return np.stack([(d[..., : n - k] * d[..., k:]).sum(-1) / n for k in range(lags + 1)], -1)


def ar_coefficients(x: np.ndarray, noise: float, p: int, add_lag: int | str = "p") -> np.ndarray:
    """Autoregressive coefficients of one trace: least squares on its autocovariance, less the noise's."""
    rows = 2 * p if add_lag == "p" else p + int(add_lag)
    cov = autocovariance(x, rows)
    system = np.array([[cov[abs(i - j)] - (noise**2 if i == j else 0.0) for j in range(p)] for i in range(rows)])
    return np.linalg.lstsq(system, cov[1 : rows + 1], rcond=None)[0]


def rising_run(x: np.ndarray) -> int:
    """Steps of the uninterrupted rise that gains most, without its last; the first on ties."""
    up = np.append(np.diff(x) > 0, False)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], up.astype(int), [0]])))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return 0
    best = int(np.argmax(x[ends - 1] - x[starts]))
    return int(ends[best] - starts[best])


def ar_response(spikes: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Traces that spikes give under an autoregressive decay: c[t] = s[t] + sum g[k] c[t-k]."""
    c = np.array(spikes, np.float64)
    for t in range(c.shape[-1]):
        for k, gk in enumerate(np.atleast_1d(g), 1):
            if t >= k:
                c[..., t] += gk * c[..., t - k]
    return c


def pulse_response(g: np.ndarray, length: int = 500) -> np.ndarray:
    return ar_response(np.eye(1, length)[0], g)


def correlate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pearson correlation of rows; 0 where a row does not vary."""
    a, b = a - a.mean(-1, keepdims=True), b - b.mean(-1, keepdims=True)
    norm = np.sqrt((a * a).sum(-1) * (b * b).sum(-1))
    return np.where(norm > 0, (a * b).sum(-1) / np.where(norm > 0, norm, 1), 0.0)
