"""Numpy kernels on one array: spectra, filters by spectrum, peaks, autocorrelation, clustering."""

from __future__ import annotations

import math

import numpy as np

#: Corner frequencies of A-weighting in Hz, and its gain at 1 kHz in dB.
A_CORNERS, A_GAIN_DB = (20.598997, 107.65265, 737.86223, 12194.217), 1.9997
#: Octave centres in Hz.
OCTAVES = [31.5, 63.0, 125.0, 250.0, 500.0, 1000.0, 2000.0, 4000.0, 8000.0, 16000.0]


def a_response(f: np.ndarray, fs: float) -> np.ndarray:
    """Complex response of the A-weighting filter made digital by the bilinear rule: the analog one, warped."""
    s = 2j * fs * np.tan(np.clip(np.pi * f / fs, 0, np.pi / 2 - 1e-9))
    w = [2 * np.pi * c for c in A_CORNERS]
    gain = w[3] ** 2 * 10 ** (A_GAIN_DB / 20)
    return gain * s**4 / ((s + w[3]) ** 2 * (s + w[0]) ** 2 * (s + w[2]) * (s + w[1]))


def filtered(x: np.ndarray, response, fs: float) -> np.ndarray:
    """``x``, at rest before its start, through a filter given by its frequency response."""
    n = 1 << (2 * len(x) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, n) * response(np.fft.rfftfreq(n, 1 / fs), fs), n)[: len(x)]


def welch(x: np.ndarray, fs: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and mean power density of Hann segments that overlap by half, each without its mean."""
    size = min(size, len(x))
    step = max(1, size // 2)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    rows = np.lib.stride_tricks.sliding_window_view(x, size)[::step]
    power = np.abs(np.fft.rfft((rows - rows.mean(axis=1, keepdims=True)) * window, axis=1)) ** 2
    power = power.mean(axis=0) / (fs * (window**2).sum())
    power[1 : -1 if size % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(size, 1 / fs), power


def analytic(x: np.ndarray) -> np.ndarray:
    """The signal and, as its imaginary part, its Hilbert transform."""
    n = len(x)
    weight = np.zeros(n)
    weight[0] = 1
    weight[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        weight[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * weight)


def local_peaks(x: np.ndarray, height: float = -np.inf, distance: int = 1) -> np.ndarray:
    """Places of local maxima (the middle of flat ones) of at least ``height``; of close ones the higher stay."""
    if len(x) < 3:
        return np.zeros(0, int)
    change = np.flatnonzero(np.diff(x) != 0)
    starts, ends = np.append(0, change + 1), np.append(change, len(x) - 1)
    level = x[starts]
    top = np.zeros(len(level), bool)
    top[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    at = ((starts + ends) // 2)[top & (level >= height)]
    keep = np.ones(len(at), bool)
    if distance > 1:
        for k in np.argsort(x[at], kind="stable")[::-1]:
            if keep[k]:
                near = np.abs(at - at[k]) < distance
                near[k] = False
                keep[near] = False
    return at[keep]


def rank_filter(x: np.ndarray, size: int, pct: float) -> np.ndarray:
    """Element ``floor(size*pct/100)`` of each sorted centred frame; the ends are repeated."""
    k = size // 2
    frames = np.lib.stride_tricks.sliding_window_view(np.pad(x, (k, size - 1 - k), mode="edge"), size)
    pick = min(size - 1, int(size * pct / 100))
    return np.partition(frames, pick, axis=1)[:, pick]


def autocorrelation(x: np.ndarray) -> np.ndarray:
    """At every lag, 1 at none; empty for fewer than eight values."""
    return acf_by_octave(x, np.array([0]))[0] if len(x) >= 8 else np.zeros(0)


def acf_by_octave(x: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """A row for each width: the autocorrelation of the series smoothed over so many values (0: as it is).

    Smoothing is a factor of the power spectrum, so all rows come from one transform there and one batch back.
    """
    n = len(x)
    size = 1 << (2 * n - 1).bit_length()
    power = np.abs(np.fft.rfft(x - x.mean(), size)) ** 2
    half = np.pi * np.arange(size // 2 + 1) / size
    with np.errstate(invalid="ignore", divide="ignore"):
        gain = np.sin(np.outer(widths, half)) / (np.maximum(widths, 1)[:, None] * np.sin(half))
    gain[:, 0] = 1
    gain[widths < 2] = 1
    rows = np.fft.irfft(power * gain**2, size)[:, :n]
    first = rows[:, :1]
    return np.where(first > 0, rows / np.where(first > 0, first, 1), 0.0)


def prominences(x: np.ndarray, at: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """How far each place stands over the higher of the least values within its reach on either side."""
    levels = [x]  # the least of each 1, 2, 4, ... values
    while 2 ** len(levels) <= len(x):
        step = 2 ** (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))

    def least(a: np.ndarray, z: np.ndarray) -> np.ndarray:
        k = np.maximum(z - a, 1)
        k = np.floor(np.log2(k)).astype(int)
        return np.array([min(levels[i][s], levels[i][e - (1 << i)]) for i, s, e in zip(k, a, z, strict=True)])

    before = least(np.maximum(at - reach, 0), at)
    after = least(at + 1, np.minimum(at + reach + 1, len(x)))
    return x[at] - np.maximum(before, after)


def average_linkage(distance: np.ndarray, cut: float) -> np.ndarray:
    """Cluster numbers of items merged, nearest pair first, while clusters are nearer than ``cut`` on average."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n), np.arange(n)
    while n and d.min() < cut:
        i, j = sorted(np.unravel_index(d.argmin(), d.shape))
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == label[j]] = label[i]
    return np.unique(label, return_inverse=True)[1]


def parabolic(x: np.ndarray, k: int) -> float:
    """Place of the maximum near ``k``, between samples."""
    if not 0 < k < len(x) - 1:
        return float(k)
    a, b, c = x[k - 1], x[k], x[k + 1]
    bend = a - 2 * b + c
    return k + 0.5 * (a - c) / bend if bend != 0 else float(k)


def log_edges(low: float = 25.0, high: float = 20000.0, n: int = 96) -> np.ndarray:
    return np.geomspace(low, high, n + 1)


def decay(ir: np.ndarray, fs: float, knee_db: float = 3.0, min_span_db: float = 15.0) -> dict[str, float | None]:
    """T60, EDT, C50, C80 and D50 of an impulse response by backward integration up to its noise floor."""
    energy = ir.astype(float) ** 2
    start = int(energy.argmax())
    energy = energy[start:]
    none = dict.fromkeys(("t60_s", "edt_s", "c50_db", "c80_db", "d50"))
    if len(energy) < fs // 20 or energy.sum() <= 0:
        return none
    width = max(1, int(fs * 0.01))
    smooth = np.convolve(energy, np.ones(width) / width, mode="same")
    floor = np.median(smooth[-max(width, len(smooth) // 10) :])
    under = np.flatnonzero(smooth < floor * 10 ** (knee_db / 10))
    end = int(under[0]) if len(under) and under[0] > width else len(energy)
    curve = np.cumsum(energy[:end][::-1])[::-1]
    level = 10 * np.log10(np.maximum(curve / curve[0], 1e-20))

    def slope(top: float, low: float) -> float | None:
        part = np.flatnonzero((level <= top) & (level >= low))
        if len(part) < 8:
            return None
        s = np.polyfit(part / fs, level[part], 1)[0]
        return -60 / s if s < 0 else None

    reach = min(-5 - min_span_db, max(-35.0, level[-max(2, end // 50)]))
    early = lambda s: energy[: int(s * fs)].sum()
    late = lambda s: energy[int(s * fs) : end].sum()
    ratio = lambda s: 10 * math.log10(early(s) / late(s)) if late(s) > 0 and early(s) > 0 else None
    return {"t60_s": slope(-5, reach), "edt_s": slope(0, -10), "c50_db": ratio(0.05), "c80_db": ratio(0.08), "d50": float(early(0.05) / energy[:end].sum())}
