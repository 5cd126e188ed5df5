"""Impulse responses and microphone arrays: sweeps, deconvolution, speech transmission, delays, coherence.

The kernels take arrays; ``per_row`` and ``per_block`` run them over tables, one
response or block of samples a row.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.dsp import decay, parabolic, welch

_EPS = 1e-20
#: Octaves of speech transmission, rates of modulation, and the male weights of octaves and neighbours.
STI_OCTAVES = [125.0, 250.0, 500.0, 1000.0, 2000.0, 4000.0, 8000.0]
STI_RATES = [0.63, 0.8, 1.0, 1.25, 1.6, 2.0, 2.5, 3.15, 4.0, 5.0, 6.3, 8.0, 10.0, 12.5]
STI_ALPHA = [0.085, 0.127, 0.230, 0.233, 0.309, 0.224, 0.173]
STI_BETA = [0.085, 0.078, 0.065, 0.011, 0.047, 0.095]


def sweep(seconds: float, f0: float, f1: float, fs: int, fade_in: float = 0.1, fade_out: float = 0.02, amplitude: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """A sine sweep whose pitch rises evenly, faded at its ends, and what it must be convolved with to give an impulse of 1."""
    t = np.arange(round(seconds * fs)) / fs
    rate = np.log(f1 / f0)
    x = np.sin(2 * np.pi * f0 * seconds / rate * (np.exp(t * rate / seconds) - 1))
    rise = lambda s: 0.5 - 0.5 * np.cos(np.pi * np.arange(round(s * fs)) / max(1, round(s * fs)))
    begin, end = rise(fade_in), rise(fade_out)
    x[: len(begin)] *= begin
    x[len(x) - len(end) :] *= end[::-1]
    x *= amplitude
    inverse = x[::-1] * np.exp(-t * rate / seconds)
    inverse = inverse / np.abs(convolve(x, inverse)).max()
    return x, inverse


def inverse_of(made: dict) -> np.ndarray:
    """The inverse of a sweep from what made it."""
    return sweep(
        made["duration_s"], made["f0_hz"], made["f1_hz"], made["fs"], made.get("fade_in_s", 0.1), made.get("fade_out_s", 0.02), made.get("amplitude", 0.5)
    )[1]


def write_sweep(path: str, seconds: float = 10.0, f0: float = 40.0, f1: float = 18000.0, fs: int = 48000, amplitude: float = 0.5) -> dict:
    """Writes a sweep, its inverse and what made them: three files beside one another."""
    from ..sources.sessions import _files, write_json
    from ..sources.wav import encode

    x, inverse = sweep(seconds, f0, f1, fs, amplitude=amplitude)
    made = {"duration_s": seconds, "f0_hz": f0, "f1_hz": f1, "fs": fs, "fade_in_s": 0.1, "fade_out_s": 0.02, "amplitude": amplitude}
    stem = path.removesuffix(".wav")
    out = {"sweep": f"{stem}.wav", "inverse": f"{stem}_inverse.wav", "params": f"{stem}.json"}
    for name, signal in (("sweep", x), ("inverse", inverse)):
        files, where = _files(out[name])
        with files.open_output_stream(where) as held:
            held.write(encode(signal[:, None], fs, 32, floating=True))
    write_json(out["params"], made)
    return out | {"made": made}


def convolve(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    n = len(x) + len(h) - 1
    size = 1 << (n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[:n]


def convolve_blocks(x: np.ndarray, h: np.ndarray, block: int = 8192) -> np.ndarray:
    """``convolve`` for long inputs: the response is cut into parts of a block, each block of input goes through all their
    spectra, and what they give is added up where it belongs.  Memory follows the response and the output."""
    parts = [np.fft.rfft(h[a : a + block], 2 * block) for a in range(0, len(h), block)]
    out = np.zeros((-(-len(x) // block) + len(parts) + 1) * block)
    for at in range(0, len(x), block):
        spectrum = np.fft.rfft(x[at : at + block], 2 * block)
        for k, part in enumerate(parts):
            start = at + k * block
            out[start : start + 2 * block] += np.fft.irfft(spectrum * part, 2 * block)
    return out[: len(x) + len(h) - 1]


def resampled(x: np.ndarray, fs: int, to: int) -> np.ndarray:
    """``x`` at another rate, by its spectrum."""
    if fs == to:
        return x
    n = round(len(x) * to / fs)
    spectrum = np.fft.rfft(x)
    held = np.zeros(n // 2 + 1, complex)
    keep = min(len(held), len(spectrum))
    held[:keep] = spectrum[:keep]
    return np.fft.irfft(held, n) * (n / len(x))


def auralize(dry: np.ndarray, fs: int, ir: np.ndarray, fs_ir: int, match: bool = True) -> tuple[np.ndarray, float]:
    """Dry sound in a room, channels in columns, and the gain in dB that brought it to the peak of the dry one.

    Equal numbers of channels go pairwise, one channel of either to all of the other, else all dry ones as their mean.
    """
    dry, ir = (np.atleast_2d(np.asarray(v, float).T).T for v in (dry, ir))
    ir = np.stack([resampled(c, fs_ir, fs) for c in ir.T], axis=1)
    if dry.shape[1] != ir.shape[1] and 1 not in (dry.shape[1], ir.shape[1]):
        dry = dry.mean(axis=1, keepdims=True)
    n = max(dry.shape[1], ir.shape[1])
    wet = np.stack([convolve_blocks(dry[:, k % dry.shape[1]], ir[:, k % ir.shape[1]]) for k in range(n)], axis=1)
    gain = (np.abs(dry).max() + _EPS) / (np.abs(wet).max() + _EPS) if match else 1.0
    return wet * gain, float(20 * np.log10(gain))


def response(recording: np.ndarray, inverse: np.ndarray, fs: int, seconds: float, lead_s: float = 0.005) -> np.ndarray:
    """The impulse response in a recorded sweep, from just before its peak."""
    h = convolve(recording, inverse)
    start = max(0, int(np.abs(h).argmax()) - int(lead_s * fs))
    return h[start : start + int(seconds * fs)]


def octave(x: np.ndarray, fs: float, centre: float) -> np.ndarray:
    """``x`` through a band of an octave, by a Butterworth-shaped weight on its spectrum."""
    n = 1 << (2 * len(x) - 1).bit_length()
    f = np.fft.rfftfreq(n, 1 / fs)
    half = centre * (2**0.5 - 2**-0.5)
    with np.errstate(divide="ignore"):
        off = (f**2 - centre**2) / np.where(f > 0, f * half, np.inf)
    weight = np.where(f > 0, 1 / np.sqrt(1 + off**8), 0)
    return np.fft.irfft(np.fft.rfft(x, n) * weight, n)[: len(x)]


def speech_transmission(ir: np.ndarray, fs: float) -> float | None:
    """Index of speech transmission of a response without noise, 0 to 1; null if the rate is too low for 8 kHz."""
    if STI_OCTAVES[-1] * 2**0.5 >= fs / 2:
        return None
    t = np.arange(len(ir)) / fs
    indices = []
    for c in STI_OCTAVES:
        energy = octave(ir, fs, c) ** 2
        depth = np.abs([(energy * np.exp(-2j * np.pi * r * t)).sum() for r in STI_RATES]) / (energy.sum() + _EPS)
        snr = np.clip(10 * np.log10(np.maximum(depth, _EPS) / np.maximum(1 - depth, _EPS)), -15, 15)
        indices.append(float(((snr + 15) / 30).mean()))
    m = np.array(indices)
    return float(np.clip(np.dot(STI_ALPHA, m) - np.dot(STI_BETA, np.sqrt(m[:-1] * m[1:])), 0, 1))


def _early(ir: np.ndarray, fs: float, window_s: float) -> np.ndarray:
    """The part of a response from its direct sound on."""
    start = int(np.abs(ir).max(axis=1).argmax())
    return ir[start : start + round(window_s * fs)]


def _alike(a: np.ndarray, b: np.ndarray, lags: int) -> float:
    """The correlation, with its sign, at the lag where its size is largest."""
    full = convolve(a, b[::-1])[len(b) - 1 - lags : len(b) + lags]
    return float(full[np.abs(full).argmax()] / (np.sqrt((a**2).sum() * (b**2).sum()) + _EPS))


def ear_correlation(ir: np.ndarray, fs: float, window_s: float = 0.08, lag_s: float = 0.001) -> float:
    """Largest correlation, in size, of the two ears of a response within a millisecond, over 80 ms from the direct sound."""
    early = _early(ir, fs, window_s)
    return abs(_alike(early[:, 0], early[:, 1], round(lag_s * fs)))


def octave_ear_correlation(ir: np.ndarray, fs: float, centres: tuple[float, ...] = (500.0, 1000.0, 2000.0), window_s: float = 0.08, lag_s: float = 0.001) -> dict | None:
    """``ear_correlation`` by octaves, with signs, and its mean; null for other than two channels, and no mean if the rate
    does not carry all octaves."""
    if ir.ndim != 2 or ir.shape[1] != 2:
        return None
    early, lags = _early(ir, fs, window_s), round(lag_s * fs)
    known = [c for c in centres if round(c * 2**0.5) < fs / 2]
    signed = {c: _alike(octave(early[:, 0], fs, c), octave(early[:, 1], fs, c), lags) for c in known}
    mean = float(np.mean([abs(v) for v in signed.values()])) if len(known) == len(centres) else None
    return {"mean": mean, "by_octave": {c: abs(v) for c, v in signed.items()}, "signed": signed}


def octave_decays(ir: np.ndarray, fs: float, centres: tuple[float, ...] = (125.0, 250.0, 500.0, 1000.0, 2000.0, 4000.0, 8000.0)) -> dict[float, dict]:
    """Reverberation and clarity of a response by octaves that its rate carries; of several channels the first."""
    x = ir[:, 0] if ir.ndim > 1 else ir
    x = np.concatenate([x / (np.abs(x).max() + _EPS)])
    return {c: decay(octave(x, fs, c), fs) for c in centres if round(c * 2**0.5) < fs / 2}


def measure(recording: np.ndarray, inverse: np.ndarray, fs: int, seconds: float | None = None, lead_s: float = 0.005) -> dict:
    """From a recorded sweep, channels in columns, to its response and what that says of the room."""
    recording = np.atleast_2d(np.asarray(recording, float).T).T
    full = np.stack([convolve_blocks(c, inverse) for c in recording.T], axis=1)
    peak = int(np.abs(full).max(axis=1).argmax())
    start = max(0, peak - round(lead_s * fs))
    ir = full[start : None if seconds is None else peak + round(seconds * fs)]
    two = octave_ear_correlation(ir, fs)
    return {
        "ir": ir,
        "direct_in_recording_s": (peak - len(inverse) + 1) / fs,
        "bands": octave_decays(ir, fs),
        "sti": speech_transmission(ir[:, 0], fs),
        "iacc_early": ear_correlation(ir, fs) if two else None,
        "iacc": two,
    }


def delays(x: np.ndarray, fs: float, most_s: float) -> list[dict]:
    """For each pair of channels, the delay of the first behind the second by the phase of their spectra alone."""
    n = 1 << (2 * len(x) - 1).bit_length()
    spectra = np.fft.rfft(x - x.mean(axis=0), n, axis=0)
    reach = max(1, int(np.ceil(most_s * fs)))
    out = []
    for i, j in itertools.combinations(range(x.shape[1]), 2):
        cross = spectra[:, i] * spectra[:, j].conj()
        r = np.fft.irfft(cross / (np.abs(cross) + _EPS), n)
        near = np.concatenate([r[-reach:], r[: reach + 1]])
        k = int(near.argmax())
        out.append({"a": i, "b": j, "delay_s": (parabolic(near, k) - reach) / fs, "prominence": float(near[k] - np.median(np.abs(near)))})
    return out


def coherence(a: np.ndarray, b: np.ndarray, fs: float, size: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and squared coherence of two channels, from segments that overlap by half."""
    window = np.hanning(size)
    rows = [np.lib.stride_tricks.sliding_window_view(v - v.mean(), size)[:: size // 2] * window for v in (a, b)]
    p, q = (np.fft.rfft(r, axis=1) for r in rows)
    cross = np.abs((p.conj() * q).mean(axis=0)) ** 2
    return np.fft.rfftfreq(size, 1 / fs), cross / ((np.abs(p) ** 2).mean(axis=0) * (np.abs(q) ** 2).mean(axis=0) + _EPS)


def diffuse_profile(x: np.ndarray, fs: float, geometry: dict, window_s: float = 4.0, size: int | None = None) -> list[dict]:
    """Per window, how diffuse the field at an array is: one less the median over pairs of how far their coherence exceeds
    that of a diffuse field, over the bands where the latter is under a half, weighted by their level."""
    n = min(len(x), round(window_s * fs))
    size = size or int(np.clip(1 << int(np.log2(max(n / 8, 2))), 128, 1024))
    out = []
    for at in range(0, len(x) - n + 1, n):
        part, found = x[at : at + n], {}
        for i, j in itertools.combinations(range(x.shape[1]), 2):
            f, seen = coherence(part[:, i], part[:, j], fs, size)
            apart = float(np.hypot(*(geometry["pos"][i] - geometry["pos"][j])))
            field = np.sinc(2 * f * apart / geometry["c"]) ** 2
            told = (field < 0.5) & (f > 0)
            if told.any():
                level = np.sqrt(welch(part[:, i], fs, size)[1] * welch(part[:, j], fs, size)[1])[told]
                over = np.clip((seen - field)[told] / (1 - field[told] + _EPS), 0, 1)
                found[i, j] = 1 - float((over * level).sum() / (level.sum() + _EPS))
        out.append({"t": (at + n / 2) / fs, "diffuseness": float(np.median(list(found.values()))) if found else None, "pairs": found})
    return out


def near_source_index(x: np.ndarray, fs: float, band: tuple[float, float] = (500.0, 1000.0), size: int = 1024) -> float:
    """Mean coherence of all pairs of channels in a band: high for a source nearby, low in a diffuse field."""
    found = []
    for i, j in itertools.combinations(range(x.shape[1]), 2):
        f, c = coherence(x[:, i], x[:, j], fs, size)
        found.append(c[(f >= band[0]) & (f <= band[1])].mean())
    return float(np.mean(found)) if found else 0.0


def per_row(df: DataFrame, keys: list[str], samples: str, kernels: dict[str, Callable[[np.ndarray], float | None]]) -> DataFrame:
    """One number for each kernel and row of samples."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = [{n: f(np.asarray(x, float)) for n, f in kernels.items()} for x in p[samples]]
            out = pd.DataFrame(rows, columns=list(kernels)).astype(float)
            for at, k in enumerate(keys):
                out.insert(at, k, p[k].to_numpy())
            yield out

    return df.select(*keys, samples).mapInPandas(run, f"{kinds}, " + ", ".join(f"{n} double" for n in kernels))


def block_delays(blocks: DataFrame, frame_s: float = 0.1, most_s: float = 0.01) -> DataFrame:
    """Delays of all pairs of channels for each frame of blocks of samples; frames don't cross blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for r in p.itertuples():
                x = np.asarray(r.samples, float).reshape(-1, r.channels)
                size = int(frame_s * r.samplerate)
                rows = [
                    {"path": r.path, "t": (r.first + at) / r.samplerate, **d}
                    for at in range(0, len(x) - size + 1, size)
                    for d in delays(x[at : at + size], r.samplerate, most_s)
                ]
                if rows:
                    yield pd.DataFrame(rows)

    return blocks.select("path", "first", "samplerate", "channels", "samples").mapInPandas(
        run, "path string, t double, a int, b int, delay_s double, prominence double"
    )
