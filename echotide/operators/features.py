"""From samples to features on four clocks: 20 ms, 125 ms, 1 s and 60 s.

A block of a recording is one row and is extracted by itself, so a recording is
spread over as many tasks as it has blocks.  The A-weighting filter is at rest
where a recording begins; other blocks must bring a lead (the source's option
``lead_s``; half a second is enough) for it to settle.  Direction and diffuseness
are given for four-channel recordings, in the order that their headers tell, and
partly for two channels; they are null for one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dsp
from ..sources.wav import WYZX

_EPS = 1e-20
SECONDS = (
    "path string, t double, rms double, peak double, centroid double, flatness double, az double, el double,"
    " diffuse double, oct_pow array<double>, logspec array<double>"
)
FAST = "path string, t double, fast_db double, fast_dba double"
HIGH = "path string, t double, env_hi double"
MINUTES = "path string, t double, minspec array<double>"


def _mono(x: np.ndarray, mode: str) -> np.ndarray:
    return x[:, :2].mean(axis=1) if mode in ("stereo", "binaural") else x[:, 0]


def _mode(channels: int) -> str:
    return "mono" if channels == 1 else "ambix" if channels >= 4 else "stereo"


def spectra(x: np.ndarray, fs: int, size: int, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """Complex Hann spectra of all channels (window, bin, channel), scaled to mean power, and window centres."""
    n = (len(x) - size) // hop + 1 if len(x) >= size else 0
    window = np.hanning(size)
    at = np.arange(n) * hop
    frames = np.lib.stride_tricks.sliding_window_view(x, size, axis=0)[at] if n else np.zeros((0, x.shape[1], size))
    out = np.fft.rfft(frames * window, axis=2).transpose(0, 2, 1) / window.sum()
    return out, (at + size // 2) / fs


def seconds_of(x: np.ndarray, fs: int, mode: str, size: int = 8192, order: tuple[int, int, int, int] = (0, 1, 2, 3)) -> list[dict]:
    """Features of each whole second of a block; a window belongs to the second of its centre."""
    size = size if fs >= 32000 else size // 4
    spec, centre = spectra(x, fs, size, max(1, fs // 10))
    f = np.fft.rfftfreq(size, 1 / fs)
    ref = _mono(x, mode)
    edges = dsp.log_edges()
    log_bin = np.digitize(f, edges) - 1
    audible, doa = (f >= 50) & (f <= 16000), (f >= 80) & (f <= 3000)
    octaves = [(f >= c / 2**0.5) & (f < c * 2**0.5) for c in dsp.OCTAVES]
    out = []
    for s in range(len(x) // fs):
        part = x[s * fs : (s + 1) * fs]
        row = {"t": float(s), "rms": float(np.sqrt(np.mean(ref[s * fs : (s + 1) * fs].astype(float) ** 2))), "peak": float(np.abs(part).max())}
        now = spec[(centre >= s) & (centre < s + 1)]
        if len(now):
            mono = now[:, :, order[0]] if mode == "ambix" else _mono(np.moveaxis(now, 2, 0).reshape(now.shape[2], -1).T, mode).reshape(now.shape[:2])
            p = (np.abs(mono) ** 2).mean(axis=0)
            q = p[audible]
            row |= {
                "oct_pow": [float(p[o].sum()) for o in octaves],
                "centroid": float((f[audible] * q).sum() / (q.sum() + _EPS)),
                "flatness": float(np.exp(np.log(q + _EPS).mean()) / (q.mean() + _EPS)),
                "logspec": np.bincount(log_bin[(log_bin >= 0) & (log_bin < 96)], p[(log_bin >= 0) & (log_bin < 96)], 96).tolist(),
                "spectrum": p,
            }
            if mode == "ambix":
                w, y, z, v = (now[:, :, k] for k in order)
                ix, iy, iz = ((w.conj() * k).real.mean(axis=0)[doa].sum() for k in (v, y, z))
                energy = (p[doa].sum() + sum((np.abs(k) ** 2).mean(axis=0)[doa].sum() for k in (v, y, z))) / 2
                row |= {
                    "az": float(np.degrees(np.arctan2(iy, ix))),
                    "el": float(np.degrees(np.arctan2(iz, np.hypot(ix, iy)))),
                    "diffuse": float(1 - min(1.0, np.sqrt(ix**2 + iy**2 + iz**2) / (energy + _EPS))),
                }
            elif mode == "stereo":
                left, right = now[:, :, 0], now[:, :, 1]
                a, b = ((np.abs(k) ** 2).mean(axis=0)[doa].sum() for k in (left, right))
                both = abs((left.conj() * right).mean(axis=0)[doa].sum())
                row |= {"az": float(90 * (a - b) / (a + b + _EPS)), "diffuse": float(1 - min(1.0, both / (np.sqrt(a * b) + _EPS)))}
        out.append(row)
    return out


def _means(x: np.ndarray, n: int) -> np.ndarray:
    return (x[: len(x) // n * n].reshape(-1, n).astype(float) ** 2).mean(axis=1)


def _each(blocks: DataFrame, shape: str, make) -> DataFrame:
    """What ``make(samples, rate, mode, order, lead)`` finds in each block; samples begin with the lead."""
    names = [c.split()[0] for c in shape.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                x = np.asarray(r.samples, np.float32).reshape(-1, r.channels)
                rows = pd.DataFrame(make(x, int(r.samplerate), _mode(r.channels), WYZX[r.order], int(r.lead)))
                rows["path"] = r.path
                if len(rows):
                    rows["t"] += r.first / r.samplerate
                    yield rows.reindex(columns=names)

    held = blocks if "order" in blocks.columns else blocks.withColumns({"order": F.lit("ambix"), "lead": F.lit(0)})
    return held.select("path", "first", "samplerate", "channels", "order", "lead", "samples").mapInPandas(run, shape)


def per_second(blocks: DataFrame) -> DataFrame:
    def make(x, fs, mode, order, lead):
        return [{k: v for k, v in r.items() if k != "spectrum"} for r in seconds_of(x[lead:], fs, mode, order=order)]

    return _each(blocks, SECONDS, make)


def per_minute(blocks: DataFrame) -> DataFrame:
    """Mean spectrum of each block of a minute."""

    def make(x, fs, mode, order, lead):
        found = [r["spectrum"] for r in seconds_of(x[lead:], fs, mode, order=order) if "spectrum" in r]
        return [{"t": 0.0, "minspec": np.mean(found, axis=0).tolist()}] if found else []

    return _each(blocks, MINUTES, make)


def fast(blocks: DataFrame, dt: float = 0.125) -> DataFrame:
    """Levels, plain and A-weighted, of each eighth of a second."""

    def make(x, fs, mode, order, lead):
        ref, n = _mono(x, mode).astype(float), max(1, round(dt * fs))
        weighted = dsp.filtered(ref, dsp.a_response, fs)
        plain, heard = (10 * np.log10(_means(v[lead:], n) + _EPS) for v in (ref, weighted))
        return {"t": np.arange(len(plain)) * n / fs, "fast_db": plain, "fast_dba": heard}

    return _each(blocks, FAST, make)


def envelope(blocks: DataFrame, dt: float = 0.02) -> DataFrame:
    """Power of each 20 ms."""

    def make(x, fs, mode, order, lead):
        n = max(1, round(dt * fs))
        power = _means(_mono(x[lead:], mode), n)
        return {"t": np.arange(len(power)) * n / fs, "env_hi": power}

    return _each(blocks, HIGH, make)


def write(blocks: DataFrame, folder: str) -> None:
    """All four tables as Parquet, parted by recording; recordings that are there already are left out."""
    spark = blocks.sparkSession
    for name, make in (("seconds", per_second), ("fast", fast), ("envelope", envelope), ("minutes", per_minute)):
        target = f"{folder.rstrip('/')}/{name}"
        todo = blocks.withColumn("take", F.element_at(F.split("path", "/"), -1))
        try:
            done = spark.read.parquet(target).select("take").distinct()
        except AnalysisException:  # none yet
            done = None
        todo = todo if done is None else todo.join(done, "take", "left_anti")
        found = make(todo.drop("take")).withColumn("take", F.element_at(F.split("path", "/"), -1))
        found.write.mode("append").partitionBy("take").parquet(target)
