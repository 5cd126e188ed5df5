"""Sound and body movement on one clock, held against shifted copies of themselves.

A group's two series are one task, with all its surrogates; shifts come from a
seed, so results repeat.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dsp import analytic

_EPS = 1e-20


def common_clock(sound: DataFrame, movement: DataFrame, keys: list[str], dt: float, t: str = "t", level: str = "level_db", x: str = "qom") -> DataFrame:
    """Means of both series in bins of ``dt`` seconds where both have rows."""
    k = F.floor(F.col(t) / dt).alias("k")
    a = sound.groupBy(*keys, k).agg(F.avg(level).alias("level_db"))
    b = movement.groupBy(*keys, k).agg(F.avg(x).alias("qom"))
    return a.join(b, [*keys, "k"])


def turned(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of ``a`` times the conjugate of ``b`` moved by s places in a circle, for every s: one product of spectra."""
    return np.fft.ifft(np.fft.fft(a) * np.conj(np.fft.fft(b)))


def chance(values: np.ndarray, least: int, surrogates: int, seed: int) -> tuple[float, float, float]:
    """The value without a shift, how often one as large comes from a drawn shift of ``least`` places or more, and their
    95th percentile.  ``values`` holds a value for every shift."""
    n = len(values)
    least = min(least, max(n // 4, 1))
    drawn = np.abs(values[np.random.default_rng(seed).integers(least, max(n - least, least + 1), surrogates)])
    return float(values[0]), float((1 + np.count_nonzero(drawn >= abs(values[0]))) / (1 + surrogates)), float(np.percentile(drawn, 95))


def _statistic(df: DataFrame, keys: list[str], order: str, columns: list[str], dt: float, surrogates: int, least_s: float, seed: int, make) -> DataFrame:
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order).dropna(subset=columns)
        row = dict.fromkeys(("value", "p", "null95"), np.nan)
        if len(pdf) >= 16:
            values = make(*(pdf[c].to_numpy(float) for c in columns))
            row = dict(zip(row, chance(values, int(least_s / dt), surrogates, seed), strict=True))
        out = pd.DataFrame([{**row, "n": len(pdf)}])
        for at, k in enumerate(keys):
            out.insert(at, k, pdf[k].iloc[0] if len(pdf) else None)
        return out

    return df.groupBy(*keys).applyInPandas(run, f"{kinds}, value double, p double, null95 double, n bigint")


def correlation(df: DataFrame, keys: list[str], order: str, dt: float, surrogates: int = 200, least_s: float = 10.0, seed: int = 0) -> DataFrame:
    """Correlation of the level with the logarithm of movement."""

    def make(level, qom):
        sound, body = level - level.mean(), np.log10(qom + _EPS)
        body = body - body.mean()
        return np.real(turned(sound, body)) / (np.linalg.norm(sound) * np.linalg.norm(body) + _EPS)

    return _statistic(df, keys, order, ["level_db", "qom"], dt, surrogates, least_s, seed, make)


def directional_correlation(df: DataFrame, keys: list[str], order: str, dt: float, azimuth: str = "az", sway: str = "sway", mask: str | None = None, surrogates: int = 200, least_s: float = 10.0, seed: int = 0) -> DataFrame:
    """Circular correlation of a bearing with twice a sway axis, in degrees; rows where ``mask`` is false do not count.

    Sway is an axis, which half a turn maps to itself; hence twice.
    """

    def make(az, axis, held=None):
        held = np.ones(len(az)) if held is None else held
        a, b = np.radians(az), 2 * np.radians(axis)
        mean = np.angle((held * np.exp(1j * a)).sum())
        x = held * np.sin(a - mean)
        one = np.exp(1j * b)
        # per shift: the mean of the moved axes under the mask, then the sums of products of sines
        middle = np.angle(turned(held, np.conj(one)))
        with_sin, with_cos = np.real(turned(x, np.sin(b))), np.real(turned(x, np.cos(b)))
        over = np.cos(middle) * with_sin - np.sin(middle) * with_cos
        both = np.real(turned(held, np.sin(b) ** 2)), np.real(turned(held, np.cos(b) ** 2)), np.real(turned(held, np.sin(b) * np.cos(b)))
        power = np.cos(middle) ** 2 * both[0] + np.sin(middle) ** 2 * both[1] - 2 * np.sin(middle) * np.cos(middle) * both[2]
        return over / (np.sqrt((x**2).sum() * np.maximum(power, 0)) + _EPS)

    rows = df if mask is None else df.withColumn(mask, F.col(mask).cast("double"))
    return _statistic(rows, keys, order, [azimuth, sway, *([mask] if mask else [])], dt, surrogates, least_s, seed, make)


def phase_locking(df: DataFrame, keys: list[str], order: str, dt: float, band: tuple[float, float], surrogates: int = 200, least_s: float = 10.0, seed: int = 0) -> DataFrame:
    """How steady the phase between both series is within a band of rates."""

    def phases(x):
        spectrum = np.fft.rfft(x - x.mean())
        f = np.fft.rfftfreq(len(x), dt)
        spectrum[(f < band[0]) | (f > band[1])] = 0
        return np.angle(analytic(np.fft.irfft(spectrum, len(x))))

    def make(level, qom):
        return np.abs(turned(np.exp(1j * phases(level)), np.exp(1j * phases(qom)))) / len(level)

    return _statistic(df, keys, order, ["level_db", "qom"], dt, surrogates, least_s, seed, make)
