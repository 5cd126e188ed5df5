"""Indices of what makes the sound: machines, voices, wind, rain, birds; and room criteria.

Rows are seconds: (keys..., ``oct_pow`` of ten octaves, ``flatness``, ``diffuse``, ...).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dsp import OCTAVES, welch
from ..functions.scalars import nan_to_null, power, quantile
from ..plans import series

_EPS = 1e-20


def octave_sum(lo: float = 0.0, hi: float = 1e9, spec: str = "oct_pow") -> Column:
    """Power of the octaves with centres in [lo, hi]."""
    return sum((F.get(spec, F.lit(k)) for k, c in enumerate(OCTAVES) if lo <= c <= hi), F.lit(0.0))


def _share(lo: float, hi: float) -> Column:
    return F.sum(octave_sum(lo, hi)) / (F.sum(octave_sum()) + _EPS)


def _clip(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def weather(df: DataFrame, keys: list[str]) -> DataFrame:
    """Wind: low octaves times median diffuseness (alone, if that is unknown); rain: high octaves times flatness."""
    found = df.groupBy(*keys).agg(
        _share(0, 200).alias("geo_lowfreq_fraction"),
        _share(2000, 16000).alias("geo_highband_fraction"),
        quantile(nan_to_null(F.col("diffuse")), 0.5).alias("_psi"),
        quantile(nan_to_null(F.col("flatness")), 0.5).alias("_flat"),
    )
    wind = _clip(F.col("geo_lowfreq_fraction") * F.coalesce("_psi", F.lit(1.0)))
    rain = _clip(F.col("geo_highband_fraction") * F.coalesce("_flat", F.lit(0.0)))
    found = found.withColumns({"geo_wind_index": wind, "geo_rain_index": rain})
    return found.withColumn("geophony_index", F.greatest("geo_wind_index", "geo_rain_index")).drop("_psi", "_flat")


def machines(df: DataFrame, keys: list[str]) -> DataFrame:
    """Share up to 250 Hz, and the level from 31.5 to 125 Hz."""
    return df.groupBy(*keys).agg(
        _share(0, 250).alias("mech_lowfreq_fraction"), (10 * F.log10(F.avg(octave_sum(31.5, 125)) + _EPS)).alias("mech_rumble_db")
    )


def voices(df: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the octaves from 250 to 2000 Hz."""
    return df.groupBy(*keys).agg(_share(250, 2000).alias("anthro_voiceband_fraction"))


def envelope_bands(df: DataFrame, keys: list[str], t: str, x: str, dt: float, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Per band of modulation, its share of the envelope's power, its strongest rate, and that rate's share.

    A group's envelope is one task; group by recording and minute or the like.
    """
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    names = [f"{b}_{n}" for b in bands for n in ("share", "hz", "strength")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(t)[x].to_numpy(float)
        row: dict[str, float | None] = dict.fromkeys(names)
        if len(v) >= 16:
            p = np.abs(np.fft.rfft((v - v.mean()) * np.hanning(len(v)))) ** 2
            f = np.fft.rfftfreq(len(v), dt)
            for b, (lo, hi) in bands.items():
                inside = (f >= lo) & (f <= hi)
                if inside.any() and p[inside].sum() > 0:
                    row[f"{b}_share"] = float(p[inside].sum() / (p[1:].sum() + _EPS))
                    row[f"{b}_hz"] = float(f[inside][p[inside].argmax()])
                    row[f"{b}_strength"] = float(p[inside].max() / (p[1:].sum() + _EPS))
        out = pd.DataFrame([row], columns=names).astype(float)
        for at, k in enumerate(keys):
            out.insert(at, k, pdf[k].iloc[0])
        return out

    return df.groupBy(*keys).applyInPandas(run, f"{kinds}, " + ", ".join(f"{n} double" for n in names))


def modulation(df: DataFrame, keys: list[str], t: str, x: str, dt: float, low: float, high: float, bins: int = 48, size: int = 1024) -> DataFrame:
    """Spectrum of the envelope over its mean, at ``bins`` rates spaced by ratio."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(t)[x].to_numpy(float)
        rates = np.geomspace(low, high, bins)
        f, p = welch(v / (v.mean() + _EPS), 1 / dt, size) if len(v) >= 16 else (rates, np.zeros(bins))
        out = pd.DataFrame({"hz": rates, "power": np.interp(rates, f, p)})
        for at, k in enumerate(keys):
            out.insert(at, k, pdf[k].iloc[0])
        return out

    return df.groupBy(*keys).applyInPandas(run, f"{kinds}, hz double, power double")


#: The band of birds, in Hz.
BIRD_BAND = (2000.0, 11000.0)


def band_power(spec: Column, fc: list[float], band: tuple[float, float] = BIRD_BAND) -> Column:
    """Power of the bands with centres in the closed range."""
    kept = [F.get(spec, F.lit(k)) for k, c in enumerate(fc) if band[0] <= c <= band[1]]
    return sum(kept, F.lit(0.0))


def active(df: DataFrame, keys: list[str], power: str, k_db: float = 3.0, window: int = 301) -> DataFrame:
    """Adds ``active``: whether a power stands ``k_db`` over the running low percentile of its level.  Rows are numbered."""
    level = df.withColumn("_db", 10 * F.log10(F.col(power) + _EPS))
    out = series.rank_filter(level, keys, "_db", window, 10.0, "_bg")
    return out.withColumn("active", F.col("_db") > F.col("_bg") + k_db).drop("_db", "_bg")


def birds(df: DataFrame, keys: list[str], t: str, band_power: str, k_db: float = 3.0, window: int = 301) -> DataFrame:
    """Share of seconds, and runs of them, in which a band stands ``k_db`` over its running low percentile."""
    rows = active(series.number_rows(df, keys, [t], t, 3600.0), keys, band_power, k_db, window)
    share = rows.groupBy(*keys).agg(F.avg(F.col("active").cast("double")).alias("activity"), (F.count("*") / 60).alias("_min"))
    found = series.runs(rows, keys, "active").where("active").groupBy(*keys, "run").agg(F.count("*").alias("_d"))
    runs = found.groupBy(*keys).agg(F.count("*").alias("events"), quantile(F.col("_d").cast("double"), 0.5).alias("median_dur_s"))
    out = share.join(runs, keys, "left").withColumn("events", F.coalesce("events", F.lit(0)).cast("bigint"))
    return out.withColumn("events_per_min", F.col("events") / F.col("_min")).drop("_min")


def narrowband(minutes: DataFrame, keys: list[str], spectrum: str, f: np.ndarray, band: tuple[float, float] = BIRD_BAND, least: int = 2, rise_db: float = 6.0) -> DataFrame:
    """Lines of a band in each minute's spectrum: median and largest number, and share of minutes with ``least`` at least."""
    from .cycles import tonal_peaks

    kinds = "".join(f"`{k}` {minutes.schema[k].dataType.simpleString()}, " for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = p[list(keys)].copy()
            out["lines"] = [len(tonal_peaks(np.asarray(s, float), f, low=band[0], high=band[1], rise_db=rise_db)) for s in p[spectrum]]
            yield out

    counts = minutes.select(*keys, spectrum).mapInPandas(run, kinds + "lines bigint")
    return counts.groupBy(*keys).agg(
        quantile(F.col("lines"), 0.5).alias("median_peaks_per_min"),
        F.max("lines").alias("max_peaks_per_min"),
        F.avg((F.col("lines") >= least).cast("double")).alias("active_minute_fraction"),
    )


def dispersion(df: DataFrame, keys: list[str], t: str, power: str, az: str = "az", el: str = "el", k_db: float = 3.0, window: int = 301, limit: float = 10.0) -> DataFrame:
    """Where a band's foreground comes from: evenness over 36 directions, and shares from above and below the horizon."""
    from . import circular

    rows = active(series.number_rows(df, keys, [t], t, 3600.0), keys, power, k_db, window)
    weight = F.when(F.col("active"), F.col(power)).otherwise(0.0)
    even = circular.directional_entropy(rows, keys, F.col(az), weight)
    high = circular.horizon_fractions(rows, keys, F.col(el), weight, limit)
    return even.join(high, keys).select(*keys, F.col("entropy").alias("directional_entropy"), F.col("above").alias("above_horizon_fraction"), F.col("below").alias("below_horizon_fraction"))


def bird_keys(seconds: DataFrame, minutes: DataFrame, keys: list[str], fc: list[float], f: np.ndarray, least_active: float = 0.02) -> DataFrame:
    """The seven values of a session's birds; directions are null where under ``least_active`` of the seconds are active."""
    from .spectral import band_entropy

    rows = seconds.withColumn("_bird", band_power(F.col("logspec"), fc))
    heard = birds(rows, keys, "t", "_bird")
    parts = [
        heard.select(*keys, "activity", F.col("events_per_min").alias("bird_event_rate_per_min")),
        narrowband(minutes, keys, "minspec", f).select(
            *keys, F.col("median_peaks_per_min").alias("bird_peaks_per_min"), F.col("active_minute_fraction").alias("bird_active_minute_fraction")
        ),
        band_entropy(rows, keys, F.col("_bird")).withColumnRenamed("entropy", "bird_temporal_entropy"),
        dispersion(rows.where("az is not null and el is not null"), keys, "t", "_bird"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, keys, "left")
    enough = F.col("activity") >= least_active
    return out.select(
        *keys,
        "bird_peaks_per_min",
        "bird_active_minute_fraction",
        (F.col("activity") * 100).alias("bird_band_activity_pct"),
        "bird_event_rate_per_min",
        "bird_temporal_entropy",
        F.when(enough, F.col("directional_entropy")).alias("bird_directional_entropy"),
        F.when(enough, F.col("above_horizon_fraction")).alias("bird_above_horizon_fraction"),
    )


def voice_activity(df: DataFrame, keys: list[str], t: str, k_db: float = 3.0, window: int = 121) -> DataFrame:
    """Share of seconds in which the octaves of voices stand ``k_db`` over their running low percentile."""
    rows = df.withColumn("_voice", octave_sum(250, 2000))
    rows = active(series.number_rows(rows, keys, [t], t, 3600.0), keys, "_voice", k_db, window)
    return rows.groupBy(*keys).agg(F.avg(F.col("active").cast("double")).alias("anthro_activity_fraction"))


def attributed(df: DataFrame) -> DataFrame:
    """Adds the indices of voices and of machines from their parts."""
    voice = _clip(F.col("anthro_voiceband_fraction") * F.col("anthro_syllabic_mod") / 0.3 * (0.5 + F.col("anthro_activity_fraction")))
    machine = _clip(F.col("mech_lowfreq_fraction") * (0.5 + F.col("mech_periodicity_strength")))
    return df.withColumns({"anthrophony_index": voice, "mechanical_index": machine})


#: For the octaves from 31.5 to 8000 Hz, the constants of the noise rating curves L = a + b NR.
NR = [
    (55.4, 0.681), (35.5, 0.790), (22.0, 0.870), (12.0, 0.930), (4.8, 0.974),
    (0.0, 1.0), (-3.5, 1.015), (-6.1, 1.025), (-8.0, 1.030),
]


def noise_rating(df: DataFrame, keys: list[str], band: str, level: str) -> DataFrame:
    """The largest rating of any octave (0: 31.5 Hz to 8: 8000 Hz), and that octave."""
    a, b = (F.get(F.array(*[F.lit(r[k]) for r in NR]), F.col(band)) for k in (0, 1))
    rating = (F.col(level) - a) / b
    best = F.max(F.struct(F.round(rating, 9).alias("nr"), (-F.col(band)).alias("at"))).alias("m")
    found = df.where(F.col(band).between(0, 8)).groupBy(*keys).agg(best)
    return found.select(*keys, F.col("m.nr").alias("nr"), (-F.col("m.at")).alias("governing_band"))


#: For the curves NC 15 to 65 in steps of 5, their levels in the octaves from 63 to 8000 Hz.
NC = [
    (47, 36, 29, 22, 17, 14, 12, 11),
    (51, 40, 33, 26, 22, 19, 17, 16),
    (54, 44, 37, 31, 27, 24, 22, 21),
    (57, 48, 41, 35, 31, 29, 28, 27),
    (60, 52, 45, 40, 36, 34, 33, 32),
    (64, 56, 50, 45, 41, 39, 38, 37),
    (67, 60, 54, 49, 46, 44, 43, 42),
    (71, 64, 58, 54, 51, 49, 48, 47),
    (74, 67, 62, 58, 56, 54, 53, 52),
    (77, 71, 67, 63, 61, 59, 58, 57),
    (80, 75, 71, 68, 66, 64, 63, 62),
]


def noise_criterion(df: DataFrame, keys: list[str], band: str, level: str) -> DataFrame:
    """The highest curve that any octave (1: 63 Hz to 8: 8000 Hz) touches, between the tabled curves by line; 15 to 65."""
    curve = F.transform(F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in NC]), lambda row: F.get(row, F.col(band) - 1))
    rows = df.where(F.col(band).between(1, 8)).select(*keys, F.col(level).alias("_l"), curve.alias("_c"))
    k = F.size(F.filter("_c", lambda c: c <= F.col("_l")))  # curves that are not above
    below, above = F.get("_c", k - 1), F.get("_c", k)
    found = F.when(k == 0, 15.0).when(k == len(NC), 65.0).otherwise(10 + 5 * (k + (F.col("_l") - below) / (above - below)))
    return rows.groupBy(*keys).agg(F.max(found).alias("nc"))


def room_criterion(df: DataFrame, keys: list[str], band: str, level: str) -> DataFrame:
    """Mean level of 500, 1000 and 2000 Hz (octaves 4 to 6), and what stands over the line of -5 dB an octave through it:
    rumble (R: 5 dB, 31.5 to 250 Hz), hiss (H: 3 dB, 2000 and 4000 Hz), both (RH) or nothing (N)."""
    middle = df.where(F.col(band).between(4, 6)).groupBy(*keys).agg(F.avg(level).alias("rc"), F.count(level).alias("_n")).where("_n = 3")
    line = F.col("rc") + 5 * (5 - F.col(band))
    over = F.col(level) - line
    told = df.join(middle, keys).groupBy(*keys, "rc").agg(
        F.coalesce(F.max(F.col(band).between(0, 3) & (over > 5)), F.lit(False)).alias("_r"),
        F.coalesce(F.max(F.col(band).between(6, 7) & (over > 3)), F.lit(False)).alias("_h"),
    )
    kind = F.when(F.col("_r") & F.col("_h"), "RH").when(F.col("_r"), "R").when(F.col("_h"), "H").otherwise("N")
    return told.select(*keys, "rc", kind.alias("rc_class"))


def band_levels(df: DataFrame, keys: list[str], pct: float = 50.0, offset_db: float = 0.0) -> DataFrame:
    """Per octave, a percentile of its level in time, with a calibration offset."""
    rows = df.select(*keys, F.posexplode("oct_pow").alias("band", "p"))
    level = 10 * F.log10(F.greatest(F.col("p"), F.lit(1e-12)))
    return rows.groupBy(*keys, "band").agg((quantile(level, pct / 100) + offset_db).alias("level_db"))


def facture(seconds: Column, attack_s: Column, iteration: Column) -> Column:
    """How a sound object is kept up: unlimited, iteration, impulse or sustained."""
    return (
        F.when(seconds >= 5, "unlimited")
        .when((seconds >= 0.4) & (iteration >= 0.35), "iteration")
        .when((attack_s <= 0.08) & (seconds <= 1), "impulse")
        .otherwise("sustained")
    )


def mass(peak_share: Column, spread_octaves: Column) -> Column:
    """What an object's spectrum is: tonic, tonic-complex, noise or complex."""
    return F.when(peak_share >= 0.5, "tonic").when(peak_share >= 0.2, "tonic-complex").when(spread_octaves >= 1.2, "noise").otherwise("complex")


def mains_summary(df: DataFrame, keys: list[str], hz: str, rise: str, nominal: float = 50.0, min_rise_db: float = 6.0) -> DataFrame:
    """Coverage, mean, deviation and largest departure of a mains frequency track, over rows with enough rise."""
    ok = F.col(rise) >= min_rise_db
    v = F.when(ok, F.col(hz))
    return df.groupBy(*keys).agg(
        F.avg(ok.cast("double")).alias("coverage"), F.avg(v).alias("mean_hz"), F.stddev_pop(v).alias("sd_hz"), F.max(F.abs(v - nominal)).alias("max_dev_hz")
    )


def calibration_offset(df: DataFrame, keys: list[str], spl: float, x: str = "level_db") -> DataFrame:
    """What to add to levels so that their energy mean is a measured sound pressure level."""
    return df.groupBy(*keys).agg((spl - 10 * F.log10(F.avg(power(F.col(x))))).alias("offset_db"))


def tag(df: DataFrame, model_factory, shape: str) -> DataFrame:
    """Rows through a model: ``model_factory()`` is made once in a worker and maps a pandas frame to one of ``shape``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for batch in batches:
            yield model(batch)

    return df.mapInPandas(run, shape)
