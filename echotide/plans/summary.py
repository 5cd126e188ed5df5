"""One summary of each recording or state, from its feature tables, with values gated by how long it was heard.

Input are the tables of ``operators.features``: seconds, fast levels and the 20 ms
envelope, each with the columns ``keys``.  The result is long: (keys..., key,
value, low_confidence).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dsp import OCTAVES, log_edges
from ..functions.scalars import nan_to_null, power, quantile
from ..operators import circular, corpus, ecology, events, indices, levels, spectral, tones
from . import series
from .store import written


def level_keys(seconds: DataFrame, fast: DataFrame, keys: list[str]) -> DataFrame:
    """Energy means, percentiles, emergence and intermittency."""
    plain = levels.energy_summary(fast, keys, "fast_db").select(
        *keys, F.col("l10_db").alias("L10"), F.col("l50_db").alias("L50"), F.col("l90_db").alias("L90")
    )
    weighted = fast.groupBy(*keys).agg(
        (10 * F.log10(F.avg(power(F.col("fast_dba"))))).alias("laeq_dbfs"), quantile(F.col("fast_dba"), 0.1).alias("_low")
    )
    whole = seconds.groupBy(*keys).agg(
        (F.count("*") / 60).alias("duration_min"), (10 * F.log10(F.avg(F.col("rms") * F.col("rms")) + 1e-20)).alias("leq_dbfs")
    )
    trimmed = levels.trimmed_leq(fast, keys, "fast_dba").withColumnRenamed("trimmed_leq_db", "laeq_trim5_dbfs")
    shares = levels.intermittency(fast, keys, "fast_db").withColumnRenamed("intermittency_pct", "intermittency_ratio_pct")
    out = reduce(lambda a, b: a.join(b, keys), [whole, plain, weighted, trimmed, shares])
    return out.withColumns(
        {
            "dynamics_L10_L90": F.col("L10") - F.col("L90"),
            "leq_minus_laeq_db": F.col("leq_dbfs") - F.col("laeq_dbfs"),
            "emergence_db": F.col("laeq_dbfs") - F.col("_low"),
        }
    ).drop("_low")


def event_keys(fast: DataFrame, keys: list[str], dt: float = 0.125) -> DataFrame:
    """Number, rate and median length of events above the running background of a minute."""
    rows = series.number_rows(fast, keys, ["t"], "t", 3600.0).withColumn("level_db", F.col("fast_db"))
    found = events.detect(rows, keys, events.odd_frames(60.0, dt), max(1, round(0.25 / dt)))
    counts = found.groupBy(*keys).agg(
        F.count("*").alias("n"), quantile((F.col("i1") - F.col("i0") + 1) * dt, 0.5).alias("event_median_dur_s")
    )
    span = fast.groupBy(*keys).agg((F.count("*") * dt / 60).alias("_min"))
    n = F.coalesce("n", F.lit(0)).cast("double")
    return span.join(counts, keys, "left").select(*keys, n.alias("n_events"), (n / F.col("_min")).alias("events_per_min"), "event_median_dur_s")


def direction_keys(seconds: DataFrame, keys: list[str]) -> DataFrame:
    """Spread, concentration and origin of directions, weighted by energy; null where there is no direction."""
    energy = F.col("rms") * F.col("rms")
    rows = seconds.withColumns({c: nan_to_null(F.col(c)) for c in ("az", "el", "diffuse", "centroid", "flatness")})
    basic = rows.groupBy(*keys).agg(
        quantile(F.col("centroid"), 0.5).alias("centroid_median_hz"),
        quantile(F.col("flatness"), 0.5).alias("flatness_median"),
        quantile(F.col("diffuse"), 0.5).alias("diffuseness_median"),
        (quantile(F.col("diffuse"), 0.75) - quantile(F.col("diffuse"), 0.25)).alias("diffuseness_iqr"),
        quantile(energy, 0.75).alias("_p75"),
        quantile(energy, 0.25).alias("_p25"),
    )
    held = rows.where("az is not null").join(basic.select(*keys, "_p75", "_p25"), keys)
    loud, quiet = energy >= F.col("_p75"), energy <= F.col("_p25")
    mean = circular.mean_direction(held, keys, F.radians("az"), energy).select(
        *keys, F.degrees("mean_angle").alias("azimuth_mean_deg"), F.col("r").alias("azimuth_R")
    )
    front = circular.mean_direction(held.where(loud), keys, F.radians("az"), energy).select(*keys, F.degrees("mean_angle").alias("azimuth_fg_deg"))
    heights = held.where("el is not null")
    parts = [
        basic.drop("_p75", "_p25"),
        mean,
        front,
        heights.where(loud).groupBy(*keys).agg(quantile(F.col("el"), 0.5).alias("elevation_fg_median_deg")),
        circular.directional_entropy(held, keys, F.col("az"), energy).withColumnRenamed("entropy", "directional_entropy"),
        circular.horizon_fractions(heights, keys, F.col("el"), energy).select(
            *keys, F.col("above").alias("above_horizon_fraction"), F.col("below").alias("below_horizon_fraction")
        ),
        circular.overlap(held, keys, F.col("az"), energy, loud, quiet).withColumnRenamed("overlap", "fgbg_az_overlap"),
    ]
    return reduce(lambda a, b: a.join(b, keys, "left"), parts)


def spectrum_keys(seconds: DataFrame, keys: list[str], chunk: int = 300, window: int = 301) -> DataFrame:
    """Ecoacoustic indices and the share of the foreground."""
    rows = series.number_rows(seconds.select(*keys, "t", "rms", F.col("logspec").alias("spec")), keys, ["t"], "t", 3600.0)
    fc = ecology.centres(log_edges().tolist())
    front = ecology.foreground(rows, keys, window).groupBy(*keys).agg(
        quantile(F.col("fg_fraction"), 0.5).alias("fg_fraction_median"), quantile(F.col("fg_fraction"), 0.9).alias("fg_fraction_p90")
    )
    parts = [
        front,
        ecology.complexity(rows, keys, chunk),
        ecology.diversity(ecology.occupancy(rows, keys, fc), keys),
        ecology.difference_index(rows, keys, fc),
        ecology.area_index(rows, keys, fc),
        ecology.entropy(rows, keys, "rms"),
    ]
    return reduce(lambda a, b: a.join(b, keys, "left"), parts)


def source_keys(seconds: DataFrame, envelope: DataFrame, keys: list[str], dt: float = 0.02) -> DataFrame:
    """Indices of machines, voices, wind and rain."""
    rates = indices.envelope_bands(envelope, keys, "t", "env_hi", dt, {"syllabic": (3.0, 8.0), "machine": (0.3, 12.0)})
    voice = indices.voice_activity(seconds, keys, "t")
    parts = [indices.weather(seconds, keys), indices.machines(seconds, keys), indices.voices(seconds, keys), rates, voice]
    out = reduce(lambda a, b: a.join(b, keys, "left"), parts)
    named = out.withColumnsRenamed(
        {"syllabic_share": "anthro_syllabic_mod", "machine_hz": "mech_periodicity_hz", "machine_strength": "mech_periodicity_strength"}
    )
    return indices.attributed(named).drop("syllabic_hz", "syllabic_strength", "machine_share")


def region_keys(seconds: DataFrame, keys: list[str], window: int = 301) -> DataFrame:
    """Rate and median length of regions of time and band that stand out."""
    rows = series.number_rows(seconds.select(*keys, "t", F.col("logspec").alias("spec")), keys, ["t"], "t", 3600.0)
    over = ecology.rises(rows, keys, window)
    found = spectral.spectral_events(over, keys, "i", "rise", log_edges().tolist())
    return spectral.spectral_event_keys(found, keys, seconds.groupBy(*keys).agg((F.count("*") / 60).alias("minutes")))


def minute_keys(seconds: DataFrame, minutes: DataFrame, envelope: DataFrame, keys: list[str], f: np.ndarray, dt: float = 0.02) -> DataFrame:
    """What the spectra of minutes say: lasting tones and birds; and the fluctuation of the envelope."""
    fc = ecology.centres(log_edges().tolist())
    held = seconds.select(*keys).distinct()
    tone = tones.tone_keys(tones.prominent_tones(minutes, keys, "t", "minspec", f), keys)
    parts = [
        held.join(tone, keys, "left").fillna(0.0, ["n_prominent_tones"]),
        tones.fluctuation_index(envelope, keys, "t", "env_hi", dt),
        indices.bird_keys(seconds, minutes, keys, fc, f),
    ]
    return reduce(lambda a, b: a.join(b, keys, "left"), parts)


def floor_keys(seconds: DataFrame, keys: list[str], nyquist: float) -> DataFrame:
    """Whether floors may be those of the recorder."""
    rows = series.number_rows(seconds.select(*keys, "t", "oct_pow"), keys, ["t"], "t", 3600.0)
    return levels.floor_suspicion(rows, keys, "oct_pow", OCTAVES, nyquist)


def full_summary(seconds: DataFrame, fast: DataFrame, envelope: DataFrame, keys: list[str], minutes: DataFrame | None = None, f: np.ndarray | None = None, nyquist: float = 24000.0) -> DataFrame:
    """(keys..., key, value, low_confidence): values that need a longer recording are null or marked.

    With ``minutes`` and their frequencies ``f`` all 65 values of a session, without them those that need no spectra of
    minutes.  For a summary by state, give a state as one of the keys.
    """
    parts = [
        level_keys(seconds, fast, keys),
        event_keys(fast, keys),
        direction_keys(seconds, keys),
        spectrum_keys(seconds, keys),
        source_keys(seconds, envelope, keys),
        region_keys(seconds, keys),
        floor_keys(seconds, keys, nyquist),
    ]
    if minutes is not None:
        parts.append(minute_keys(seconds, minutes, envelope, keys, f))
    # each family of values is a plan of its own: together they would be planned for longer than they run
    parts = [written(p, "summary") for p in parts]
    wide = reduce(lambda a, b: a.join(b, keys, "left"), parts)
    names = [c for c in wide.columns if c not in keys]
    doubles = wide.select(*keys, (F.col("duration_min") * 60).alias("_s"), *[F.col(c).cast("double").alias(c) for c in names])
    long = doubles.unpivot([*keys, "_s"], names, "key", "value")
    return corpus.gate(long, "_s").select(*keys, "key", "value", "low_confidence")


def by_state(tables: dict[str, DataFrame], states: DataFrame, keys: list[str], least: int = 30) -> dict[str, DataFrame]:
    """Feature tables cut to the intervals [a, b) of states (keys..., state, a, b), with the column ``state``; states of under
    ``least`` seconds are left out.  Summaries by keys and state are then one pass, whatever the number of states."""
    from ..operators.intervals import labelled

    cut = {name: labelled(rows, states, keys, "t", "state") for name, rows in tables.items()}
    enough = cut["seconds"].groupBy(*keys, "state").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return {name: rows.join(enough.select(*keys, "state"), [*keys, "state"], "left_semi") for name, rows in cut.items()}
