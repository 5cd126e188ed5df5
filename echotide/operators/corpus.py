"""Many sessions: catalogues of summaries, dated series, surveys, interval validity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import COS45, quantile, quadrant


def long_form(wide: DataFrame, session: str) -> DataFrame:
    """(session, key, value) from one column for each key."""
    names = [c for c in wide.columns if c != session]
    doubles = wide.select(session, *[F.col(c).cast("double").alias(c) for c in names])
    return doubles.unpivot([session], names, "key", "value")


def merge(parts: list[DataFrame]) -> DataFrame:
    """All rows, with the union of all columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def transposed(long: DataFrame, session: str, sessions: list) -> DataFrame:
    """Keys as rows and the given sessions as columns."""
    return long.groupBy("key").pivot(session, sessions).agg(F.first("value"))


def rank(wide: DataFrame, session: str, key: str, descending: bool = True) -> DataFrame:
    """Sessions with a number for ``key``, ordered by it."""
    known = wide.where(F.col(key).isNotNull()).select(session, key)
    return known.orderBy(F.desc(key) if descending else F.asc(key), session)


def outliers(wide: DataFrame, session: str, key: str, z: float = 1.5) -> DataFrame:
    """Sessions at least ``z`` deviations from the mean; none of fewer than three sessions or without spread."""
    stats = wide.agg(F.avg(key).alias("_m"), F.stddev_pop(key).alias("_s"), F.count(key).alias("_n"))
    rows = wide.crossJoin(F.broadcast(stats)).where("_n >= 3 and _s > 0")
    score = (F.col(key) - F.col("_m")) / F.col("_s")
    return rows.select(session, key, F.round(score, 2).alias("z")).where(F.abs("z") >= z)


def _day(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date"))


def rolling_trend(df: DataFrame, keys: list[str], date: str, y: str, window_days: float = 365.0, block_days: int = 3650) -> DataFrame:
    """Adds ``trend``: the median of all values within half a window.  Days are dealt out in blocks with a halo."""
    half = int(window_days // 2)
    rows = df.where(F.col(y).isNotNull() & ~F.isnan(y)).withColumn("_d", _day(F.col(date)))
    low, high = F.floor((F.col("_d") - half) / block_days), F.floor((F.col("_d") + half) / block_days)
    dealt = rows.withColumn("_blk", F.explode(F.sequence(low, high)))
    frame = Window.partitionBy(*keys, "_blk").orderBy("_d").rangeBetween(-half, half)
    out = dealt.withColumn("trend", quantile(F.col(y), 0.5).over(frame))
    return out.where(F.col("_blk") == F.floor(F.col("_d") / block_days)).drop("_blk", "_d")


def climatology(df: DataFrame, keys: list[str], date: str, y: str) -> DataFrame:
    """Mean and number of values of each calendar month, months without any included."""
    known = df.where(F.col(y).isNotNull() & ~F.isnan(y))
    months = known.select(*keys).distinct().withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    means = known.groupBy(*keys, F.month(date).alias("month")).agg(F.avg(y).alias("mean"), F.count(y).alias("n"))
    return months.join(means, [*keys, "month"], "left").fillna(0, ["n"])


def decompose(df: DataFrame, keys: list[str], date: str, y: str, window_days: float = 365.0) -> DataFrame:
    """Adds ``trend``, ``seasonal`` (monthly means of what the trend leaves, about zero) and ``residual``."""
    rows = rolling_trend(df, keys, date, y, window_days).withColumn("_rest", F.col(y) - F.col("trend"))
    rows = rows.withColumn("_month", F.month(date))
    means = rows.groupBy(*keys, "_month").agg(F.avg("_rest").alias("_mean"))
    centre = means.groupBy(*keys).agg(F.avg("_mean").alias("_centre"))
    out = rows.join(means, [*keys, "_month"]).join(centre, keys).withColumn("seasonal", F.col("_mean") - F.col("_centre"))
    return out.withColumn("residual", F.col("_rest") - F.col("seasonal")).drop("_rest", "_month", "_mean", "_centre")


def trend_per_year(df: DataFrame, keys: list[str], date: str, y: str) -> DataFrame:
    """Least-squares change in a year; 0 for fewer than two values."""
    known = df.where(F.col(y).isNotNull() & ~F.isnan(y))
    slope = F.regr_slope(F.col(y), _day(F.col(date)).cast("double"))
    return known.groupBy(*keys).agg(F.coalesce(slope * 365.25, F.lit(0.0)).alias("per_year"), F.count(y).alias("n"))


def seasonal_summary(df: DataFrame, keys: list[str], date: str, y: str, window_days: float = 365.0) -> DataFrame:
    """Number, span, change in a year, seasonal range, months of its ends, spread of the residual."""
    parts = decompose(df, keys, date, y, window_days).withColumn("_month", F.month(date))
    monthly = parts.groupBy(*keys, "_month").agg(F.first("seasonal").alias("s"))
    top = F.max(F.struct(F.round("s", 9).alias("s"), (-F.col("_month")).alias("m")))
    least = F.min(F.struct(F.round("s", 9).alias("s"), F.col("_month").alias("m")))
    ends = monthly.groupBy(*keys).agg(
        (F.max("s") - F.min("s")).alias("seasonal_amplitude"), (-top["m"]).alias("peak_month"), least["m"].alias("trough_month")
    )
    day = _day(F.col(date))
    sums = parts.groupBy(*keys).agg((F.max(day) - F.min(day)).alias("span_days"), F.stddev_pop("residual").alias("residual_sd"))
    return trend_per_year(df, keys, date, y).join(sums, keys).join(ends, keys)


#: The scales of the questionnaire.
SCALES = ["pleasant", "vibrant", "eventful", "chaotic", "annoying", "monotonous", "uneventful", "calm"]


def coordinates(df: DataFrame, lo: float = 1.0, hi: float = 5.0) -> DataFrame:
    """Adds ``pleasantness`` and ``eventfulness``, -1 to 1, from the eight scales."""
    norm = (hi - lo) * (1 + math.sqrt(2))
    c = F.col
    diagonal = COS45 * (c("calm") - c("chaotic"))
    other = COS45 * (c("vibrant") - c("monotonous"))
    return df.withColumns(
        {
            "pleasantness": ((c("pleasant") - c("annoying")) + diagonal + other) / norm,
            "eventfulness": ((c("eventful") - c("uneventful")) - diagonal + other) / norm,
        }
    )


def survey_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Means, deviations, dispersion, quadrant and 95 percent ellipse of :func:`coordinates`."""
    p, e = F.col("pleasantness"), F.col("eventfulness")
    found = df.groupBy(*keys).agg(
        F.count(p).alias("n"),
        F.avg(p).alias("pleasantness_mean"),
        F.avg(e).alias("eventfulness_mean"),
        F.stddev_samp(p).alias("pleasantness_sd"),
        F.stddev_samp(e).alias("eventfulness_sd"),
        F.sqrt(F.var_pop(p) + F.var_pop(e)).alias("dispersion"),
        F.var_samp(p).alias("_pp"),
        F.var_samp(e).alias("_ee"),
        F.covar_samp(p, e).alias("_pe"),
    )
    middle = (F.col("_pp") + F.col("_ee")) / 2
    reach = F.sqrt(F.pow((F.col("_pp") - F.col("_ee")) / 2, F.lit(2.0)) + F.pow(F.col("_pe"), F.lit(2.0)))
    axis = lambda v: F.when(F.col("n") >= 3, 2 * F.sqrt(5.9915 * F.greatest(v, F.lit(0.0))))
    turn = F.degrees(F.atan2(2 * F.col("_pe"), F.col("_pp") - F.col("_ee")) / 2)
    return found.withColumns(
        {
            "quadrant": quadrant(F.col("pleasantness_mean"), F.col("eventfulness_mean")),
            "ellipse_width": axis(middle + reach),
            "ellipse_height": axis(middle - reach),
            "ellipse_angle_deg": F.when(F.col("n") >= 3, turn),
        }
    ).drop("_pp", "_ee", "_pe")


#: Per descriptor its tier of evidence, the seconds that it needs, and whether below them it does not exist
#: (hard) or is unsure (soft).
REGISTRY = [
    ("floor_suspect", "S", None, None),
    ("floor_suspect_lo_hz", "S", None, None),
    ("floor_suspect_hi_hz", "S", None, None),
    ("floor_spread_db", "S", None, None),
    ("duration_min", "S", None, None),
    ("leq_dbfs", "S", None, None),
    ("laeq_dbfs", "PC", None, None),
    ("laeq_trim5_dbfs", "PC", None, None),
    ("leq_minus_laeq_db", "PC", None, None),
    ("L10", "PC", 60.0, "soft"),
    ("L50", "PC", 60.0, "soft"),
    ("L90", "PC", 60.0, "soft"),
    ("dynamics_L10_L90", "PC", 60.0, "soft"),
    ("events_per_min", "PM", 60.0, "soft"),
    ("event_median_dur_s", "PM", None, None),
    ("centroid_median_hz", "S", None, None),
    ("flatness_median", "S", None, None),
    ("diffuseness_median", "S", None, None),
    ("diffuseness_iqr", "S", None, None),
    ("azimuth_mean_deg", "S", None, None),
    ("azimuth_R", "S", None, None),
    ("azimuth_fg_deg", "PD", None, None),
    ("elevation_fg_median_deg", "PD", None, None),
    ("n_events", "PM", None, None),
    ("emergence_db", "PM", None, None),
    ("intermittency_ratio_pct", "PM", 60.0, "soft"),
    ("fg_fraction_median", "PD", 60.0, "soft"),
    ("fg_fraction_p90", "PD", 60.0, "soft"),
    ("spectral_events_per_min", "PM", 60.0, "soft"),
    ("spectral_event_median_dur_s", "PM", 30.0, "soft"),
    ("aci", "S", 300.0, "hard"),
    ("adi", "S", None, None),
    ("aei", "S", 360.0, "soft"),
    ("ndsi", "S", 360.0, "soft"),
    ("bi", "S", 360.0, "soft"),
    ("acoustic_entropy", "S", 60.0, "soft"),
    ("directional_entropy", "S", None, None),
    ("above_horizon_fraction", "S", None, None),
    ("below_horizon_fraction", "S", None, None),
    ("fgbg_az_overlap", "PD", None, None),
    ("bird_peaks_per_min", "S", 60.0, "soft"),
    ("bird_active_minute_fraction", "S", 60.0, "hard"),
    ("bird_band_activity_pct", "S", 60.0, "soft"),
    ("bird_event_rate_per_min", "S", 60.0, "soft"),
    ("bird_temporal_entropy", "S", 60.0, "soft"),
    ("bird_directional_entropy", "S", None, None),
    ("bird_above_horizon_fraction", "S", None, None),
    ("mech_lowfreq_fraction", "S", None, None),
    ("mech_rumble_db", "S", None, None),
    ("mech_periodicity_hz", "S", 10800.0, "soft"),
    ("mech_periodicity_strength", "S", 10800.0, "soft"),
    ("mechanical_index", "PM", None, None),
    ("anthro_voiceband_fraction", "PM", None, None),
    ("anthro_syllabic_mod", "PM", None, None),
    ("anthro_activity_fraction", "PM", 60.0, "soft"),
    ("anthrophony_index", "PM", None, None),
    ("geo_lowfreq_fraction", "S", None, None),
    ("geo_highband_fraction", "S", None, None),
    ("geo_wind_index", "PM", None, None),
    ("geo_rain_index", "PM", None, None),
    ("geophony_index", "PM", None, None),
    ("tonal_prominence_db", "PM", 60.0, "hard"),
    ("tonal_prominence_hz", "PM", 60.0, "hard"),
    ("n_prominent_tones", "PM", 60.0, "hard"),
    ("fluctuation_index", "PM", 360.0, "soft"),
    ("attack_s", "S", 0.2, "hard"),
    ("decay_s", "S", 0.2, "hard"),
    ("temporal_centroid", "S", 0.2, "hard"),
    ("crest_db", "S", 0.2, "soft"),
    ("iteration_hz", "S", 0.2, "soft"),
    ("iteration_strength", "S", 0.2, "soft"),
]
#: The tiers, from no listener in the number to a number that stands for one.
TIERS = {"S": "signal only", "PM": "perceptually motivated", "PC": "perceptually calibrated", "PD": "perceptually defined"}


def registry(df: DataFrame) -> DataFrame:
    """The registry as a table (key, tier, min_s, kind); a tier that is none is an error."""
    if bad := [k for k, t, _, _ in REGISTRY if t not in TIERS]:
        raise ValueError(f"no tier: {', '.join(bad)}")
    return df.sparkSession.createDataFrame(REGISTRY, "key string, tier string, min_s double, kind string")


def needs(df: DataFrame) -> DataFrame:
    """The registered needs as a table (key, min_s, kind)."""
    return registry(df).where("min_s is not null").select("key", "min_s", "kind")


def tiers(df: DataFrame) -> DataFrame:
    """The registered tiers as a table (tier, meaning, key), from the signal up."""
    order = {t: k for k, t in enumerate(TIERS)}
    meaning = F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair])
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    return registry(df).select("tier", meaning[F.col("tier")].alias("meaning"), "key", place[F.col("tier")].alias("place")).orderBy("place", "key")


def tier_counts(df: DataFrame) -> DataFrame:
    """How many registered descriptors each tier has."""
    return registry(df).groupBy("tier").count()


def with_tier(long: DataFrame) -> DataFrame:
    """(session..., key, value) with the key's tier; null where it has none."""
    return long.join(F.broadcast(registry(long).select("key", "tier")), "key", "left")


def cautions(long: DataFrame, keys: list[str]) -> DataFrame:
    """Per session, the keys whose values are easily taken for facts about a listener (PD), in order, and the number of
    those that are only motivated by one (PM)."""
    known = with_tier(long)
    return known.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.when(F.col("tier") == "PD", F.col("key")))).alias("defined"),
        F.count(F.when(F.col("tier") == "PM", 1)).alias("n_motivated"),
    )


def ungrounded(long: DataFrame, exempt: list[str]) -> DataFrame:
    """Keys that have neither a tier nor an exemption."""
    return long.select("key").distinct().join(F.broadcast(registry(long).select("key")), "key", "left_anti").where(~F.col("key").isin(exempt))


def gate(long: DataFrame, duration: str) -> DataFrame:
    """(session..., key, value) with values of too short sessions null if hard, and ``low_confidence``."""
    known = long.join(F.broadcast(needs(long)), "key", "left")
    short = F.coalesce(F.col(duration) < F.col("min_s"), F.lit(False))
    return known.withColumn("value", F.when(~(short & (F.col("kind") == "hard")), F.col("value"))).withColumn("low_confidence", short)


def unregistered(long: DataFrame, exempt: list[str]) -> DataFrame:
    """Keys that have neither a registered need nor an exemption."""
    return long.select("key").distinct().join(F.broadcast(needs(long)), "key", "left_anti").where(~F.col("key").isin(exempt))


def detect_scale(df: DataFrame) -> str:
    """Whether answers go from 1 to 5 or from 0 to 100, by the least and the largest of all scales; others are an error."""
    low, high = df.agg(F.min(F.least(*SCALES)), F.max(F.greatest(*SCALES))).first()
    if low is None or low < 0 or high > 100:
        raise ValueError("answers are neither 1 to 5 nor 0 to 100")
    return "1-5" if low >= 1 and high <= 5 else "0-100"


def versus(survey: DataFrame, measured: DataFrame, pairs: list[tuple[str, str, list[str]]]) -> DataFrame:
    """Survey values beside measured ones: for each (label, survey key, measured keys), the first measured key there is.

    Both tables are long (key, value) of one session.
    """
    rows = [(place, label, key, k, alt) for place, (label, key, alts) in enumerate(pairs) for k, alt in enumerate(alts)]
    plan = survey.sparkSession.createDataFrame(rows, "place int, label string, skey string, k int, mkey string")
    left = F.broadcast(plan).join(survey.select(F.col("key").alias("skey"), F.col("value").alias("survey")), "skey")
    met = left.join(measured.select(F.col("key").alias("mkey"), F.col("value").alias("measured")), "mkey", "left")
    first = F.min(F.when(F.col("measured").isNotNull(), F.struct("k", "mkey", "measured"))).alias("m")
    found = met.groupBy("place", "label", "survey").agg(first)
    return found.select("place", "label", "survey", F.col("m.mkey").alias("measured_key"), F.col("m.measured").alias("measured")).orderBy("place")


def prefixed(long: DataFrame, prefix: str) -> DataFrame:
    """Long values under keys of their own family, for a summary."""
    return long.withColumn("key", F.concat(F.lit(prefix), "key"))


def finite_series(long: DataFrame, least: int = 3) -> DataFrame:
    """(session, date, key, value) of keys with ``least`` finite values at least; rows without a date or a finite value go."""
    ok = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    rows = long.where(F.col("date").isNotNull() & ok)
    enough = rows.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return rows.join(enough.select("key"), "key", "left_semi")
