"""Levels: energy means, percentiles, floors, and what rises above them.

Operators take a frame of rows (keys..., ``level_db``), and ``i`` and ``n`` where
order counts.  Null levels are left out of aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import db, power, quantile
from ..plans import series

#: Lift of a running minimum, margin for a level to be measurable, least share of such frames.
MIN_BIAS_DB, MARGIN_DB, MIN_COVERAGE = 1.5, 6.0, 0.10


def energy_summary(df: DataFrame, keys: list[str], x: str = "level_db") -> DataFrame:
    """Frames, energy mean and the levels exceeded 10, 50 and 90 percent of the time."""
    v = F.col(x)
    return df.groupBy(*keys).agg(
        F.count(v).alias("frames"),
        db(F.avg(power(v))).alias("leq_db"),
        quantile(v, 0.9).alias("l10_db"),
        quantile(v, 0.5).alias("l50_db"),
        quantile(v, 0.1).alias("l90_db"),
    )


def trimmed_leq(df: DataFrame, keys: list[str], x: str = "level_db", trim_pct: float = 5.0) -> DataFrame:
    """Energy mean without the loudest ``trim_pct`` percent of frames."""
    limits = df.groupBy(*keys).agg(quantile(F.col(x), 1 - trim_pct / 100).alias("limit"))
    kept = df.join(limits, keys).where(F.col(x) <= F.col("limit"))
    return kept.groupBy(*keys).agg(db(F.avg(power(F.col(x)))).alias("trimmed_leq_db"))


def intermittency(df: DataFrame, keys: list[str], x: str = "level_db", k_db: float = 3.0) -> DataFrame:
    """Percent of all energy in frames at least ``k_db`` over the energy mean."""
    means = df.groupBy(*keys).agg(db(F.avg(power(F.col(x)))).alias("leq"))
    p = power(F.col(x))
    loud = F.sum(F.when(F.col(x) >= F.col("leq") + k_db, p).otherwise(0.0))
    return df.join(means, keys).groupBy(*keys).agg((100 * loud / (F.sum(p) + 1e-20)).alias("intermittency_pct"))


def timeline(df: DataFrame, keys: list[str], t: str = "t", x: str = "level_db", bin_s: float = 60.0, min_fill: float = 0.75) -> DataFrame:
    """Energy mean of each bin of ``bin_s`` seconds; null where under ``min_fill`` of the median fill."""
    bins = df.groupBy(*keys, F.floor(F.col(t) / bin_s).alias("bin")).agg(
        F.count(x).alias("frames"), db(F.avg(power(F.col(x)))).alias("mean_db")
    )
    typical = bins.groupBy(*keys).agg(quantile(F.col("frames"), 0.5).alias("typical"))
    enough = F.col("frames") >= min_fill * F.col("typical")
    return bins.join(typical, keys).select(
        *keys, "bin", "frames", F.when(enough, F.col("mean_db")).alias("laeq_db")
    )


def noise_floor(df: DataFrame, keys: list[str], n: int, x: str = "level_db", name: str = "floor_db", bias_db: float = MIN_BIAS_DB) -> DataFrame:
    """Adds the running minimum over ``n`` frames, lifted by ``bias_db``; the whole series' if it is no longer."""
    left = n // 2
    near = lambda w: F.min(x).over(w.rowsBetween(-left, n - 1 - left))
    # all rows of a series of no more than n lie within n - 1 of each
    out = series.framed(df, keys, n - 1, n - 1, {"_m": near, "_all": lambda w: F.min(x).over(w)})
    return out.withColumn(name, F.when(F.col("n") <= n, F.col("_all")).otherwise(F.col("_m")) + bias_db).drop("_m", "_all")


def floor_corrected(df: DataFrame, keys: list[str], n: int, x: str = "level_db", margin_db: float = MARGIN_DB) -> DataFrame:
    """Adds ``floor_db``, ``measurable`` and ``signal_db``, the level less the floor in power (null if not measurable)."""
    out = noise_floor(df, keys, n, x)
    excess, floor = power(F.col(x)) - power(F.col("floor_db")), power(F.col("floor_db"))
    out = out.withColumn("measurable", excess > floor * (10 ** (margin_db / 10) - 1))
    return out.withColumn("signal_db", F.when(F.col("measurable"), 10 * F.log10(F.when(excess > 0, excess))))


def floor_summary(df: DataFrame, keys: list[str], min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Energy mean of the measurable frames of :func:`floor_corrected`; null under ``min_coverage`` of them."""
    found = df.groupBy(*keys).agg(
        F.avg(F.col("measurable").cast("double")).alias("coverage"),
        F.sum(F.col("measurable").cast("bigint")).alias("n_measurable"),
        (10 * F.log10(F.avg(power(F.col("signal_db"))))).alias("_l"),
    )
    return found.withColumn("signal_level_db", F.when(F.col("coverage") >= min_coverage, F.col("_l"))).drop("_l")


def steady_sources(df: DataFrame, keys: list[str], short: int, long: int, x: str = "level_db", min_excess_db: float = 3.0) -> DataFrame:
    """Machines that cycle: how far the floor over ``short`` frames stands above that over ``long`` frames, and how often."""
    both = noise_floor(noise_floor(df, keys, short, x, "short_db"), keys, long, x, "long_db")
    excess = F.col("short_db") - F.col("long_db")
    running = excess >= min_excess_db
    found = both.groupBy(*keys).agg(
        quantile(F.col("long_db"), 0.5).alias("self_noise_db"),
        F.avg(running.cast("double")).alias("machine_duty"),
        quantile(F.when(running, excess), 0.5).alias("steady_excess_db"),
    )
    return found.withColumn("machine_detected", (F.col("machine_duty") > 0.02) & (F.col("machine_duty") < 0.98))


def floor_occupancy(df: DataFrame, keys: list[str], x: str = "level_db", within_db: float = 3.0, pct: float = 5.0) -> DataFrame:
    """Share of frames within ``within_db`` of the series' own floor, that floor, and the median height above it."""
    floors = df.groupBy(*keys).agg(quantile(F.col(x), pct / 100).alias("floor_db"))
    above = F.col(x) - F.col("floor_db")
    return (
        df.join(floors, keys)
        .groupBy(*keys, "floor_db")
        .agg(F.avg((above <= within_db).cast("double")).alias("at_floor_fraction"), quantile(above, 0.5).alias("median_above_floor_db"))
    )


def floor_spread(df: DataFrame, keys: list[str], chunk: int, x: str = "level_db", pct: float = 10.0, min_chunks: int = 6, limit_db: float = 1.5) -> DataFrame:
    """How much the floors of whole chunks of ``chunk`` rows vary: median less 5th percentile; suspect under ``limit_db``."""
    whole = df.withColumn("chunk", F.floor((F.col("i") - 1) / chunk)).where(F.col("chunk") < F.floor(F.col("n") / chunk))
    floors = whole.groupBy(*keys, "chunk").agg(quantile(F.col(x), pct / 100).alias("floor"))
    found = floors.groupBy(*keys).agg(
        F.count("*").alias("chunks"),
        (quantile(F.col("floor"), 0.5) - quantile(F.col("floor"), 0.05)).alias("floor_spread_db"),
        quantile(F.col("floor"), 0.5).alias("floor_median_db"),
    )
    enough = F.col("chunks") >= min_chunks
    return found.withColumn("floor_suspect", enough & (F.col("floor_spread_db") < limit_db) & (F.col("floor_median_db") > -119.0))


def floor_suspicion(df: DataFrame, keys: list[str], band_powers: str, centres: list[float], nyquist: float, chunk: int = 300, pct: float = 10.0, min_chunks: int = 6, limit_db: float = 1.5, from_hz: float = 2000.0) -> DataFrame:
    """Whether the floors of high bands move so little that they may be the recorder's: per series ``floor_suspect``, the
    range in Hz of the bands that say so, and the smallest spread among them (null if none does).

    Rows are seconds with ``i``, ``n`` and an array of band powers.  A band counts from ``from_hz`` on, if it reaches
    under the Nyquist rate; its floor is that of whole chunks, of which there must be ``min_chunks``.
    """
    whole = df.withColumn("chunk", F.floor((F.col("i") - 1) / chunk)).where(F.col("chunk") < F.floor(F.col("n") / chunk))
    cells = whole.select(*keys, "chunk", F.posexplode(band_powers).alias("band", "_p"))
    hz = F.get(F.array(*[F.lit(float(c)) for c in centres]), F.col("band"))
    low = cells.groupBy(*keys, "chunk", "band").agg(quantile(db(F.col("_p")), pct / 100).alias("floor"))
    bands = low.groupBy(*keys, "band").agg(
        F.count("*").alias("chunks"),
        quantile(F.col("floor"), 0.5).alias("middle"),
        (quantile(F.col("floor"), 0.5) - quantile(F.col("floor"), 0.05)).alias("spread"),
    )
    suspect = (F.col("chunks") >= min_chunks) & (hz >= from_hz) & (hz / 2**0.5 < nyquist) & (F.col("spread") < limit_db) & (F.col("middle") > -119.0)
    held = bands.withColumn("_s", suspect)
    of = lambda c: F.when(F.col("_s"), c)
    found = held.groupBy(*keys).agg(
        F.max("_s").alias("floor_suspect"),
        F.rint(F.min(of(hz)) / 2**0.5).cast("int").alias("floor_suspect_lo_hz"),
        F.rint(F.least(F.max(of(hz)) * 2**0.5, F.lit(float(nyquist)))).cast("int").alias("floor_suspect_hi_hz"),
        F.min(of(F.col("spread"))).alias("floor_spread_db"),
    )
    some = F.col("floor_suspect")
    named = {c: F.when(some, F.col(c)) for c in ("floor_suspect_lo_hz", "floor_suspect_hi_hz")}
    return df.select(*keys).distinct().join(found.withColumns(named), keys, "left").fillna(False, ["floor_suspect"])


def pick_segments(df: DataFrame, keys: list[str], t: str, x: str, dt: float, seg_s: float = 600.0, jump_db: float = 6.0, smooth_s: float = 30.0) -> DataFrame:
    """Windows worth hearing: the quietest, the most active, the most typical, and that about the largest jump of the
    level (if it is over ``jump_db``); of a series shorter than a window, all of it.  (keys..., kind, t0, dur_s, also):
    a window that several kinds share is given once, with the others in ``also``.

    Rows are numbered (``i``, ``n``).
    """
    size = max(1, int(seg_s / dt))
    means = df.groupBy(*keys).agg(F.avg(x).alias("_mean"), F.min(t).alias("_first"), F.max(t).alias("_last"))
    rows = df.select(*keys, "i", "n", F.col(t).alias("_t"), F.col(x).alias("_x")).join(means, keys)
    away = F.pow(F.col("_x") - F.col("_mean"), 2)
    rows = rows.withColumns({"_p": power(F.col("_x")), "_v": away})
    windows = series.framed(rows, keys, 0, size - 1, {"_e": lambda w: F.avg("_p").over(w), "_a": lambda w: F.avg("_v").over(w)})
    whole = windows.where(F.col("i") + size - 1 <= F.col("n")).withColumn("_l", db(F.col("_e")))
    middle = whole.groupBy(*keys).agg(quantile(F.col("_l"), 0.5).alias("_mid"))
    near = F.abs(F.col("_l") - F.col("_mid"))
    best = lambda value: F.min_by("_t", F.struct(F.round(value, 9), F.col("i")))
    picks = whole.join(middle, keys).groupBy(*keys).agg(
        best(F.col("_e")).alias("quietest"), best(-F.col("_a")).alias("most_active"), best(near).alias("typical")
    )
    smooth = series.rank_filter(rows.select(*keys, "i", "n", "_t", "_x", "_first"), keys, "_x", max(3, int(smooth_s / dt) | 1), 50.0, "_s")
    steps = series.previous(smooth, keys, {"_b": "_s"})
    jump = F.abs(F.col("_s") - F.col("_b"))
    at = F.greatest(F.min("_first"), F.max_by(F.col("_t") - dt, F.struct(jump, -F.col("i"))) - seg_s / 2)
    moves = steps.where(F.col("_b").isNotNull()).groupBy(*keys).agg(F.when(F.max(jump) > jump_db, at).alias("transition"))
    wide = means.join(picks, keys, "left").join(moves, keys, "left")
    kinds = ["quietest", "most_active", "typical", "transition"]
    listed = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(at).alias("place"), F.col(k).alias("t0")) for at, k in enumerate(kinds)])
    some = wide.where("quietest is not null").select(*keys, F.explode(F.filter(listed, lambda s: s["t0"].isNotNull())).alias("s")).select(*keys, "s.*")
    # a kind joins the first one whose window starts within a frame of its own
    earlier = some.select(*keys, F.col("place").alias("_pl"), F.col("t0").alias("_t0"), F.col("kind").alias("_k"))
    met = some.join(earlier, keys).where((F.col("_pl") <= F.col("place")) & (F.abs(F.col("_t0") - F.col("t0")) <= dt))
    owner = met.groupBy(*keys, "kind", "place", "t0").agg(F.min(F.struct("_pl", "_k", "_t0")).alias("o"))
    out = owner.groupBy(*keys, F.col("o._k").alias("kind"), F.col("o._t0").alias("t0")).agg(
        F.lit(float(seg_s)).alias("dur_s"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") != F.col("o._k"), F.struct("place", "kind")))), lambda s: s["kind"]).alias("also"),
    )
    short = wide.where("quietest is null").select(
        *keys, F.lit("whole").alias("kind"), F.col("_first").alias("t0"), (F.col("_last") - F.col("_first")).alias("dur_s"), F.array().cast("array<string>").alias("also")
    )
    return out.unionByName(short)


def quietest(df: DataFrame, keys: list[str], channel: str, x: str = "level_db", pct: float = 5.0) -> DataFrame:
    """Per key, the channel with the lowest low percentile (the first in order among equals)."""
    floors = df.groupBy(*keys, channel).agg(quantile(F.col(x), pct / 100).alias("low_db"))
    least = F.min(F.struct("low_db", channel))
    return floors.groupBy(*keys).agg(least.alias("_m")).select(*keys, F.col(f"_m.{channel}").alias(channel), F.col("_m.low_db").alias("low_db"))


def apply_offset(df: DataFrame, names: list[str], offset_db: float) -> DataFrame:
    """Adds, for each level column, its value in sound pressure level, to a tenth of a decibel."""
    return df.withColumns({f"{c}_spl": F.round(F.col(c) + offset_db, 1) for c in names})
