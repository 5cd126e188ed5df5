"""Directions and phases: resultants, entropy of azimuths, hopping windows, schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import circular_sd, rayleigh_p

_EPS = 1e-20


def _sums(angle: Column, weight: Column) -> list[Column]:
    return [F.sum(weight * F.cos(angle)).alias("_c"), F.sum(weight * F.sin(angle)).alias("_s"), F.sum(weight).alias("_w")]


def _resultant() -> tuple[Column, Column]:
    c, s = F.col("_c") / (F.col("_w") + _EPS), F.col("_s") / (F.col("_w") + _EPS)
    return F.atan2(s, c), F.sqrt(c * c + s * s)


def mean_direction(df: DataFrame, keys: list[str], angle: Column, weight: Column | None = None) -> DataFrame:
    """Weighted mean angle in radians and resultant length."""
    found = df.groupBy(*keys).agg(*_sums(angle, F.lit(1.0) if weight is None else weight))
    mean, r = _resultant()
    return found.select(*keys, mean.alias("mean_angle"), r.alias("r"))


def phase_stats(df: DataFrame, keys: list[str], t: str, period: float) -> DataFrame:
    """Times folded at ``period``: mean phase, resultant, spread in seconds, chance, number."""
    angle = 2 * math.pi * F.pmod(F.col(t) / period, F.lit(1.0))
    found = df.groupBy(*keys).agg(*_sums(angle, F.lit(1.0)), F.count("*").alias("n"))
    mean, r = _resultant()
    return found.select(
        *keys,
        F.pmod(mean / (2 * math.pi), F.lit(1.0)).alias("mean_phase"),
        r.alias("r"),
        (circular_sd(r) * period / (2 * math.pi)).alias("circ_sd_s"),
        rayleigh_p(r, F.col("n")).alias("rayleigh_p"),
        "n",
    )


def best_period(df: DataFrame, keys: list[str], t: str, periods: list[float]) -> DataFrame:
    """Of a stated list of periods, that with the longest resultant (the first among equals)."""
    grid = F.explode(F.array(*[F.struct(F.lit(-k).alias("rank"), F.lit(p).alias("period")) for k, p in enumerate(periods)]))
    rows = df.select(*keys, t, grid.alias("g")).select(*keys, t, "g.*")
    angle = 2 * math.pi * F.pmod(F.col(t) / F.col("period"), F.lit(1.0))
    found = rows.groupBy(*keys, "rank", "period").agg(*_sums(angle, F.lit(1.0)))
    found = found.withColumn("r", _resultant()[1])
    best = F.max(F.struct("r", "rank", "period")).alias("b")
    return found.groupBy(*keys).agg(best).select(*keys, F.col("b.period").alias("period"), F.col("b.r").alias("r"))


def correlation(df: DataFrame, keys: list[str], a: Column, b: Column) -> DataFrame:
    """Circular correlation of two angles."""
    one = F.lit(1.0)
    means = df.groupBy(*keys).agg(
        F.atan2(F.sum(F.sin(a) * one), F.sum(F.cos(a) * one)).alias("_ma"), F.atan2(F.sum(F.sin(b)), F.sum(F.cos(b))).alias("_mb")
    )
    rows = df.join(means, keys)
    x, y = F.sin(a - F.col("_ma")), F.sin(b - F.col("_mb"))
    sums = rows.groupBy(*keys).agg(F.sum(x * y).alias("_xy"), F.sum(x * x).alias("_xx"), F.sum(y * y).alias("_yy"))
    norm = F.sqrt(F.col("_xx") * F.col("_yy"))
    return sums.select(*keys, F.when(norm > 0, F.col("_xy") / norm).alias("circ_corr"))


def relative_phase(times: DataFrame, refs: DataFrame, keys: list[str], t: str, period: float) -> DataFrame:
    """Phase of each time behind the reference before it, the first reference if there is none; then as phase_stats.

    References are matched in hour-long buckets: within a bucket by a window, else by the last reference of an
    earlier bucket.
    """
    width = 3600.0
    both = times.select(*keys, F.col(t).alias("t"), F.lit(1).alias("kind")).unionByName(
        refs.select(*keys, F.col(t).alias("t"), F.lit(0).alias("kind"))
    )
    both = both.withColumn("_b", F.floor(F.col("t") / width)).withColumn("_r", F.when(F.col("kind") == 0, F.col("t")))
    buckets = both.groupBy(*keys, "_b").agg(F.max("_r").alias("_last"), F.min("_r").alias("_least"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select(
        *keys, "_b", F.last("_last", True).over(before).alias("_o"), F.min("_least").over(Window.partitionBy(*keys)).alias("_first")
    )
    within = Window.partitionBy(*keys, "_b").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("_w", F.last("_r", True).over(within)).where("kind = 1").join(carried, [*keys, "_b"])
    behind = F.col("t") - F.coalesce("_w", "_o", "_first")
    return phase_stats(rows.withColumn("behind", behind).where(behind.isNotNull()), keys, "behind", period)


def _shares(df: DataFrame, keys: list[str], weight: Column, cell: Column) -> DataFrame:
    cells = df.groupBy(*keys, cell.alias("cell")).agg(F.sum(weight).alias("w"))
    totals = cells.groupBy(*keys).agg(F.sum("w").alias("_t"))
    return cells.join(totals, keys).select(*keys, "cell", F.when(F.col("_t") > 0, F.col("w") / F.col("_t")).alias("p"))


def azimuth_cell(az: Column, span: float = 180.0, bins: int = 36) -> Column:
    """Number of the bin of [-span, span]; the last one is closed on the right; null beyond."""
    k = F.floor((az + span) / (2 * span / bins)).cast("int")
    return F.when((az >= -span) & (az <= span), F.least(k, F.lit(bins - 1)))


def directional_entropy(df: DataFrame, keys: list[str], az: Column, weight: Column, bins: int = 36) -> DataFrame:
    """Entropy of the weighted azimuth histogram, 0 (one direction) to 1 (all alike)."""
    shares = _shares(df.where(az.isNotNull()), keys, weight, azimuth_cell(az, bins=bins))
    return shares.groupBy(*keys).agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln("p"))) / math.log(bins)).alias("entropy"))


def horizon_fractions(df: DataFrame, keys: list[str], el: Column, weight: Column, limit: float = 10.0) -> DataFrame:
    """Shares of the energy from above, near and below the horizon."""
    part = lambda c: F.sum(F.when(c, weight).otherwise(0.0)) / (F.sum(weight) + _EPS)
    return df.groupBy(*keys).agg(
        part(el > limit).alias("above"), part(F.abs(el) <= limit).alias("near"), part(el < -limit).alias("below")
    )


def overlap(df: DataFrame, keys: list[str], az: Column, weight: Column, loud: Column, quiet: Column, bins: int = 36) -> DataFrame:
    """Likeness of the weighted azimuth histograms of loud and quiet frames, 0 to 1."""
    cell = azimuth_cell(az, bins=bins)
    a = _shares(df.where(loud), keys, weight, cell).withColumnRenamed("p", "_p")
    b = _shares(df.where(quiet), keys, weight, cell).withColumnRenamed("p", "_q")
    return a.join(b, [*keys, "cell"]).groupBy(*keys).agg(F.sum(F.sqrt(F.col("_p") * F.col("_q"))).alias("overlap"))


def organisation(df: DataFrame, keys: list[str], angle: Column, weight: Column, window: int = 60, step: int = 20) -> DataFrame:
    """Resultant in windows of ``window`` rows every ``step``; a shorter series is one window.  Needs ``i`` and ``n``."""
    last = F.greatest(F.floor((F.col("n") - window) / step), F.lit(0))
    at = F.col("i") - 1
    low = F.greatest(F.ceil((at - window + 1) / step), F.lit(0))
    high = F.least(F.floor(at / step), last)
    rows = df.where(low <= high).withColumn("window", F.explode(F.sequence(low, high)))
    found = rows.groupBy(*keys, "window").agg(*_sums(angle, weight), F.count("*").alias("rows"))
    mean, r = _resultant()
    return found.select(*keys, "window", "rows", mean.alias("mean_angle"), r.alias("r"))


def grid_scan(df: DataFrame, keys: list[str], t: str, x: str, bg: str, period: float, phase: float = 0.0, window: float = 120.0, rise_db: float = 6.0) -> DataFrame:
    """Per tick of a schedule, the largest rise over ``bg`` within half a window, and whether it reaches ``rise_db``.

    Each row goes to the ticks within reach of it, so the match is an equi-grouping.
    """
    ends = df.groupBy(*keys).agg(F.min(t).alias("_a"), F.max(t).alias("_z"))
    low = F.ceil((F.col(t) - window / 2 - phase) / period)
    high = F.floor((F.col(t) + window / 2 - phase) / period)
    rows = df.where(low <= high).withColumn("k", F.explode(F.sequence(low, high))).join(ends, keys)
    tick = F.col("k") * period + phase
    rows = rows.where((tick >= F.col("_a")) & (tick <= F.col("_z"))).withColumn("tick", tick)
    best = F.max(F.struct((F.col(x) - F.col(bg)).alias("rise"), (-F.col(t)).alias("at"))).alias("b")
    found = rows.groupBy(*keys, "tick").agg(best)
    return found.select(
        *keys, "tick", F.col("b.rise").alias("rise_db"), (-F.col("b.at") - F.col("tick")).alias("offset_s"), (F.col("b.rise") >= rise_db).alias("detected")
    )


#: The periods of public clocks, in seconds.
CIVIC = [60.0, 300.0, 900.0, 1800.0, 3600.0, 86400.0]


def match_periods(df: DataFrame, keys: list[str], t: str, periods: list[float] = CIVIC) -> DataFrame:
    """How events gather at a phase of each period, best first: phase, concentration, spread, chance, number, and how many
    cycles they are spread over (in one cycle any events gather)."""
    rows = df.select(*keys, F.col(t).alias("_t"), F.explode(F.array(*[F.lit(float(p)) for p in periods])).alias("period_s"))
    angle = 2 * math.pi * F.pmod(F.col("_t") / F.col("period_s"), F.lit(1.0))
    found = rows.groupBy(*keys, "period_s").agg(
        F.atan2(F.sum(F.sin(angle)), F.sum(F.cos(angle))).alias("_a"),
        (F.sqrt(F.pow(F.sum(F.sin(angle)), 2) + F.pow(F.sum(F.cos(angle)), 2)) / F.count("*")).alias("r"),
        F.count("*").alias("n"),
        (F.max("_t") - F.min("_t")).alias("_span"),
    )
    turn = F.pmod(F.col("_a") / (2 * math.pi), F.lit(1.0))
    out = found.select(
        *keys,
        "period_s",
        (turn * F.col("period_s")).alias("phase_s"),
        "r",
        (circular_sd(F.col("r")) / (2 * math.pi) * F.col("period_s")).alias("circ_sd_s"),
        rayleigh_p(F.col("r"), F.col("n")).alias("rayleigh_p"),
        "n",
        (F.floor(F.col("_span") / F.col("period_s")) + 1).alias("n_cycles"),
    )
    return out.orderBy(*keys, F.desc("r"))
