"""Indices of band spectra: rows (keys..., ``i``, ``n``, ``spec``), ``spec`` an array of power per band."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import quantile
from ..plans import series

_EPS = 1e-20


def centres(edges: list[float]) -> list[float]:
    """Geometric centres of the bands between edges."""
    return [math.sqrt(a * b) for a, b in zip(edges, edges[1:], strict=False)]


def bands(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each band: the kept columns, ``band`` (from 0) and ``power``."""
    return df.select(*keep, F.posexplode("spec").alias("band", "power"))


def _at(band: Column, values: list[float]) -> Column:
    return F.get(F.array(*[F.lit(float(v)) for v in values]), band)


def band_sum(spec: Column, fc: list[float], lo: float, hi: float, closed: bool = True) -> Column:
    """Power of the bands whose centre lies in [lo, hi], or in [lo, hi)."""
    picked = [k for k, f in enumerate(fc) if lo <= f and (f <= hi if closed else f < hi)]
    return sum((F.get(spec, F.lit(k)) for k in picked), F.lit(0.0))


def complexity(df: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """Mean over whole chunks of ``chunk`` rows of the bands' summed changes over their sums (null: no whole chunk)."""
    whole = df.withColumn("chunk", F.floor((F.col("i") - 1) / chunk)).withColumn("chunks", F.floor(F.col("n") / chunk))
    rows = bands(whole.where("chunk < chunks"), [*keys, "i", "chunk"])
    step = Window.partitionBy(*keys, "chunk", "band").orderBy("i")
    rows = rows.withColumn("change", F.abs(F.col("power") - F.lag("power").over(step)))
    ratio = F.coalesce(F.sum("change"), F.lit(0.0)) / (F.sum("power") + _EPS)
    per_band = rows.groupBy(*keys, "chunk", "band").agg(ratio.alias("r"))
    return per_band.groupBy(*keys, "chunk").agg(F.sum("r").alias("r")).groupBy(*keys).agg(F.avg("r").alias("aci"))


def mean_spectrum(df: DataFrame, keys: list[str]) -> DataFrame:
    return bands(df, keys).groupBy(*keys, "band").agg(F.avg("power").alias("power"))


def occupancy(df: DataFrame, keys: list[str], fc: list[float], fmax: float = 10000.0, bin_hz: float = 1000.0, limit_db: float = -50.0) -> DataFrame:
    """Share of cells over ``limit_db`` below the largest cell, for each frequency bin that has a band."""
    rows = bands(df, keys).withColumn("bin", F.floor(_at(F.col("band"), fc) / bin_hz)).where(F.col("bin") < fmax / bin_hz)
    top = bands(df, keys).groupBy(*keys).agg(F.max("power").alias("top"))
    over = 10 * F.log10(F.col("power") / (F.col("top") + _EPS) + _EPS) > limit_db
    return rows.join(top, keys).groupBy(*keys, "bin").agg(F.avg(over.cast("double")).alias("occupancy"))


def diversity(found: DataFrame, keys: list[str]) -> DataFrame:
    """Entropy (``adi``) and unevenness (``aei``) of :func:`occupancy`."""
    all_ = Window.partitionBy(*keys)
    p = F.col("occupancy") / (F.sum("occupancy").over(all_) + _EPS)
    rows = found.withColumns({"p": p, "rank": F.row_number().over(all_.orderBy("occupancy", "bin")), "bins": F.count("*").over(all_)})
    weight = 2 * F.col("rank") - F.col("bins") - 1
    return rows.groupBy(*keys).agg(
        (-F.sum(F.col("p") * F.ln(F.col("p") + _EPS)) / F.ln(F.max("bins") + F.lit(_EPS))).alias("adi"),
        (F.sum(weight * F.col("occupancy")) / (F.max("bins") * F.sum("occupancy") + _EPS)).alias("aei"),
    )


def difference_index(df: DataFrame, keys: list[str], fc: list[float], low=(1000.0, 2000.0), high=(2000.0, 8000.0)) -> DataFrame:
    """(B-A)/(B+A) of the mean spectrum's power in two half-open bands."""
    f = _at(F.col("band"), fc)
    part = lambda r: F.sum(F.when((f >= r[0]) & (f < r[1]), F.col("power")).otherwise(0.0))
    a, b = part(low), part(high)
    return mean_spectrum(df, keys).groupBy(*keys).agg(((b - a) / (b + a + _EPS)).alias("ndsi"))


def area_index(df: DataFrame, keys: list[str], fc: list[float], band=(2000.0, 8000.0)) -> DataFrame:
    """Area of the mean spectrum in decibels above its lowest value, in a closed band."""
    f = _at(F.col("band"), fc)
    rows = mean_spectrum(df, keys).where((f >= band[0]) & (f <= band[1])).withColumn("l", 10 * F.log10(F.col("power") + _EPS))
    return rows.groupBy(*keys).agg((F.sum("l") - F.count("l") * F.min("l")).alias("bi"))


def _entropy(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    p = F.col(value) / (F.sum(value).over(Window.partitionBy(*keys)) + _EPS)
    return df.withColumn("_p", p).groupBy(*keys).agg((-F.sum(F.col("_p") * F.ln(F.col("_p") + _EPS)) / F.ln(F.count("*"))).alias(name))


def entropy(df: DataFrame, keys: list[str], envelope: str) -> DataFrame:
    """Spectral entropy times temporal entropy.  The series is summed first, so no window holds it."""
    spectral = _entropy(mean_spectrum(df, keys), keys, "power", "hf")
    totals = df.groupBy(*keys).agg(F.sum(envelope).alias("_t"), F.count("*").alias("_n"))
    p = F.col(envelope) / (F.col("_t") + _EPS)
    temporal = df.join(totals, keys).groupBy(*keys, "_n").agg((-F.sum(p * F.ln(p + _EPS)) / F.ln(F.col("_n"))).alias("ht"))
    return spectral.join(temporal, keys).select(*keys, (F.col("hf") * F.col("ht")).alias("acoustic_entropy"))


def foreground(df: DataFrame, keys: list[str], size: int, pct: float = 10.0, rise_db: float = 3.0) -> DataFrame:
    """Per row, the share of its power in bands more than ``rise_db`` above their running background."""
    rows = bands(df, [*keys, "i", "n"])
    rows = series.rank_filter(rows, [*keys, "band"], "power", size, pct, "bg")
    rise = 10 * F.log10((F.col("power") + _EPS) / (F.col("bg") + _EPS))
    part = F.sum(F.when(rise > rise_db, F.col("power")).otherwise(0.0)) / (F.sum("power") + _EPS)
    return rows.groupBy(*keys, "i").agg(part.alias("fg_fraction"))


def rises(df: DataFrame, keys: list[str], size: int, pct: float = 10.0) -> DataFrame:
    """Per row, how far each band stands over its running background, in decibels: (keys..., i, rise)."""
    rows = series.rank_filter(bands(df, [*keys, "i", "n"]), [*keys, "band"], "power", size, pct, "bg")
    rise = 10 * F.log10((F.col("power") + _EPS) / (F.col("bg") + _EPS))
    held = F.sort_array(F.collect_list(F.struct("band", rise.alias("r"))))
    return rows.groupBy(*keys, "i").agg(F.transform(held, lambda s: s["r"]).alias("rise"))


def masking(df: DataFrame, keys: list[str], active: Column) -> DataFrame:
    """Per band, how far the median of active rows stands over that of the others, in decibels."""
    rows = bands(df.withColumn("_on", active), [*keys, "_on"])
    on, off = (quantile(F.when(c, F.col("power")), 0.5) for c in (F.col("_on"), ~F.col("_on")))
    return rows.groupBy(*keys, "band").agg((10 * F.log10((on + _EPS) / (off + _EPS))).alias("masking_db"))
