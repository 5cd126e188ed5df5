"""What beats: onset functions, periods, phases and grids of strikes, and clockwork.

Times of strikes are rows, so folding, windows and grids are table plans; what
needs a whole envelope in order is a task a group, of one recording each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dsp
from ..functions.scalars import quantile
from ..plans import series
from .cycles import _grouped, allan_deviation

_EPS = 1e-12


def rise_function(df: DataFrame, keys: list[str], t: str, envelopes: str, columns: list[int] | None = None) -> DataFrame:
    """Per row the mean rise, against the row before, of the logarithms of some columns of an array of envelopes (0 in the
    first row): what strikes are picked from."""
    order = Window.partitionBy(*keys).orderBy(t)
    picked = F.col(envelopes) if columns is None else F.array(*[F.get(envelopes, F.lit(c)) for c in columns])
    rows = df.withColumn("_l", F.transform(picked, lambda x: F.log10(x + _EPS)))
    before = F.coalesce(F.lag("_l").over(order), F.col("_l"))
    ups = F.zip_with(F.col("_l"), before, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    mean = F.aggregate(ups, F.lit(0.0), lambda s, x: s + x) / F.size(ups)
    return rows.select(*keys, t, mean.alias("odf"))


def structure(df: DataFrame, keys: list[str], t: str, x: str, dt: float, most_s: float = 8.0, share: float = 0.25, prominence: float = 0.02) -> DataFrame:
    """The cycle and the shortest gap of an onset function, from peaks of its autocorrelation: the first peak within a
    tenth of the highest, and the first of at least ``share`` of it."""

    def make(p):
        acf = dsp.autocorrelation(p[x].to_numpy(float))[: int(most_s / dt)]
        at = dsp.local_peaks(acf) if len(acf) else np.zeros(0, int)
        at = at[dsp.prominences(acf, at, np.full(len(at), len(acf))) >= prominence] if len(at) else at
        if not len(at):
            return []
        top = acf[at].max()
        return [{"cycle_s": at[acf[at] >= 0.9 * top][0] * dt, "gap_s": at[acf[at] >= share * top][0] * dt}]

    return _grouped(df, keys, t, "cycle_s double, gap_s double", make)


def concentration(df: DataFrame, keys: list[str], t: str, periods: DataFrame, harmonics: int = 2) -> DataFrame:
    """Per stated period (``periods``: one column period), how strikes gather at phases of it, summed over harmonics."""
    rows = df.select(*keys, F.col(t).alias("_t")).join(F.broadcast(periods))
    return _resultants(rows, keys, harmonics)


def _resultants(rows: DataFrame, keys: list[str], harmonics: int) -> DataFrame:
    angle = 2 * np.pi * F.col("_t") / F.col("period")
    parts = [F.sqrt(F.pow(F.avg(F.cos(h * angle)), 2) + F.pow(F.avg(F.sin(h * angle)), 2)) for h in range(1, harmonics + 1)]
    return rows.groupBy(*keys, "period").agg(sum(parts[1:], parts[0]).alias("strength"), F.count("*").alias("strikes"))


def grid_of(df: DataFrame, low: float, high: float, step: float) -> DataFrame:
    """A ladder of periods."""
    n = int(np.ceil((high - low) / step - 1e-9))
    return df.sparkSession.range(n).select((low + F.col("id") * step).alias("period"))


def best_period(df: DataFrame, keys: list[str], t: str, low: float = 0.5, high: float = 8.0, step: float = 5e-4, harmonics: int = 2) -> DataFrame:
    """The period of a ladder that gathers strikes best (the first among equals), refined by a parabola through its neighbours."""
    found = concentration(df, keys, t, grid_of(df, low, high, step), harmonics)
    order = Window.partitionBy(*keys).orderBy("period")
    told = found.withColumns({"_a": F.lag("strength").over(order), "_c": F.lead("strength").over(order)})
    best = told.groupBy(*keys).agg(F.max_by(F.struct("period", "strength", "_a", "_c"), F.struct(F.round("strength", 12), -F.col("period"))).alias("b"))
    a, b, c = F.col("b._a"), F.col("b.strength"), F.col("b._c")
    bend = 2 * (a - 2 * b + c)
    move = F.when(a.isNotNull() & c.isNotNull() & (bend != 0), (a - c) / bend).otherwise(0.0)
    return best.select(*keys, (F.col("b.period") + move * step).alias("period"), b.alias("strength"))


def period_track(df: DataFrame, keys: list[str], t: str, period: float, window: float = 150.0, step: float = 30.0, reach: float = 0.05, harmonics: int = 2, least: int = 20) -> DataFrame:
    """The best period near a known one in windows that slide, of at least ``least`` strikes: (keys..., t, period)."""
    ends = df.groupBy(*keys).agg(F.min(t).alias("_first"), F.max(t).alias("_end"))
    rows = df.select(*keys, F.col(t).alias("_t")).join(ends, keys)
    since = F.col("_t") - F.col("_first")
    low = F.greatest(F.lit(0), F.floor((since - window) / step) + 1)
    high = F.least(F.floor(since / step), F.ceil((F.col("_end") - window - F.col("_first")) / step) - 1)
    dealt = rows.where(low <= high).withColumn("w", F.explode(F.sequence(low, high)))
    dealt = dealt.withColumn("at", F.col("_first") + F.col("w") * step + window / 2)
    grid = grid_of(df, period - reach, period + reach, 5e-4)
    found = _resultants(dealt.join(F.broadcast(grid)), [*keys, "w", "at"], harmonics).where(F.col("strikes") >= least)
    best = F.max_by("period", F.struct(F.round("strength", 12), -F.col("period")))
    return found.groupBy(*keys, "w", "at").agg(best.alias("period")).select(*keys, F.col("at").alias("t"), "period")


def phase_clusters(df: DataFrame, keys: list[str], t: str, period: float, width: float = 0.12) -> DataFrame:
    """Strikes by phase of a period: modes of the histogram, the highest first, each taking what lies within ``width``
    and is still free; phase 0 is the first mode.  Strikes of no mode have cluster -1."""

    def make(p):
        at = p[t].to_numpy(float)
        phase = np.mod(at / period, 1)
        counts, edges = np.histogram(phase, bins=100)
        phase = np.mod(phase - edges[counts.argmax()] - 0.005, 1)
        label, centres = np.full(len(at), -1), []
        while (label < 0).any():
            counts = np.bincount(np.minimum((phase[label < 0] * 50).astype(int), 49), minlength=50)
            if counts.max() < max(3, 0.02 * len(at)):
                break
            centre = (counts.argmax() + 0.5) / 50
            off = np.abs(phase - centre)
            mine = (label < 0) & (np.minimum(off, 1 - off) < width)
            if not mine.any():
                break
            label[mine] = len(centres)
            centres.append(centre)
        return [{"t_s": s, "phase": f, "cluster": int(c), "centre": centres[c] if c >= 0 else None} for s, f, c in zip(at, phase, label, strict=True)]

    return _grouped(df, keys, t, "t_s double, phase double, cluster int, centre double", make)


def cycle_grid(df: DataFrame, keys: list[str], stream: str, t: str, period: float, end: float, reference: str, wander_s: float = 60.0) -> DataFrame:
    """How named streams of strikes keep to one cycle, whose start is the median phase of the stream ``reference``.

    Per stream: place in the cycle, share of cycles hit (within 0.45 of a period; the nearest counts), deviation, its
    parts slower and faster than ``wander_s``, and the correlation of neighbours.
    """
    def middle(rows: DataFrame, by: list[str], since: Column, name: str) -> DataFrame:
        """The median place in the cycle, taken about the mean direction, so that it does not matter where a cycle begins."""
        angle = 2 * np.pi * since / period
        mean = rows.groupBy(*by).agg(F.atan2(F.sum(F.sin(angle)), F.sum(F.cos(angle))).alias("_m"))
        off = F.pmod(since / period - F.col("_m") / (2 * np.pi) + 0.5, F.lit(1.0)) - 0.5
        about = rows.join(mean, by) if by else rows.join(F.broadcast(mean))
        found = about.groupBy(*by, "_m").agg(quantile(off, 0.5).alias("_o"))
        return found.select(*by, (F.pmod(F.col("_m") / (2 * np.pi) + F.col("_o"), F.lit(1.0)) * period).alias(name))

    start = middle(df.where(F.col(stream) == reference), keys, F.col(t), "_t0")
    rows = df.join(start, keys).withColumn("_n", F.floor((end - F.col("_t0")) / period))
    place = middle(rows, [*keys, stream], F.col(t) - F.col("_t0"), "place_s")
    # a place just under a whole cycle is one just before its start
    near_end = F.when(F.col("place_s") > 0.999 * period, F.col("place_s") - period).otherwise(F.col("place_s"))
    place = place.withColumn("place_s", near_end)
    rows = rows.join(place, [*keys, stream]).withColumn("cycle", F.rint((F.col(t) - F.col("_t0") - F.col("place_s")) / period).cast("bigint"))
    rest = F.col(t) - (F.col("_t0") + F.col("cycle") * period + F.col("place_s"))
    rows = rows.withColumn("rest", rest).where((F.col("cycle") >= 0) & (F.col("cycle") < F.col("_n")) & (F.abs("rest") < 0.45 * period))
    near = rows.groupBy(*keys, stream, "place_s", "_n", "cycle").agg(F.min_by("rest", F.abs("rest")).alias("rest"))
    size = max(3, int(wander_s / period))

    def make(p):
        n = int(p["_n"].iloc[0])
        at, rest = p["cycle"].to_numpy(int), p["rest"].to_numpy(float)
        every = np.interp(np.arange(n), at, rest)
        half = size // 2
        padded = np.concatenate([every[:half][::-1], every, every[n - (size - 1 - half) :][::-1] if size - 1 - half else every[:0]])
        slow = np.convolve(padded, np.ones(size) / size, "valid")[:n] if len(padded) >= size else every
        nearby = np.flatnonzero(np.diff(at) == 1)
        pairs = rest[nearby], rest[nearby + 1]
        lag = float(np.corrcoef(*pairs)[0, 1]) if len(nearby) > 3 else None
        return [
            {
                "place_s": p["place_s"].iloc[0],
                "cycles": n,
                "hit_rate": len(at) / n,
                "sd_ms": rest.std() * 1e3,
                "lag1": lag,
                "slow_sd_ms": slow.std() * 1e3,
                "fast_sd_ms": (every[: len(slow)] - slow).std() * 1e3,
            }
        ]

    shape = "place_s double, cycles int, hit_rate double, sd_ms double, lag1 double, slow_sd_ms double, fast_sd_ms double"
    return _grouped(near.drop("place_s").join(place, [*keys, stream]), [*keys, stream], "cycle", shape, make)


def crosstalk(df: DataFrame, keys: list[str], stream: str, t: str, within_s: float = 0.06) -> DataFrame:
    """Per pair of streams, the share of the first one's strikes that have one of the other within ``within_s``."""
    a = df.select(*keys, F.col(stream).alias("a"), F.col(t).alias("ta"))
    b = df.select(*keys, F.col(stream).alias("b"), F.col(t).alias("tb"))
    cell = lambda x: F.floor(x / within_s)
    near = b.withColumn("_c", F.explode(F.array(cell(F.col("tb")) - 1, cell(F.col("tb")), cell(F.col("tb")) + 1)))
    met = a.withColumn("_c", cell(F.col("ta"))).join(near, [*keys, "_c"]).where((F.col("a") != F.col("b")) & (F.abs(F.col("ta") - F.col("tb")) < within_s))
    hits = met.groupBy(*keys, "a", "b").agg(F.count_distinct("ta").alias("_h"))
    sizes = a.groupBy(*keys, "a").agg(F.count_distinct("ta").alias("_n"))
    return hits.join(sizes, [*keys, "a"]).select(*keys, "a", "b", (F.col("_h") / F.col("_n")).alias("share"))


# ------------------------------------------------------------------ clockwork


def click_envelope(x: np.ndarray, fs: int, low: float = 2000.0, high: float = 9000.0, rate: int = 1000) -> np.ndarray:
    """Clicks of a signal at ``rate`` values a second: the mean size in a band, over its median, as a logarithm, less its
    running median of two seconds."""
    high = min(high, 0.45 * fs)
    f = np.fft.rfftfreq(len(x), 1 / fs)
    with np.errstate(divide="ignore"):
        away = (f**2 - low * high) / (np.maximum(f, 1e-9) * (high - low))
    band = np.fft.irfft(np.fft.rfft(x) / np.sqrt(1 + away**8), len(x))
    hop = round(fs / rate)
    size = np.abs(band[: len(band) // hop * hop]).reshape(-1, hop).mean(axis=1)
    said = np.log1p(size / (np.median(size) + _EPS))
    return said - dsp.rank_filter(said, 2 * rate + 1, 50)


def beat_of(envelope: np.ndarray, rate: int = 1000, slowest: float = 0.3, fastest: float = 6.0) -> float:
    """Seconds from tick to tick: the first peak of the autocorrelation of at least 0.4 of the highest in range."""
    acf = dsp.autocorrelation(envelope[: 400 * rate])
    low, high = int(rate / fastest), min(int(rate / slowest), len(acf))
    part = acf[low:high]
    at = dsp.local_peaks(part, 0.0)
    if not len(at):
        return float((low + part.argmax()) / rate)
    return float((low + at[part[at] >= 0.4 * part[at].max()][0]) / rate)


def ticks_of(envelope: np.ndarray, rate: int, beat_s: float, k: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Times and heights of ticks: peaks over ``k`` median deviations, 0.55 of a beat apart at least, between samples."""
    middle = np.median(envelope)
    bound = middle + k * (np.median(np.abs(envelope - middle)) + _EPS)
    at = dsp.local_peaks(envelope, bound, max(1, int(0.55 * beat_s * rate)))
    return np.array([dsp.parabolic(envelope, int(i)) for i in at]) / rate, envelope[at]


def tick_table(blocks: DataFrame, keys: list[str], samples: str, fs: int, k: float = 3.0, rate: int = 1000) -> DataFrame:
    """Per row of samples its beat and ticks: (keys..., beat_s, t, height)."""
    from .tones import _rows

    def make(x):
        envelope = click_envelope(x, fs, rate=rate)
        beat = beat_of(envelope, rate)
        t, height = ticks_of(envelope, rate, beat, k)
        return [{"beat_s": beat, "t": a, "height": h} for a, h in zip(t, height, strict=True)]

    return _rows(blocks, keys, [samples], "beat_s double, t double, height double", make)


def tick_runs(ticks: DataFrame, keys: list[str], t: str, beat: Column, least: int = 4) -> DataFrame:
    """Ticks with the number ``run`` of their stretch without a gap over 1.6 beats and their place in it; shorter than
    ``least`` go."""
    order = Window.partitionBy(*keys).orderBy(t)
    new = F.when(F.col(t) - F.lag(t).over(order) <= 1.6 * beat, 0).otherwise(1)
    rows = ticks.withColumn("_new", new).withColumn("run", F.sum("_new").over(order)).drop("_new")
    of = Window.partitionBy(*keys, "run")
    return rows.withColumns({"place": F.row_number().over(of.orderBy(t)) - 1, "_n": F.count("*").over(of)}).where(F.col("_n") >= least)


def beat_stats(ticks: DataFrame, keys: list[str], t: str = "t", height: str = "height", beat: str = "beat_s") -> DataFrame:
    """A watchmaker's figures of ticks in runs: intervals (0.6 to 1.6 beats) and their spread, the spread of whole cycles
    about their running median and of that median, the correlation of neighbouring cycles, how uneven tick and tock are
    in time and height, and the change of rate from one half to the other in parts per million."""
    rows = tick_runs(ticks, keys, t, F.col(beat))
    inside = Window.partitionBy(*keys, "run").orderBy("place")
    rows = rows.withColumns({"ioi": F.lead(t).over(inside) - F.col(t), "cycle": (F.lead(t, 2).over(inside) - F.col(t)) / 2})
    good = F.when((F.col("ioi") > 0.6 * F.col(beat)) & (F.col("ioi") < 1.6 * F.col(beat)), F.col("ioi"))
    basic = rows.groupBy(*keys).agg(
        F.count(good).alias("n_valid_iois"), (1000 * F.stddev_pop(good)).alias("sd_ms"), (F.stddev_pop(good) / F.avg(good)).alias("cv")
    )
    # tick and tock: medians by parity within each run, weighted by the run's ticks
    even = F.col("place") % 2 == 0
    half = lambda c, side: quantile(F.when(side, F.col(c)), 0.5)
    each = rows.groupBy(*keys, "run").agg(
        F.count("*").alias("w"),
        (F.abs(half("ioi", even) - half("ioi", ~even)) / 2).alias("e"),
        F.abs(20 * F.log10((half(height, even) + _EPS) / (half(height, ~even) + _EPS))).alias("a"),
        F.least(F.count(F.when(even, F.col("ioi"))), F.count(F.when(~even, F.col("ioi")))).alias("c"),
    ).where("c >= 2")
    uneven = each.groupBy(*keys).agg(
        (1000 * F.sum(F.col("w") * F.col("e")) / F.sum("w")).alias("beat_error_ms"), (F.sum(F.col("w") * F.col("a")) / F.sum("w")).alias("amp_alternation_db")
    )
    cycles = rows.where("cycle is not null").select(*keys, "run", "place", "cycle", beat)
    numbered = cycles.withColumns(
        {
            "i": F.row_number().over(Window.partitionBy(*keys).orderBy("run", "place")).cast("bigint"),
            "n": F.count("*").over(Window.partitionBy(*keys)),
            "_m": F.count("*").over(Window.partitionBy(*keys, "run")),
            "_k": F.row_number().over(Window.partitionBy(*keys, "run").orderBy("place")).cast("bigint"),
        }
    )
    fast = series.rank_filter(
        numbered.where("_m >= 3").select(*keys, "run", F.col("_k").alias("i"), F.col("_m").alias("n"), "cycle"), [*keys, "run"], "cycle", 9, 50.0, "mid"
    )
    fast = fast.groupBy(*keys).agg((1000 * F.stddev_pop(F.col("cycle") - F.col("mid"))).alias("fast_sd_ms"))
    slow = series.rank_filter(numbered.select(*keys, "i", "n", "cycle"), keys, "cycle", 31, 50.0, "mid")
    slow = slow.groupBy(*keys).agg((1000 * F.stddev_pop("mid")).alias("slow_sd_ms"))
    told = numbered.withColumn("_next", F.lead("cycle").over(Window.partitionBy(*keys).orderBy("i")))
    first = F.col("i") <= F.floor(F.col("n") / 2)
    drift = 1e6 * (quantile(F.when(~first, F.col("cycle")), 0.5) - quantile(F.when(first, F.col("cycle")), 0.5)) / F.avg(beat)
    moves = told.groupBy(*keys).agg(
        F.when(F.count("*") > 3, F.corr("cycle", "_next")).alias("lag1"), F.when(F.count("*") >= 8, drift).otherwise(0.0).alias("rate_drift_ppm")
    )
    out = basic
    for part in (fast, slow, moves, uneven):
        out = out.join(part, keys, "left")
    return out


def clock_stability(ticks: DataFrame, keys: list[str], beat_s: float, t: str = "t") -> DataFrame:
    """Allan deviation of the cycles of ticks in runs."""
    rows = tick_runs(ticks, keys, t, F.lit(beat_s))
    cycle = (F.lead(t, 2).over(Window.partitionBy(*keys, "run").orderBy("place")) - F.col(t)) / 2
    return allan_deviation(rows.withColumn("cycle", cycle).where("cycle is not null"), keys, t, "cycle", beat_s)
