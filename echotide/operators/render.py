"""Sound to listen to: the background alone, the stretch that is most like it, and a loop.

Which stretch is chosen is a table plan over seconds; samples are made block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import quantile
from ..plans import series

_EPS = 1e-12
SIZE, HOP = 4096, 2048


def _box(x: np.ndarray) -> np.ndarray:
    """Mean of the 3 by 3 cells about each, edges mirrored."""
    p = np.pad(x, 1, mode="symmetric")
    rows = p[:-2] + p[1:-1] + p[2:]
    return (rows[:, :-2] + rows[:, 1:-1] + rows[:, 2:]) / 9


def background(x: np.ndarray, fs: int, margin_db: float = 12.0, block_s: float = 10.0, pct: float = 50.0, least_s: float = 120.0) -> tuple[np.ndarray, float, float]:
    """One channel with all that stands more than ``margin_db`` over its background held down to there, and the shares of
    cells well over that limit before and after.

    The background of a frequency is the least, over ``least_s`` about a block, of the blocks' percentiles.
    """
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(SIZE) / SIZE)
    frames = -(-len(x) // HOP) + 1
    padded = np.zeros((frames + 1) * HOP)
    padded[HOP : HOP + len(x)] = x
    spectra = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(padded, SIZE)[::HOP] * window, axis=1)
    size = np.abs(spectra)
    per = max(1, round(block_s * fs / HOP))
    blocks = max(1, len(size) // per)
    level = np.stack([np.percentile(size[k * per : (k + 1) * per], pct, axis=0) for k in range(blocks)])
    wide = max(1, min(round(least_s / block_s) | 1, blocks))
    reach = wide // 2
    edged = np.pad(level, ((reach, wide - 1 - reach), (0, 0)), mode="edge")
    least = np.lib.stride_tricks.sliding_window_view(edged, wide, axis=0).min(axis=-1)
    floor = least[np.minimum(np.arange(len(size)) // per, blocks - 1)]
    limit = floor * 10 ** (margin_db / 20) / (size + _EPS)
    gain = np.minimum(np.minimum(_box(np.minimum(1.0, limit)), limit), 1.0)
    over = floor * 10 ** ((margin_db + 3) / 20)
    out, weight = np.zeros(len(padded)), np.zeros(len(padded))
    back = np.fft.irfft(spectra * gain, SIZE, axis=1)
    for k, frame in enumerate(back):
        out[k * HOP : k * HOP + SIZE] += frame * window
        weight[k * HOP : k * HOP + SIZE] += window**2
    made = (out / np.maximum(weight, 1e-8))[HOP : HOP + len(x)]
    return made.astype(np.float32), float((size > over).mean()), float((size * gain > over).mean())


def background_blocks(blocks: DataFrame, **settings) -> DataFrame:
    """The background of each block of samples, all its channels: (path, first, samplerate, channels, samples, over_before,
    over_after).  Give blocks of some twenty minutes, with a lead for context."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                x = np.asarray(r.samples, float).reshape(-1, r.channels)
                made = [background(c, r.samplerate, **settings) for c in x.T]
                y = np.stack([m[0] for m in made], axis=1)[r.lead :]
                yield pd.DataFrame(
                    [
                        {
                            "path": r.path,
                            "first": r.first,
                            "samplerate": r.samplerate,
                            "channels": r.channels,
                            "samples": y.ravel(),
                            "over_before": float(np.mean([m[1] for m in made])),
                            "over_after": float(np.mean([m[2] for m in made])),
                        }
                    ]
                )

    held = blocks.select("path", "first", "samplerate", "channels", "lead", "samples")
    return held.mapInPandas(run, "path string, first bigint, samplerate int, channels int, samples array<float>, over_before double, over_after double")


def _windows(seconds: DataFrame, keys: list[str], spec: str, size: int, hop: int) -> DataFrame:
    """Rows of seconds (numbered, with ``level_db``) dealt to the windows that hold them: ``w`` is a window's first row."""
    n = F.col("n")
    last = F.floor(F.greatest(n - size, F.lit(0)) / hop)
    at = F.col("i") - 1
    low = F.greatest(F.lit(0), F.floor((at - size) / hop) + 1)
    high = F.least(last, F.floor(at / hop))
    rows = seconds.select(*keys, "i", "n", "t", "level_db", F.col(spec).alias("spec"))
    dealt = rows.where(low <= high).withColumn("w", F.explode(F.sequence(low, high)))
    return dealt.withColumn("w", F.col("w") * hop)


def _distance(rows: DataFrame, profile: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Mean over bands of how far the group's median spectrum is from a profile (keys..., band, q)."""
    cells = rows.select(*by, F.posexplode("spec").alias("band", "p"))
    middle = cells.groupBy(*by, "band").agg(quantile(10 * F.log10(F.col("p") + _EPS), 0.5).alias("m"))
    return middle.join(profile, [*keys, "band"]).groupBy(*by).agg(F.avg(F.abs(F.col("m") - F.col("q"))).alias("distance_db"))


def _profile(seconds: DataFrame, keys: list[str], spec: str, p: float) -> DataFrame:
    cells = seconds.select(*keys, F.posexplode(spec).alias("band", "p"))
    return cells.groupBy(*keys, "band").agg(quantile(10 * F.log10(F.col("p") + _EPS), p).alias("q"))


def characteristic_excerpt(seconds: DataFrame, keys: list[str], spec: str = "logspec", size: int = 60, hop: int = 5, event_db: float = 20.0) -> DataFrame:
    """The window most like the background: its median spectrum is near the 10th percentile of the whole, and few of its
    seconds stand 6 dB over the median level.  (keys..., t0, distance_db, eventful, score); rows are numbered seconds with
    ``t``, ``level_db`` and a spectrum."""
    middle = seconds.groupBy(*keys).agg(quantile(F.col("level_db"), 0.5).alias("_mid"))
    rows = _windows(seconds, keys, spec, size, hop).join(middle, keys)
    by = [*keys, "w"]
    busy = rows.groupBy(*by).agg(F.min("t").alias("t0"), F.avg((F.col("level_db") > F.col("_mid") + 6).cast("double")).alias("eventful"))
    found = busy.join(_distance(rows, _profile(seconds, keys, spec, 0.1), keys, by), by)
    scored = found.withColumn("score", F.col("distance_db") + event_db * F.col("eventful"))
    best = F.min_by(F.struct("t0", "distance_db", "eventful", "score"), F.struct(F.round("score", 9), "w"))
    return scored.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def loop_window(seconds: DataFrame, keys: list[str], spec: str = "logspec", size: int = 60, hop: int = 5, seam: int = 2) -> DataFrame:
    """The window most typical of the whole that also ends much as it begins: (keys..., t0, score and its parts)."""
    sums = seconds.groupBy(*keys).agg(quantile(F.col("level_db"), 0.5).alias("_mid"))
    busy = F.col("level_db") > F.col("_mid") + 6
    whole = seconds.join(sums, keys).groupBy(*keys, "_mid").agg(F.avg(busy.cast("double")).alias("_busy"))
    by = [*keys, "w"]
    rows = _windows(seconds, keys, spec, size, hop).join(whole, keys)
    rows = rows.withColumn("_k", F.col("i") - 1 - F.col("w"))
    length = F.least(F.lit(size), F.col("n"))
    head, tail = F.col("_k") < seam, F.col("_k") >= length - seam
    each = rows.groupBy(*by).agg(
        F.min("t").alias("t0"),
        F.abs(quantile(F.col("level_db"), 0.5) - F.max("_mid")).alias("level_off_db"),
        (20 * F.abs(F.avg(busy.cast("double")) - F.max("_busy"))).alias("event_off"),
        F.abs(F.avg(F.when(head, F.col("level_db"))) - F.avg(F.when(tail, F.col("level_db")))).alias("_seam"),
    )
    cells = rows.where(head | tail).select(*by, head.alias("h"), F.posexplode("spec").alias("band", "p"))
    level = 10 * F.log10(F.col("p") + _EPS)
    ends = cells.groupBy(*by, "band").agg(quantile(F.when(F.col("h"), level), 0.5).alias("a"), quantile(F.when(~F.col("h"), level), 0.5).alias("z"))
    seams = ends.groupBy(*by).agg(F.avg(F.abs(F.col("a") - F.col("z"))).alias("_d"))
    found = each.join(_distance(rows, _profile(seconds, keys, spec, 0.5), keys, by), by).join(seams, by)
    found = found.withColumn("seam_db", F.col("_seam") + F.col("_d"))
    scored = found.withColumn("score", F.col("distance_db") + F.col("level_off_db") + F.col("event_off") + 0.5 * F.col("seam_db"))
    parts = F.struct("t0", "distance_db", "level_off_db", "event_off", "seam_db", "score")
    return scored.groupBy(*keys).agg(F.min_by(parts, F.struct(F.round("score", 9), "w")).alias("b")).select(*keys, "b.*")


def looped(x: np.ndarray, fs: int, fade_s: float = 1.0) -> np.ndarray:
    """Samples whose end runs into their beginning: the last part is faded, at equal power, over the first."""
    n = min(round(fade_s * fs), len(x) // 4)
    turn = (np.arange(n) + 0.5) / max(n, 1) * np.pi / 2
    out = np.array(x[n:], float)
    out[:n] = np.cos(turn)[:, None] * x[len(x) - n :] + np.sin(turn)[:, None] * x[:n]
    peak = np.abs(out).max() if out.size else 0.0
    return out * (0.99 / peak) if peak > 0.99 else out


def numbered_seconds(seconds: DataFrame, keys: list[str]) -> DataFrame:
    """Feature seconds with their level and their numbers."""
    rows = seconds.withColumn("level_db", 10 * F.log10(F.col("rms") * F.col("rms") + _EPS))
    return series.number_rows(rows, keys, ["t"], "t", 3600.0)
