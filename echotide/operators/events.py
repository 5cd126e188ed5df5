"""Events in an ordered level series: rises above a running background, and falls."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import quantile
from ..plans import series


def odd_frames(window_s: float, dt: float) -> int:
    return max(3, int(round(window_s / dt)) | 1)


def running_background(df: DataFrame, keys: list[str], size: int, x: str = "level_db", pct: float = 10.0, name: str = "background_db") -> DataFrame:
    """Adds the low percentile of the centred frame of ``size`` rows."""
    return series.rank_filter(df, keys, x, size, pct, name)


def detect(df: DataFrame, keys: list[str], size: int, min_frames: int, x: str = "level_db", rise_db: float = 8.0) -> DataFrame:
    """Runs of at least ``min_frames`` rows more than ``rise_db`` above the background.

    Per run its first and last row (from 0), its first loudest row, and how far that stands above the background.
    Runs are found in blocks; only those that touch a block's edge are then put together in order.
    """

    def kernel(table: pa.Table, own: np.ndarray, _: int) -> pa.Table:
        level, i = table.column(x).to_numpy().astype(float)[own], table.column("i").to_numpy()[own]
        background = series.ranked(table, own, x, size, 10.0)
        edge = np.diff((level > background + rise_db).astype(np.int8), prepend=0, append=0)
        a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        top = np.array([s + int(level[s:e].argmax()) for s, e in zip(a, z, strict=True)], int)
        n = table.column("n")[0].as_py()
        open_ = ((a == 0) & (i[a] > 1) if len(a) else a == 1) | ((z == len(level)) & (i[z - 1] < n) if len(z) else z == 1)
        made = {k: pa.repeat(table.column(k)[0], len(a)) for k in keys}
        made |= {"i0": i[a] - 1, "i1": i[z - 1] - 1, "ipk": i[top] - 1, "x": level[top], "bg": background[top], "cut": open_}
        return pa.table(made)

    rows = df.select(*keys, "i", "n", x)
    found = series.blocks(rows, keys, size // 2, size // 2, kernel, series.schema_of(df.select(*keys), **_RUN))
    in_order = Window.partitionBy("cut", *keys).orderBy("i0")
    new = F.when(F.col("cut") & (F.lag("i1").over(in_order) + 1 == F.col("i0")), 0).otherwise(1)
    put = found.withColumn("_new", new).withColumn("run", F.sum("_new").over(in_order))
    loudest = F.max(F.struct("x", (-F.col("ipk")).alias("at"), "bg"))
    whole = put.where("cut").groupBy("cut", *keys, "run").agg(F.min("i0").alias("i0"), F.max("i1").alias("i1"), loudest.alias("_m"))
    whole = whole.select(*keys, "i0", "i1", (-F.col("_m.at")).alias("ipk"), F.col("_m.x").alias("x"), F.col("_m.bg").alias("bg"))
    every = found.where("not cut").select(*whole.columns).unionByName(whole)
    return every.where(F.col("i1") - F.col("i0") + 1 >= min_frames).select(*keys, "i0", "i1", "ipk", (F.col("x") - F.col("bg")).alias("exceed_db"))


_RUN = {"i0": "bigint", "i1": "bigint", "ipk": "bigint", "x": "double", "bg": "double", "cut": "boolean"}


def cessations(df: DataFrame, keys: list[str], before: int, after: int, x: str = "level_db", drop_db: float = 6.0) -> DataFrame:
    """Rows where a level steady over ``before`` rows falls by ``drop_db`` for ``after`` rows.

    Candidates are found in frames; one is kept of each steady stretch, so a kept row rules out the ``before`` rows
    after it.  That choice runs over the candidates of one series, in order.
    """
    framed = series.framed(df, keys, before, -1, {"_lo": lambda w: quantile(F.col(x), 0.5).over(w), "_sd": lambda w: F.stddev_pop(x).over(w)})
    framed = series.framed(framed, keys, 0, after - 1, {"_hi": lambda w: quantile(F.col(x), 0.5).over(w)})
    inside = (F.col("i") > before) & (F.col("i") <= F.col("n") - after)
    found = framed.where(inside & (F.col("_lo") - F.col("_hi") >= drop_db) & (F.col("_sd") <= drop_db / 2))
    rows = found.select(*keys, (F.col("i") - 1).alias("i"), F.col("_lo").alias("before_db"), F.col("_hi").alias("after_db"))

    def keep(pdf):
        pdf = pdf.sort_values("i")
        picked, free = [], -1
        for at in pdf["i"]:
            picked.append(at >= free)
            if at >= free:
                free = at + before
        return pdf[picked]

    return rows.groupBy(*keys).applyInPandas(keep, rows.schema)


def intervals(df: DataFrame, keys: list[str], t: str, mask: Column, step: float = 1.0) -> DataFrame:
    """Runs of rows where ``mask`` holds, as [a, b): from the first row's time to a step after the last's."""
    cut = series.runs(df.withColumn("_on", F.coalesce(mask, F.lit(False))), keys, "_on").where("_on")
    return cut.groupBy(*keys, "run").agg(F.min(t).alias("a"), (F.max(t) + step).alias("b")).drop("run")


def sessions(df: DataFrame, keys: list[str], t: str, gap: float) -> DataFrame:
    """Stretches of a series without a gap of more than ``gap``: start, end and rows."""
    gaps = series.previous(df, keys, {"_p": t})
    new = F.when(F.col("_p").isNull() | (F.col(t) - F.col("_p") > gap), 1).otherwise(0)
    cut = series.running_sum(gaps, keys, new, "session")
    return cut.groupBy(*keys, "session").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("rows"))
