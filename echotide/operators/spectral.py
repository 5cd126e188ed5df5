"""Regions of time and band that stand out, how direct a field is, and long-term spectra by state."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import quantile
from .cycles import _kinds

_EPS = 1e-12


def _labelled(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and region of each true cell; cells that touch along an edge are of one region."""
    at = np.flatnonzero(mask.ravel())
    rows, columns = np.unravel_index(at, mask.shape)
    number = np.full(mask.size, -1)
    number[at] = np.arange(len(at))
    number = number.reshape(mask.shape)
    links = []
    for a, b in ((number[:, :-1], number[:, 1:]), (number[:-1], number[1:])):
        both = (a >= 0) & (b >= 0)
        links.append(np.stack([a[both], b[both]]))
    a, b = np.concatenate(links, axis=1)
    root = np.arange(len(at))
    while True:  # the least number spreads over links, by halving paths
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        root = root[root]
        if (root == before).all():
            return rows, columns, root


def spectral_events(df: DataFrame, keys: list[str], i: str, rise: str, edges: list[float], least_db: float = 6.0, least_rows: int = 2, least_bands: int = 2, block: int = 4096) -> DataFrame:
    """Regions of (row, band) where the rise over the background is more than ``least_db``: (keys..., i0, rows, lo_hz, hi_hz,
    peak_rise_db), for regions of at least so many rows and bands.

    ``rise`` is an array of bands; ``i`` numbers the rows.  The peak is that of the region's whole box.  Regions are found
    in blocks of rows; cells of neighbouring blocks that touch join them, over the regions that reach an edge alone.
    """
    found = df.groupBy(*keys, F.floor(F.col(i) / block).alias("_b")).applyInPandas(
        _region_finder(keys, i, rise, least_db),
        _kinds(df, keys) + "_b bigint, region bigint, i0 bigint, i1 bigint, b0 int, b1 int, first array<int>, last array<int>",
    )
    # pieces that meet at the border between blocks
    ends = found.select(*keys, (F.col("_b") + 1).alias("_b"), F.col("region").alias("a"), F.explode("last").alias("band"))
    starts = found.select(*keys, "_b", F.col("region").alias("b"), F.explode("first").alias("band"))
    links = ends.join(starts, [*keys, "_b", "band"]).select(*keys, (F.col("_b") - 1).alias("ba"), "a", F.col("_b").alias("bb"), "b").distinct()
    touching = links.groupBy(*keys).applyInPandas(_joiner(keys), _kinds(df, keys) + "_b bigint, region bigint, whole string")
    named = found.join(touching, [*keys, "_b", "region"], "left")
    whole = F.coalesce("whole", F.concat_ws(":", "_b", "region"))
    boxes = named.groupBy(*keys, whole.alias("_w")).agg(F.min("i0").alias("i0"), F.max("i1").alias("i1"), F.min("b0").alias("b0"), F.max("b1").alias("b1"))
    boxes = boxes.where((F.col("i1") - F.col("i0") + 1 >= least_rows) & (F.col("b1") - F.col("b0") + 1 >= least_bands))
    # the loudest cell of each box, rows met by blocks
    cut = boxes.withColumn("_b", F.explode(F.sequence(F.floor(F.col("i0") / block), F.floor(F.col("i1") / block))))
    rows = df.select(*keys, F.col(i).alias("_i"), F.col(rise).alias("_r"), F.floor(F.col(i) / block).alias("_b"))
    met = rows.join(cut, [*keys, "_b"]).where("_i BETWEEN i0 AND i1")
    top = F.array_max(F.slice("_r", F.col("b0") + 1, F.col("b1") - F.col("b0") + 1))
    peak = met.groupBy(*keys, "_w", "i0", "i1", "b0", "b1").agg(F.max(top).alias("peak_rise_db"))
    hz = F.array(*[F.lit(float(e)) for e in edges])
    return peak.select(
        *keys,
        "i0",
        (F.col("i1") - F.col("i0") + 1).alias("rows"),
        F.get(hz, F.col("b0")).alias("lo_hz"),
        F.get(hz, F.least(F.col("b1") + 1, F.lit(len(edges) - 1))).alias("hi_hz"),
        "peak_rise_db",
    )


def _region_finder(keys: list[str], i: str, rise: str, least_db: float):
    names = [*keys, "_b", "region", "i0", "i1", "b0", "b1", "first", "last"]

    def find(key, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(i)
        at = p[i].to_numpy()
        mask = np.zeros((int(at[-1] - at[0]) + 1, len(p[rise].iloc[0])), bool)
        mask[at - at[0]] = np.stack(p[rise].to_numpy()) > least_db
        rows, columns, root = _labelled(mask)
        out = []
        block = key[-1]
        for r in np.unique(root):
            mine = root == r
            y, x = rows[mine], columns[mine]
            out.append((*key[:-1], block, int(r), int(at[0] + y.min()), int(at[0] + y.max()), int(x.min()), int(x.max()), x[y == 0].tolist(), x[y == len(mask) - 1].tolist()))
        return pd.DataFrame(out, columns=names)

    return find


def _joiner(keys: list[str]):
    def join(key, p: pd.DataFrame) -> pd.DataFrame:
        parent: dict[tuple, tuple] = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for ba, a, bb, b in zip(p["ba"], p["a"], p["bb"], p["b"], strict=True):
            x, y = root((ba, a)), root((bb, b))
            parent[max(x, y)] = min(x, y)
        out = [(*key, n[0], n[1], "{}:{}".format(*root(n))) for n in list(parent)]
        return pd.DataFrame(out, columns=[*keys, "_b", "region", "whole"])

    return join


def spectral_event_keys(found: DataFrame, keys: list[str], minutes: DataFrame) -> DataFrame:
    """Rate and median length of spectral events; ``minutes`` has the length of each series in ``minutes``."""
    sums = found.groupBy(*keys).agg(F.count("*").alias("_n"), quantile(F.col("rows").cast("double"), 0.5).alias("spectral_event_median_dur_s"))
    held = minutes.join(sums, keys, "left")
    return held.select(*keys, (F.coalesce("_n", F.lit(0)) / F.col("minutes")).alias("spectral_events_per_min"), "spectral_event_median_dur_s")


def directness(df: DataFrame, keep: list[str], intensity: str, power: str) -> DataFrame:
    """Per row and octave, 1 for a plane wave and 0 for a diffuse field: the length of the intensity over the power.

    ``intensity`` is an array of (x, y, z) for each octave.
    """
    rows = df.select(*keep, F.posexplode(F.arrays_zip(F.col(intensity).alias("v"), F.col(power).alias("p"))).alias("band", "_c"))
    length = F.sqrt(F.aggregate(F.col("_c.v"), F.lit(0.0), lambda s, x: s + x * x))
    share = F.least(F.greatest(length / (F.col("_c.p") + _EPS), F.lit(0.0)), F.lit(1.0))
    return rows.select(*keep, "band", share.alias("directness"))


def median_directness(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.groupBy(*keys, "band").agg(quantile(F.col("directness"), 0.5).alias("directness"))


def block_background(df: DataFrame, keys: list[str], i: str, spec: str, block: int = 300, pct: float = 10.0) -> DataFrame:
    """Adds ``background``: per band the percentile of the block of rows that a row lies in."""
    rows = df.withColumn("_b", F.floor(F.col(i) / block))
    cells = rows.select(*keys, "_b", F.posexplode(spec).alias("band", "p"))
    low = cells.groupBy(*keys, "_b", "band").agg(quantile(F.col("p"), pct / 100).alias("q"))
    back = low.groupBy(*keys, "_b").agg(F.transform(F.sort_array(F.collect_list(F.struct("band", "q"))), lambda s: s["q"]).alias("background"))
    return rows.join(back, [*keys, "_b"]).drop("_b")


def excess_spectrum(df: DataFrame, keys: list[str], spec: str, background: str) -> DataFrame:
    """Per group (a sound object, say) and band, how far the mean stands over the mean background, not under 0; as an array."""
    cells = df.select(*keys, F.posexplode(F.arrays_zip(F.col(spec).alias("s"), F.col(background).alias("b"))).alias("band", "c"))
    over = F.greatest(F.avg("c.s") - F.avg("c.b"), F.lit(0.0))
    each = cells.groupBy(*keys, "band").agg(over.alias("e"))
    return each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("band", "e"))), lambda s: s["e"]).alias("excess"))


def ltas_by_state(df: DataFrame, keys: list[str], spec: str, state: str) -> DataFrame:
    """Median spectrum in dB of all rows (state null) and of each state, in one pass: (keys..., state, band, level_db)."""
    cells = df.select(*keys, F.col(state).alias("state"), F.posexplode(spec).alias("band", "p"))
    none = F.lit(None).cast("string")
    named = F.when(F.col("state").isNull(), F.array(none)).otherwise(F.array(none, F.col("state").cast("string")))
    every = cells.withColumn("state", F.explode(named))
    return every.groupBy(*keys, "state", "band").agg((10 * F.log10(quantile(F.col("p"), 0.5) + _EPS)).alias("level_db"))


def band_entropy(df: DataFrame, keys: list[str], power: Column) -> DataFrame:
    """How even a band's power is over time: 0 (in one row) to 1."""
    p = F.col("_p") / (F.sum("_p").over(Window.partitionBy(*keys)) + _EPS)
    rows = df.select(*keys, power.alias("_p")).withColumn("_q", p)
    found = rows.groupBy(*keys).agg(F.sum(-F.col("_q") * F.ln(F.col("_q") + _EPS)).alias("_h"), F.count("*").alias("_n"))
    return found.select(*keys, F.when(F.col("_n") > 1, F.col("_h") / F.ln("_n")).otherwise(0.0).alias("entropy"))
