"""Light and movement in video frames: rows (keys..., order, ``rgb`` bytes, ``height``, ``width``)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import quantile
from ..plans import series

_EPS = 1e-12
#: Weights of red, green and blue in brightness.
LUMA = (0.2126, 0.7152, 0.0722)
NAMES = [
    "brightness", "brightness_sd", "r_frac", "g_frac", "b_frac", "warm_cool_ratio", "saturation", "colourfulness",
    "spatial_entropy", "bright_centroid_x", "bright_centroid_y",
]


def describe(rgb: np.ndarray, cells: int = 3) -> dict[str, float]:
    """Descriptors of one frame of values from 0 to 1."""
    red, green, blue = np.moveaxis(rgb, 2, 0)
    light = rgb @ np.array(LUMA)
    mean = rgb.mean(axis=(0, 1))
    top, bottom = rgb.max(axis=2), rgb.min(axis=2)
    opponents = red - green, (red + green) / 2 - blue
    spread = math.hypot(*(o.std() for o in opponents)) + 0.3 * math.hypot(*(o.mean() for o in opponents))
    rows = [np.array_split(r, cells, axis=1) for r in np.array_split(light, cells, axis=0)]
    p = np.array([c.mean() if c.size else 0.0 for r in rows for c in r])
    p = p / (p.sum() + _EPS)
    height, width = light.shape
    total = light.sum() + _EPS
    values = [
        light.mean(), light.std(), *(mean / (mean.sum() + _EPS)), mean[0] / (mean[2] + _EPS),
        np.where(top > 0, (top - bottom) / (top + _EPS), 0).mean(), spread, -(p * np.log(p + _EPS)).sum() / math.log(cells**2),
        (light.sum(axis=0) * np.arange(width)).sum() / total / max(width - 1, 1),
        (light.sum(axis=1) * np.arange(height)).sum() / total / max(height - 1, 1),
    ]
    return dict(zip(NAMES, map(float, values), strict=True))


def unit(rgb: np.ndarray) -> np.ndarray:
    """Colours from 0 to 1, of bytes or of numbers that go beyond 1.5."""
    values = np.asarray(rgb, float)
    return values / 255 if rgb.dtype == np.uint8 or (values.size and values.max() > 1.5) else values


def _frame(data: bytes, height: int, width: int) -> np.ndarray:
    return unit(np.frombuffer(data, np.uint8).reshape(height, width, 3))


def frames_of(spark: SparkSession, folder: str, fps: float = 1.0) -> DataFrame:
    """The images of a folder, in order of their names, as frames: name, i, n, t, rgb, height, width."""
    held = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")
    name = F.element_at(F.split("origin", "/"), -1)
    rows = held.where("nChannels = 3").select(name.alias("name"), "height", "width", F.col("data").alias("bgr"))

    def turned(batches):
        for p in batches:
            out = p.copy()
            out["rgb"] = [np.frombuffer(b, np.uint8).reshape(-1, 3)[:, ::-1].tobytes() for b in p["bgr"]]
            yield out[["name", "height", "width", "rgb"]]

    frames = rows.mapInPandas(turned, "name string, height int, width int, rgb binary")
    order = Window.partitionBy(F.lit(1)).orderBy("name")
    places = rows.select("name").withColumns({"i": F.row_number().over(order).cast("bigint"), "n": F.count("*").over(Window.partitionBy(F.lit(1)))})
    return frames.join(places, "name").withColumn("t", (F.col("i") - 1) / fps)


def frame_features(frames: DataFrame, keep: list[str]) -> DataFrame:
    """Descriptors of each frame."""
    kinds = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = pd.DataFrame([describe(_frame(*r)) for r in zip(p["rgb"], p["height"], p["width"], strict=True)], columns=NAMES)
            for at, k in enumerate(keep):
                out.insert(at, k, p[k].to_numpy())
            yield out

    return frames.select(*keep, "rgb", "height", "width").mapInPandas(run, f"{kinds}, " + ", ".join(f"{n} double" for n in NAMES))


def motion(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Mean change of brightness from the frame before (null for the first).  Needs ``i`` and ``n``."""
    pairs = series.previous(frames, keys, {"_before": "rgb"}, block=512)
    kinds = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in [*keys, "i"])

    def change(now, before, height, width):
        if before is None:
            return None
        return float(np.abs((_frame(now, height, width) - _frame(before, height, width)) @ np.array(LUMA)).mean())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = p[[*keys, "i"]].copy()
            out["motion"] = [change(*r) for r in zip(p["rgb"], p["_before"], p["height"], p["width"], strict=True)]
            yield out.astype({"motion": float})

    return pairs.select(*keys, "i", "rgb", "_before", "height", "width").mapInPandas(run, f"{kinds}, motion double")


def summary(found: DataFrame, keys: list[str]) -> DataFrame:
    """Medians over frames, and the range of brightness."""
    middle = [quantile(F.col(n), 0.5).alias(f"vis_{n}_median") for n in ("brightness", "colourfulness", "saturation", "warm_cool_ratio", "spatial_entropy")]
    b = F.col("brightness")
    return found.groupBy(*keys).agg(F.count("*").alias("n_frames"), (quantile(b, 0.9) - quantile(b, 0.1)).alias("vis_brightness_range"), *middle)
