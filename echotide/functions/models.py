"""Models that are not part of the engine: whether they are there, and how their results become tables.

A model is made once in a worker by a factory and maps a window of samples to scores.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The power that speech detectors expect, as a root of the mean square.
SPEECH_RMS = 0.05


def available(name: str) -> bool:
    """Whether a package is installed."""
    return importlib.util.find_spec(name) is not None


def require(name: str, what: str) -> None:
    if not available(name):
        raise ImportError(f"{what} needs the package {name}")


def scores(windows: DataFrame, keys: list[str], samples: str, fs: int, factory: Callable[[], Callable[[np.ndarray, int], dict[str, float]]]) -> DataFrame:
    """(keys..., label, score) of each window, by a model that maps samples and their rate to scores of labels."""
    kinds = "".join(f"`{k}` {windows.schema[k].dataType.simpleString()}, " for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for p in batches:
            found = [list(model(np.asarray(x, np.float32), fs).items()) for x in p[samples]]
            at = np.repeat(np.arange(len(p)), [len(f) for f in found])
            out = pd.DataFrame([s for f in found for s in f], columns=["label", "score"])
            for place, k in enumerate(keys):
                out.insert(place, k, p[k].to_numpy()[at])
            yield out

    return windows.select(*keys, samples).mapInPandas(run, kinds + "label string, score double")


def top_labels(found: DataFrame, keys: list[str], top: int = 3, least: float = 0.1) -> DataFrame:
    """Per window the ``top`` labels with a score of ``least`` or more."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "label")
    return found.where(F.col("score") >= least).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top).drop("_r")


def wanted(found: DataFrame, labels: list[str], known: list[str]) -> DataFrame:
    """Scores of stated labels; one that the model does not know is an error."""
    if bad := sorted(set(labels) - set(known)):
        raise ValueError(f"unknown labels: {', '.join(bad)}")
    return found.where(F.col("label").isin(labels))


def tally(found: DataFrame, keys: list[str], least: float = 0.25) -> DataFrame:
    """Per label how often it was found with at least that score, and its best one: a session's species, say."""
    some = found.where(F.col("score") >= least)
    return some.groupBy(*keys, "label").agg(F.count("*").alias("n"), F.max("score").alias("max_score"))


def speech_input(x: np.ndarray, target: float = SPEECH_RMS) -> np.ndarray:
    """Samples brought to a usual power, but not beyond full scale; silence as it is."""
    power = float(np.sqrt(np.mean(np.asarray(x, float) ** 2))) if len(x) else 0.0
    if power <= 0:
        return x
    gain = min(target / power, 1 / max(float(np.abs(x).max()), 1e-12))
    return x * gain


def speech_share(windows: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    """Per recording the share of its length that a detector heard speech in: rows (keys..., start, end) against its length."""
    return windows.groupBy(*keys, seconds).agg((F.sum(F.col("end") - F.col("start")) / F.col(seconds)).alias("speech_fraction"))


def resample(x: np.ndarray, fs: int, to: int) -> np.ndarray:
    """``x`` at another rate."""
    from ..operators.rooms import resampled

    return resampled(np.asarray(x, float), fs, to)
