from __future__ import annotations

import math

import numpy as np
import pytest

from echotide.operators import features
from echotide.plans import summary
from echotide.sources import wav

FS = 8000


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    t = np.arange(8 * FS) / FS
    rng = np.random.default_rng(1)
    x = 0.02 * rng.normal(size=len(t)) + 0.4 * np.sin(2 * np.pi * 1000 * t) * (t % 4 < 1)
    folder = tmp_path_factory.mktemp("wav")
    for name, channels in (("mono", 1), ("ambix", 4)):
        gains = [1, math.sin(math.radians(60)), 0, math.cos(math.radians(60))][:channels]
        (folder / f"{name}.wav").write_bytes(wav.encode(np.stack([g * x for g in gains], axis=1), FS))
    wav.register(spark)
    blocks = spark.read.format("wav").option("block_s", "4").load(f"{folder}/mono.wav,{folder}/ambix.wav").cache()
    rows = summary.full_summary(features.per_second(blocks), features.fast(blocks), features.envelope(blocks), ["path"]).collect()
    return {n: {r.key: r for r in rows if n in r.path} for n in ("mono", "ambix")}


def test_values(found):
    got = {k: r.value for k, r in found["ambix"].items()}
    power = 0.02**2 + 0.4**2 / 2 / 4
    assert abs(got["duration_min"] - 8 / 60) < 1e-9
    assert abs(got["leq_dbfs"] - 10 * math.log10(power)) < 0.2
    assert abs(got["azimuth_mean_deg"] - 60) < 1 and got["azimuth_R"] > 0.95 and got["directional_entropy"] < 0.2
    assert got["intermittency_ratio_pct"] > 80 and got["L10"] > got["L50"] >= got["L90"]
    assert got["anthro_voiceband_fraction"] > 0.8 and got["n_events"] >= 1
    assert len(got) >= 40


def test_all_values(spark, tmp_path_factory):
    """With the spectra of minutes, all 65 values of a session."""
    from echotide.operators import corpus

    t = np.arange(12 * FS) / FS
    x = 0.02 * np.random.default_rng(2).normal(size=len(t)) + 0.2 * np.sin(2 * np.pi * 700 * t)
    path = tmp_path_factory.mktemp("all") / "a.wav"
    path.write_bytes(wav.encode(np.stack([x, 0.5 * x, 0 * x, 0.8 * x], axis=1), FS))
    wav.register(spark)
    blocks = spark.read.format("wav").options(block_s=4, lead_s=0.5).load(str(path)).cache()
    minutes = features.per_minute(blocks)
    f = np.linspace(0, FS / 2, len(minutes.first().minspec))
    rows = summary.full_summary(features.per_second(blocks), features.fast(blocks), features.envelope(blocks), ["path"], minutes, f, FS / 2).collect()
    names = {r.key for r in rows}
    missing = {r[0] for r in corpus.REGISTRY[:65]} - names
    assert not missing and len(names) == len(rows)
    got = {r.key: r.value for r in rows}
    assert got["n_prominent_tones"] is None and got["fluctuation_index"] < 0.5 and got["floor_suspect"] == 0 and got["spectral_events_per_min"] >= 0


def test_gates(found):
    got = found["mono"]
    assert got["aci"].value is None and got["aci"].low_confidence
    assert got["L50"].value is not None and got["L50"].low_confidence
    assert not got["leq_dbfs"].low_confidence and got["azimuth_R"].value is None
