from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotide.operators import bearings, entrainment, indices, rooms, vision

FS = 24000


def test_sweep_gives_back_the_response():
    x, inverse = rooms.sweep(1.0, 50, 9000, FS)
    h = np.zeros(2000)
    h[[0, 700, 1500]] = 1, 0.5, -0.25
    got = rooms.response(rooms.convolve(x, h), inverse, FS, 0.1, lead_s=0.0)
    assert [round(float(got[k]), 1) for k in (0, 700)] == [1.0, 0.5] and abs(got[1500] + 0.25) < 0.05


def test_speech_transmission(spark):
    rng = np.random.default_rng(1)
    dry = np.zeros(FS)
    dry[10] = 1
    wet = lambda t60: rng.normal(size=FS) * 10 ** (-3 * np.arange(FS) / FS / t60)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate((dry, wet(0.3), wet(3.0)))], "k int, ir array<double>")
    got = rooms.per_row(df, ["k"], "ir", {"sti": lambda v: rooms.speech_transmission(v, FS)}).orderBy("k").collect()
    assert got[0].sti > 0.97 and 0.6 < got[1].sti < 0.9 and got[2].sti < 0.5
    assert rooms.speech_transmission(dry, 8000) is None
    assert rooms.ear_correlation(np.stack([dry, np.roll(dry, 5)], axis=1), FS) > 0.99


def test_array(spark):
    rng = np.random.default_rng(2)
    source = rng.normal(size=FS)
    x = np.stack([np.roll(source, 3 * k) for k in range(3)], axis=1)
    rows = [("p", 0, 0, FS, 3, x.ravel().tolist())]
    blocks = spark.createDataFrame(rows, "path string, block int, first bigint, samplerate int, channels int, samples array<double>")
    got = rooms.block_delays(blocks, most_s=0.001)
    assert got.count() == 30
    medians = {(r.a, r.b): r.d for r in got.groupBy("a", "b").agg(F.median("delay_s").alias("d")).collect()}
    assert all(abs(d * FS + 3 * (b - a)) < 0.2 for (a, b), d in medians.items())
    apart = got.withColumn("spacing", (F.col("a") - F.col("b")) * 0.1)
    found = bearings.linear_bearing(apart, ["t"], "spacing", "delay_s", "prominence").collect()
    want = np.degrees(np.arccos(np.clip(-343 * 3 / FS / 0.1 * np.sign(1), -1, 1)))
    assert all(abs(r.bearing_deg - want) < 2 and not r.clipped for r in found)
    noise = rng.normal(size=(FS, 2))
    assert rooms.near_source_index(x, FS) > 0.9 > 0.2 > rooms.near_source_index(noise, FS)


def test_lines_meet(spark):
    rows = [(1, 0.0, 0.0, 45.0, 1.0), (1, 10.0, 0.0, 135.0, 2.0), (1, 5.0, -5.0, 90.0, 1.0), (2, 0.0, 0.0, 10.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, x double, y double, a double, w double")
    got = {r.k: r for r in bearings.intersect(df, ["k"], "x", "y", "a", "w").collect()}
    assert abs(got[1].x - 5) < 1e-9 and abs(got[1].y - 5) < 1e-9 and got[1].residual < 1e-6 and got[2].x is None


def test_vision(spark):
    black, red = np.zeros((6, 9, 3), np.uint8), np.zeros((6, 9, 3), np.uint8)
    red[..., 0] = 255
    corner = black.copy()
    corner[:, 8] = 255
    rows = [("v", k + 1, 3, v.tobytes(), 6, 9) for k, v in enumerate((black, red, corner))]
    df = spark.createDataFrame(rows, "cam string, i bigint, n bigint, rgb binary, height int, width int")
    got = vision.frame_features(df, ["cam", "i"]).orderBy("i").collect()
    assert got[0].brightness == 0 and got[1].r_frac > 0.999 and got[1].saturation > 0.999 and got[2].bright_centroid_x > 0.999
    moved = [r.motion for r in vision.motion(df, ["cam"]).orderBy("i").collect()]
    assert moved[0] is None and abs(moved[1] - 0.2126) < 1e-6
    assert vision.summary(vision.frame_features(df, ["cam"]), ["cam"]).first().n_frames == 3


def test_entrainment(spark):
    rng = np.random.default_rng(3)
    slow = np.convolve(rng.normal(size=2000), np.ones(20) / 20, mode="same")
    rows = [("with", i, float(10 * v), float(10 ** (v + 0.05 * rng.normal()))) for i, v in enumerate(slow)]
    other = np.convolve(rng.normal(size=2000), np.ones(20) / 20, mode="same")
    rows += [("without", i, float(10 * v), float(10**w)) for i, (v, w) in enumerate(zip(slow, other, strict=True))]
    df = spark.createDataFrame(rows, "node string, t int, level_db double, qom double")
    got = {r.node: r for r in entrainment.correlation(df, ["node"], "t", 0.125).collect()}
    assert got["with"].value > 0.9 and got["with"].p < 0.01 and abs(got["without"].value) < 0.3
    locked = {r.node: r for r in entrainment.phase_locking(df, ["node"], "t", 0.125, (0.05, 0.5)).collect()}
    assert locked["with"].value > locked["with"].null95
    clock = entrainment.common_clock(df, df, ["node"], 10.0)
    assert clock.groupBy("node").count().first()["count"] == 200


@pytest.mark.parametrize("n", [0, 5, 1000])
def test_envelopes(spark, n):
    rows = [("k", i * 0.02, 2.0 + float(np.sin(2 * np.pi * 4 * i * 0.02))) for i in range(n)]
    df = spark.createDataFrame(rows, "node string, t double, env double")
    got = indices.envelope_bands(df, ["node"], "t", "env", 0.02, {"syllabic": (3.0, 8.0), "machine": (0.3, 2.0)}).collect()
    assert len(got) == (n > 0)
    if n == 1000:
        assert got[0].syllabic_share > 0.99 and abs(got[0].syllabic_hz - 4) < 0.1 and got[0].machine_share < 0.01
        top = indices.modulation(df, ["node"], "t", "env", 0.02, 0.5, 20.0).orderBy(F.desc("power")).first()
        assert abs(top.hz - 4) < 0.5


def test_birds(spark):
    rows = [("k", i, 1.0 + 9.0 * (500 <= i < 540 or 700 <= i < 710)) for i in range(1000)]
    df = spark.createDataFrame(rows, "node string, t int, p double")
    got = indices.birds(df, ["node"], "t", "p").first()
    assert (got.events, got.median_dur_s, got.activity) == (2, 25.0, 0.05)
