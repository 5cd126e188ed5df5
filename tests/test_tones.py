"""Tones, fluctuation, mains and rooms on signals whose results are known."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotide.operators import cycles, indices, render, rooms, tones

FS = 16000


def tone(hz, seconds=6.0, size=0.1):
    return size * np.sin(2 * np.pi * hz * np.arange(int(seconds * FS)) / FS)


def beaten(rate, depth=1.0, seconds=6.0):
    t = np.arange(int(seconds * FS)) / FS
    return tone(1000.0, seconds) * (1 + depth * np.sin(2 * np.pi * rate * t)) / 2


def spectrum(x, size=4096):
    window = np.hanning(size)
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[:: size // 2] * window
    return (np.abs(np.fft.rfft(frames, axis=1)) ** 2).mean(axis=0) / (FS * (window**2).sum()), np.fft.rfftfreq(size, 1 / FS)


def test_fluctuation_strength():
    assert tones.fluctuation_strength(beaten(4.0), FS) == pytest.approx(1.0, abs=0.15)
    assert tones.fluctuation_strength(tone(1000.0), FS) < 0.05
    assert tones.fluctuation_strength(beaten(4.0), FS) > 3 * tones.fluctuation_strength(beaten(0.5), FS)
    assert 0.02 < tones.fluctuation_strength(beaten(4.0, 0.3), FS) < tones.fluctuation_strength(beaten(4.0), FS)
    assert tones.fluctuation_strength(0.1 * np.random.default_rng(3).normal(size=6 * FS), FS) < 0.3


def test_fluctuation_index(spark):
    hop = int(0.02 * FS)
    power = lambda x: (x**2).reshape(-1, hop).mean(axis=1)
    assert tones.fluctuation_of(power(beaten(4.0)), 0.02) > 0.5
    assert tones.fluctuation_of(power(tone(1000.0)), 0.02) < 0.05
    assert tones.fluctuation_of(np.ones(8), 0.02) is None
    rows = [("k", i * 0.02, float(v)) for i, v in enumerate(power(beaten(4.0)))] + [("short", 0.0, 1.0)]
    df = spark.createDataFrame(rows, "node string, t double, env double")
    got = {r.node: r.fluctuation_index for r in tones.fluctuation_index(df, ["node"], "t", "env", 0.02).collect()}
    assert got["k"] > 0.5 and got["short"] is None
    found = tones.modulation_profile(df, ["node"], "t", "env", 0.02, 0.5, 20.0).collect()
    assert len(found) == 1 and abs(found[0].peak_hz - 4) < 0.5


def test_tone_prominence():
    rng = np.random.default_rng(0)
    power, f = spectrum(tone(1000.3, size=0.05) + 0.01 * rng.normal(size=6 * FS))
    top = tones.tones_of(power, f)[0]
    width = 25 + 75 * (1 + 1.4) ** 0.69
    assert top["hz"] == pytest.approx(1000.3, abs=6)
    assert top["over_db"] == pytest.approx(10 * np.log10(0.05**2 * FS / (4 * 0.01**2 * width)), abs=3)


def test_tones_that_last(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(5):
        x = tone(250.0, size=0.04 if k < 4 else 0.0) + tone(3000.0, size=0.04 if k == 0 else 0.0) + 0.01 * rng.normal(size=6 * FS)
        power, f = spectrum(x)
        rows.append(("s", k, power.tolist()))
    df = spark.createDataFrame(rows, "node string, t int, spec array<double>")
    found = tones.prominent_tones(df, ["node"], "t", "spec", f, least_share=0.5)
    got = found.collect()
    assert len(got) == 1 and got[0].hz == pytest.approx(250, abs=6) and got[0].n_minutes == 4 and got[0].share == pytest.approx(0.8)
    keys = tones.tone_keys(found, ["node"]).first()
    assert keys.n_prominent_tones == 1 and keys.tonal_prominence_hz == got[0].hz
    assert tones.prominent_tones(df.limit(0), ["node"], "t", "spec", f).count() == 0


def lines(f, peaks, floor=1e-8):
    out = np.full(len(f), floor)
    for hz, power in peaks:
        out += power * np.exp(-0.5 * ((f - hz) / 3) ** 2)
    return out


def test_tracks_groups_and_classes(spark):
    f = np.linspace(0, 8000, 4001)
    steady = [lines(f, [(1000, 1.0)])] * 8 + [lines(f, [])] * 4 + [lines(f, [(1005, 1.0)])] * 3
    df = spark.createDataFrame([("s", k, s.tolist()) for k, s in enumerate(steady)], "node string, t int, spec array<double>")
    tracks = cycles.tonal_tracks(df, ["node"], "t", "spec", f)
    got = tracks.orderBy("first").collect()
    assert [r.rows for r in got] == [8, 3] and abs(got[0].hz - 1000) < 10
    group = tones.group_tracks(tracks, ["node"]).collect()
    assert len(group) == 1 and (group[0].rows, group[0].segments, group[0].first, group[0].last) == (11, 2, 0, 14)
    both = spark.createDataFrame([("s", lines(f, [(440, 1.0), (880, 0.5)]).tolist())], "node string, spec array<double>")
    top = tones.pitch_classes(both, ["node"], "spec", f).orderBy(F.desc("share")).first()
    assert top.pitch_class == 9 and top.share > 0.9


def test_families(spark):
    f = np.arange(0, 400, 0.1)
    level = np.random.default_rng(2).normal(0, 1, len(f))
    for n in range(1, 14):
        level[np.abs(f - n * 25).argmin()] += 20
    bins = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(f, level, strict=True)], "node string, hz double, db double")
    got = tones.family_percentile(bins, ["node"], "hz", "db", 25.0, sweep=(12.0, 60.0, 1.0)).first()
    assert got.score > 12 and got.percentile > 80


def test_fingerprint(spark):
    f = np.linspace(0, 2000, 1001)
    quiet, on = lines(f, []), lines(f, [(120, 1e-5), (240, 1e-5), (360, 1e-5)])
    rows = [("s", k, (on if k < 5 else quiet).tolist()) for k in range(10)]
    df = spark.createDataFrame(rows, "node string, t int, spec array<double>")
    got = tones.source_fingerprint(df, ["node"], "spec", f, F.col("t") < 5, F.col("t") >= 5).first()
    assert [round(h) for h in got.peaks_hz] == [120, 240, 360] and got.comb_hz == pytest.approx(120, abs=2) and got.harmonicity > 0.9


def test_mains(spark):
    t = np.arange(60 * 4000) / 4000
    x = 0.02 * np.sin(2 * np.pi * 50.047 * t) + 0.01 * np.sin(2 * np.pi * 100.094 * t + 0.7) + 0.01 * np.random.default_rng(11).normal(size=len(t))
    hz, rise = tones.hum(x, 4000)
    assert hz == pytest.approx(50.047, abs=0.003) and rise > 10
    df = spark.createDataFrame([(0.0, x.tolist()), (300.0, x[:100].tolist())], "t0 double, x array<double>")
    got = {r.harmonic: r.hz for r in tones.mains_track(df, ["t0"], "x", 4000).collect()}
    assert got[1] == pytest.approx(50.047, abs=0.003) and got[2] == pytest.approx(50.047, abs=0.003)
    found = tones.mains_track(df, ["t0"], "x", 4000).where("harmonic = 1")
    assert indices.mains_summary(found.withColumn("k", F.lit(1)), ["k"], "hz", "rise_db").first().coverage == 1.0


OCTAVES = [31.5, 63, 125, 250, 500, 1000, 2000, 4000, 8000]


def rated(spark, values):
    return spark.createDataFrame([("r", k, float(v)) for k, v in enumerate(values)], "room string, band int, level_db double")


def test_room_criteria(spark):
    on = [a + b * 30 for a, b in indices.NR]
    assert indices.noise_rating(rated(spark, on), ["room"], "band", "level_db").first().nr == pytest.approx(30)
    on[1] = 35.5 + 0.790 * 42
    got = indices.noise_rating(rated(spark, on), ["room"], "band", "level_db").first()
    assert got.nr == pytest.approx(42) and got.governing_band == 1
    nc = [60.0, *indices.NC[3]]
    assert indices.noise_criterion(rated(spark, nc), ["room"], "band", "level_db").first().nc == pytest.approx(30)
    assert indices.noise_criterion(rated(spark, [v + 2 for v in nc]), ["room"], "band", "level_db").first().nc > 30
    line = [30 + 5 * np.log2(1000 / f) for f in OCTAVES]
    got = indices.room_criterion(rated(spark, line), ["room"], "band", "level_db").first()
    assert got.rc == pytest.approx(30, abs=0.1) and got.rc_class == "N"
    line[1] += 12
    assert indices.room_criterion(rated(spark, line), ["room"], "band", "level_db").first().rc_class == "R"
    line[7] += 12
    assert indices.room_criterion(rated(spark, line), ["room"], "band", "level_db").first().rc_class == "RH"


def test_rooms():
    x, inverse = rooms.sweep(1.0, 50, 7000, FS)
    made = {"duration_s": 1.0, "f0_hz": 50, "f1_hz": 7000, "fs": FS}
    assert np.allclose(rooms.inverse_of(made), inverse)
    rng = np.random.default_rng(1)
    room = rng.normal(size=FS // 2) * 10 ** (-3 * np.arange(FS // 2) / FS / 0.4)
    room[0] = 5
    found = rooms.measure(rooms.convolve(x, room), inverse, FS, 0.5)
    assert found["iacc"] is None and abs(found["bands"][1000.0]["t60_s"] - 0.4) < 0.1
    assert abs(found["direct_in_recording_s"]) < 0.002
    long = rng.normal(size=30_000)
    assert np.allclose(rooms.convolve_blocks(long, room, 1024), rooms.convolve(long, room))
    two = np.stack([room, room], axis=1)
    assert rooms.octave_ear_correlation(two, FS)["mean"] > 0.99 and rooms.octave_ear_correlation(two * [1, -1], FS)["signed"][500.0] < -0.99
    late = np.concatenate([np.zeros((4000, 2)), two])
    assert rooms.ear_correlation(late, FS) > 0.99
    wet, gain = rooms.auralize(long, FS, room, FS)
    assert wet.shape == (len(long) + len(room) - 1, 1) and np.abs(wet).max() == pytest.approx(np.abs(long).max())
    assert rooms.auralize(np.stack([long, long, long], axis=1), FS, two, FS)[0].shape[1] == 2
    assert len(rooms.auralize(long, FS, room[: FS // 4], FS // 2)[0]) == len(long) + FS // 2 - 1


def test_diffuse_field():
    rng = np.random.default_rng(4)
    geometry = {"pos": np.array([[0.0, 0], [0.3, 0], [0.7, 0]]), "c": 343.0}
    one = rng.normal(size=4 * FS)
    direct = np.stack([one, np.roll(one, 3), np.roll(one, 7)], axis=1)
    wide = rng.normal(size=(4 * FS, 3))
    near, far = (rooms.diffuse_profile(x, FS, geometry)[0]["diffuseness"] for x in (direct, wide))
    assert near < 0.2 and far > 0.8


def test_background_render():
    fs, rng = 8000, np.random.default_rng(5)
    x = 0.01 * rng.normal(size=60 * fs)
    burst = 0.4 * np.sin(2 * np.pi * 1000 * np.arange(2 * fs) / fs)
    for s in (11, 31, 47):
        x[s * fs : (s + 2) * fs] += burst
    y, before, after = render.background(x, fs, margin_db=6.0, block_s=5.0, least_s=25.0)

    def level(v, a, z, lo, hi):
        p = np.abs(np.fft.rfft(v[int(a * fs) : int(z * fs)])) ** 2
        f = np.fft.rfftfreq(int(z * fs) - int(a * fs), 1 / fs)
        return 10 * np.log10(p[(f >= lo) & (f <= hi)].sum())

    assert len(y) == len(x) and after < before
    for s in (11, 31, 47):
        assert level(x, s + 0.5, s + 1.5, 900, 1100) - level(y, s + 0.5, s + 1.5, 900, 1100) > 12
    assert abs(level(x, 3, 8, 200, 3500) - level(y, 3, 8, 200, 3500)) < 1.5
    loop = render.looped(np.stack([x, x], axis=1), fs)
    assert loop.shape == (59 * fs, 2) and np.abs(loop).max() <= 0.99


def test_excerpt_and_loop(spark):
    rng = np.random.default_rng(9)
    rows = []
    for t in range(300):
        loud = t < 200 and t % 12 in (5, 6)
        spec = (1e-6 * (1 + 0.1 * rng.random(8)) * (1000 if loud else 1)).tolist()
        rows.append(("s", t + 1, 300, float(t), 30.0 if loud else 0.0, spec))
    df = spark.createDataFrame(rows, "take string, i bigint, n bigint, t double, level_db double, logspec array<double>")
    got = render.characteristic_excerpt(df, ["take"]).first()
    assert got.t0 >= 195 and got.eventful == 0
    assert render.loop_window(df, ["take"]).first().seam_db < 5
