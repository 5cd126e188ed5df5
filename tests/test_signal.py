"""Recordings, features, kernels and streams on signals whose results are known."""

from __future__ import annotations

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotide.functions import dsp, scalars
from echotide.operators import circular, corpus, cycles, features, intervals, network
from echotide.sources import sinks, text, wav
from echotide.streaming import capture

FS = 8000


@pytest.fixture(scope="module")
def recording(tmp_path_factory):
    t = np.arange(5 * FS) / FS
    tone = 0.5 * np.sin(2 * np.pi * 1000 * t)
    # in the order that the header tells: W, X, Y, Z
    x = np.stack([tone, tone * np.cos(np.radians(30)), tone * np.sin(np.radians(30)), 0 * t], axis=1)
    path = tmp_path_factory.mktemp("wav") / "20240203_040506.wav"
    data = wav.encode(x, FS)
    body = b"zTRK1=W\r\nzTRK2=X\r\nzTRK3=Y\r\nzTRK4=Z\r\n".ljust(256, b"\0") + b"\0" * 64 + b"2024-02-03" + b"04:05:06" + struct.pack("<Q", 77)
    bext = b"bext" + struct.pack("<I", len(body)) + body
    path.write_bytes(data[:12] + bext + data[12:])
    return str(path), x


def test_wav(spark, recording):
    path, x = recording
    row = wav.takes(spark, [path]).first()
    assert (row.samplerate, row.channels, row.frames, row.time_reference) == (FS, 4, len(x), 77)
    found = wav.session_takes(wav.takes(spark, [path]), {"20240203_040506.wav": 2.0}).withColumn("o", wav.channel_order(F.col("description")))
    row = found.first()
    assert (row.start, row.duration, row.o) == (4 * 3600 + 5 * 60 + 6 + 2.0, 5.0, "fuma")
    wav.register(spark)
    blocks = spark.read.format("wav").option("block_s", "2").load(path).orderBy("first").collect()
    assert [b.first for b in blocks] == [0, 2 * FS, 4 * FS]
    assert np.allclose(np.concatenate([b.samples for b in blocks]), x.ravel(), atol=1e-4)
    with pytest.raises(ValueError, match="RIFF"):
        wav.parse_header(lambda at, n: b"nope"[:n])


@pytest.mark.parametrize("bits", [16, 24, 32])
def test_sample_formats(bits):
    x = np.linspace(-1, 0.99, 50)[:, None].repeat(2, axis=1)
    data = wav.encode(x, FS, bits)
    h = wav.parse_header(lambda at, n: data[at : at + n])
    assert np.allclose(wav.decode(data[h.data_at :], h.bits, h.coding, h.channels), x, atol=2 ** (1 - bits) * 2 + 1e-7)


def test_features(spark, recording):
    path, x = recording
    wav.register(spark)
    blocks = spark.read.format("wav").option("block_s", "2").load(path).cache()
    sec = features.per_second(blocks).orderBy("t").collect()
    assert [r.t for r in sec] == [0, 1, 2, 3, 4]
    assert all(abs(r.rms - 0.5 / 2**0.5) < 1e-3 and abs(r.centroid - 1000) < 5 for r in sec)
    assert all(abs(r.az - 30) < 0.5 and abs(r.el) < 0.5 and r.diffuse < 0.05 for r in sec)
    assert all(np.argmax(r.oct_pow) == dsp.OCTAVES.index(1000.0) for r in sec)
    fast = features.fast(blocks).orderBy("t").collect()
    assert len(fast) == 40 and abs(np.median([r.fast_db for r in fast]) - 10 * np.log10(0.125)) < 0.01
    assert abs(np.median([r.fast_dba - r.fast_db for r in fast])) < 0.2  # A-weighting is 0 dB at 1 kHz
    assert features.envelope(blocks).count() == 250 and features.per_minute(blocks).count() == 3
    assert blocks.limit(0).transform(features.per_second).count() == 0


def test_kernels():
    rng = np.random.default_rng(1)
    x = rng.normal(size=4096)
    f, p = dsp.welch(x, 100.0, 512)
    assert abs(p.sum() * (f[1] - f[0]) - x.var()) < 0.1
    assert np.allclose(np.abs(dsp.analytic(np.cos(2 * np.pi * 8 * np.arange(256) / 256))), 1)
    assert dsp.local_peaks(np.array([0, 2, 2, 2, 0, 5, 0, 4, 0]), 1, 3).tolist() == [2, 5]
    assert np.allclose(dsp.a_response(np.array([100.0, 1000.0]), 48000).__abs__() ** 2, [10**-1.91, 1], rtol=0.02)
    label = dsp.average_linkage(np.array([[0, 0.1, 1], [0.1, 0, 1], [1, 1, 0]]), 0.35)
    assert label[0] == label[1] != label[2]
    ir = np.concatenate([np.zeros(50), rng.normal(size=FS) * 10 ** (-3 * np.arange(FS) / FS / 0.5)])
    got = dsp.decay(ir, FS)
    assert abs(got["t60_s"] - 0.5) < 0.05 and got["c80_db"] > got["c50_db"]


def series(spark, x, dt=1.0):
    return spark.createDataFrame([("k", i, i * dt, float(v)) for i, v in enumerate(x)], "node string, i int, t double, x double")


def test_cycles(spark):
    i = np.arange(8000)
    x = 5 * (i % 700 < 250) + np.random.default_rng(2).normal(0, 0.3, len(i))
    df = series(spark, x)
    found = cycles.dominant_cycles(df, ["node"], "i", "x", 1.0).collect()
    assert abs(found[0].period_s - 700) < 5 and found[0].band == "cyclic"
    odd = x.copy()
    odd[3333] += 30
    assert [round(r.t_s) for r in cycles.cycle_residual(series(spark, odd), ["node"], "i", "x", 1.0, sigmas=12).collect()] == [3333]
    drift = cycles.cycle_drift(df, ["node"], "i", "x", 1.0, low_s=300.0).first()
    assert not drift.drifting and abs(drift.period_s - 700) < 10
    assert cycles.dominant_cycles(df.limit(5), ["node"], "i", "x", 1.0).count() == 0
    assert cycles.dominant_cycles(df.limit(0), ["node"], "i", "x", 1.0).count() == 0


def test_onsets(spark):
    df = spark.createDataFrame([(1, i, float(i >= 20), float(30 <= i < 60)) for i in range(100)], "k int, i int, a double, b double")
    span = cycles.onset_span(df, ["k"], "i", "b").first()
    assert (span.onset, span.last) == (30, 59)
    assert cycles.onset_lead(df, ["k"], "i", "a", "b", 0.5).first().lead_s == 5.0
    assert cycles.onset_span(df.where("i < 4"), ["k"], "i", "b").first().onset is None


def test_rhythm_and_regimes(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.1, 3000)
    x[100::250] += 8
    x[130::250] += 4  # too near a stronger one
    got = cycles.pick_strikes(series(spark, x, 0.01), ["node"], "t", "x", apart_s=0.5, k=20, window_s=4.0).collect()
    assert [round(r.t_s * 100) for r in got] == list(range(100, 3000, 250))
    period = circular.best_period(spark.createDataFrame([("k", r.t_s) for r in got], "node string, t double"), ["node"], "t", [2.0, 2.5, 3.0])
    assert period.first().period == 2.5
    y = np.concatenate([np.full(600, -60.0), np.full(600, -40.0), np.full(600, -59.0)]) + rng.normal(0, 0.2, 1800)
    found = cycles.regimes(series(spark, y), ["node"], "t", "x", 1.0).orderBy("a")
    assert [abs(r.a - a) < 20 for r, a in zip(found.collect(), (0, 600, 1200), strict=True)] == [True] * 3
    held = cycles.beds(found.withColumn("s", F.col("b") - F.col("a")), ["node"], "level_db", "s").orderBy("lo").collect()
    assert [(r.parts, r.name) for r in held] == [(2, "quiet"), (1, "moderate")]
    beats = 1 + rng.normal(0, 1e-4, 2000)
    spread = cycles.allan_deviation(series(spark, beats), ["node"], "i", "x", 1.0).orderBy("beats").collect()
    assert abs(spread[0].ppm - 100) < 15 and spread[4].ppm < spread[0].ppm


def test_tones_and_clusters(spark):
    f = np.arange(2000) * 2.0
    rows = []
    for k in range(6):
        p = 1 + 0.1 * np.random.default_rng(k).random(2000)
        p[100] = 100 if k != 3 else 1
        p[[200, 300]] = 60
        rows.append(("s", k, p.tolist()))
    df = spark.createDataFrame(rows, "node string, i int, spec array<double>")
    got = cycles.tonal_tracks(df, ["node"], "i", "spec", f).orderBy("hz").collect()
    assert [(round(r.hz), r.rows, r.first, r.last) for r in got] == [(200, 6, 0, 5), (400, 6, 0, 5), (600, 6, 0, 5)]
    f0, share = cycles.harmonic_sieve(np.array([200.0, 400.0, 600.0, 770.0]), np.array([5.0, 4.0, 3.0, 0.5]))
    assert f0 == 200.0 and share > 0.9
    shapes = [[1, 2, 3, 4], [2, 4, 6, 8.5], [4, 3, 2, 1], [1, 5, 1, 5], [4, 3, 2, 0.9]]
    df = spark.createDataFrame([("s", k, [float(v) for v in s]) for k, s in enumerate(shapes)], "node string, i int, v array<double>")
    label = [r.cluster for r in cycles.cluster(df, ["node"], "i", "v").orderBy("row").collect()]
    assert label[0] == label[1] != label[2] == label[4] and label[3] == -1


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.note_name(F.lit(440.0)).alias("a"),
        scalars.note_name(F.lit(261.6)).alias("c"),
        scalars.wrap_degrees(F.lit(190.0)).alias("w"),
        scalars.wrap_degrees(F.lit(-180.0)).alias("v"),
        scalars.clock_text(F.lit(90061.0)).alias("t"),
        scalars.parse_clock(F.lit("1 01:01:01")).alias("s"),
        scalars.parse_clock(F.lit("12.5")).alias("n"),
        scalars.parse_clock(F.lit("x")).alias("x"),
        scalars.date_in(F.lit("room 20240230 2024-02-28")).cast("string").alias("d"),
        scalars.band_of(F.lit(0.5)).alias("b"),
        scalars.channel_mode(F.lit(3)).alias("m"),
        scalars.quadrant(F.lit(-0.1), F.lit(0.0)).alias("q"),
    ).first()
    assert tuple(row) == ("A4", "C4", -170.0, 180.0, "1 01:01:01", 90061.0, 12.5, None, "2024-02-28", "meso", "stereo", "chaotic")


def test_scalars_at_odd_values(spark):
    odd = [0.0, -0.0, 4.0, -4.0, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame(list(enumerate(odd)), "k int, f double")
    got = df.select("k", scalars.fluctuation_weight(F.col("f")).alias("w"), scalars.note_name(F.col("f")).alias("n")).orderBy("k").collect()
    assert [r.w for r in got[:6]] == [0.0, 0.0, 1.0, -1.0, 0.0, 0.0]
    assert np.isnan(got[6].w) and got[7].w is None
    assert [r.n for r in got] == [None, None, "C-2", None, None, None, None, None]


def test_text_sources(spark, tmp_path):
    (tmp_path / "log.csv").write_text("Class;Start time;Stop time\ncook;2024-01-02 00:00:10.500000;2024-01-02 00:01:00\n")
    row = text.activities(spark, str(tmp_path / "log.csv")).first()
    assert (row["class"], row.a, row.b) == ("cook", 10.5, 60.0)
    (tmp_path / "a.csv").write_text("1,2,0,-30,5\n\n2,2,0,10,5,120\n")
    assert [r.distance_cm for r in text.annotations(spark, str(tmp_path / "a.csv")).orderBy("frame").collect()] == [None, 120.0]
    (tmp_path / "bad.csv").write_text("1,2,0\n")
    with pytest.raises(Exception, match="not an annotation"):
        text.annotations(spark, str(tmp_path / "bad.csv")).collect()
    head = ",".join(["ID", *[s.title() for s in corpus.SCALES], "age"])
    (tmp_path / "s.csv").write_text(f"{head}\nr1,5,5,3,1,1,1,3,5,40\nr2,x,5,3,1,1,1,3,5,40\n")
    rows = corpus.coordinates(text.responses(spark, str(tmp_path / "s.csv"))).collect()
    assert len(rows) == 1 and rows[0].extras == {"age": "40"} and abs(rows[0].pleasantness - 1) < 1e-9
    for name, body in (("s1", json.dumps({"ndsi": 0.5, "date": "x"})), ("s2", "{broken")):
        (tmp_path / name / "analysis").mkdir(parents=True)
        (tmp_path / name / "analysis" / "summary.json").write_text(body)
    got = text.summaries(spark, f"{tmp_path}/*/analysis/summary.json").where("value is not null").collect()
    assert [(r.session, r.key, r.value) for r in got] == [("s1", "ndsi", 0.5)]
    assert "| ndsi |" in sinks.markdown(spark.createDataFrame([("ndsi", 0.5)], "key string, value double"))


def test_joins_at_edges(spark):
    left = spark.createDataFrame([("k", t) for t in (0.0, 3599.0, 3600.0, 9000.0)], "k string, t double")
    right = spark.createDataFrame([("k", 10.0, 1.0), ("k", 3600.0, 2.0)], "k string, t double, v double")
    got = {r.t: r.matched for r in intervals.as_of(left, right, ["k"], "t", "v").collect()}
    assert got == {0.0: None, 3599.0: 1.0, 3600.0: 2.0, 9000.0: 2.0}
    spans = spark.createDataFrame([("k", 0.0, 3600.0), ("k", 5.0, 5.0)], "k string, a double, b double")
    assert sorted(r.t for r in intervals.inside(left, spans, ["k"], "t", width=100.0).collect()) == [0.0, 3599.0]
    assert sorted(r.t for r in intervals.inside(left, spans, ["k"], "t", width=100.0, anti=True).collect()) == [3600.0, 9000.0]
    edges = spark.createDataFrame([(0, "a", "b", 0.9), (0, "b", "c", 0.9), (0, "a", "c", 0.2)], "window int, a string, b string, coupling double")
    assert network.transitivity(edges).first().transitivity == 0
    assert network.transitivity(edges.withColumn("coupling", F.lit(1.0))).first().transitivity == 1


def test_streams(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:{m:02d}:00", float(m * 60), float(50 + 20 * (m // 10 % 2))) for m in range(40)]
    schema = "node string, ts string, t double, level_db double"
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").withColumn("ts", F.col("ts").cast("timestamp"))

    def drain(frame, name):
        q = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    assert all(r.rows == 10 for r in drain(capture.window_levels(stream, ["node"], window="10 minutes"), "w"))
    assert drain(capture.session_windows(stream, ["node"], gap="30 minutes"), "s") == []
    got = drain(capture.switches(stream, "node", "t", "level_db", 60.0), "x")
    assert [(r.t, r.state) for r in sorted(got, key=lambda r: r.t)] == [(0.0, "off"), (600.0, "on"), (1200.0, "off"), (1800.0, "on")]
    days = stream.withColumn("day", F.to_date("ts"))
    query = capture.roll_up_days(days, f"{tmp_path}/out", f"{tmp_path}/c", lambda rows: rows.groupBy("day").agg(F.count("*").alias("rows")))
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/days").first().rows == 40
