"""Sessions, spans, documents, annotations, reports and commands."""

from __future__ import annotations

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotide.functions import models
from echotide.operators import annotations, bearings, corpus, features
from echotide.sources import reports, sessions, wav

FS = 8000


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("session")
    t = np.arange(4 * FS) / FS
    x = 0.5 * np.sin(2 * np.pi * 500 * t)
    for name, gains in (("20240203_040506.wav", [1]), ("20240203_040700 b.wav", [1, 0.5, 0, 0.5])):
        (path / name).write_bytes(wav.encode(np.stack([g * x for g in gains], axis=1), FS))
    (path / "calibration.json").write_text(json.dumps({"clock_offset_s": 1.5, "dbfs_to_dbspl": 100, "dbfs_to_dbspl_takes": {"20240203_040506.wav": 90}}))
    (path / "broken.txt").write_text("no sound")
    return str(path), x


def test_open_session(spark, folder):
    path, _ = folder
    rows = sessions.open_session(spark, path).collect()
    assert [r["name"] for r in rows] == ["20240203_040506.wav", "20240203_040700 b.wav"]
    assert [r.start for r in rows] == [4 * 3600 + 5 * 60 + 6 + 1.5, 4 * 3600 + 7 * 60 + 1.5]
    assert [(r["mode"], r.offset_db, r.end - r.start) for r in rows] == [("mono", 90.0, 4.0), ("ambix", 100.0, 4.0)]
    whole = sessions.session_summary(sessions.open_session(spark, path)).first()
    assert (whole.takes, whole.duration_s) == (2, 8.0)
    with pytest.raises(FileNotFoundError):
        sessions.open_session(spark, f"{path}/none")


def test_modes_and_clips(spark, folder, tmp_path):
    rows = spark.createDataFrame([(1,), (2,), (4,)], "channels int")
    modes = lambda o: [r.m for r in rows.select(sessions.resolve_mode(F.col("channels"), o).alias("m")).collect()]
    assert modes(None) == ["mono", "stereo", "ambix"] and modes("binaural") == ["mono", "binaural", "ambix"] and modes("odd") == modes(None)
    for name, n in (("b", 2), ("a", 1)):
        (tmp_path / f"{name}.wav").write_bytes(wav.encode(np.zeros((n * FS, 1)), FS))
    (tmp_path / "c.wav").write_bytes(b"RIFF no")
    clips, skipped = sessions.open_clips(spark, str(tmp_path))
    assert [(r["name"], r.start, r.end) for r in clips.orderBy("start").collect()] == [("a.wav", 0.0, 1.0), ("b.wav", 1.0, 3.0)] and skipped == ["c.wav"]
    one = sessions.open_recording(spark, str(tmp_path / "a.wav")).first()
    assert one.session == "a" and one.start >= 0 and one.duration == 1.0


def test_spans(spark, folder, tmp_path):
    path, x = folder
    takes = sessions.open_session(spark, path)
    start = takes.first()["start"]
    got, fs = sessions.read_span(takes, start + 1, 0.5)
    assert fs == FS and np.allclose(got[:, 0], x[FS : FS + FS // 2], atol=1e-4)
    assert len(sessions.read_span(takes, start + 3.5, 10)[0]) == FS // 2
    with pytest.raises(ValueError):
        sessions.read_span(takes, start + 50, 1)
    at = spark.createDataFrame([(start + 1,), (start + 2,), (0.0,)], "t0 double")
    rows = sessions.spans(takes, at, 0.25).orderBy("t0").collect()
    assert len(rows) == 2 and np.allclose(rows[1].samples, x[2 * FS : 2 * FS + FS // 4], atol=1e-4)
    out = sessions.export_segment(takes, start + 1, 0.5, f"{tmp_path}/cut.wav")
    assert out.endswith("20240203_040508 cut.wav")
    back, _ = sessions.read_span(sessions.open_recording(spark, out), sessions.open_recording(spark, out).first()["start"], 1)
    assert (back[:, 0] == got[:, 0]).all()
    assert sessions.stamped("x", datetime.date(2024, 1, 1), 90061) == "20240102_010101 x"


def test_previews():
    x = np.random.default_rng(1).normal(size=(10, 4))
    two = sessions.stereo_preview(x)
    assert np.allclose(two, 0.5 * np.stack([x[:, 0] + x[:, 1], x[:, 0] - x[:, 1]], axis=1))
    assert sessions.stereo_preview(x[:, :1]).shape == (10, 2) and (sessions.stereo_preview(x[:, :2], mode="stereo") == x[:, :2]).all()
    assert np.allclose(sessions.ears(x, "fuma")[0][:, 0], 0.5 * (x[:, 0] + x[:, 2]))
    assert np.allclose(sessions.b_format(x, np.eye(4)[::-1]), x[:, ::-1])


def test_features_are_written_once_and_leads_settle(spark, folder, tmp_path):
    path, _ = folder
    wav.register(spark)
    files = ",".join(sessions.files_in(path))
    cut = spark.read.format("wav").options(block_s=1.0, lead_s=0.5).load(files)
    whole = spark.read.format("wav").options(block_s=60.0).load(files)
    one, other = ({(r.path, round(r.t, 3)): r.fast_dba for r in features.fast(b).collect()} for b in (cut, whole))
    assert one.keys() == other.keys() and max(abs(one[k] - other[k]) for k in one) < 0.05
    features.write(cut, f"{tmp_path}/f")
    features.write(cut, f"{tmp_path}/f")
    held = sessions.load_features(spark, f"{tmp_path}/f")
    assert held["seconds"].count() == 8 and held["fast"].count() == 64 and held["minutes"].count() == 8


def test_calibration(spark, tmp_path):
    folder = str(tmp_path)
    assert sessions.load_calibration(folder) is None
    sessions.write_calibration(folder, 94.0, "meter", date="2024-01-01")
    sessions.write_calibration(folder, 90.0, take="a.wav", date="2024-01-02")
    held = sessions.load_calibration(folder)
    assert held == {"dbfs_to_dbspl": 94.0, "method": "meter", "date": "2024-01-02", "dbfs_to_dbspl_takes": {"a.wav": 90.0}}
    rows = spark.createDataFrame([("a.wav",), ("b.wav",)], "name string")
    assert [r.o for r in rows.select(sessions.take_offset(held, F.col("name")).alias("o")).collect()] == [90.0, 94.0]
    assert rows.select(sessions.take_offset(None, F.col("name")).alias("o")).first().o is None


def test_geometry_and_triangulation(spark):
    line = sessions.load_geometry([0.0, 0.1, 0.25])
    assert line["linear"] and line["c"] == 343.0 and not sessions.load_geometry({"mics": [[0, 0], [1, 0], [0, 1]], "c": 340})["linear"]
    with pytest.raises(ValueError):
        sessions.load_geometry([[0, 0]])
    pairs = []
    for frame, deg in enumerate((40.0, 90.0, 120.0)):
        for a, b in ((0, 1), (0, 2), (1, 2)):
            apart = line["pos"][a][0] - line["pos"][b][0]
            pairs.append((frame, a, b, float(-apart * np.cos(np.radians(deg)) / 343), 0.9))
    df = spark.createDataFrame(pairs, "frame int, a int, b int, delay_s double, prominence double")
    got = [r.bearing_deg for r in bearings.array_bearing(df, ["frame"], line).orderBy("frame").collect()]
    assert got == pytest.approx([40, 90, 120], abs=1e-6)
    plan = sessions.load_plan({"nodes": [{"name": "a", "pos": [0, 0], "axis_deg": 0}, {"name": "b", "pos": [4, 0], "axis_deg": 90}, {"name": "c", "pos": [1, 5], "axis_deg": 20}]})
    rows = []
    for k in range(5):
        x, y = 1.5 + 0.2 * k, 2.0
        for n in plan:
            turn = np.degrees(np.arctan2(y - n["pos"][1], x - n["pos"][0])) - n["axis_deg"]
            rows.append((n["name"], k + 0.1, float(abs((turn + 180) % 360 - 180)), 0.8, False))
    table = spark.createDataFrame(rows, "node string, t double, bearing_deg double, confidence double, clipped boolean")
    got = bearings.triangulate(table, plan).orderBy("k").collect()
    assert [(round(r.x, 3), round(r.y, 3)) for r in got] == [(round(1.5 + 0.2 * k, 3), 2.0) for k in range(5)]
    assert all(r.residual_m < 1e-6 and not r.ambiguous for r in got)
    assert bearings.triangulate(table.where("node <> 'c' or t > 2"), plan).count() == 3


def test_directions(spark, tmp_path):
    t = np.arange(2 * FS) / FS
    x = 0.5 * np.sin(2 * np.pi * 1000 * t)
    turn = np.radians(40)
    (tmp_path / "a.wav").write_bytes(wav.encode(np.stack([x, np.sin(turn) * x, 0 * x, np.cos(turn) * x], axis=1), FS))
    wav.register(spark)
    blocks = spark.read.format("wav").options(block_s=1.0, lead_s=0.2).load(f"{tmp_path}/a.wav")
    for sub in (None, 0.01):
        found = bearings.frame_directions(blocks, sub_s=sub)
        got = found.orderBy("frame").collect()
        assert [r.frame for r in got] == list(range(20)) and all(abs(r.az_deg - 40) < 0.5 and r.diffuseness < 0.1 for r in got)
    labels = spark.createDataFrame([(got[0].path, k, 3, 0, 30.0) for k in range(20)] + [(got[0].path, 5, 4, 1, 90.0)], "path string, frame bigint, class int, source int, azimuth double")
    rows = bearings.validate(labels, found, ["path"])
    assert rows.count() == 19 and bearings.error_stats(rows, ["path"], "error_deg").first().median_abs_deg == pytest.approx(10, abs=0.5)


def test_motion(spark, tmp_path):
    head = "Date_Time;Acc X (m/s^2);Acc Y;Acc Z\n"
    (tmp_path / "m.csv").write_text(head + "".join(f"2024-01-01T00:00:{k:02d}Z;{k};{2 * k};9.8\n" for k in (3, 1, *range(5, 13))))
    rows = sessions.motion(spark, str(tmp_path / "m.csv")).collect()
    assert [r.t for r in rows][:2] == [1.0, 3.0] and rows[1].y == 6.0 and str(rows[0].date0) == "2024-01-01"
    (tmp_path / "n.csv").write_text("a,b,c,d\n" + "".join(f"{k},1,2,3\n" for k in range(9)))
    rows = sessions.motion(spark, str(tmp_path / "n.csv")).collect()
    assert (rows[3].t, rows[3].x, rows[3].z) == (3.0, 1.0, 3.0) and rows[0].date0 is None
    (tmp_path / "s.csv").write_text("t,x,y,z\n1,2,3,4\n")
    with pytest.raises(ValueError, match="eight"):
        sessions.motion(spark, str(tmp_path / "s.csv"))
    assert sessions.cleaned(' "X (g)" ') == "x"


OBJECTS = "name string, label string, kind string, level_dbfs double, facture string, mass string, auto boolean, spans array<struct<a:double,b:double>>, events array<double>"


def test_annotations(spark):
    rows = [
        ("door", None, "signal", -30.0, "impulse", "noise", False, [], [1.0, 5.0]),
        ("hum -52 dBFS", "AUTO x", "keynote", None, None, None, None, [(0.0, 100.0)], None),
        ("bell", None, "soundmark", None, "iteration", "tonic", None, [(2.0, 4.0)], None),
        ("talk", None, "signal", None, None, None, None, [(2.0, 3.0)], None),
        ("-60 to -50 dBFS", None, "keynote", None, "unlimited", "noise", None, [(0.0, 900.0)], None),
    ]
    df = spark.createDataFrame(rows, OBJECTS)
    found = annotations.map_objects(df, spark.createDataFrame([("e", "impulse", "noise", -20.0, 0.5), ("l", "impulse", "noise", -20.0, 50.0)], "name string, facture string, mass string, level_dbfs double, seconds double"))
    assert {(r.source, r.status): r["count"] for r in annotations.census(found).collect()} == {
        ("hand", "object"): 3, ("hand", "regime"): 2, ("hand", "untyped"): 1, ("detected", "object"): 1, ("detected", "long"): 1,
    }
    assert annotations.expand_events(df).count() == 6
    levels = df.select("name", annotations.level_of(F.col("level_dbfs"), F.col("name"), F.col("label")).alias("l"), annotations.bed_middle(F.col("level_dbfs"), F.col("name"), F.col("label")).alias("m"))
    got = {r["name"]: (r.l, r.m) for r in levels.collect()}
    assert got["door"] == (-30, -30) and got["hum -52 dBFS"] == (-52, -52) and got["-60 to -50 dBFS"][1] == -55 and got["bell"] == (None, None)
    kept = found.where("status = 'object'")
    assert annotations.drawn(kept, 2).groupBy("facture", "mass").count().count() == 2 and annotations.drawn(kept, 100).count() == 4
    alphas = [r.alpha for r in annotations.opacity(kept).orderBy("name").collect()]
    assert all(0.18 <= a <= 0.9 for a in alphas)
    one = spark.range(1)
    text = one.select(
        annotations.bed_title(F.lit(-60.2), F.lit(-54.4), F.lit(23)).alias("a"),
        annotations.bed_title(F.lit(-40.0), F.lit(-40.0), F.lit(1)).alias("b"),
        annotations.duration_text(F.lit(5400.0)).alias("h"),
        annotations.duration_text(F.lit(600.0)).alias("m"),
        F.array(*[annotations.letters(F.lit(k)) for k in (0, 25, 26, 51, 52, 701, 702)]).alias("l"),
        annotations.point_label(F.lit("n"), F.lit("AUTO y"), F.lit(1), F.lit(100)).alias("p"),
        annotations.point_label(F.lit("n"), F.lit("y"), F.lit(3), F.lit(100)).alias("q"),
    ).first()
    assert text.a == "quiet bed, -60 to -54 dBFS, 23 spans" and text.b == "moderate bed, -40 dBFS, 1 span"
    assert (text.h, text.m, text.p, text.q) == ("1.5 h", "10 min", "n", None) and text.l == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"]


def test_beds_and_activities(spark):
    rows = [("s", f"steady state {k}", None, "keynote", -70.0 + 3 * k, None, None, None, [(float(100 * k), float(100 * k + 10 + k))], None) for k in range(12)]
    df = spark.createDataFrame(rows, "take string, " + OBJECTS)
    got = annotations.merge_beds(df, ["take"], most=2).orderBy("name").collect()
    assert len(got) == 3 and sum(r.spans for r in got) == 12 and any(r["name"].startswith("other beds") for r in got)
    assert annotations.merge_beds(df, ["take"], most=20).count() == 12
    acts = spark.createDataFrame([("cook", 0.0, 50.0), ("sleep", 50.0, 500.0)], "class string, a double, b double")
    objs = spark.createDataFrame([(1, [(40.0, 70.0)], None), (2, None, [45.0, 60.0]), (3, None, [900.0])], "id int, spans array<struct<a:double,b:double>>, events array<double>")
    assert {r.id: r["class"] for r in annotations.dominant(objs, acts, ["id"], "class").collect()} == {1: "sleep", 2: "cook"}


def test_reports(spark, tmp_path):
    with pytest.raises(ValueError, match="no soundscape"):
        reports.category("fx-a", soundscapes_only=True)
    with pytest.raises(ValueError, match="none of"):
        reports.category("zz")
    held = json.loads(open(reports.sidecar(f"{tmp_path}/a.wav", " SS-I ", speech=0.02, extra={"k": 1})).read())
    assert held["bst_category"] == "ss-i" and held["privacy_review"] and held["k"] == 1 and held["filename"] == "a.wav"
    one = spark.createDataFrame([(2828.0, 16000.0, 0.4)], "lo double, hi double, s double")
    said = one.select(reports.floor_warning(F.col("lo"), F.col("hi"), F.col("s")).alias("w")).first().w
    assert "2.8–16 kHz" in said and "0.4 dB" in said
    long = spark.createDataFrame([("on", "ndsi", 0.5), ("off", "ndsi", 0.1), ("on", "L90", float("nan")), ("on", "other", 1.0)], "state string, key string, value double")
    table = reports.state_table(long)
    assert [r.Descriptor for r in table.collect()] == ["L90 (dBFS)", "NDSI"] and table.columns == ["Descriptor", "off", "on"]
    assert json.loads(open(reports.summary_json(long.where("state = 'on'"), f"{tmp_path}/s.json")).read()) == {"L90": None, "ndsi": 0.5, "other": 1.0}
    page = f"{tmp_path}/README.md"
    with open(page, "w") as f:
        f.write("my words\n")
    takes = [{"name": "a.wav", "date": "2024-01-01", "clock": "01:02:03", "duration": 90.0}]
    reports.session_page(page, "room", takes, "note", [("Leq", "-30")])
    with open(page) as f:
        first = f.read()
    assert "my words" not in first and "| `a.wav` | 2024-01-01 | 01:02:03 | 1.5 min |" in first
    with open(page, "w") as f:
        f.write("kept\n" + first)
    reports.session_page(page, "room", takes, "other", [], warning="> careful")
    with open(page) as f:
        again = f.read()
    assert again.startswith("kept\n") and "other" in again and "> careful" in again and "| Leq |" not in again
    document = reports.recipe([{"hz": 100.0, "p10_db": -50.0, "p50_db": -40.0}], [{"hz": 1.0 * k, "rise_db": 1.0 * k} for k in range(9)], {}, {}, "r")
    assert [t["hz"] for t in document["lines"]] == [8, 7, 6, 5, 4, 3] and document["bands"][0]["low_db"] == -10
    assert "recipe" in open(reports.recipe_page(document, f"{tmp_path}/r.html")).read()


def test_registry_and_surveys(spark):
    assert corpus.registry(spark.range(1)).count() == 71 and corpus.tiers(spark.range(1)).first().tier == "S"
    long = spark.createDataFrame([("s", "azimuth_fg_deg", 1.0), ("s", "n_events", 2.0), ("s", "odd", 3.0)], "session string, key string, value double")
    got = corpus.cautions(long, ["session"]).first()
    assert got.defined == ["azimuth_fg_deg"] and got.n_motivated == 1
    assert [r.key for r in corpus.ungrounded(long, []).collect()] == ["odd"] and corpus.ungrounded(long, ["odd"]).count() == 0
    scale = lambda v: spark.createDataFrame([(v,) * 8], ", ".join(f"{s} double" for s in corpus.SCALES))
    assert corpus.detect_scale(scale(4.0)) == "1-5" and corpus.detect_scale(scale(60.0)) == "0-100"
    with pytest.raises(ValueError):
        corpus.detect_scale(scale(400.0))
    survey = spark.createDataFrame([("pleasantness_mean", 0.3)], "key string, value double")
    measured = spark.createDataFrame([("L50", -40.0)], "key string, value double")
    row = corpus.versus(survey, measured, [("Pleasantness", "pleasantness_mean", ["laeq_dbfs", "L50"])]).first()
    assert (row.measured_key, row.measured, row.survey) == ("L50", -40.0, 0.3)
    dated = spark.createDataFrame([("a", f"2024-01-0{k}", "x", float(k)) for k in range(1, 5)] + [("a", None, "x", 1.0), ("a", "2024-01-01", "y", float("nan"))], "session string, date string, key string, value double")
    assert corpus.finite_series(dated).count() == 4


def test_models(spark):
    assert models.available("numpy") and not models.available("no_such_package")
    with pytest.raises(ImportError):
        models.require("no_such_package", "this")
    df = spark.createDataFrame([(1, [0.5] * 8), (2, [0.0] * 8)], "k int, x array<float>")

    def factory():
        return lambda x, fs: {"loud": float(np.abs(x).max()), "quiet": 0.2}

    found = models.scores(df, ["k"], "x", 8000, factory)
    assert {(r.k, r.label) for r in models.top_labels(found, ["k"], top=1).collect()} == {(1, "loud"), (2, "quiet")}
    assert models.tally(found, []).first().label == "loud"
    with pytest.raises(ValueError):
        models.wanted(found, ["odd"], ["loud", "quiet"])
    x = np.sin(np.arange(1000))
    assert np.sqrt(np.mean(models.speech_input(0.001 * x) ** 2)) == pytest.approx(0.05) and (models.speech_input(0 * x) == 0).all()
    heard = spark.createDataFrame([(1, 10.0, 0.0, 2.0), (1, 10.0, 5.0, 6.0)], "k int, s double, start double, end double")
    assert models.speech_share(heard, ["k"], "s").first().speech_fraction == 0.3
    assert len(models.resample(x, 8000, 4000)) == 500


def test_commands(spark, folder, capsys):
    from echotide import cli

    path, _ = folder
    assert cli.main(["probe", path]) == 0
    assert "20240203_040506.wav" in capsys.readouterr().out
    assert cli.main(["analyze", path, "--block", "2"]) == 0
    for name in ("tones", "modspec", "geophony", "spatial", "schedule", "draft"):
        assert cli.main([name, path]) == 0
    assert cli.main(["timescales"]) == 0
    with pytest.raises(ImportError):
        cli.main(["iso", path])
    assert sessions.read_json(f"{path}/analysis/summary.json")["duration_min"] is not None
    assert len(cli.COMMANDS) >= 43
