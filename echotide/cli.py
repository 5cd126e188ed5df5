"""Commands: ``spark-submit echotide/cli.py COMMAND ...`` or ``python -m echotide.cli COMMAND ...``.

Each reads a folder of recordings, or of feature tables that ``analyze`` wrote, and
prints a table or writes files; ``--out`` names a folder for Parquet.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotide.functions import models
from echotide.functions.dsp import OCTAVES, log_edges
from echotide.operators import (
    annotations,
    bearings,
    circular,
    corpus,
    cycles,
    ecology,
    events,
    features,
    indices,
    levels,
    network,
    objects,
    render,
    rhythm,
    rooms,
    spectral,
    states,
    tones,
    vision,
)
from echotide.plans import series, summary
from echotide.plans.store import written
from echotide.sources import reports, sessions, sinks, text, wav
from echotide.streaming import capture as streams

COMMANDS: dict[str, tuple[Callable, list[tuple[tuple, dict]], str]] = {}
FOLDER = (("folder",), {"help": "a folder of recordings or of feature tables"})


def command(name: str, *arguments, help: str):
    """Registers a command; it gets the session and its arguments, and may return a table to show."""

    def add(run):
        COMMANDS[name] = (run, list(arguments), help)
        return run

    return add


def arg(*names, **more):
    return names, more


def tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return sessions.load_features(spark, f"{folder.rstrip('/')}/analysis/features")


def frequencies(minutes: DataFrame, fs: int = 48000) -> np.ndarray:
    """The frequencies of the bins of spectra."""
    row = minutes.select(F.size("minspec").alias("n")).first()
    bins = row["n"] if row else 0
    return np.linspace(0, fs / 2, bins) if bins else np.zeros(0)


def numbered(rows: DataFrame, x: str, name: str = "level_db") -> DataFrame:
    return series.number_rows(rows.withColumn(name, F.col(x)), ["take"], ["t"], "t", 3600.0)


def second_levels(spark: SparkSession, folder: str) -> DataFrame:
    return render.numbered_seconds(tables(spark, folder)["seconds"], ["take"])


# ------------------------------------------------------------------ sessions


@command("probe", FOLDER, help="the takes of a folder")
def probe(spark, folder):
    return sessions.open_session(spark, folder).select("name", "started", "start", "duration", "samplerate", "channels", "mode", "channel_order")


@command("analyze", FOLDER, arg("--block", type=float, default=60.0), help="feature tables and summary of a folder")
def analyze(spark, folder, block):
    wav.register(spark)
    takes = sessions.open_session(spark, folder)
    paths = [r["path"] for r in takes.select("path").collect()]
    blocks = spark.read.format("wav").options(block_s=block, lead_s=0.5).load(",".join(paths))
    features.write(blocks, f"{folder}/analysis/features")
    found = written(summarise(spark, folder, ["take"]), "summary")
    reports.summary_json(found.groupBy("key").agg(F.avg("value").alias("value")), f"{folder}/analysis/summary.json")
    return found


def summarise(spark, folder, keys, held=None):
    held = held or tables(spark, folder)
    return summary.full_summary(held["seconds"], held["fast"], held["envelope"], keys, held["minutes"], frequencies(held["minutes"]))


@command("scenes", FOLDER, arg("--block", type=float, default=60.0), help="each recording of a folder as a session of its own")
def scenes(spark, folder, block):
    return analyze(spark, folder, block)


@command("resolve", FOLDER, help="a summary for each machine state")
def resolve(spark, folder):
    held = tables(spark, folder)
    rows = second_levels(spark, folder)
    segs = states.segments(rows, ["take"], states.otsu(rows, ["take"]), min_rows=180)
    kept = states.auto_states(segs, ["take"], rows.groupBy("take").agg(F.max("n").alias("n")))
    cut = summary.by_state(held, states.state_intervals(kept, ["take"]), ["take"])
    return summarise(spark, folder, ["take", "state"], cut)


@command("calibrate", FOLDER, arg("spl", type=float), arg("--take"), arg("--method", default=""), help="derive and keep the offset to sound pressure level")
def calibrate(spark, folder, spl, take, method):
    fast = tables(spark, folder)["fast"]
    fast = fast.where(F.col("take") == take) if take else fast
    offset = indices.calibration_offset(fast.withColumn("level_db", F.col("fast_dba")), [], spl).first()["offset_db"]
    sessions.write_calibration(folder, round(offset, 1), method, take)
    return spark.createDataFrame([(take, float(offset))], "take string, offset_db double")


@command("capture", arg("inbox"), arg("out"), arg("--discard-audio", action="store_true"), help="features of recordings as they come into a folder")
def capture(spark, inbox, out, discard_audio):
    streams.capture(spark, inbox, out, f"{out}/_checkpoint", keep_audio=not discard_audio).awaitTermination()


@command("deposit", FOLDER, help="seconds as tab-separated text")
def deposit(spark, folder):
    rows = tables(spark, folder)["seconds"].withColumn("level_db", 10 * F.log10(F.col("rms") * F.col("rms") + 1e-12))
    fc = ecology.centres(log_edges().tolist())
    total = F.aggregate("logspec", F.lit(0.0), lambda s, x: s + x)
    sinks.take_tsv(rows, f"{folder}/deposit", ecology.band_sum(F.col("logspec"), fc, 0, 250), ecology.band_sum(F.col("logspec"), fc, 2000, 1e9), total)


@command("speechgate", FOLDER, arg("--limit", type=float, default=reports.SPEECH_LIMIT), help="recordings with little enough speech; reads speech.json shares")
def speechgate(spark, folder, limit):
    shares = sessions.read_json(f"{folder}/speech.json") or {}
    rows = spark.createDataFrame([(k, float(v)) for k, v in shares.items()], "name string, speech_fraction double")
    return reports.speech_gate(rows, limit=limit)


# ------------------------------------------------------------------ what is heard


@command("tones", FOLDER, help="tones that last, over the critical band around them")
def tones_(spark, folder):
    minutes = tables(spark, folder)["minutes"]
    return tones.prominent_tones(minutes, ["take"], "t", "minspec", frequencies(minutes))


@command("tonality", FOLDER, help="lines followed from minute to minute, gathered")
def tonality(spark, folder):
    minutes = tables(spark, folder)["minutes"]
    return tones.group_tracks(cycles.tonal_tracks(minutes, ["take"], "t", "minspec", frequencies(minutes)), ["take"])


@command("modspec", FOLDER, help="modulation at three scales")
def modspec(spark, folder):
    held = tables(spark, folder)
    power = held["fast"].withColumn("p", F.pow(10.0, F.col("fast_db") / 10))
    parts = [
        ("micro", tones.modulation_profile(held["envelope"], ["take"], "t", "env_hi", 0.02, 0.5, 20.0)),
        ("meso", tones.modulation_profile(power, ["take"], "t", "p", 0.125, 0.01, 0.5)),
        ("macro", tones.modulation_profile(held["seconds"].withColumn("p", F.col("rms") * F.col("rms")), ["take"], "t", "p", 1.0, 1e-4, 0.01)),
    ]
    found = [p.withColumn("scale", F.lit(name)) for name, p in parts]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _family(prefix: tuple[str, ...]):
    def run(spark, folder):
        held = tables(spark, folder)
        found = summary.source_keys(held["seconds"], held["envelope"], ["take"])
        return found.select("take", *[c for c in found.columns if c.startswith(prefix)])

    return run


for _name, _prefix in (("anthrophony", ("anthro",)), ("geophony", ("geo",)), ("mechanical", ("mech",))):
    command(_name, FOLDER, help=f"indices of {_name}")(_family(_prefix))


@command("birdnet", FOLDER, help="species, by a model that must be installed")
def birdnet(spark, folder):
    models.require("birdnetlib", "species detection")


@command("music", FOLDER, help="tempo and chroma, by a package that must be installed")
def music(spark, folder):
    models.require("librosa", "tempo and chroma")


@command("carillon", FOLDER, help="which bells were struck, by a package that must be installed")
def carillon(spark, folder):
    models.require("librosa", "bell inventories")


@command("iso", FOLDER, help="loudness and sharpness of picked segments, by a package that must be installed")
def iso(spark, folder):
    models.require("mosqito", "loudness and sharpness")


@command("objects", FOLDER, help="each clip of a folder as one sound object")
def objects_(spark, folder):
    envelope = tables(spark, folder)["envelope"]
    held = F.transform(F.sort_array(F.collect_list(F.struct("t", "env_hi"))), lambda s: s["env_hi"])
    spec = F.transform(F.sequence(F.lit(0), F.lit(95)), lambda b: F.lit(0.0))
    clips = envelope.groupBy("take").agg(held.alias("env")).withColumn("excess", spec)
    return objects.typed(clips, ["take"], "env", "excess", 0.02).drop("mass", "peak_share", "spread_oct", "flatness")


@command("draft", FOLDER, help="regimes and beds as a first draft of annotations")
def draft(spark, folder):
    fast = tables(spark, folder)["fast"]
    found = cycles.regimes(fast, ["take"], "t", "fast_db", 0.125).withColumn("seconds", F.col("b") - F.col("a"))
    held = cycles.beds(found, ["take"], "level_db", "seconds")
    rows = [r.asDict() for r in found.orderBy("take", "a").collect()]
    sessions.write_json(f"{folder}/annotations.draft.json", {"objects": [{"name": f"AUTO {r['level_db']:.0f} dBFS", "kind": "keynote", "spans": [[r["a"], r["b"]]], "_auto": True} for r in rows]})
    return held


@command("taxonomy", FOLDER, help="what annotated objects are, by upkeep and mass")
def taxonomy(spark, folder):
    held = sessions.read_json(f"{folder}/annotations.json") or {}
    rows = [
        (o.get("name"), o.get("label"), o.get("kind"), o.get("_level_dbfs"), o.get("facture"), o.get("mass"), bool(o.get("_auto")), [tuple(map(float, s)) for s in o.get("spans", [])], [float(e) for e in o.get("events", [])])
        for o in held.get("objects", [])
    ]
    shape = "name string, label string, kind string, level_dbfs double, facture string, mass string, auto boolean, spans array<struct<a:double,b:double>>, events array<double>"
    return annotations.census(annotations.map_objects(spark.createDataFrame(rows, shape)))


@command("rhythm", FOLDER, arg("--apart", type=float, default=0.5), help="strikes of an envelope, and their period")
def rhythm_(spark, folder, apart):
    envelope = tables(spark, folder)["envelope"]
    odf = rhythm.rise_function(envelope.withColumn("e", F.array("env_hi")), ["take"], "t", "e")
    strikes = cycles.pick_strikes(odf, ["take"], "t", "odf", apart_s=apart)
    return rhythm.best_period(strikes, ["take"], "t_s", step=0.01)


@command("timbre", FOLDER, help="events gathered by the spectrum of their seconds")
def timbre(spark, folder):
    held = tables(spark, folder)
    rows = numbered(held["fast"], "fast_db")
    found = events.detect(rows, ["take"], events.odd_frames(60.0, 0.125), 2).withColumn("sec", F.floor(F.col("ipk") * 0.125))
    spec = held["seconds"].select("take", F.floor("t").alias("sec"), "logspec")
    return cycles.cluster(found.join(spec, ["take", "sec"]), ["take"], "i0", "logspec")


@command("schedule", FOLDER, help="whether events keep to public clocks")
def schedule(spark, folder):
    rows = numbered(tables(spark, folder)["fast"], "fast_db")
    found = events.detect(rows, ["take"], events.odd_frames(60.0, 0.125), 2)
    return circular.match_periods(found.withColumn("t", F.col("ipk") * 0.125), ["take"], "t")


@command("spatial", FOLDER, help="how steady directions are, and what passes by")
def spatial(spark, folder):
    rows = series.number_rows(tables(spark, folder)["seconds"].where("az is not null"), ["take"], ["t"], "t", 3600.0)
    return circular.organisation(rows, ["take"], F.radians("az"), F.col("rms") * F.col("rms"))


@command("enf", FOLDER, arg("--nominal", type=float, default=50.0), arg("--step", type=float, default=300.0), arg("--window", type=float, default=60.0), help="the mains hum over a session")
def enf(spark, folder, nominal, step, window):
    takes = sessions.open_session(spark, folder)
    at = takes.select(F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("duration") - 1 - window) / step).cast("int")))).alias("k"), "start", "duration")
    at = at.where(F.col("duration") >= window + 1).select((F.col("start") + 1 + F.col("k") * step).alias("t0")).distinct()
    spans = sessions.spans(takes, at, window)
    rate = takes.select("samplerate", "channels").first()
    first = F.filter("samples", lambda x, i: F.pmod(i, F.lit(rate["channels"])) == 0)
    return tones.mains_track(spans.withColumn("x", first), ["t0"], "x", rate["samplerate"], nominal).orderBy("t0", "harmonic")


@command("escapement", FOLDER, arg("--k", type=float, default=3.0), help="how evenly a clock ticks")
def escapement(spark, folder, k):
    wav.register(spark)
    paths = sessions.files_in(folder)
    blocks = spark.read.format("wav").options(block_s=3600.0).load(",".join(paths))
    rate = blocks.select("samplerate", "channels").first()
    first = F.filter("samples", lambda x, i: F.pmod(i, F.lit(rate["channels"])) == 0)
    ticks = rhythm.tick_table(blocks.withColumn("x", first), ["path"], "x", rate["samplerate"], k)
    return rhythm.beat_stats(ticks, ["path"])


@command("entrain", FOLDER, arg("motion"), help="sound and a body's movement on one clock")
def entrain(spark, folder, motion):
    from echotide.operators import entrainment

    sound = tables(spark, folder)["fast"].select(F.lit(1).alias("one"), "t", F.col("fast_db").alias("level_db"))
    moved = sessions.motion(spark, motion)
    size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    clock = entrainment.common_clock(sound, moved.select(F.lit(1).alias("one"), "t", size.alias("qom")), ["one"], 0.125)
    return entrainment.correlation(clock, ["one"], "k", 0.125).drop("one")


@command("vision", FOLDER, arg("--fps", type=float, default=1.0), help="light and movement in a folder of images")
def vision_(spark, folder, fps):
    frames = vision.frames_of(spark, folder, fps).withColumn("video", F.lit(folder))
    return vision.summary(vision.frame_features(frames, ["video", "i"]), ["video"])


# ------------------------------------------------------------------ sound to listen to


@command("background", FOLDER, arg("out"), arg("--margin", type=float, default=12.0), help="recordings without what stands over their background")
def background(spark, folder, out, margin):
    wav.register(spark)
    blocks = spark.read.format("wav").options(block_s=1200.0, lead_s=10.0).load(",".join(sessions.files_in(folder)))
    made = render.background_blocks(blocks, margin_db=margin)

    def write(rows):
        for r in rows:
            x = np.asarray(r["samples"]).reshape(-1, r["channels"])
            files, where = sessions._files(f"{out}/{r['path'].rsplit('/', 1)[-1].removesuffix('.wav')}_{r['first']:012d}_background.wav")
            files.create_dir(where.rpartition("/")[0], recursive=True)
            with files.open_output_stream(where) as held:
                held.write(wav.encode(x, r["samplerate"], 24))

    made.foreachPartition(write)
    return spark.createDataFrame([(out,)], "out string")


@command("excerpt", FOLDER, arg("out"), arg("--seconds", type=int, default=60), help="the stretch most like the background, as it is")
def excerpt(spark, folder, out, seconds):
    found = render.characteristic_excerpt(second_levels(spark, folder), ["take"], size=seconds)
    best = found.orderBy("score").first()
    takes = sessions.open_session(spark, folder)
    own = takes.where(F.col("name") == best["take"])
    start = own.first()["start"] + best["t0"]
    return spark.createDataFrame([(sessions.export_segment(own, start, seconds, out), best["score"])], "path string, score double")


@command("loop", FOLDER, arg("out"), arg("--seconds", type=int, default=60), arg("--fade", type=float, default=1.0), help="a typical stretch that can be looped")
def loop(spark, folder, out, seconds, fade):
    best = render.loop_window(second_levels(spark, folder), ["take"], size=seconds).orderBy("score").first()
    own = sessions.open_session(spark, folder).where(F.col("name") == best["take"])
    x, fs = sessions.read_span(own, own.first()["start"] + best["t0"], seconds)
    files, where = sessions._files(out)
    with files.open_output_stream(where) as held:
        held.write(wav.encode(render.looped(x, fs, fade), fs, 24))
    return spark.createDataFrame([(out, best["score"])], "path string, score double")


@command("resynth", FOLDER, help="a recipe to build the soundscape from, and its page")
def resynth(spark, folder):
    held = tables(spark, folder)
    bands = [indices.band_levels(held["seconds"], [], p).withColumnRenamed("level_db", f"p{p:.0f}_db") for p in (10.0, 50.0)]
    octaves = [{**r.asDict(), "hz": OCTAVES[r["band"]]} for r in bands[0].join(bands[1], "band").orderBy("band").collect()]
    minutes = held["minutes"]
    lines = cycles.tonal_tracks(minutes, ["take"], "t", "minspec", frequencies(minutes))
    tracks = [{"hz": r["hz"], "rise_db": r["rise_db"]} for r in lines.orderBy(F.desc("rise_db"), "hz").limit(6).collect()]
    rows = summary.event_keys(held["fast"], ["take"]).agg(F.avg("events_per_min").alias("events_per_min")).first().asDict()
    wide = held["seconds"].agg(F.percentile("diffuse", 0.5).alias("diffuseness")).first().asDict()
    document = reports.recipe(octaves, tracks, rows, wide, folder.rstrip("/").rsplit("/", 1)[-1])
    sessions.write_json(f"{folder}/analysis/recipe.json", document)
    reports.recipe_page(document, f"{folder}/analysis/recipe.html")


# ------------------------------------------------------------------ several sessions


@command("catalog", arg("pattern"), arg("--out"), help="all summaries of a corpus as one table")
def catalog(spark, pattern, out):
    long = text.summaries(spark, pattern)
    names = [r["key"] for r in long.select("key").distinct().orderBy("key").collect()]
    wide = long.groupBy("session").pivot("key", names).agg(F.first("value"))
    if out:
        sinks.csv_table(wide, out)
    return wide


@command("longitudinal", arg("pattern"), help="trend and season of dated summaries")
def longitudinal(spark, pattern):
    from echotide.functions.scalars import date_in

    long = text.summaries(spark, pattern).withColumn("date", date_in(F.col("session")))
    return corpus.seasonal_summary(corpus.finite_series(long), ["key"], "date", "value")


@command("compare", arg("folders", nargs="+"), help="levels and spectra of sessions beside one another")
def compare(spark, folders):
    parts = [tables(spark, f)["fast"].withColumn("session", F.lit(f)).withColumn("level_db", F.col("fast_dba")) for f in folders]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return levels.energy_summary(rows, ["session"])


@command("network", FOLDER, arg("--window", type=int, default=960), arg("--lag", type=int, default=32), help="coupling of recorders under a folder, parted by node")
def network_(spark, folder, window, lag):
    rows = sessions.load_nodes(spark, folder)
    return network.pairwise(network.grid(rows, "node", "t", "fast_dba", 0.125), "node", window, lag)


@command("array", arg("recording"), arg("geometry"), help="bearings of a line of microphones")
def array(spark, recording, geometry):
    wav.register(spark)
    held = sessions.load_geometry(geometry)
    blocks = spark.read.format("wav").options(block_s=60.0).load(recording)
    apart = float(max(np.hypot(*(a - b)) for a in held["pos"] for b in held["pos"]))
    return bearings.array_bearing(rooms.block_delays(blocks, most_s=apart / held["c"] * 1.05), ["path", "t"], held).orderBy("t")


@command("doavalidate", FOLDER, arg("annotations"), help="directions of clips against their labels")
def doavalidate(spark, folder, annotations):
    wav.register(spark)
    parts = []
    for path in sessions.files_in(folder):
        stem = path.rsplit("/", 1)[-1].removesuffix(".wav")
        csv = f"{annotations.rstrip('/')}/{stem}.csv"
        if sessions._files(csv)[0].get_file_info(sessions._files(csv)[1]).type.name == "NotFound":
            print(f"no labels for {stem}", file=sys.stderr)
            continue
        blocks = spark.read.format("wav").options(block_s=60.0, lead_s=0.5).load(path)
        found = bearings.frame_directions(blocks)
        parts.append(bearings.validate(text.annotations(spark, csv).withColumn("path", F.lit(path)), found, ["path"]))
    if not parts:
        raise FileNotFoundError(f"no labelled clips in {folder}")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return bearings.error_stats(rows, ["path"], "error_deg")


@command("survey", arg("responses"), help="a questionnaire as points, mean and ellipse")
def survey(spark, responses):
    rows = text.responses(spark, responses)
    low, high = (1.0, 5.0) if corpus.detect_scale(rows) == "1-5" else (0.0, 100.0)
    return corpus.survey_summary(corpus.coordinates(rows, low, high).withColumn("survey", F.lit(responses)), ["survey"])


@command("timescales", help="what each descriptor needs, and what may be concluded from it")
def timescales(spark):
    return corpus.registry(spark.range(1))


# ------------------------------------------------------------------ rooms


@command("sweep", arg("out"), arg("--seconds", type=float, default=10.0), arg("--rate", type=int, default=48000), help="a sine sweep, its inverse and what made them")
def sweep(spark, out, seconds, rate):
    rooms.write_sweep(out, seconds, fs=rate)


@command("impulse", arg("recording"), arg("params"), help="the response in a recorded sweep")
def impulse(spark, recording, params):
    x, fs = sessions.read_span(sessions.open_recording(spark, recording), 0.0, 1e9)
    found = rooms.measure(x, rooms.inverse_of(sessions.read_json(params)), fs)
    ir = found.pop("ir")
    files, where = sessions._files(f"{recording.removesuffix('.wav')}_ir.wav")
    with files.open_output_stream(where) as held:
        held.write(wav.encode(ir * (0.5 / max(np.abs(ir).max(), 1e-12)), fs, 32, floating=True))
    sessions.write_json(f"{recording.removesuffix('.wav')}_impulse.json", json.loads(json.dumps(found, default=float)))
    return spark.createDataFrame([(float(c), v["t60_s"], v["edt_s"], v["c80_db"]) for c, v in found["bands"].items()], "hz double, t60_s double, edt_s double, c80_db double")


@command("auralize", arg("dry"), arg("ir"), arg("out"), help="a dry recording in a measured room")
def auralize(spark, dry, ir, out):
    x, fs = sessions.read_span(sessions.open_recording(spark, dry), 0.0, 1e9)
    h, fs_ir = sessions.read_span(sessions.open_recording(spark, ir), 0.0, 1e9)
    wet, gain = rooms.auralize(x, fs, h, fs_ir)
    files, where = sessions._files(out)
    with files.open_output_stream(where) as held:
        held.write(wav.encode(wet, fs, 24))
    return spark.createDataFrame([(out, gain)], "path string, gain_db double")


@command("sources", FOLDER, help="median spectra of a session's seconds")
def sources(spark, folder):
    rows = tables(spark, folder)["seconds"].withColumn("state", F.lit(None).cast("string"))
    return spectral.ltas_by_state(rows, ["take"], "logspec", "state")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="echotide", description=__doc__.splitlines()[0])
    commands = out.add_subparsers(dest="command", required=True)
    for name, (_, arguments, said) in sorted(COMMANDS.items()):
        one = commands.add_parser(name, help=said)
        for names, more in arguments:
            one.add_argument(*names, **more)
        one.add_argument("--parquet", help="a folder to write the table to, instead of showing it")
    return out


def main(argv: list[str] | None = None) -> int:
    given = vars(parser().parse_args(argv))
    run, parquet = COMMANDS[given.pop("command")][0], given.pop("parquet")
    spark = SparkSession.builder.appName("echotide").getOrCreate()
    found = run(spark, **given)
    if found is not None and parquet:
        found.write.mode("overwrite").parquet(parquet)
    elif found is not None:
        found.show(200, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
