"""Tables from logs, annotations and surveys in text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import SCALES

#: The names under which a respondent's id is found, the first that is there.
RESPONDENT = ["respondent", "participant", "id", "subject"]


def activities(spark: SparkSession, path: str) -> DataFrame:
    """A log ``Class;Start time;Stop time`` as (class, start, stop, a, b), a and b in seconds of the first row's day."""
    rows = spark.read.csv(path, sep=";", header=True)
    names = {c: c.strip().lower().replace(" ", "_") for c in rows.columns}
    rows = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    time = lambda c: F.coalesce(
        F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")), F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd HH:mm:ss"))
    )
    rows = rows.select("class", time("start_time").alias("start"), time("stop_time").alias("stop"))
    first = rows.agg(F.to_date(F.min("start")).cast("timestamp").alias("_day"))
    out = rows.crossJoin(F.broadcast(first))
    since = lambda c: F.col(c).cast("double") - F.col("_day").cast("double")
    return out.withColumns({"a": since("start"), "b": since("stop")}).drop("_day")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Frames with a class, a source and a direction; five columns, or six with a distance.  Other rows are an error."""
    schema = "frame int, class int, source int, azimuth double, elevation double, distance_cm double, extra string"
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split(F.trim("value"), r"\s*,\s*")
    number = lambda k, t: F.get(parts, F.lit(k)).try_cast(t)
    kinds = [c.split() for c in schema.split(", ")[:6]]
    out = lines.select(F.size(parts).alias("_n"), "value", *[number(k, t).alias(n) for k, (n, t) in enumerate(kinds)])
    bad = ~F.col("_n").isin(5, 6)
    for name, _ in kinds[:5]:
        bad = bad | F.col(name).isNull()
    bad = bad | ((F.col("_n") == 6) & F.col("distance_cm").isNull())
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not an annotation: "), "value")).cast("int")).otherwise(F.col("frame"))
    return out.withColumn("frame", checked).select(*[n for n, _ in kinds])


def responses(spark: SparkSession, path: str) -> DataFrame:
    """A questionnaire as (respondent, the eight scales, extras); rows with a scale that is no number are left out."""
    rows = spark.read.csv(path, header=True)
    rows = rows.toDF(*[c.strip().lower() for c in rows.columns])
    missing = [s for s in SCALES if s not in rows.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    known = next((c for c in RESPONDENT if c in rows.columns), None)
    extras = [c for c in rows.columns if c not in SCALES and c != known]
    pairs = [x for c in extras for x in (F.lit(c), F.col(f"`{c}`"))]
    kept = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    scales = [F.col(s).try_cast("double").alias(s) for s in SCALES]
    name = F.col(f"`{known}`") if known else F.lit(None).cast("string")
    return rows.select(name.alias("respondent"), *scales, kept.alias("extras")).dropna(subset=SCALES)


def summaries(spark: SparkSession, paths: str) -> DataFrame:
    """``<session>/analysis/summary.json`` files as (session, key, value); files that are no JSON are left out."""
    raw = spark.read.text(paths, wholetext=True).withColumn("path", F.input_file_name())
    held = F.from_json("value", "map<string,string>")
    rows = raw.select(F.element_at(F.split("path", "/"), -3).alias("session"), held.alias("m")).where("m is not null")
    return rows.select("session", F.explode("m").alias("key", "text")).select("session", "key", F.col("text").try_cast("double").alias("value"))
