"""Annotated sounds: keynotes, objects and activities, as rows.

An annotation is a row (id, name, label, kind, level_dbfs, facture, mass, auto, spans, events): spans are arrays of
(a, b) in seconds, events arrays of seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import quantile
from .cycles import beds

#: The kinds of upkeep and of mass that a typed object can have.
FACTURES = ["impulse", "iteration", "sustained", "unlimited"]
MASSES = ["tonic", "tonic-complex", "complex", "noise"]
#: Seconds that a sound object lasts.
OBJECT_S = (0.2, 8.0)
OTHER = "other"


def duration_text(seconds: Column) -> Column:
    """Hours, or minutes under one hour."""
    return F.when(seconds >= 3600, F.format_string("%.1f h", seconds / 3600)).otherwise(F.format_string("%.0f min", seconds / 60))


def is_auto(auto: Column, label: Column, name: Column) -> Column:
    """Whether a machine drafted it."""
    return F.coalesce(auto, F.lit(False)) | F.coalesce(label.startswith("AUTO"), F.lit(False)) | F.coalesce(name.startswith("steady state "), F.lit(False))


def _told(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(-\d+(?:\.\d+)?)\s*dBFS", 1).try_cast("double")


def level_of(level: Column, name: Column, label: Column) -> Column:
    """The level given, else that in the name, else that in the label; null if there is none."""
    return F.coalesce(level, _told(name), _told(label))


def bed_middle(level: Column, name: Column, label: Column) -> Column:
    """The middle of ``lo to hi dBFS`` in the name, else the level."""
    pattern = r"(-?\d+(?:\.\d+)?) to (-?\d+(?:\.\d+)?)\s*dBFS"
    lo, hi = (F.regexp_extract(F.coalesce(name, F.lit("")), pattern, k).try_cast("double") for k in (1, 2))
    return F.coalesce((lo + hi) / 2, level_of(level, name, label))


def bed_title(lo: Column, hi: Column, spans: Column) -> Column:
    """What a bed of background is called: its loudness, its range and its number of spans."""
    middle = (lo + hi) / 2
    kind = F.when(middle <= -50, "quiet bed").when(middle <= -38, "moderate bed").otherwise("loud bed")
    a, b = F.bround(lo).cast("int"), F.bround(hi).cast("int")
    reach = F.when(a == b, F.format_string("%d dBFS", a)).otherwise(F.format_string("%d to %d dBFS", a, b))
    return F.concat(kind, F.lit(", "), reach, F.format_string(", %d span", spans.cast("int")), F.when(spans != 1, "s").otherwise(""))


def merge_beds(objects: DataFrame, keys: list[str], most: int = 8, width_db: float = 6.0) -> DataFrame:
    """Drafted keynotes gathered to beds by level (keys..., name, spans, seconds), if there are more than ``most`` of them;
    fewer stay as they are."""
    told = objects.withColumn("_lv", level_of(F.col("level_dbfs"), F.col("name"), F.col("label")))
    auto = is_auto(F.col("auto"), F.col("label"), F.col("name"))
    mine = told.where((F.col("kind") == "keynote") & auto & (F.size("spans") > 0) & F.col("_lv").isNotNull())
    mine = mine.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    length = F.aggregate("spans", F.lit(0.0), lambda s, x: s + x["b"] - x["a"])
    rows = mine.withColumns({"_s": length, "_c": F.size("spans")})
    few = rows.where(F.col("_n") <= most).select(*keys, "name", F.col("_c").cast("bigint").alias("spans"), F.col("_s").alias("seconds"))
    many = beds(rows.where(F.col("_n") > most), keys, "_lv", "_s", width_db, most)
    spans = rows.select(*keys, "_lv", "_c").join(many.select(*keys, "lo", "hi", F.col("name").alias("_b"), "seconds"), keys)
    # a bed takes the levels from its lowest to its highest; the pooled ones are what no other takes
    inside = spans.where((F.col("_b") != "rest") & F.col("_lv").between(F.col("lo"), F.col("hi")))
    named = inside.groupBy(*keys, "lo", "hi", "seconds").agg(F.sum("_c").alias("spans"))
    named = named.select(*keys, bed_title(F.col("lo"), F.col("hi"), F.col("spans")).alias("name"), "spans", "seconds")
    every = rows.where(F.col("_n") > most).groupBy(*keys).agg(F.sum("_c").alias("_all"))
    taken = named.groupBy(*keys).agg(F.sum("spans").alias("_t"))
    pooled = many.where("name = 'rest'").join(every, keys).join(taken, keys, "left")
    left = F.col("_all") - F.coalesce("_t", F.lit(0))
    pooled = pooled.select(*keys, F.format_string("other beds (%d spans)", left).alias("name"), left.alias("spans"), "seconds")
    return few.unionByName(named).unionByName(pooled)


def is_object(spans: Column, events: Column, most_s: float = OBJECT_S[1]) -> Column:
    """Whether an annotation is itself a sound object: its longest span is short, or it has events."""
    longest = F.array_max(F.transform(spans, lambda s: s["b"] - s["a"]))
    return F.when(F.size(F.coalesce(spans, F.array().cast("array<struct<a:double,b:double>>"))) > 0, longest <= most_s).otherwise(
        F.coalesce(F.size(events) > 0, F.lit(False))
    )


def expand_events(objects: DataFrame) -> DataFrame:
    """A row for each event, without spans; rows without events stay."""
    some = F.coalesce(F.size("events") > 0, F.lit(False))
    parts = F.when(some, F.transform("events", lambda e: F.array(e))).otherwise(F.array(F.col("events")))
    rows = objects.withColumn("_e", F.explode(parts))
    none = F.array().cast(objects.schema["spans"].dataType)
    return rows.withColumns({"spans": F.when(some, none).otherwise(F.col("spans")), "events": F.col("_e")}).drop("_e")


def map_objects(hand: DataFrame, detected: DataFrame | None = None, least_s: float = OBJECT_S[0], most_s: float = OBJECT_S[1]) -> DataFrame:
    """All sound objects on one map: typed annotations of that scale, a row for each event, and detected ones of a length
    within the window.  The column ``status`` says what became of each row: object, short, long, regime or untyped."""
    auto = is_auto(F.col("auto"), F.col("label"), F.col("name"))
    typed = F.coalesce(F.col("facture").isin(FACTURES) & F.col("mass").isin(MASSES), F.lit(False))
    small = is_object(F.col("spans"), F.col("events"), most_s)
    status = F.when(auto | ~F.coalesce(small, F.lit(False)), "regime").when(~typed, "untyped").otherwise("object")
    told = hand.withColumn("status", status)
    rows = expand_events(told.where("status = 'object'")).unionByName(told.where("status <> 'object'"))
    rows = rows.select("name", "facture", "mass", "level_dbfs", "status", F.lit("hand").alias("source"))
    if detected is None:
        return rows
    seconds = F.col("seconds")
    known = F.coalesce(F.col("facture").isin(FACTURES) & F.col("mass").isin(MASSES), F.lit(False))
    status = F.when(seconds < least_s, "short").when(seconds > most_s, "long").when(~known, "untyped").otherwise("object")
    found = detected.select("name", "facture", "mass", "level_dbfs", status.alias("status"), F.lit("detected").alias("source"))
    return rows.unionByName(found)


def census(mapped: DataFrame) -> DataFrame:
    """Rows of a map by source and status."""
    return mapped.groupBy("source", "status").count()


def drawn(mapped: DataFrame, most: int, seed: int = 11) -> DataFrame:
    """At most about ``most`` objects to draw, from each cell of the map its share, at least one; all if there are fewer.

    A figure's own sample: counts come from the whole map.
    """
    cell = Window.partitionBy("facture", "mass")
    rows = mapped.withColumns({"_n": F.count("*").over(cell), "_all": F.count("*").over(Window.partitionBy(F.lit(1)))})
    rows = rows.withColumn("_r", F.row_number().over(cell.orderBy(F.xxhash64("name", "level_dbfs", F.lit(seed)), "name")))
    share = F.greatest(F.lit(1), F.rint(F.col("_n") * most / F.col("_all")))
    return rows.where((F.col("_all") <= most) | (F.col("_r") <= share)).drop("_n", "_all", "_r")


def opacity(mapped: DataFrame) -> DataFrame:
    """Adds ``alpha``: louder objects are drawn more strongly, from the 5th to the 95th percentile of levels; 0.85 for all
    if there are under two levels or they hardly differ, 0.5 for one without."""
    ends = mapped.agg(quantile(F.col("level_dbfs"), 0.05).alias("_lo"), quantile(F.col("level_dbfs"), 0.95).alias("_hi"), F.count("level_dbfs").alias("_n"))
    part = F.least(F.greatest((F.col("level_dbfs") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")), F.lit(0.0)), F.lit(1.0))
    alike = (F.col("_n") < 2) | (F.col("_hi") - F.col("_lo") < 1)
    alpha = F.when(alike, 0.85).when(F.col("level_dbfs").isNull(), 0.5).otherwise(0.18 + 0.72 * part)
    return mapped.join(F.broadcast(ends)).withColumn("alpha", alpha).drop("_lo", "_hi", "_n")


def point_label(name: Column, label: Column, in_cell: Column, placed: Column, most: int = 40) -> Column:
    """The text beside a point: none where there are many and it is not alone; drafted labels give way to the name."""
    text = F.when(F.coalesce(label, name).startswith("AUTO"), name).otherwise(F.coalesce(label, name))
    return F.when((placed > most) & (in_cell > 1), None).otherwise(text)


def suffix(shares: DataFrame, keys: list[str], label: str, most: int = 3, least: float = 0.05) -> DataFrame:
    """Per object what went on meanwhile, as text: the ``most`` largest shares of ``least`` at least; empty if none."""
    order = Window.partitionBy(*keys).orderBy(F.desc("share"), label)
    told = shares.withColumn("_r", F.row_number().over(order))
    said = F.when((F.col("_r") <= most) & (F.col("share") >= least), F.struct("_r", F.format_string("%s %.0f%%", F.col(label), F.bround(100 * F.col("share"))).alias("s")))
    listed = F.transform(F.sort_array(F.collect_list(said)), lambda x: x["s"])
    text = F.concat(F.lit(" — during: "), F.array_join("_l", ", "))
    return told.groupBy(*keys).agg(listed.alias("_l")).select(*keys, F.when(F.size("_l") > 0, text).otherwise("").alias("suffix"))


def dominant(objects: DataFrame, activities: DataFrame, keys: list[str], label: str, width: float = 3600.0) -> DataFrame:
    """Per object the activity that takes most of its spans; of one without spans, that which holds its first event that
    any does.  Objects are (keys..., spans, events), activities (label, a, b).
    """
    from .intervals import overlap_shares

    spans = objects.select(*keys, F.explode("spans").alias("s")).select(*keys, "s.a", "s.b")
    first = Window.partitionBy(*keys).orderBy(F.desc("share"), label)
    by_span = overlap_shares(spans, activities, keys, label, width).withColumn("_r", F.row_number().over(first)).where("_r = 1")
    lone = objects.where(F.coalesce(F.size("spans") <= 0, F.lit(True))).select(*keys, F.posexplode("events").alias("k", "t"))
    cells = activities.withColumn("_b", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor(F.col("b") / width))))
    met = lone.withColumn("_b", F.floor(F.col("t") / width)).join(cells, "_b").where("t BETWEEN a AND b")
    by_event = met.groupBy(*keys).agg(F.min(F.struct("k", "a", label)).alias("m")).select(*keys, F.col(f"m.{label}").alias(label))
    return by_span.select(*keys, label).unionByName(by_event)


def span_levels(df: DataFrame, spans: DataFrame, keys: list[str], t: str = "t", x: str = "level_db", width: float = 3600.0) -> DataFrame:
    """Per span (keys..., a, b) the median level inside [a, b); null if no row is."""
    cells = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor(F.col("b") / width))))
    rows = df.select(*keys, F.col(t).alias("_t"), F.col(x).alias("_x"), F.floor(F.col(t) / width).alias("_b"))
    met = cells.join(rows, [*keys, "_b"]).where("_t >= a AND _t < b")
    found = met.groupBy(*keys, "a", "b").agg(quantile(F.col("_x"), 0.5).alias("level_db"))
    return spans.select(*keys, "a", "b").distinct().join(found, [*keys, "a", "b"], "left")


def level_context(df: DataFrame, keys: list[str], x: str = "level_db", least_db: float = 6.0) -> DataFrame:
    """Per series the median level and the range about it (5th to 99th percentile, ``least_db`` wide at least) that colours span."""
    held = df.groupBy(*keys).agg(*[quantile(F.col(x), p).alias(n) for p, n in ((0.5, "median_db"), (0.05, "_lo"), (0.99, "_hi"))])
    low, high = F.col("_lo") - F.col("median_db"), F.col("_hi") - F.col("median_db")
    return held.select(*keys, "median_db", low.alias("low_db"), F.greatest(high, low + least_db).alias("high_db"))


def mass_hint(df: DataFrame, spans: DataFrame, keys: list[str], t: str = "t", width: float = 3600.0) -> DataFrame:
    """A first guess of an object's mass from the median flatness inside its span: tonic under 0.05, tonic-complex under 0.2,
    complex under 0.5, else noise."""
    found = span_levels(df.withColumn("_f", F.col("flatness")), spans, keys, t, "_f", width)
    f = F.col("level_db")
    kind = F.when(f < 0.05, "tonic").when(f < 0.2, "tonic-complex").when(f < 0.5, "complex").when(f.isNotNull(), "noise")
    return found.select(*keys, "a", "b", f.alias("flatness"), kind.alias("mass"))


def letters(k: Column, longest: int = 4) -> Column:
    """A, B, ... Z, AA, AB, ... for 0, 1, ...: the label of the k-th regime."""
    place = F.sequence(F.lit(0), F.lit(longest - 1))

    def digit(p: Column) -> Column:
        below = ((F.pow(F.lit(26.0), p + 1) - 26) / 25).cast("bigint")
        left = k - below
        return F.when(left >= 0, F.char((F.pmod(F.floor(left / F.pow(F.lit(26.0), p)), F.lit(26)) + 65).cast("int"))).otherwise("")

    return F.reverse(F.array_join(F.transform(place, digit), ""))
