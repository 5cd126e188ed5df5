"""The standard tables as series, vectors, dated values and intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import db
from . import series
from .store import written


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) / 1e6


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as level series: node, user_id, event_id, t, p, level_db."""
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("node"),
        "user_id",
        "event_id",
        "ts",
        seconds(F.col("ts")).alias("t"),
        F.col("value").alias("p"),
        db(F.col("value")).alias("level_db"),
    )


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`levels` with each row's number ``i`` in its node's series of ``n`` rows; written, as plans read it more than once."""
    return written(series.number_rows(levels(spark, sf_dir), ["node"], ["t", "event_id"], "t", 86400.0), "series")


def hour_angle(t: Column) -> Column:
    """Time of day as an angle, 0 to 2 pi."""
    return 2 * math.pi * F.pmod(t, F.lit(86400.0)) / 86400.0


def azimuth(t: Column) -> Column:
    """Time of day as degrees, -180 to 180."""
    return 360 * F.pmod(t, F.lit(86400.0)) / 86400.0 - 180


#: Edges of the 64 bands that the standard vectors stand for.
EDGES = [50.0 * 10 ** (2.4 * k / 64) for k in range(65)]


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as power spectra: label, i, n, spec, energy.  Row numbers follow vec_id."""
    rows = read(spark, sf_dir, "embeddings").select(
        "label",
        "vec_id",
        F.transform("embedding", lambda x: x.cast("double") * x.cast("double")).alias("spec"),
    )
    rows = rows.withColumn("energy", F.aggregate("spec", F.lit(0.0), lambda a, x: a + x))
    return series.number_rows(rows, ["label"], ["vec_id"], "vec_id", 100_000.0)


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as daily means: priority, day, price, n."""
    orders = read(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    return orders.groupBy(F.col("o_orderpriority").alias("priority"), day.alias("day")).agg(
        F.round(F.avg("o_totalprice"), 4).alias("price"), F.count("*").alias("orders")
    )


def shipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order the interval from its date to its last shipment, in seconds, where that is after it."""
    last = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    orders = read(spark, sf_dir, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"))
    rows = orders.select(
        "o_orderkey", "o_custkey", F.col("o_orderpriority").alias("priority"), seconds(F.col("o_orderdate")).alias("a"), seconds(F.col("last")).alias("b")
    )
    return rows.where("b > a")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, as a session, a few summary values of its events."""
    return read(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("events"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("top_value")
    )
