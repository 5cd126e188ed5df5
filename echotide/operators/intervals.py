"""Intervals and nearest-in-time joins without nested loops.

An interval is cut into the buckets of time that it touches, so overlaps are
found by an equi-join on the bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _buckets(a: Column, b: Column, width: float) -> Column:
    """Buckets that [a, b) touches."""
    last = F.greatest(F.floor(a / width), F.ceil(b / width) - 1)
    return F.explode(F.sequence(F.floor(a / width), last))


def inside(df: DataFrame, spans: DataFrame, keys: list[str], t: str, width: float = 86400.0, anti: bool = False) -> DataFrame:
    """Rows whose time lies in a span [a, b) of their key, or with ``anti`` in none."""
    cut = spans.where("a < b").select(*keys, F.col("a").alias("_a"), F.col("b").alias("_z"), _buckets(F.col("a"), F.col("b"), width).alias("_b"))
    rows = df.withColumn("_b", F.floor(F.col(t) / width))
    on = [rows[k] == cut[k] for k in (*keys, "_b")] + [rows[t] >= cut["_a"], rows[t] < cut["_z"]]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return rows.join(cut, condition, "left_anti" if anti else "left_semi").drop("_b")


def labelled(df: DataFrame, spans: DataFrame, keys: list[str], t: str, label: str, width: float = 86400.0, least: float = 0.0) -> DataFrame:
    """Rows with the label of each span [a, b) of their key that holds them, spans of ``least`` length at least; rows that
    none holds are left out."""
    cut = spans.where((F.col("a") < F.col("b")) & (F.col("b") - F.col("a") >= least))
    cut = cut.select(*keys, F.col(label), F.col("a").alias("_a"), F.col("b").alias("_z"), _buckets(F.col("a"), F.col("b"), width).alias("_b"))
    rows = df.withColumn("_b", F.floor(F.col(t) / width)).join(cut, [*keys, "_b"])
    return rows.where((F.col(t) >= F.col("_a")) & (F.col(t) < F.col("_z"))).drop("_b", "_a", "_z")


def overlap_shares(spans: DataFrame, others: DataFrame, keys: list[str], label: str, width: float = 86400.0) -> DataFrame:
    """Per key and label, the length of the overlaps of ``spans`` with ``others``, and its share of the spans' length."""
    lengths = spans.groupBy(*keys).agg(F.sum(F.col("b") - F.col("a")).alias("total"))
    left = spans.select(*keys, F.col("a").alias("a1"), F.col("b").alias("b1"), _buckets(F.col("a"), F.col("b"), width).alias("_b"))
    right = others.select(label, F.col("a").alias("a2"), F.col("b").alias("b2"), _buckets(F.col("a"), F.col("b"), width).alias("_b"))
    start, end = F.greatest("a1", "a2", F.col("_b") * width), F.least("b1", "b2", (F.col("_b") + 1) * width)
    both = left.join(right, "_b").where(end > start).groupBy(*keys, label).agg(F.sum(end - start).alias("overlap_s"))
    return both.join(lengths, keys).select(*keys, label, "overlap_s", F.when(F.col("total") > 0, F.col("overlap_s") / F.col("total")).alias("share"))


def lanes(df: DataFrame, label: str, a: str, b: str, min_share: float = 0.005) -> DataFrame:
    """Labels by total length; those under ``min_share`` of all are pooled as ``other``."""
    sums = df.groupBy(label).agg(F.sum(F.col(b) - F.col(a)).alias("seconds"))
    total = sums.agg(F.sum("seconds").alias("_t"))
    lane = F.when(F.col("seconds") >= min_share * F.col("_t"), F.col(label)).otherwise("other")
    return sums.crossJoin(F.broadcast(total)).groupBy(lane.alias("lane")).agg(F.sum("seconds").alias("seconds"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], t: str, value: str, width: float = 3600.0) -> DataFrame:
    """Rows of ``left`` with ``matched_t`` and ``matched``: the last row of ``right`` at or before theirs (null: none).

    Both sides are dealt out in buckets of ``width``; what a bucket lacks comes from the last of an earlier one.
    """
    side = right.select(*keys, F.col(t).alias("_t"), F.struct(F.col(t).alias("t"), F.col(value).alias("v")).alias("_r"), F.lit(0).alias("_k"))
    main = left.withColumns({"_t": F.col(t), "_k": F.lit(1)})
    both = main.unionByName(side, allowMissingColumns=True).withColumn("_b", F.floor(F.col("_t") / width))
    lasts = both.groupBy(*keys, "_b").agg(F.max("_r").alias("_l"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*keys, "_b", F.last("_l", True).over(before).alias("_o"))
    within = Window.partitionBy(*keys, "_b").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("_w", F.last("_r", True).over(within)).where("_k = 1").join(carried, [*keys, "_b"], "left")
    found = F.coalesce("_w", "_o")
    return rows.withColumns({"matched_t": found["t"], "matched": found["v"]}).select(*left.columns, "matched_t", "matched")
