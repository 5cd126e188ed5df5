"""Ordered series dealt out in blocks, so that no task holds a whole one.

A series is the rows of one value of ``keys`` in the order of ``i`` = 1, 2, ....
Blocks of ``block`` rows are the unit of work: frames take a halo of rows from
the neighbouring blocks, and running sums or last values are first taken in each
block, then over the blocks' results, one row each.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192


def _on(keys: list[str], left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    return left.join(right, keys, how)


def number_rows(df: DataFrame, keys: list[str], order: list[str], t: str, bucket: float) -> DataFrame:
    """Adds ``i`` (from 1) and ``n`` (rows of the series).

    Rows are numbered within buckets of ``bucket`` units of ``t``, which must not
    contradict ``order``, and offset by the counts of earlier buckets.
    """
    dealt = df.withColumn("_b", F.floor(F.col(t) / bucket))
    counts = dealt.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    series = Window.partitionBy(*keys).orderBy("_b")
    offsets = counts.select(
        *keys,
        "_b",
        F.coalesce(F.sum("_c").over(series.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"),
        F.sum("_c").over(Window.partitionBy(*keys)).alias("n"),
    )
    within = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))
    numbered = dealt.withColumn("_w", within)
    return _on([*keys, "_b"], numbered, offsets).withColumn("i", (F.col("_o") + F.col("_w")).cast("bigint")).drop("_b", "_w", "_o")


def number_evenly(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """:func:`number_rows` by any numeric ``order``: each series' span is dealt into a bucket for every ``BLOCK`` of its rows.

    Reads ``df`` three times.
    """
    at = F.col(order).cast("double")
    spans = df.groupBy(*keys).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"), F.ceil(F.count("*") / BLOCK).alias("_parts"))
    place = F.when(F.col("_hi") > F.col("_lo"), (at - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_parts"))
    # as Spark sorts: null before all, not a number after all
    dealt = F.when(at.isNull(), -1.0).when(F.isnan(place), F.col("_parts") + 1.0).otherwise(F.coalesce(place, F.lit(0.0)))
    placed = _on(keys, df, spans).withColumn("_at", dealt).drop("_lo", "_hi", "_parts")
    return number_rows(placed, keys, [order], "_at", 1.0).drop("_at")


def framed(
    df: DataFrame, keys: list[str], left: int, right: int, exprs: dict[str, Callable[[Window], Column]], block: int = BLOCK
) -> DataFrame:
    """Adds columns over the rows i-left to i+right; each is made from its window.  Needs ``i`` and ``n``.

    A frame may lie beside its row (``right`` or ``left`` under 0); the row still goes to its own block.
    """
    block = max(block, left + right)
    at = F.col("i") - 1
    lowest = F.floor(F.greatest(at - max(right, 0), F.lit(0)) / block)
    highest = F.floor(F.least(at + max(left, 0), F.col("n") - 1) / block)
    dealt = df.withColumn("_blk", F.explode(F.sequence(lowest, highest)))
    window = Window.partitionBy(*keys, "_blk").orderBy("i").rowsBetween(-left, right)
    out = dealt.withColumns({name: make(window) for name, make in exprs.items()})
    return out.where(F.col("_blk") == F.floor(at / block)).drop("_blk")


def previous(df: DataFrame, keys: list[str], columns: dict[str, str], block: int = BLOCK) -> DataFrame:
    """Adds, under the names given, the columns of the row before (null in the first row)."""
    at = F.col("i") - 1
    own, following = F.floor(at / block), F.floor(F.col("i") / block)
    targets = F.when((own != following) & (F.col("i") < F.col("n")), F.array(own, following)).otherwise(F.array(own))
    dealt = df.withColumn("_blk", F.explode(targets))
    window = Window.partitionBy(*keys, "_blk").orderBy("i")
    out = dealt.withColumns({name: F.lag(c).over(window) for name, c in columns.items()})
    return out.where(F.col("_blk") == own).drop("_blk")


def running_sum(df: DataFrame, keys: list[str], value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to this one."""
    dealt = df.withColumn("_blk", F.floor((F.col("i") - 1) / block)).withColumn("_v", value)
    sums = dealt.groupBy(*keys, "_blk").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_blk", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    within = Window.partitionBy(*keys, "_blk").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumn("_w", F.sum("_v").over(within))
    return _on([*keys, "_blk"], out, offsets).withColumn(name, F.col("_o") + F.col("_w")).drop("_blk", "_v", "_w", "_o")


def last_value(df: DataFrame, keys: list[str], value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Adds the last non-null ``value`` up to this row."""
    dealt = df.withColumn("_blk", F.floor((F.col("i") - 1) / block)).withColumn("_v", value)
    lasts = dealt.groupBy(*keys, "_blk").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("i"))).alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*keys, "_blk", F.last("_s", True).over(before).alias("_o"))
    within = Window.partitionBy(*keys, "_blk").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumn("_w", F.last("_v", True).over(within))
    return _on([*keys, "_blk"], out, carried).withColumn(name, F.coalesce("_w", "_o")).drop("_blk", "_v", "_w", "_o")


def runs(df: DataFrame, keys: list[str], state: str, block: int = BLOCK) -> DataFrame:
    """Adds ``run``: 1, 2, ... for each stretch of rows with equal ``state``."""
    changed = previous(df, keys, {"_p": state}, block)
    new = F.when((F.col("i") == 1) | ~F.col(state).eqNullSafe(F.col("_p")), 1).otherwise(0)
    return running_sum(changed, keys, new, "run", block).drop("_p")


def blocks(df: DataFrame, keys: list[str], left: int, right: int, kernel: Callable[[pa.Table, np.ndarray, int], pa.Table], schema: str, block: int = BLOCK) -> DataFrame:
    """What ``kernel`` makes of each block: its rows in order with up to ``left`` and ``right`` neighbours, which of them
    are its own, and the number of the block.  Needs ``i`` and ``n``; one exchange."""
    block = max(block, left + right)
    at = F.col("i") - 1
    lowest = F.floor(F.greatest(at - right, F.lit(0)) / block)
    highest = F.floor(F.least(at + left, F.col("n") - 1) / block)
    dealt = df.withColumn("_blk", F.explode(F.sequence(lowest, highest)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        number = table.column("_blk")[0].as_py()
        own = (table.column("i").to_numpy() - 1) // block == number
        return kernel(table.drop_columns(["_blk"]), own, number)

    return dealt.groupBy(*keys, "_blk").applyInArrow(run, schema)


def edged(values: np.ndarray, own: np.ndarray, left: int, right: int) -> np.ndarray:
    """The values with the end ones repeated, so that each own row has all its neighbours."""
    first, last = int(own.argmax()), len(own) - 1 - int(own[::-1].argmax())
    start = np.repeat(values[:1], max(0, left - first))
    end = np.repeat(values[-1:], max(0, right - (len(values) - 1 - last)))
    return np.concatenate([start, values[max(0, first - left) : last + 1 + right], end])


def ranked(table: pa.Table, own: np.ndarray, x: str, size: int, pct: float) -> np.ndarray:
    """For the own rows, the element ``floor(size*pct/100)`` of the sorted centred frame; rows beyond the ends repeat them."""
    k = size // 2
    values = edged(table.column(x).to_numpy().astype(float), own, k, size - 1 - k)
    frames = np.lib.stride_tricks.sliding_window_view(values, size)
    pick = min(size - 1, int(size * pct / 100))
    parts = [np.partition(frames[a : a + 1024], pick, axis=1)[:, pick] for a in range(0, len(frames), 1024)]
    return np.concatenate(parts)


def schema_of(df: DataFrame, **more: str) -> str:
    """The columns of ``df`` and more, by name and type."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in more), *(f"`{k}` {v}" for k, v in more.items())])


def rank_filter(df: DataFrame, keys: list[str], x: str, size: int, pct: float, name: str, block: int = BLOCK) -> DataFrame:
    """Adds the element ``floor(size*pct/100)`` of the sorted centred frame; rows beyond the ends repeat the end rows."""

    def kernel(table: pa.Table, own: np.ndarray, _: int) -> pa.Table:
        return table.filter(pa.array(own)).append_column(name, pa.array(ranked(table, own, x, size, pct)))

    rows = df.drop(name)
    return blocks(rows, keys, size // 2, size // 2, kernel, schema_of(rows, **{name: "double"}), block)
