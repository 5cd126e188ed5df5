"""Two-state segmentation of level series: threshold, hysteresis, short runs, cycles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import quantile
from ..plans import series

_EPS = 1e-20


def otsu(df: DataFrame, keys: list[str], x: str = "level_db", bins: int = 128) -> DataFrame:
    """Per key ``threshold_db``: the midpoint of the two class means of the histogram split that separates best.

    The histogram runs from the 0.5th to the 99.5th percentile; among equal splits the first counts.
    """
    ends = df.groupBy(*keys).agg(quantile(F.col(x), 0.005).alias("lo"), quantile(F.col(x), 0.995).alias("hi"))
    inside = df.join(ends, keys).where((F.col(x) >= F.col("lo")) & (F.col(x) <= F.col("hi")))
    width = (F.col("hi") - F.col("lo")) / bins
    k = F.least(F.floor((F.col(x) - F.col("lo")) / width).cast("int"), F.lit(bins - 1))
    counts = inside.groupBy(*keys, "lo", "hi", k.alias("k")).agg(F.count("*").alias("c"))
    cells = ends.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    cells = cells.join(counts.select(*keys, "k", "c"), [*keys, "k"], "left").fillna(0, ["c"])
    up_to = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    p = F.col("c") / F.sum("c").over(all_)
    cells = cells.withColumn("p", p).withColumn("m", F.col("p") * (F.col("lo") + (F.col("k") + 0.5) * width))
    cells = cells.withColumns({"w0": F.sum("p").over(up_to), "mu": F.sum("m").over(up_to), "mt": F.sum("m").over(all_)})
    var = F.pow(F.col("mt") * F.col("w0") - F.col("mu"), F.lit(2.0)) / (F.col("w0") * (1 - F.col("w0")) + _EPS)
    best = F.max(F.struct(F.round(var, 9).alias("v"), (-F.col("k")).alias("at"), "w0", "mu", "mt"))
    split = cells.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")
    low, high = F.col("mu") / (F.col("w0") + _EPS), (F.col("mt") - F.col("mu")) / (1 - F.col("w0") + _EPS)
    return split.select(*keys, ((low + high) / 2).alias("threshold_db"))


def separation(df: DataFrame, keys: list[str], x: str = "level_db", min_separation_db: float = 2.0, min_fraction: float = 0.02) -> DataFrame:
    """Class means on either side of the threshold, their distance, and whether it speaks for two modes."""
    upper = F.col(x) > F.col("threshold_db")
    found = (
        df.join(otsu(df, keys, x), keys)
        .groupBy(*keys, "threshold_db")
        .agg(
            F.avg(F.when(~upper, F.col(x))).alias("lower_mean_db"),
            F.avg(F.when(upper, F.col(x))).alias("upper_mean_db"),
            F.avg(upper.cast("double")).alias("upper_fraction"),
        )
    )
    found = found.withColumn("separation_db", F.col("upper_mean_db") - F.col("lower_mean_db"))
    enough = F.col("upper_fraction").between(min_fraction, 1 - min_fraction)
    return found.withColumn("bimodal", F.coalesce((F.col("separation_db") >= min_separation_db) & enough, F.lit(False)))


def segments(df: DataFrame, keys: list[str], thresholds: DataFrame, x: str = "level_db", smooth: int = 11, hysteresis_db: float = 1.0, min_rows: int = 30) -> DataFrame:
    """Segments of the smoothed series on either side of ``thresholds`` (keys, threshold_db).

    A state changes only beyond half the hysteresis; runs shorter than ``min_rows``, but for the first and the last,
    take the state before.  Per segment: state, t0 (row from 0), rows, median and deviation of the raw level.
    """
    size = max(3, smooth | 1)

    def kernel(table: pa.Table, own: np.ndarray, number: int) -> pa.Table:
        """The block's runs; until a level first decides, the state is that of the block before (null)."""
        level, i = series.ranked(table, own, x, size, 50.0), table.column("i").to_numpy()[own]
        threshold = table.column("threshold_db")[0].as_py()
        flip = np.where(level < threshold - hysteresis_db / 2, 0, np.where(level > threshold + hysteresis_db / 2, 1, -1))
        if i[0] == 1 and flip[0] < 0:
            flip[0] = level[0] > threshold
        decided = np.maximum.accumulate(np.where(flip >= 0, np.arange(len(flip)), -1))
        state = np.where(decided >= 0, flip[decided], -1)
        a = np.flatnonzero(np.diff(state, prepend=-2))
        z = np.append(a[1:], len(state)) - 1
        made = {k: pa.repeat(table.column(k)[0], len(a)) for k in keys}
        on = pa.array(state[a], pa.int32(), mask=state[a] < 0)
        return pa.table(made | {"n": pa.repeat(table.column("n")[0], len(a)), "on": on, "i0": i[a], "i1": i[z]})

    rows = df.select(*keys, "i", "n", x)
    shape = series.schema_of(rows.select(*keys, "n"), on="int", i0="bigint", i1="bigint")
    runs = series.blocks(rows.join(thresholds, keys), keys, size // 2, size // 2, kernel, shape)

    in_order = Window.partitionBy(*keys).orderBy("i0")

    def joined(runs: DataFrame) -> DataFrame:
        """Neighbouring runs of one state made one."""
        new = F.when(F.col("on").eqNullSafe(F.lag("on").over(in_order)), 0).otherwise(1)
        told = runs.withColumn("_new", new).withColumn("segment", F.sum("_new").over(in_order))
        return told.groupBy(*keys, "n", "segment", "on").agg(F.min("i0").alias("i0"), F.max("i1").alias("i1"))

    runs = joined(runs.withColumn("on", F.last("on", True).over(in_order)))
    stays = (F.col("i1") - F.col("i0") + 1 >= min_rows) | (F.col("i0") == 1) | (F.col("i1") == F.col("n"))
    segs = joined(runs.withColumn("on", F.last(F.when(stays, F.col("on")), True).over(in_order)))

    block = series.BLOCK
    reach = F.sequence(F.floor((F.col("i0") - 1) / block), F.floor((F.col("i1") - 1) / block))
    dealt = segs.select(*keys, "segment", "on", F.col("i0").alias("_a"), F.col("i1").alias("_z"), F.explode(reach).alias("_blk"))
    named = rows.withColumn("_blk", F.floor((F.col("i") - 1) / block)).join(dealt, [*keys, "_blk"]).where("i BETWEEN _a AND _z")
    return (
        named.groupBy(*keys, "segment", "on")
        .agg(
            (F.min("i") - 1).alias("t0"),
            F.count("*").alias("rows"),
            quantile(F.col(x), 0.5).alias("median_db"),
            F.stddev_pop(x).alias("sd_db"),
        )
        .withColumn("state", F.when(F.col("on") == 1, "on").otherwise("off"))
        .drop("on")
    )


def switch_points(segs: DataFrame, keys: list[str]) -> DataFrame:
    """Where a segment follows another: its start, its state, and the step between the medians."""
    in_order = Window.partitionBy(*keys).orderBy("segment")
    step = F.col("median_db") - F.lag("median_db").over(in_order)
    return segs.withColumn("step_db", step).where(F.col("segment") > 1).select(*keys, "t0", F.col("state").alias("direction"), "step_db")


def duty_cycle(segs: DataFrame, keys: list[str]) -> DataFrame:
    """Median distance of the starts of on-segments, the median on-time as a share of it, and their number."""
    in_order = Window.partitionBy(*keys).orderBy("segment")
    on = segs.where("state = 'on'").withColumn("period", F.lead("t0").over(in_order) - F.col("t0"))
    found = on.groupBy(*keys).agg(
        quantile(F.col("period"), 0.5).alias("period"), quantile(F.col("rows"), 0.5).alias("_on"), F.count("*").alias("n_cycles")
    )
    return found.withColumn("duty", F.col("_on") / F.col("period")).drop("_on")


def cycle_series(segs: DataFrame, keys: list[str]) -> DataFrame:
    """Trend of on-times and periods over the cycles; a last on-segment that ends with the series has no on-time."""
    in_order = Window.partitionBy(*keys).orderBy("segment")
    last = F.col("segment") == F.max("segment").over(Window.partitionBy(*keys))
    on = segs.withColumn("cut", last).where("state = 'on'")
    on = on.withColumns({"k": (F.row_number().over(in_order) - 1).cast("double"), "period": (F.lead("t0").over(in_order) - F.col("t0")).cast("double")})
    length = F.when(~F.col("cut"), F.col("rows").cast("double"))

    def trend(v, name):
        known = F.col("k") * F.when(v.isNotNull(), 1.0)
        many = F.count(v) >= 3
        flat = F.coalesce(F.stddev_pop(v), F.lit(0.0)) == 0
        return [
            F.when(many, F.when(flat, 0.0).otherwise(F.corr(known, v))).alias(f"{name}_rho"),
            F.when(many, F.when(flat, 0.0).otherwise(F.regr_slope(v, known))).alias(f"{name}_per_cycle"),
            F.when(many, F.max(v) - F.min(v)).alias(f"{name}_spread"),
        ]

    return on.groupBy(*keys).agg(
        F.count("*").alias("n_cycles"), *trend(length, "on"), *trend(F.col("period"), "period"), F.max("cut").alias("truncated_final_run")
    )


def auto_states(segs: DataFrame, keys: list[str], rows_total: DataFrame, min_rows: int = 180, min_step_db: float = 4.0, min_share: float = 0.05) -> DataFrame:
    """The segments, if both states last ``min_rows`` rows and ``min_share`` of the series (``rows_total``: keys, n) at least
    and their median levels differ by ``min_step_db``; else none."""
    sums = segs.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("state") == s, F.col("rows")).otherwise(0)).alias(f"_{s}") for s in ("on", "off")],
        *[quantile(F.when(F.col("state") == s, F.col("median_db")), 0.5).alias(f"_{s}_db") for s in ("on", "off")],
    )
    least = F.greatest(F.lit(min_rows), min_share * F.col("_all"))
    told = sums.join(rows_total.select(*keys, F.col("n").alias("_all")), keys)
    both = told.where((F.least("_on", "_off") >= least) & (F.abs(F.col("_on_db") - F.col("_off_db")) >= min_step_db))
    return segs.join(both.select(*keys), keys, "left_semi")


def state_intervals(segs: DataFrame, keys: list[str], dt: float = 1.0, labels: tuple[str, str] = ("machine_on", "machine_off")) -> DataFrame:
    """Segments as [a, b) in seconds of the series, under the names given."""
    name = F.when(F.col("state") == "on", labels[0]).otherwise(labels[1])
    return segs.select(*keys, name.alias("state"), (F.col("t0") * dt).alias("a"), ((F.col("t0") + F.col("rows")) * dt).alias("b"))


def transitions(df: DataFrame, segs: DataFrame, keys: list[str], x: str = "level_db", dt: float = 1.0, tolerance_db: float = 1.0, most_s: float = 120.0, around_s: float = 30.0) -> DataFrame:
    """How one state gives way to the next: the step, the time spent from 10 to 90 % of it within ``around_s`` on either
    side, and how long until nine tenths of what is left of ``most_s`` lie within the tolerance of the new median (null:
    never).  The tolerance is ``tolerance_db``, or twice the new state's deviation if that is more.
    """
    in_order = Window.partitionBy(*keys).orderBy("segment")
    edges = segs.withColumn("from_db", F.lag("median_db").over(in_order)).where("from_db is not null and t0 > 0")
    edges = edges.select(
        *keys, "segment", F.col("t0").alias("_i"), "from_db", F.col("median_db").alias("to_db"), (F.col("median_db") - F.col("from_db")).alias("step_db"),
        F.greatest(F.lit(tolerance_db), 2 * F.coalesce("sd_db", F.lit(0.0))).alias("settle_tol_db"),
    ).where(F.abs("step_db") >= 1e-9)
    w, m = int(round(min(most_s, around_s) / dt)), int(round(most_s / dt))
    reach = max(w, m)
    block = series.BLOCK
    cells = F.sequence(F.floor(F.greatest(F.col("_i") - w, F.lit(0)) / block), F.floor((F.col("_i") + reach - 1) / block))
    dealt = edges.withColumn("_blk", F.explode(cells))
    rows = df.select(*keys, (F.col("i") - 1).alias("_r"), F.col(x).alias("_x"), F.floor((F.col("i") - 1) / block).alias("_blk"))
    met = rows.join(dealt, [*keys, "_blk"]).withColumn("_k", F.col("_r") - F.col("_i")).where(f"_k >= -{w} AND _k < {reach}")
    part = (F.col("_x") - F.col("from_db")) / F.col("step_db")
    crossing = (F.col("_k") < w) & (part >= 0.1) & (part <= 0.9)
    inside = (F.abs(F.col("_x") - F.col("to_db")) <= F.col("settle_tol_db")).cast("double")
    named = [*keys, "segment"]
    rest = Window.partitionBy(*named).orderBy("_k").rowsBetween(0, Window.unboundedFollowing)
    tail = met.where(f"_k >= 0 AND _k < {m}").withColumn("_share", F.avg(inside).over(rest))
    settle = tail.groupBy(*named).agg((F.min(F.when(F.col("_share") >= 0.9, F.col("_k"))) * dt).alias("settle_s"))
    cross = met.groupBy(*named).agg((F.sum(crossing.cast("int")) * dt).alias("crossing_s"))
    out = edges.join(cross, named).join(settle, named, "left")
    way = F.when(F.col("step_db") > 0, "onset").otherwise("cessation")
    return out.select(*named, (F.col("_i") * dt).alias("t_s"), way.alias("direction"), "step_db", "crossing_s", "settle_s", "settle_tol_db", "from_db", "to_db")
