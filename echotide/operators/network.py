"""Several recorders at once: common grids, coupling, graph measures, loudest node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import db, power, quantile


def grid(df: DataFrame, node: str, t: str, x: str, dt: float) -> DataFrame:
    """(node, k, level): each row on the nearest step of a common grid; the last row on a step counts."""
    k = F.rint(F.col(t) / dt).cast("bigint")
    return df.groupBy(node, k.alias("k")).agg(F.max_by(x, t).alias("level_db"))


def day_matrix(df: DataFrame, node: str, t: str, x: str, bin_s: float = 300.0, min_rows: int = 30) -> DataFrame:
    """Energy mean of each node and bin with more than ``min_rows`` rows, and its height above the node's median."""
    bins = df.groupBy(node, F.floor(F.col(t) / bin_s).alias("bin")).agg(F.count(x).alias("_n"), db(F.avg(power(F.col(x)))).alias("level_db"))
    bins = bins.where(F.col("_n") > min_rows).drop("_n")
    middle = bins.groupBy(node).agg(quantile(F.col("level_db"), 0.5).alias("_m"))
    return bins.join(middle, node).select(node, "bin", "level_db", (F.col("level_db") - F.col("_m")).alias("height_db"))


def floors(df: DataFrame, node: str, x: str, pct: float = 5.0) -> DataFrame:
    """Low percentile of each node."""
    return df.groupBy(node).agg(quantile(F.col(x), pct / 100).alias("floor_db"))


def gain_offsets(found: DataFrame, node: str) -> DataFrame:
    """How far each node's floor stands from the median of all."""
    middle = found.agg(quantile(F.col("floor_db"), 0.5).alias("_m"))
    return found.crossJoin(F.broadcast(middle)).select(node, "floor_db", (F.col("floor_db") - F.col("_m")).alias("gain_offset_db"))


def loudest(matrix: DataFrame, floor: DataFrame, node: str, margin_db: float = 3.0, clear_db: float = 3.0) -> DataFrame:
    """Per bin with two nodes at least, the loudest one if it beats the next by more than the margin and clears its floor."""
    order = Window.partitionBy("bin").orderBy(F.desc("level_db"), node)
    ranked = matrix.withColumns(
        {"_r": F.row_number().over(order), "_next": F.lead("level_db").over(order), "_n": F.count("*").over(Window.partitionBy("bin"))}
    ).where("_r = 1 and _n >= 2")
    won = (F.col("level_db") - F.col("_next") > margin_db) & (F.col("level_db") - F.col("floor_db") >= clear_db)
    return ranked.join(floor, node).select("bin", F.when(won, F.col(node)).alias("winner"), (F.col("level_db") - F.col("_next")).alias("lead_db"))


def pairwise(on_grid: DataFrame, node: str, window: int, max_lag: int, min_coverage: float = 0.9) -> DataFrame:
    """Per window of ``window`` steps and pair of nodes (a < b), the strongest correlation within ``max_lag`` steps.

    A node counts in a window if it has ``min_coverage`` of its steps and is not flat; gaps take its mean, and its line
    over the window is taken away.  Correlations are sums of products over the steps that overlap, over their number and
    the deviations of the whole windows; at most 1.  The lag, positive if ``a`` leads, is refined by a parabola.
    The nodes of a window meet as arrays, one for each node, so work grows with windows, pairs and lags.
    """
    cells = on_grid.withColumn("window", F.floor(F.col("k") / window)).where(F.col("level_db").isNotNull() & ~F.isnan("level_db"))
    at = F.pmod("k", F.lit(window)).cast("int")
    middle, v = (window - 1) / 2, F.col("level_db")
    ramp = at - F.lit(middle)
    held = cells.groupBy("window", node).agg(
        F.map_from_entries(F.collect_list(F.struct(at.alias("s"), v.alias("v")))).alias("_m"),
        F.avg(v).alias("_mean"),
        F.var_pop(v).alias("_var"),
        F.sum(v * ramp).alias("_vr"),
        F.sum(ramp).alias("_r"),
        F.count("*").alias("_n"),
    )
    held = held.where(F.col("_n") >= min_coverage * window)
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    squares = window * (window**2 - 1) / 12  # of the ramp; gaps, at the mean, add nothing to what follows
    held = held.withColumn("_slope", (F.col("_vr") - F.col("_mean") * F.col("_r")) / squares)
    rest = F.greatest(F.col("_var") * F.col("_n") - F.col("_slope") * F.col("_slope") * squares, F.lit(0.0))
    held = held.withColumn("_sd", F.sqrt(rest / window)).where("_sd > 1e-6")
    steps = F.sequence(F.lit(0), F.lit(window - 1))
    held = held.withColumn(
        "_x", F.transform(steps, lambda s: F.coalesce(F.try_element_at("_m", s) - F.col("_mean"), F.lit(0.0)) - F.col("_slope") * (s - F.lit(middle)))
    )
    one = held.select("window", F.col(node).alias("a"), F.col("_x").alias("x"), F.col("_sd").alias("sx"))
    other = held.select("window", F.col(node).alias("b"), F.col("_x").alias("y"), F.col("_sd").alias("sy"))
    met = one.join(other, "window").where(F.col("a") < F.col("b"))

    def at_lag(lag: Column) -> Column:
        """Steps of ``a`` against those of ``b`` that come ``lag`` later."""
        n = F.lit(window) - F.abs(lag)
        x = F.slice("x", F.greatest(F.lit(1), 1 - lag), n)
        y = F.slice("y", F.greatest(F.lit(1), 1 + lag), n)
        return F.struct((add(F.zip_with(x, y, lambda p, q: p * q)) / (n * F.col("sx") * F.col("sy"))).alias("r"), lag.alias("lag"))

    # among equal ones the latest wins, as the first of the search by the other node's lag
    lags = F.transform(F.sequence(F.lit(-max_lag), F.lit(max_lag)), at_lag)
    found = met.select("window", "a", "b", lags.alias("_r"))
    best = F.aggregate("_r", F.get("_r", F.lit(0)), lambda s, x: F.when(F.round(x["r"], 9) >= F.round(s["r"], 9), x).otherwise(s))
    found = found.withColumn("_b", best)
    near = lambda d: F.get(F.col("_r"), (F.col("_b.lag") + max_lag + d).cast("int"))["r"]
    bend = near(-1) - 2 * F.col("_b.r") + near(1)
    inner = F.abs("_b.lag") < max_lag
    move = F.when(inner & (bend < 0), 0.5 * (near(-1) - near(1)) / bend).otherwise(0.0)
    return found.select("window", "a", "b", F.least(F.col("_b.r"), F.lit(1.0)).alias("coupling"), (F.col("_b.lag") + move).alias("lag"))


def strength(edges: DataFrame) -> DataFrame:
    """Per window and node, the sum of its coupling with all others."""
    ends = edges.select("window", F.col("a").alias("node"), "coupling").unionByName(edges.select("window", F.col("b").alias("node"), "coupling"))
    return ends.groupBy("window", "node").agg(F.sum("coupling").alias("strength"))


def density(edges: DataFrame, n_nodes: int, threshold: float = 0.35) -> DataFrame:
    """Per window, the share of possible links at or over the threshold, and the pairs with a coupling."""
    linked = F.col("coupling") >= threshold
    possible = n_nodes * (n_nodes - 1) / 2
    return edges.groupBy("window").agg((F.sum(linked.cast("double")) / possible).alias("density"), F.count("*").alias("pairs"))


def hourly(edges: DataFrame, n_nodes: int, hour: Column, threshold: float = 0.35) -> DataFrame:
    """Per hour of day: median density, windows, and the node with the largest median strength (first among equals)."""
    timed = density(edges, n_nodes, threshold).withColumn("hour", hour).groupBy("hour").agg(
        quantile(F.col("density"), 0.5).alias("density"), F.count("*").alias("n_windows")
    )
    return timed.join(hubs(edges, hour), "hour")


def representative_hours(found: DataFrame, n: int = 3) -> DataFrame:
    """Of the hours with a density, all if there are at most ``n``, else the quietest, the middle and the busiest."""
    order = Window.partitionBy(F.lit(1)).orderBy("density", "hour")
    told = found.withColumns({"_k": F.row_number().over(order) - 1, "_n": F.count("*").over(Window.partitionBy(F.lit(1)))})
    picked = (F.col("_n") <= n) | (F.col("_k") == 0) | (F.col("_k") == F.floor(F.col("_n") / 2)) | (F.col("_k") == F.col("_n") - 1)
    return told.where(picked).drop("_k", "_n")


def transitivity(edges: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Per window, closed triplets as a share of all: three times the triangles over the paths of two links."""
    e = edges.where(F.col("coupling") >= threshold).select("window", "a", "b")
    ends = e.select("window", F.col("a").alias("n")).unionByName(e.select("window", F.col("b").alias("n")))
    degree = ends.groupBy("window", "n").agg(F.count("*").alias("d"))
    paths = degree.groupBy("window").agg(F.sum(F.col("d") * (F.col("d") - 1) / 2).alias("paths"))
    first, second = e.alias("p"), e.select("window", F.col("a").alias("b"), F.col("b").alias("c")).alias("q")
    closed = first.join(second, ["window", "b"]).join(e.select("window", "a", F.col("b").alias("c")), ["window", "a", "c"])
    triangles = closed.groupBy("window").agg(F.count("*").alias("triangles"))
    both = paths.join(triangles, "window", "left").fillna(0, ["triangles"])
    return both.select("window", "triangles", F.when(F.col("paths") > 0, 3 * F.col("triangles") / F.col("paths")).alias("transitivity"))


def hubs(edges: DataFrame, hour: Column) -> DataFrame:
    """Per hour of day, the node with the largest median coupling (the first in order among equals)."""
    timed = edges.withColumn("hour", hour)
    ends = timed.select("hour", "window", F.col("a").alias("node"), "coupling").unionByName(
        timed.select("hour", "window", F.col("b").alias("node"), "coupling")
    )
    strength = ends.groupBy("hour", "window", "node").agg(F.sum("coupling").alias("s"))
    middle = strength.groupBy("hour", "node").agg(F.round(quantile(F.col("s"), 0.5), 9).alias("strength"))
    order = Window.partitionBy("hour").orderBy(F.desc("strength"), "node")
    return middle.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("hour", F.col("node").alias("hub"), "strength")


def follow(df: DataFrame, node: str, t: str, x: str, start: float, end: float, baseline_s: float = 600.0, slice_s: float = 10.0, rise_db: float = 6.0) -> DataFrame:
    """Stays of a source: consecutive slices won by one node, by its rise over its median before ``start``.

    Slices that nobody wins don't end a stay.
    """
    base = df.where((F.col(t) >= start - baseline_s) & (F.col(t) < start)).groupBy(node).agg(quantile(F.col(x), 0.5).alias("_base"))
    cut = df.where((F.col(t) >= start) & (F.col(t) < end)).groupBy(F.floor((F.col(t) - start) / slice_s).alias("slice"), node).agg(
        quantile(F.col(x), 0.5).alias("_l")
    )
    rise = cut.join(base, node).withColumn("rise", F.col("_l") - F.col("_base"))
    first = Window.partitionBy("slice").orderBy(F.desc("rise"), node)
    won = rise.withColumn("_r", F.row_number().over(first)).where((F.col("_r") == 1) & (F.col("rise") >= rise_db))
    in_order = Window.partitionBy(F.lit(1)).orderBy("slice")
    new = F.when(F.col(node).eqNullSafe(F.lag(node).over(in_order)), 0).otherwise(1)
    stays = won.withColumn("_new", new).withColumn("stay", F.sum("_new").over(in_order))
    return stays.groupBy("stay", node).agg(
        (start + F.min("slice") * slice_s).alias("from_s"), (start + (F.max("slice") + 1) * slice_s).alias("to_s"), F.max("rise").alias("peak_rise_db")
    )
