"""Directions of sources: errors, frames of reference, passing sources, arrays, rows of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import circular_sd, nan_to_null, quantile, wrap_degrees
from ..plans import series

_EPS = 1e-20


def error_stats(df: DataFrame, keys: list[str], error_deg: str, within: float = 20.0) -> DataFrame:
    """Frames, median and quartile range of the absolute error, circular bias and spread, share within a limit."""
    e = F.col(error_deg)
    a = F.radians(e)
    found = df.groupBy(*keys).agg(
        F.count(e).alias("n_frames"),
        quantile(F.abs(e), 0.5).alias("median_abs_deg"),
        (quantile(F.abs(e), 0.75) - quantile(F.abs(e), 0.25)).alias("iqr_deg"),
        F.avg(F.cos(a)).alias("_c"),
        F.avg(F.sin(a)).alias("_s"),
        F.avg((F.abs(e) <= within).cast("double")).alias("within"),
    )
    r = F.sqrt(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s"))
    return found.withColumns(
        {"bias_deg": F.degrees(F.atan2("_s", "_c")), "circ_sd_deg": F.degrees(circular_sd(r))}
    ).drop("_c", "_s")


def frame_errors(labels: DataFrame, estimates: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """Signed errors of the estimates in frames that have exactly one label."""
    single = labels.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, frame))).where("_n = 1").drop("_n")
    both = single.join(estimates.withColumnRenamed("azimuth", "_est"), [*keys, frame])
    return both.withColumn("error_deg", wrap_degrees(F.col("_est") - F.col("azimuth"))).drop("_est")


def frame_reference(df: DataFrame, keys: list[str], bearing_deg: Column, heading_deg: Column, weight: Column) -> DataFrame:
    """Whether a direction keeps still relative to the rig or to the world, or to neither more than chance would."""
    b, h = F.radians(bearing_deg), F.radians(heading_deg)
    rows = df.select(*keys, b.alias("_b"), (b + h).alias("_w"), weight.alias("_k")).dropna(subset=["_b", "_w", "_k"])

    def length(angle: str) -> Column:
        c, s = F.sum(F.col("_k") * F.cos(angle)), F.sum(F.col("_k") * F.sin(angle))
        return F.sqrt(c * c + s * s) / (F.sum("_k") + _EPS)

    found = rows.groupBy(*keys).agg(
        length("_b").alias("r_rig"),
        length("_w").alias("r_world"),
        F.sqrt((F.sum(F.col("_k") * F.col("_k")) + _EPS) / F.pow(F.sum("_k"), F.lit(2.0))).alias("r_chance"),
        F.count("*").alias("n"),
    )
    chance = F.greatest("r_rig", "r_world") <= F.col("r_chance")
    return found.withColumn("frame", F.when(chance, "neither").when(F.col("r_rig") >= F.col("r_world"), "rig").otherwise("world"))


def pass_bys(df: DataFrame, keys: list[str], azimuth_deg: str, min_rows: int = 4, min_sweep_deg: float = 25.0, min_r2: float = 0.7) -> DataFrame:
    """Events (one for each value of keys, ordered by ``i``) whose unwrapped azimuth moves along a line."""
    order = Window.partitionBy(*keys).orderBy("i")
    step = wrap_degrees(F.col(azimuth_deg) - F.lag(azimuth_deg).over(order))
    rows = df.withColumn("_step", F.coalesce(step, F.col(azimuth_deg)))
    rows = rows.withColumn("_az", F.sum("_step").over(order)).withColumn("_k", F.col("i").cast("double"))
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.regr_slope("_az", "_k").alias("rate_deg"), F.regr_r2("_az", "_k").alias("r2")
    )
    found = found.withColumn("sweep_deg", F.col("rate_deg") * F.col("rows"))
    kept = found.where((F.col("rows") >= min_rows) & (F.abs("sweep_deg") >= min_sweep_deg) & (F.col("r2") >= min_r2))
    return kept.withColumn("direction", F.when(F.col("sweep_deg") < 0, "left-to-right").otherwise("right-to-left"))


def linear_bearing(pairs: DataFrame, keys: list[str], spacing: str, delay: str, weight: str, c: float = 343.0) -> DataFrame:
    """Angle to a line of microphones by weighted least squares over the delays of their pairs."""
    w, d, tau = F.greatest(F.col(weight), F.lit(0.0)), F.col(spacing), F.coalesce(nan_to_null(F.col(delay)), F.lit(0.0))
    sums = pairs.groupBy(*keys).agg(
        F.sum(w * d * d).alias("_dd"), F.sum(w * d * tau).alias("_dt"), quantile(F.col(weight), 0.5).alias("confidence")
    )
    cos = F.when(F.col("_dd") > _EPS, -c * F.col("_dt") / F.col("_dd"))
    sums = sums.withColumn("cos_theta", cos).withColumn("clipped", F.abs("cos_theta") > 1)
    clipped = F.greatest(F.least("cos_theta", F.lit(1.0)), F.lit(-1.0))
    return sums.withColumn("bearing_deg", F.degrees(F.acos(clipped))).drop("_dd", "_dt")


def intersect(bearings: DataFrame, keys: list[str], x: str, y: str, angle_deg: str, weight: str) -> DataFrame:
    """The point nearest to all lines of sight (from x, y at an angle), and its weighted distance from them."""
    a = F.radians(angle_deg)
    nx, ny, w = -F.sin(a), F.cos(a), F.col(weight)
    q = nx * F.col(x) + ny * F.col(y)
    s = bearings.groupBy(*keys).agg(
        F.sum(w * nx * nx).alias("_a"), F.sum(w * nx * ny).alias("_b"), F.sum(w * ny * ny).alias("_c"),
        F.sum(w * nx * q).alias("_p"), F.sum(w * ny * q).alias("_q"), F.sum(w * q * q).alias("_r"), F.sum(w).alias("_w"), F.count("*").alias("lines"),
    )
    det = F.col("_a") * F.col("_c") - F.col("_b") * F.col("_b")
    px = F.when(det > 1e-12, (F.col("_c") * F.col("_p") - F.col("_b") * F.col("_q")) / det)
    py = F.when(det > 1e-12, (F.col("_a") * F.col("_q") - F.col("_b") * F.col("_p")) / det)
    out = s.withColumns({"x": px, "y": py})
    left = F.col("_r") - F.col("x") * F.col("_p") - F.col("y") * F.col("_q")
    return out.withColumn("residual", F.sqrt(F.greatest(left, F.lit(0.0)) / F.col("_w"))).select(*keys, "x", "y", "residual", "lines")


def clock_rows(sessions: DataFrame, keys: list[str], start: str, end: str, gap: float) -> DataFrame:
    """Adds ``row``: sessions share one if they start at most ``gap`` after the end of all before them.  Needs ``i`` by start."""
    ends = series.previous(_running_max(sessions, keys, end), keys, {"_before": "_reach"})
    new = F.when(F.col("_before").isNull() | (F.col(start) > F.col("_before") + gap), 1).otherwise(0)
    return series.running_sum(ends, keys, new, "row").drop("_reach", "_before")


def _running_max(df: DataFrame, keys: list[str], value: str, block: int = series.BLOCK) -> DataFrame:
    dealt = df.withColumn("_blk", F.floor((F.col("i") - 1) / block))
    tops = dealt.groupBy(*keys, "_blk").agg(F.max(value).alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "_blk", F.max("_m").over(before).alias("_o"))
    within = Window.partitionBy(*keys, "_blk").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumn("_w", F.max(value).over(within)).join(tops, [*keys, "_blk"])
    return out.withColumn("_reach", F.greatest("_w", "_o")).drop("_blk", "_w", "_o")


def array_bearing(pairs: DataFrame, keys: list[str], geometry: dict) -> DataFrame:
    """Per frame, the bearing of a linear array from the delays of its pairs (a, b, delay_s, prominence): degrees from the
    line of the first to the last microphone, its confidence, the residual, and whether it had to be cut to the line."""
    if not geometry["linear"]:
        raise ValueError("a bearing needs microphones on a line")
    along = F.array(*[F.lit(float(v)) for v in geometry["pos"] @ geometry["axis"]])
    apart = F.get(along, F.col("a")) - F.get(along, F.col("b"))
    w = F.greatest("prominence", F.lit(0.0))
    delay = F.when(~F.isnan("delay_s"), F.col("delay_s")).otherwise(0.0)
    rows = pairs.select(*keys, apart.alias("_d"), w.alias("_w"), F.coalesce(delay, F.lit(0.0)).alias("_t"), "prominence")
    sums = rows.groupBy(*keys).agg(
        F.sum(F.col("_w") * F.col("_d") * F.col("_d")).alias("_dd"),
        F.sum(F.col("_w") * F.col("_d") * F.col("_t")).alias("_dt"),
        F.sum("_w").alias("_ww"),
        F.sum(F.col("_w") * F.col("_t") * F.col("_t")).alias("_tt"),
        quantile(F.col("prominence"), 0.5).alias("confidence"),
    )
    c = geometry["c"]
    cosine = F.when(F.col("_dd") > 1e-12, -c * F.col("_dt") / F.col("_dd"))
    cut = F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))
    rest = F.col("_tt") + 2 * cut / c * F.col("_dt") + cut * cut / (c * c) * F.col("_dd")
    return sums.select(
        *keys,
        F.degrees(F.acos(cut)).alias("bearing_deg"),
        "confidence",
        F.sqrt(F.greatest(rest, F.lit(0.0)) / (F.col("_ww") + 1e-12)).alias("residual_s"),
        (F.abs(cosine) > 1).alias("clipped"),
    )


def on_grid(bearings: DataFrame, node: str, t: str, grid_s: float = 1.0, least: float = 0.2) -> DataFrame:
    """Per node and step of a common grid, the frame nearest to the step, if within half a step, confident and not cut."""
    step = F.rint(F.col(t) / grid_s)
    near = bearings.withColumn("k", step.cast("bigint")).withColumn("_off", F.abs(F.col(t) - F.col("k") * grid_s))
    first = Window.partitionBy(node, "k").orderBy("_off", t)
    best = near.where(F.col("_off") <= grid_s / 2).withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return best.where((F.col("confidence") >= least) & ~F.col("clipped") & F.col("bearing_deg").isNotNull()).drop("_off", "_r")


def triangulate(bearings: DataFrame, plan: list[dict], node: str = "node", t: str = "t", grid_s: float = 1.0, least: float = 0.2) -> DataFrame:
    """Where the bearings of all nodes of a plan meet, per step of a grid: (k, t, x, y, residual_m, angle_deg, confidence,
    ambiguous).

    A line array does not tell its two sides apart, so every choice of sides is solved by weighted least squares; a
    choice that puts the source behind a node is out, the one with the least residual wins, and the point is ambiguous
    if the next is nearly as good.
    """
    n = len(plan)
    held = on_grid(bearings, node, t, grid_s, least)
    place = {p["name"]: k for k, p in enumerate(plan)}
    numbered = held.withColumn("_n", F.create_map(*[F.lit(v) for pair in place.items() for v in pair])[F.col(node)]).where("_n is not null")
    met = numbered.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("_n", "bearing_deg", "confidence"))).alias("b"), F.count("*").alias("_c"))
    met = met.where(F.col("_c") == n)
    sides = F.explode(F.array(*[F.array(*[F.lit(1.0 if m >> k & 1 else -1.0) for k in range(n)]) for m in range(1 << n)]))
    rows = met.select("k", "b", sides.alias("s"))
    parts = []
    for k, p in enumerate(plan):
        turn = F.radians(F.lit(p["axis_deg"]) + F.get("s", F.lit(k)) * F.get("b", F.lit(k))["bearing_deg"])
        w = F.get("b", F.lit(k))["confidence"]
        parts.append((F.cos(turn), F.sin(turn), w, F.lit(p["pos"][0]), F.lit(p["pos"][1])))
    total = lambda values: sum(values[1:], values[0])
    a = total([w * (1 - u * u) for u, _, w, _, _ in parts])
    b = total([-w * u * v for u, v, w, _, _ in parts])
    c = total([w * (1 - v * v) for _, v, w, _, _ in parts])
    p = total([w * ((1 - u * u) * x - u * v * y) for u, v, w, x, y in parts])
    q = total([w * (-u * v * x + (1 - v * v) * y) for u, v, w, x, y in parts])
    solved = rows.withColumns({"_det": a * c - b * b, "_p": p, "_q": q, "_a": a, "_b": b, "_c": c}).where(F.abs("_det") >= 1e-9)
    solved = solved.withColumns({"x": (F.col("_c") * F.col("_p") - F.col("_b") * F.col("_q")) / F.col("_det"), "y": (F.col("_a") * F.col("_q") - F.col("_b") * F.col("_p")) / F.col("_det")})
    ahead = [(F.col("x") - x) * u + (F.col("y") - y) * v for u, v, _, x, y in parts]
    off = [w * (F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2) - along * along) for (_, _, w, x, y), along in zip(parts, ahead, strict=True)]
    rest = F.sqrt(F.greatest(total(off), F.lit(0.0)) / total([w for _, _, w, _, _ in parts]))
    angles = [
        F.abs(F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), parts[i][0] * parts[j][1] - parts[i][1] * parts[j][0])))))
        for i in range(n)
        for j in range(i + 1, n)
    ]
    behind = total([(v < 0).cast("int") for v in ahead]) > 0
    told = solved.select(
        "k", "x", "y", rest.alias("residual_m"), (F.least(*angles) if len(angles) > 1 else angles[0]).alias("angle_deg"),
        F.array_min(F.transform("b", lambda s: s["confidence"])).alias("confidence"), behind.alias("_behind"),
    )
    order = Window.partitionBy("k").orderBy("_behind", "residual_m", "x", "y")
    ranked = told.withColumns({"_r": F.row_number().over(order), "_next": F.lead(F.when(~F.col("_behind"), F.col("residual_m"))).over(order)})
    best = ranked.where("_r = 1 and not _behind")
    near = F.coalesce(F.col("_next") <= 2 * F.col("residual_m") + 0.05, F.lit(False))
    return best.select("k", (F.col("k") * grid_s).alias("t"), "x", "y", "residual_m", "angle_deg", "confidence", near.alias("ambiguous"))


def single_sources(labels: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """Labels of frames that have exactly one."""
    alone = labels.groupBy(*keys, frame).agg(F.count("*").alias("_n")).where("_n = 1")
    return labels.join(alone.select(*keys, frame), [*keys, frame], "left_semi")


def frame_directions(blocks: DataFrame, frame_s: float = 0.1, band: tuple[float, float] = (80.0, 3000.0), sub_s: float | None = None) -> DataFrame:
    """Azimuth, energy and diffuseness of each whole frame of four-channel blocks, in a band: (path, frame, az_deg, energy,
    diffuseness).

    With ``sub_s`` the azimuths of parts of a frame are averaged by their energy; else the whole frame's intensity counts.
    """
    import numpy as np
    import pandas as pd

    from ..sources.wav import WYZX

    def run(batches):
        for batch in batches:
            for r in batch.itertuples():
                x = np.asarray(r.samples, float).reshape(-1, r.channels)
                if r.channels < 4:
                    raise ValueError(f"{r.path} has {r.channels} channels, not four")
                f = np.fft.rfftfreq(len(x), 1 / r.samplerate)
                low, high = band[0], min(band[1], 0.45 * r.samplerate)
                with np.errstate(divide="ignore"):
                    away = (f**2 - low * high) / (np.maximum(f, 1e-9) * (high - low))
                x = np.fft.irfft(np.fft.rfft(x, axis=0) / np.sqrt(1 + away**8)[:, None], len(x), axis=0)[r.lead :]
                size = max(1, round(frame_s * r.samplerate))
                n = len(x) // size
                w, y, z, v = (x[: n * size, k].reshape(n, size) for k in WYZX[r.order])
                ix, iy, iz = ((w * k).sum(axis=1) for k in (v, y, z))
                energy = (w**2).sum(axis=1) + (v**2 + y**2 + z**2).sum(axis=1) / 3
                az = np.degrees(np.arctan2(iy, ix))
                part = max(1, round((sub_s or 0) * r.samplerate))
                if sub_s and size // part >= 2:
                    cut = [k[:, : size // part * part].reshape(n, -1, part) for k in (w, y, v)]
                    a = np.arctan2((cut[0] * cut[1]).sum(axis=2), (cut[0] * cut[2]).sum(axis=2))
                    az = np.degrees(np.angle(((cut[0] ** 2).sum(axis=2) * np.exp(1j * a)).sum(axis=1)))
                wide = np.clip(1 - np.sqrt(ix**2 + iy**2 + iz**2) / (energy / 2 + 1e-20), 0, 1)
                first = round(r.first / size)
                yield pd.DataFrame({"path": r.path, "frame": first + np.arange(n), "az_deg": az, "energy": (w**2).sum(axis=1), "diffuseness": wide})

    held = blocks.select("path", "first", "samplerate", "channels", "order", "lead", "samples")
    return held.mapInPandas(run, "path string, frame bigint, az_deg double, energy double, diffuseness double")


def validate(labels: DataFrame, directions: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """Labelled frames of one source beside their directions: keys, frame, class, error_deg, diffuseness."""
    alone = single_sources(labels, keys, frame)
    met = alone.join(directions.select(*keys, frame, "az_deg", "diffuseness"), [*keys, frame])
    return met.select(*keys, frame, "class", wrap_degrees(F.col("az_deg") - F.col("azimuth")).alias("error_deg"), "diffuseness")
