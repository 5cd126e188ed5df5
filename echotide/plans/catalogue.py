"""Registered queries: each applies one operator to a standard table; and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.scalars import power
from ..operators import bearings, circular, corpus, cycles, ecology, events, indices, intervals, levels, network, states
from . import series, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
NODE = ["node"]


def query(sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    """Registers a query, with its doubles rounded, and its SQL, in which ``{s}`` stands for the numbered series."""

    def add(make: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = make(spark, sf_dir)
            return out.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

        QUERIES[make.__name__] = run
        if sql:
            _SQL[make.__name__] = sql
        return make

    return add


SERIES = """s AS (
    SELECT event_type AS node, user_id, event_id, ts, epoch_us(ts) / 1e6 AS t, value AS p,
           10 * log10(greatest(value, 1e-12)) AS level_db,
           row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i,
           count(*) OVER (PARTITION BY event_type) AS n
    FROM events
)"""
DAY = """d AS (
    SELECT o_orderpriority AS priority, o_orderdate::DATE AS day, round(avg(o_totalprice), 4) AS price, count(*) AS orders
    FROM orders GROUP BY ALL
)"""
BANDS = f"""e AS (
    SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, count(*) OVER (PARTITION BY label) AS n,
           list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE) AS spec FROM embeddings
), edges AS (SELECT range AS k, 50.0 * pow(10, 2.4 * range / 64.0) AS lo, 50.0 * pow(10, 2.4 * (range + 1) / 64.0) AS hi FROM range(64)
), b AS (
    SELECT label, vec_id, i, n, k AS band, sqrt(lo * hi) AS fc, spec[k + 1] AS power FROM e, edges
)"""


@query(
    """WITH {s} SELECT node, count(*) AS frames, round(10 * log10(avg(pow(10, level_db / 10))), 6) AS leq_db,
    round(quantile_cont(level_db, 0.9), 6) AS l10_db, round(quantile_cont(level_db, 0.5), 6) AS l50_db,
    round(quantile_cont(level_db, 0.1), 6) AS l90_db FROM s GROUP BY node"""
)
def leq_levels(spark, d):
    return levels.energy_summary(tables.levels(spark, d), NODE)


@query(
    """WITH {s}, q AS (SELECT node, quantile_cont(level_db, 0.95) AS lim FROM s GROUP BY node)
    SELECT node, round(10 * log10(avg(pow(10, level_db / 10))), 6) AS trimmed_leq_db FROM s JOIN q USING (node)
    WHERE level_db <= lim GROUP BY node"""
)
def trimmed_leq(spark, d):
    return levels.trimmed_leq(tables.levels(spark, d), NODE)


@query(
    """WITH {s}, q AS (SELECT node, 10 * log10(avg(pow(10, level_db / 10))) AS leq FROM s GROUP BY node)
    SELECT node, round(100 * sum(CASE WHEN level_db >= leq + 3 THEN pow(10, level_db / 10) ELSE 0 END)
    / (sum(pow(10, level_db / 10)) + 1e-20), 6) AS intermittency_pct FROM s JOIN q USING (node) GROUP BY node"""
)
def intermittency(spark, d):
    return levels.intermittency(tables.levels(spark, d), NODE)


@query(
    """WITH {s}, b AS (SELECT node, floor(t / 21600)::BIGINT AS bin, count(*) AS frames,
    10 * log10(avg(pow(10, level_db / 10))) AS m FROM s GROUP BY ALL),
    q AS (SELECT node, quantile_cont(frames, 0.5) AS typical FROM b GROUP BY node)
    SELECT node, bin, frames, CASE WHEN frames >= 0.75 * typical THEN round(m, 6) END AS laeq_db FROM b JOIN q USING (node)"""
)
def laeq_timeline(spark, d):
    return levels.timeline(tables.levels(spark, d), NODE, bin_s=21600.0)


BACKGROUND = """pad AS (
    SELECT node, i, level_db FROM s
    UNION ALL SELECT node, 1 - k, level_db FROM s, range(1, 31) r(k) WHERE i = 1
    UNION ALL SELECT node, n + k, level_db FROM s, range(1, 31) r(k) WHERE i = n
), bg AS (
    SELECT node, i, list_sort(list(level_db) OVER (PARTITION BY node ORDER BY i ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING))[7] AS background_db
    FROM pad
)"""


@query("WITH {s}, " + BACKGROUND + " SELECT node, s.i, round(background_db, 6) AS background_db FROM s JOIN bg USING (node, i)")
def running_background(spark, d):
    return events.running_background(tables.numbered(spark, d), NODE, 61).select("node", "i", "background_db")


@query(
    "WITH {s}, " + BACKGROUND + """, a AS (SELECT s.node, s.i, level_db, background_db, level_db > background_db + 8 AS above
    FROM s JOIN bg USING (node, i)),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY node, above ORDER BY i) AS grp FROM a), x AS (SELECT * FROM g WHERE above)
    SELECT node, min(i) - 1 AS i0, max(i) - 1 AS i1, arg_max(i, (level_db, -i)) - 1 AS ipk,
    round(arg_max(level_db - background_db, (level_db, -i)), 6) AS exceed_db FROM x GROUP BY node, grp HAVING count(*) >= 2"""
)
def detect_events(spark, d):
    return events.detect(tables.numbered(spark, d), NODE, size=61, min_frames=2)


FLOOR = """f AS (SELECT *, min(level_db) OVER (PARTITION BY node ORDER BY i ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING) + 1.5 AS floor_db FROM s),
c AS (SELECT *, pow(10, level_db / 10) - pow(10, floor_db / 10) AS excess, pow(10, floor_db / 10) AS nf FROM f),
m AS (SELECT *, excess > nf * (pow(10, 0.6) - 1) AS measurable FROM c)"""


@query("WITH {s}, " + FLOOR + " SELECT node, i, round(floor_db, 6) AS floor_db FROM f")
def noise_floor(spark, d):
    return levels.noise_floor(tables.numbered(spark, d), NODE, 61).select("node", "i", "floor_db")


@query(
    "WITH {s}, " + FLOOR + """ SELECT node, i, measurable, CASE WHEN measurable THEN round(10 * log10(excess), 6) END AS signal_db FROM m"""
)
def floor_corrected(spark, d):
    return levels.floor_corrected(tables.numbered(spark, d), NODE, 61).select("node", "i", "measurable", "signal_db")


@query(
    "WITH {s}, " + FLOOR + """ SELECT node, round(avg(measurable::INT), 6) AS coverage, sum(measurable::INT)::BIGINT AS n_measurable,
    CASE WHEN avg(measurable::INT) >= 0.1 THEN round(10 * log10(avg(CASE WHEN measurable THEN excess END)), 6) END AS signal_level_db
    FROM m GROUP BY node"""
)
def floor_summary(spark, d):
    return levels.floor_summary(levels.floor_corrected(tables.numbered(spark, d), NODE, 61), NODE)


@query(
    """WITH {s}, f AS (SELECT node, min(level_db) OVER (PARTITION BY node ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + 1.5 AS a,
    CASE WHEN n <= 201 THEN min(level_db) OVER (PARTITION BY node) ELSE
    min(level_db) OVER (PARTITION BY node ORDER BY i ROWS BETWEEN 100 PRECEDING AND 100 FOLLOWING) END + 1.5 AS b FROM s),
    g AS (SELECT node, round(quantile_cont(b, 0.5), 6) AS self_noise_db, round(avg((a - b >= 3)::INT), 6) AS machine_duty,
    round(quantile_cont(CASE WHEN a - b >= 3 THEN a - b END, 0.5), 6) AS steady_excess_db FROM f GROUP BY node)
    SELECT *, machine_duty > 0.02 AND machine_duty < 0.98 AS machine_detected FROM g"""
)
def steady_sources(spark, d):
    return levels.steady_sources(tables.numbered(spark, d), NODE, short=11, long=201)


@query(
    """WITH {s}, q AS (SELECT node, quantile_cont(level_db, 0.05) AS fl FROM s GROUP BY node)
    SELECT node, round(fl, 6) AS floor_db, round(avg((level_db - fl <= 3)::INT), 6) AS at_floor_fraction,
    round(quantile_cont(level_db - fl, 0.5), 6) AS median_above_floor_db FROM s JOIN q USING (node) GROUP BY node, fl"""
)
def floor_occupancy(spark, d):
    return levels.floor_occupancy(tables.levels(spark, d), NODE)


@query(
    """WITH {s}, c AS (SELECT node, (i - 1) // 100 AS chunk, quantile_cont(level_db, 0.1) AS fl FROM s WHERE (i - 1) // 100 < n // 100 GROUP BY ALL),
    g AS (SELECT node, count(*) AS chunks, quantile_cont(fl, 0.5) - quantile_cont(fl, 0.05) AS sp, quantile_cont(fl, 0.5) AS md FROM c GROUP BY node)
    SELECT node, chunks, round(sp, 6) AS floor_spread_db, round(md, 6) AS floor_median_db, chunks >= 6 AND sp < 1.5 AND md > -119 AS floor_suspect FROM g"""
)
def floor_suspicion(spark, d):
    return levels.floor_spread(tables.numbered(spark, d), NODE, 100)


@query(
    """WITH {s}, q AS (SELECT node, user_id, quantile_cont(level_db, 0.05) AS low FROM s GROUP BY ALL)
    SELECT node, arg_min(user_id, (low, user_id)) AS user_id, round(min(low), 6) AS low_db FROM q GROUP BY node"""
)
def quietest_channel(spark, d):
    return levels.quietest(tables.levels(spark, d), NODE, "user_id")


OTSU = """ends AS (SELECT node, quantile_cont(level_db, 0.005) AS lo, quantile_cont(level_db, 0.995) AS hi FROM s GROUP BY node),
h AS (SELECT node, least(floor((level_db - lo) / ((hi - lo) / 128))::INT, 127) AS k, count(*) AS c FROM s JOIN ends USING (node)
    WHERE level_db >= lo AND level_db <= hi GROUP BY ALL),
cells AS (SELECT ends.node, lo, hi, r.k, coalesce(c, 0) AS c FROM ends CROSS JOIN (SELECT range::INT AS k FROM range(128)) r
    LEFT JOIN h ON h.node = ends.node AND h.k = r.k),
pm AS (SELECT node, k, c / sum(c) OVER (PARTITION BY node) AS p, lo + (k + 0.5) * ((hi - lo) / 128) AS x FROM cells),
cum AS (SELECT node, k, sum(p) OVER w AS w0, sum(p * x) OVER w AS mu, sum(p * x) OVER (PARTITION BY node) AS mt FROM pm
    WINDOW w AS (PARTITION BY node ORDER BY k ROWS UNBOUNDED PRECEDING)),
best AS (SELECT node, arg_max((w0, mu, mt), (round(pow(mt * w0 - mu, 2) / (w0 * (1 - w0) + 1e-20), 9), -k)) AS z FROM cum GROUP BY node),
th AS (SELECT node, (z[2] / (z[1] + 1e-20) + (z[3] - z[2]) / (1 - z[1] + 1e-20)) / 2 AS threshold_db FROM
    (SELECT node, [z[1], z[2], z[3]] AS z FROM best))"""


@query("WITH {s}, " + OTSU + " SELECT node, round(threshold_db, 6) AS threshold_db FROM th")
def otsu_threshold(spark, d):
    return states.otsu(tables.levels(spark, d), NODE)


@query(
    "WITH {s}, " + OTSU + """, g AS (SELECT node, threshold_db, avg(CASE WHEN level_db <= threshold_db THEN level_db END) AS lo,
    avg(CASE WHEN level_db > threshold_db THEN level_db END) AS hi, avg((level_db > threshold_db)::INT) AS fr
    FROM s JOIN th USING (node) GROUP BY ALL)
    SELECT node, round(threshold_db, 6) AS threshold_db, round(lo, 6) AS lower_mean_db, round(hi, 6) AS upper_mean_db,
    round(fr, 6) AS upper_fraction, round(hi - lo, 6) AS separation_db, hi - lo >= 2 AND fr BETWEEN 0.02 AND 0.98 AS bimodal FROM g"""
)
def bimodal_separation(spark, d):
    return states.separation(tables.levels(spark, d), NODE)


SEGMENTS = """pad AS (
    SELECT node, i, n, level_db FROM s
    UNION ALL SELECT node, 1 - k, n, level_db FROM s, range(1, 6) r(k) WHERE i = 1
    UNION ALL SELECT node, n + k, n, level_db FROM s, range(1, 6) r(k) WHERE i = n
), sm AS (
    SELECT node, i, n, list_sort(list(level_db) OVER (PARTITION BY node ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))[6] AS v FROM pad
), q AS (SELECT node, quantile_cont(level_db, 0.5) AS th FROM s GROUP BY node
), fl AS (
    SELECT sm.node, i, n, CASE WHEN v < th - 0.5 THEN 0 WHEN v > th + 0.5 THEN 1 WHEN i = 1 THEN (v > th)::INT END AS f
    FROM sm JOIN q USING (node) WHERE i BETWEEN 1 AND n
), o AS (SELECT node, i, n, last_value(f IGNORE NULLS) OVER (PARTITION BY node ORDER BY i) AS st FROM fl
), r0 AS (SELECT *, CASE WHEN st IS DISTINCT FROM lag(st) OVER (PARTITION BY node ORDER BY i) OR i = 1 THEN 1 ELSE 0 END AS nw FROM o
), r1 AS (SELECT *, sum(nw) OVER (PARTITION BY node ORDER BY i) AS run FROM r0
), rr AS (SELECT node, run, any_value(st) AS st, any_value(n) AS n, min(i) AS a, max(i) AS z FROM r1 GROUP BY node, run
), ab AS (
    SELECT *, last_value(CASE WHEN z - a + 1 >= 6 OR a = 1 OR z = n THEN st END IGNORE NULLS) OVER (PARTITION BY node ORDER BY run) AS fin FROM rr
), nn AS (SELECT *, CASE WHEN fin IS DISTINCT FROM lag(fin) OVER (PARTITION BY node ORDER BY run) THEN 1 ELSE 0 END AS nw FROM ab
), sg AS (SELECT *, sum(nw) OVER (PARTITION BY node ORDER BY run) AS segment FROM nn
), seg AS (
    SELECT node, segment::BIGINT AS segment, min(s.i) - 1 AS t0, count(*) AS rows, quantile_cont(level_db, 0.5) AS median_db,
           stddev_pop(level_db) AS sd_db, CASE WHEN any_value(fin) = 1 THEN 'on' ELSE 'off' END AS state
    FROM s JOIN r1 USING (node, i) JOIN sg USING (node, run) GROUP BY node, segment
)"""


def _segments(spark, d):
    rows = tables.numbered(spark, d)
    middle = rows.groupBy("node").agg(F.percentile("level_db", 0.5).alias("threshold_db"))
    return states.segments(rows, NODE, middle, smooth=11, min_rows=6)


@query("WITH {s}, {seg} SELECT node, segment, t0, rows, round(median_db, 6) AS median_db, round(sd_db, 6) AS sd_db, state FROM seg")
def state_segments(spark, d):
    return _segments(spark, d).withColumn("segment", F.col("segment").cast("bigint"))


@query(
    """WITH {s}, {seg}, x AS (SELECT *, median_db - lag(median_db) OVER (PARTITION BY node ORDER BY segment) AS step FROM seg)
    SELECT node, t0, state AS direction, round(step, 6) AS step_db FROM x WHERE segment > 1"""
)
def switch_points(spark, d):
    return states.switch_points(_segments(spark, d), NODE)


@query(
    """WITH {s}, {seg}, x AS (SELECT *, lead(t0) OVER (PARTITION BY node ORDER BY segment) - t0 AS pr FROM seg WHERE state = 'on')
    SELECT node, round(quantile_cont(pr, 0.5), 6) AS period, count(*) AS n_cycles,
    round(quantile_cont(rows, 0.5) / quantile_cont(pr, 0.5), 6) AS duty FROM x GROUP BY node"""
)
def duty_cycle(spark, d):
    return states.duty_cycle(_segments(spark, d), NODE)


@query(
    """WITH {s}, {seg}, x AS (SELECT *, segment = max(segment) OVER (PARTITION BY node) AS cut FROM seg),
    y AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY segment) - 1.0 AS k,
    lead(t0) OVER (PARTITION BY node ORDER BY segment) - t0 AS pr, CASE WHEN NOT cut THEN rows END AS ln FROM x WHERE state = 'on')
    SELECT node, count(*) AS n_cycles,
    CASE WHEN count(ln) >= 3 THEN round(CASE WHEN stddev_pop(ln) = 0 THEN 0 ELSE corr(k, ln) END, 6) END AS on_rho,
    CASE WHEN count(ln) >= 3 THEN round(CASE WHEN stddev_pop(ln) = 0 THEN 0 ELSE regr_slope(ln, k) END, 6) END AS on_per_cycle,
    CASE WHEN count(ln) >= 3 THEN (max(ln) - min(ln))::DOUBLE END AS on_spread,
    CASE WHEN count(pr) >= 3 THEN round(CASE WHEN stddev_pop(pr) = 0 THEN 0 ELSE corr(k, pr) END, 6) END AS period_rho,
    CASE WHEN count(pr) >= 3 THEN round(CASE WHEN stddev_pop(pr) = 0 THEN 0 ELSE regr_slope(pr, k) END, 6) END AS period_per_cycle,
    CASE WHEN count(pr) >= 3 THEN (max(pr) - min(pr))::DOUBLE END AS period_spread,
    bool_or(cut) AS truncated_final_run FROM y GROUP BY node"""
)
def cycle_series(spark, d):
    return states.cycle_series(_segments(spark, d), NODE)


@query(
    """WITH {s}, g AS (SELECT *, i - row_number() OVER (PARTITION BY node, level_db > 20 ORDER BY i) AS grp FROM s)
    SELECT node, round(min(t), 6) AS a, round(max(t) + 1, 6) AS b FROM g WHERE level_db > 20 GROUP BY node, grp"""
)
def intervals_from_mask(spark, d):
    return events.intervals(tables.numbered(spark, d), NODE, "t", F.col("level_db") > 20)


@query(
    """WITH {s}, x AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY node ORDER BY i) <= 3600 THEN 0 ELSE 1 END AS nw FROM s),
    y AS (SELECT *, sum(nw) OVER (PARTITION BY node ORDER BY i) AS session FROM x)
    SELECT node, session::BIGINT AS session, round(min(t), 6) AS start, round(max(t), 6) AS "end", count(*) AS rows FROM y GROUP BY ALL"""
)
def gap_sessions(spark, d):
    out = events.sessions(tables.numbered(spark, d), NODE, "t", 3600.0)
    return out.withColumn("session", F.col("session").cast("bigint"))


@query(
    """WITH {s}, x AS (SELECT node, CASE WHEN hour(ts) >= 22 OR hour(ts) < 6 THEN 'night' ELSE 'day' END AS state, level_db FROM s)
    SELECT node, state, grouping(state)::INT AS pooled, count(*) AS frames, round(10 * log10(avg(pow(10, level_db / 10))), 6) AS leq_db
    FROM x GROUP BY GROUPING SETS ((node), (node, state))"""
)
def diel_states(spark, d):
    rows = tables.levels(spark, d)
    night = (F.hour("ts") >= 22) | (F.hour("ts") < 6)
    rows = rows.withColumn("state", F.when(night, "night").otherwise("day"))
    both = rows.groupingSets([["node"], ["node", "state"]], "node", "state")
    return both.agg(
        F.grouping("state").cast("int").alias("pooled"), F.count("*").alias("frames"), (10 * F.log10(F.avg(power(F.col("level_db"))))).alias("leq_db")
    )


@query(
    """WITH {s}, x AS (SELECT node, 2 * pi() * (t % 86400) / 86400 AS a, p FROM s),
    g AS (SELECT node, sum(p * cos(a)) / (sum(p) + 1e-20) AS c, sum(p * sin(a)) / (sum(p) + 1e-20) AS z FROM x GROUP BY node)
    SELECT node, round(atan2(z, c), 6) AS mean_angle, round(sqrt(c * c + z * z), 6) AS r FROM g"""
)
def circular_mean(spark, d):
    return circular.mean_direction(tables.levels(spark, d), NODE, tables.hour_angle(F.col("t")), F.col("p"))


@query(
    """WITH {s}, x AS (SELECT node, 2 * pi() * ((t / 3600) - floor(t / 3600)) AS a FROM s),
    g AS (SELECT node, avg(cos(a)) AS c, avg(sin(a)) AS z, count(*) AS n FROM x GROUP BY node), h AS (SELECT *, sqrt(c * c + z * z) AS r FROM g)
    SELECT node, round(((atan2(z, c) / (2 * pi())) % 1 + 1) % 1, 6) AS mean_phase, round(r, 6) AS r,
    round(sqrt(-2 * ln(greatest(r, 1e-20))) * 3600 / (2 * pi()), 6) AS circ_sd_s,
    round(least(exp(sqrt(1 + 4.0 * n + 4 * (n * n - pow(n * r, 2))) - (1 + 2 * n)), 1), 6) AS rayleigh_p, n FROM h"""
)
def phase_stats(spark, d):
    return circular.phase_stats(tables.levels(spark, d), NODE, "t", 3600.0)


PERIODS = [1800.0, 3600.0, 7200.0, 14400.0, 43200.0, 86400.0, 604800.0]


@query(
    """WITH {s}, x AS (SELECT node, v AS period, k, 2 * pi() * (t / v - floor(t / v)) AS a FROM s,
    (SELECT unnest([1800.0, 3600, 7200, 14400, 43200, 86400, 604800])::DOUBLE AS v, unnest([0, 1, 2, 3, 4, 5, 6]) AS k)),
    g AS (SELECT node, period, k, sqrt(pow(avg(cos(a)), 2) + pow(avg(sin(a)), 2)) AS r FROM x GROUP BY ALL)
    SELECT node, arg_max(period, (r, -k)) AS period, round(max(r), 6) AS r FROM g GROUP BY node"""
)
def best_period(spark, d):
    return circular.best_period(tables.levels(spark, d), NODE, "t", PERIODS)


@query(
    """WITH {s}, x AS (SELECT node, 2 * pi() * (t % 86400) / 86400 AS a, 2 * pi() * (t % 3600) / 3600 AS b FROM s),
    m AS (SELECT node, atan2(sum(sin(a)), sum(cos(a))) AS ma, atan2(sum(sin(b)), sum(cos(b))) AS mb FROM x GROUP BY node)
    SELECT node, round(sum(sin(a - ma) * sin(b - mb)) / sqrt(sum(pow(sin(a - ma), 2)) * sum(pow(sin(b - mb), 2))), 6) AS circ_corr
    FROM x JOIN m USING (node) GROUP BY node""",
    digits=6,
)
def circular_correlation(spark, d):
    import math

    t = F.col("t")
    return circular.correlation(
        tables.levels(spark, d), NODE, tables.hour_angle(t), 2 * math.pi * F.pmod(t, F.lit(3600.0)) / 3600.0
    )


@query(
    """WITH {s}, nd AS (SELECT DISTINCT node AS ref FROM s), c AS (SELECT s.node, nd.ref, s.t FROM s JOIN nd ON s.node <> nd.ref), r AS (SELECT node AS ref, t FROM s),
    f AS (SELECT ref, min(t) AS f0 FROM r GROUP BY ref), k AS (SELECT c.node, c.ref, c.t, r.t AS m FROM c ASOF LEFT JOIN r ON c.ref = r.ref AND c.t >= r.t),
    j AS (SELECT k.node, k.ref, k.t - coalesce(k.m, f0) AS b FROM k JOIN f ON k.ref = f.ref),
    g AS (SELECT node, ref, avg(cos(2 * pi() * (b / 600 - floor(b / 600)))) AS c, avg(sin(2 * pi() * (b / 600 - floor(b / 600)))) AS z, count(*) AS n FROM j GROUP BY node, ref),
    h AS (SELECT *, sqrt(c * c + z * z) AS r FROM g)
    SELECT node, ref, round(((atan2(z, c) / (2 * pi())) % 1 + 1) % 1, 6) AS mean_phase, round(r, 6) AS r,
    round(sqrt(-2 * ln(greatest(r, 1e-20))) * 600 / (2 * pi()), 6) AS circ_sd_s,
    round(least(exp(sqrt(1 + 4.0 * n + 4 * (n * n - pow(n * r, 2))) - (1 + 2 * n)), 1), 6) AS rayleigh_p, n FROM h"""
)
def relative_phase(spark, d):
    rows = tables.levels(spark, d).select("node", "t")
    nodes = rows.select(F.col("node").alias("ref")).distinct()
    times = rows.join(F.broadcast(nodes), F.col("node") != F.col("ref"))
    refs = times.select(F.col("ref").alias("node"), F.col("node").alias("ref"), "t")
    return circular.relative_phase(times, refs, ["node", "ref"], "t", 600.0)


ENTROPY = """x AS (SELECT node, p, least(floor((360 * (t % 86400) / 86400 - 180 + 180.0) / (360.0 / 36))::INT, 35) AS cell, level_db FROM s),
c AS (SELECT node, cell, sum(p) AS w FROM x GROUP BY ALL), pp AS (SELECT node, cell, w / sum(w) OVER (PARTITION BY node) AS p FROM c)"""


@query("WITH {s}, " + ENTROPY + " SELECT node, round(-sum(p * ln(p)) / ln(36), 6) AS entropy FROM pp WHERE p > 0 GROUP BY node")
def azimuth_entropy(spark, d):
    return circular.directional_entropy(tables.levels(spark, d), NODE, tables.azimuth(F.col("t")), F.col("p"))


@query(
    """WITH {s}, x AS (SELECT node, p, (360 * (t % 86400) / 86400 - 180) / 2 AS el FROM s)
    SELECT node, round(sum(CASE WHEN el > 10 THEN p ELSE 0 END) / (sum(p) + 1e-20), 6) AS above,
    round(sum(CASE WHEN abs(el) <= 10 THEN p ELSE 0 END) / (sum(p) + 1e-20), 6) AS near,
    round(sum(CASE WHEN el < -10 THEN p ELSE 0 END) / (sum(p) + 1e-20), 6) AS below FROM x GROUP BY node"""
)
def horizon_fractions(spark, d):
    return circular.horizon_fractions(tables.levels(spark, d), NODE, tables.azimuth(F.col("t")) / 2, F.col("p"))


@query(
    """WITH {s}, q AS (SELECT node, quantile_cont(level_db, 0.75) AS hi, quantile_cont(level_db, 0.25) AS lo FROM s GROUP BY node),
    x AS (SELECT s.node, p, least(floor((360 * (t % 86400) / 86400) / 10)::INT, 35) AS cell, level_db >= hi AS loud, level_db <= lo AS quiet
    FROM s JOIN q USING (node)),
    a AS (SELECT node, cell, sum(p) AS w FROM x WHERE loud GROUP BY ALL), b AS (SELECT node, cell, sum(p) AS w FROM x WHERE quiet GROUP BY ALL),
    pa AS (SELECT node, cell, w / sum(w) OVER (PARTITION BY node) AS p FROM a), pb AS (SELECT node, cell, w / sum(w) OVER (PARTITION BY node) AS p FROM b)
    SELECT node, round(sum(sqrt(pa.p * pb.p)), 6) AS overlap FROM pa JOIN pb USING (node, cell) GROUP BY node"""
)
def foreground_overlap(spark, d):
    rows = tables.levels(spark, d)
    ends = rows.groupBy("node").agg(F.percentile("level_db", 0.75).alias("hi"), F.percentile("level_db", 0.25).alias("lo"))
    rows = rows.join(ends, "node")
    loud, quiet = F.col("level_db") >= F.col("hi"), F.col("level_db") <= F.col("lo")
    return circular.overlap(rows, NODE, tables.azimuth(F.col("t")), F.col("p"), loud, quiet)


@query(
    """WITH {s}, w AS (SELECT node, unnest(range(0, greatest((n - 60) // 20, 0) + 1)) AS w FROM s WHERE i = 1),
    x AS (SELECT s.node, w.w AS "window", 2 * pi() * (t % 86400) / 86400 AS a, p FROM s JOIN w ON s.node = w.node AND i - 1 >= w.w * 20 AND i - 1 < w.w * 20 + 60),
    g AS (SELECT node, "window", count(*) AS rows, sum(p * cos(a)) / (sum(p) + 1e-20) AS c, sum(p * sin(a)) / (sum(p) + 1e-20) AS z FROM x GROUP BY ALL)
    SELECT node, "window", rows, round(atan2(z, c), 6) AS mean_angle, round(sqrt(c * c + z * z), 6) AS r FROM g"""
)
def azimuth_organization(spark, d):
    return circular.organisation(tables.numbered(spark, d), NODE, tables.hour_angle(F.col("t")), F.col("p"))


@query(
    """WITH {s}, e AS (SELECT node, min(t) AS a, max(t) AS z FROM s GROUP BY node), m AS (SELECT node, quantile_cont(level_db, 0.5) AS bg FROM s GROUP BY node),
    k AS (SELECT node, a, z, unnest(range(ceil(a / 21600)::BIGINT, floor(z / 21600)::BIGINT + 1)) * 21600.0 AS tick FROM e),
    x AS (SELECT k.node, tick, t, level_db - bg AS rise FROM k JOIN s ON s.node = k.node AND t BETWEEN tick - 1800 AND tick + 1800 JOIN m ON m.node = s.node)
    SELECT node, tick::DOUBLE AS tick, round(max(rise), 6) AS rise_db, round(arg_max(t, (rise, -t)) - tick, 6) AS offset_s, max(rise) >= 6 AS detected FROM x GROUP BY node, tick"""
)
def grid_scan(spark, d):
    rows = tables.levels(spark, d)
    middle = rows.groupBy("node").agg(F.percentile("level_db", 0.5).alias("bg"))
    return circular.grid_scan(rows.join(middle, "node"), NODE, "t", "level_db", "bg", 21600.0, window=3600.0)


@query(
    """WITH {s}, z AS (SELECT node, min(t) AS a, min(t) + 36000 AS b FROM s GROUP BY node UNION ALL
    SELECT node, max(t) - 90000 AS a, max(t) AS b FROM s GROUP BY node)
    SELECT s.node, s.event_id FROM s WHERE EXISTS (SELECT 1 FROM z WHERE z.node = s.node AND s.t >= z.a AND s.t < z.b)"""
)
def interval_semi_join(spark, d):
    rows = tables.levels(spark, d)
    ends = rows.groupBy("node").agg(F.min("t").alias("x"), F.max("t").alias("y"))
    spans = ends.select("node", F.col("x").alias("a"), (F.col("x") + 36000).alias("b")).unionByName(
        ends.select("node", (F.col("y") - 90000).alias("a"), F.col("y").alias("b"))
    )
    return intervals.inside(rows, spans, NODE, "t").select("node", "event_id")


SHIP = """lst AS (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY 1), sp AS (
    SELECT o_orderkey, o_custkey, o_orderpriority AS priority, epoch_us(o_orderdate) / 1e6 AS a, epoch_us(last) / 1e6 AS b
    FROM orders JOIN lst ON o_orderkey = l_orderkey WHERE last > o_orderdate)"""


@query(
    "WITH " + SHIP + """, c AS (SELECT 'slow' AS class, 0.0 AS a, 820454400.0 + 86400 * 400 AS b UNION ALL SELECT 'fast', 820454400.0 + 86400 * 200, 4e9),
    t AS (SELECT priority, sum(b - a) AS total FROM sp GROUP BY 1),
    o AS (SELECT priority, class, sum(least(sp.b, c.b) - greatest(sp.a, c.a)) AS ov FROM sp JOIN c ON least(sp.b, c.b) > greatest(sp.a, c.a) GROUP BY ALL)
    SELECT priority, class, round(ov, 3) AS overlap_s, round(ov / total, 6) AS share FROM o JOIN t USING (priority)"""
)
def overlap_shares(spark, d):
    start = 820454400.0
    classes = spark.createDataFrame(
        [("slow", 0.0, start + 86400 * 400), ("fast", start + 86400 * 200, 4e9)], "class string, a double, b double"
    )
    out = intervals.overlap_shares(tables.shipping(spark, d), classes, ["priority"], "class", width=86400.0 * 50)
    return out.withColumn("overlap_s", F.round("overlap_s", 3))


@query(
    "WITH " + SHIP + """, g AS (SELECT priority, sum(b - a) AS sec FROM sp GROUP BY 1)
    SELECT CASE WHEN sec >= 0.2 * (SELECT sum(sec) FROM g) THEN priority ELSE 'other' END AS lane, round(sum(sec), 3) AS seconds FROM g GROUP BY 1"""
)
def activity_lanes(spark, d):
    return intervals.lanes(tables.shipping(spark, d), "priority", "a", "b", min_share=0.2).withColumn("seconds", F.round("seconds", 3))


@query(
    """WITH {s}, nd AS (SELECT DISTINCT node AS ref FROM s), c AS (SELECT event_id, nd.ref, t FROM s JOIN nd ON s.node <> nd.ref),
    r AS (SELECT node AS ref, t, arg_max(level_db, event_id) AS level_db FROM s GROUP BY ALL)
    SELECT event_id, c.ref, round(r.t, 6) AS matched_t, round(r.level_db, 6) AS matched FROM c ASOF LEFT JOIN r ON c.ref = r.ref AND c.t >= r.t"""
)
def as_of_join(spark, d):
    rows = tables.levels(spark, d).select("node", "t", "event_id", "level_db")
    right = rows.groupBy(F.col("node").alias("ref"), "t").agg(F.max_by("level_db", "event_id").alias("level_db"))
    nodes = rows.select(F.col("node").alias("ref")).distinct()
    left = rows.join(F.broadcast(nodes), F.col("node") != F.col("ref")).select("ref", "t", "event_id")
    return intervals.as_of(left, right, ["ref"], "t", "level_db").select("event_id", "ref", "matched_t", "matched")


MATRIX = """mm AS (SELECT node, floor(t / 21600)::BIGINT AS bin, 10 * log10(avg(pow(10, level_db / 10))) AS level_db FROM s GROUP BY ALL HAVING count(*) > 10),
md AS (SELECT node, quantile_cont(level_db, 0.5) AS m FROM mm GROUP BY node), fl AS (SELECT node, quantile_cont(level_db, 0.05) AS floor_db FROM s GROUP BY node)"""


def _matrix(spark, d):
    return network.day_matrix(tables.levels(spark, d), "node", "t", "level_db", bin_s=21600.0, min_rows=10)


@query("WITH {s}, " + MATRIX + " SELECT node, bin, round(level_db, 6) AS level_db, round(level_db - m, 6) AS height_db FROM mm JOIN md USING (node)")
def xnode_matrix(spark, d):
    return _matrix(spark, d)


@query(
    "WITH {s}, " + MATRIX + """, r AS (SELECT node, bin, level_db, row_number() OVER w AS r, lead(level_db) OVER w AS nx, count(*) OVER (PARTITION BY bin) AS c
    FROM mm WINDOW w AS (PARTITION BY bin ORDER BY level_db DESC, node))
    SELECT bin, CASE WHEN level_db - nx > 1 AND level_db - floor_db >= 3 THEN node END AS winner, round(level_db - nx, 6) AS lead_db
    FROM r JOIN fl USING (node) WHERE r = 1 AND c >= 2"""
)
def xnode_loudest(spark, d):
    return network.loudest(_matrix(spark, d), network.floors(tables.levels(spark, d), "node", "level_db"), "node", margin_db=1.0)


@query("WITH {s}, " + MATRIX + " SELECT node, round(floor_db, 6) AS floor_db, round(floor_db - (SELECT quantile_cont(floor_db, 0.5) FROM fl), 6) AS gain_offset_db FROM fl")
def xnode_gain_offsets(spark, d):
    return network.gain_offsets(network.floors(tables.levels(spark, d), "node", "level_db"), "node")


@query("WITH {s} SELECT node, round_even(t / 3600, 0)::BIGINT AS k, round(arg_max(level_db, t), 6) AS level_db FROM s GROUP BY ALL")
def node_grid(spark, d):
    return network.grid(tables.levels(spark, d), "node", "t", "level_db", 3600.0)


PAIRS = """g AS (SELECT node, round_even(t / 3600, 0)::BIGINT AS k, arg_max(level_db, t) AS x FROM s GROUP BY ALL),
h AS (SELECT node, k // 72 AS w, avg(x) AS m FROM g GROUP BY ALL HAVING count(*) >= 0.2 * 72),
y AS (SELECT h.node, h.w, z.s, coalesce(g.x, m) - m AS x FROM h CROSS JOIN (SELECT range AS s FROM range(72)) z LEFT JOIN g ON g.node = h.node AND g.k = h.w * 72 + z.s),
sl AS (SELECT node, w, sum(x * (s - 35.5)) / (72 * (72 * 72 - 1) / 12.0) AS b FROM y GROUP BY ALL),
v AS (SELECT y.node, y.w, s, x - b * (s - 35.5) AS x FROM y JOIN sl ON y.node = sl.node AND y.w = sl.w),
sd AS (SELECT node, w, sqrt(avg(x * x)) AS sd FROM v GROUP BY ALL HAVING sqrt(avg(x * x)) > 1e-6),
cc AS (SELECT p.w, p.node AS a, q.node AS b, l.lag, sum(p.x * q.x) / ((72 - abs(l.lag)) * any_value(c.sd) * any_value(d.sd)) AS r
    FROM v p CROSS JOIN (SELECT range - 3 AS lag FROM range(7)) l JOIN v q ON q.w = p.w AND q.s = p.s + l.lag AND p.node < q.node
    JOIN sd c ON c.node = p.node AND c.w = p.w JOIN sd d ON d.node = q.node AND d.w = q.w GROUP BY p.w, p.node, q.node, l.lag),
bt AS (SELECT w, a, b, bx.r, bx.lag FROM (SELECT w, a, b, arg_max({r: r, lag: lag}, (round(r, 9), lag)) AS bx FROM cc GROUP BY w, a, b)),
pr AS (SELECT bt.w AS "window", bt.a, bt.b, least(bt.r, 1) AS coupling, bt.lag + CASE WHEN abs(bt.lag) < 3 AND x.r - 2 * bt.r + z.r < 0
    THEN 0.5 * (x.r - z.r) / (x.r - 2 * bt.r + z.r) ELSE 0 END AS lag FROM bt LEFT JOIN cc x ON x.w = bt.w AND x.a = bt.a AND x.b = bt.b AND x.lag = bt.lag - 1
    LEFT JOIN cc z ON z.w = bt.w AND z.a = bt.a AND z.b = bt.b AND z.lag = bt.lag + 1)"""


def _pairs(spark, d):
    on_grid = network.grid(tables.levels(spark, d), "node", "t", "level_db", 3600.0)
    return network.pairwise(on_grid, "node", window=72, max_lag=3, min_coverage=0.2)


@query("WITH {s}, " + PAIRS + ' SELECT "window", a, b, round(coupling, 6) AS coupling, round(lag, 6) AS lag FROM pr')
def pairwise_coupling(spark, d):
    return _pairs(spark, d)


@query("WITH {s}, " + PAIRS + ' SELECT "window", round(sum((coupling >= 0.2)::INT) / 10.0, 6) AS density, count(*) AS pairs FROM pr GROUP BY 1')
def graph_density(spark, d):
    return network.density(_pairs(spark, d), 5, threshold=0.2)


@query(
    "WITH {s}, " + PAIRS + """, e AS (SELECT "window" AS w, a, b FROM pr WHERE coupling >= 0.2), dg AS (SELECT w, n, count(*) AS d FROM
    (SELECT w, a AS n FROM e UNION ALL SELECT w, b FROM e) GROUP BY ALL), pt AS (SELECT w, sum(d * (d - 1) / 2) AS paths FROM dg GROUP BY w),
    tr AS (SELECT p.w, count(*) AS c FROM e p JOIN e q ON p.w = q.w AND p.b = q.a JOIN e r ON r.w = p.w AND r.a = p.a AND r.b = q.b GROUP BY 1)
    SELECT w AS "window", coalesce(c, 0) AS triangles, CASE WHEN paths > 0 THEN round(3 * coalesce(c, 0) / paths, 6) END AS transitivity
    FROM pt LEFT JOIN tr USING (w)"""
)
def graph_transitivity(spark, d):
    return network.transitivity(_pairs(spark, d), threshold=0.2)


@query(
    "WITH {s}, " + PAIRS + """, t AS (SELECT ("window" * 3) % 24 AS hour, * FROM pr), ends AS (SELECT hour, "window", a AS node, coupling FROM t UNION ALL
    SELECT hour, "window", b, coupling FROM t), st AS (SELECT hour, "window", node, sum(coupling) AS st FROM ends GROUP BY ALL),
    md AS (SELECT hour, node, round(quantile_cont(st, 0.5), 9) AS strength FROM st GROUP BY ALL)
    SELECT hour, arg_max(node, (strength, -rk)) AS hub, round(max(strength), 6) AS strength FROM
    (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY node) AS rk FROM md) GROUP BY hour"""
)
def hourly_hub(spark, d):
    return network.hubs(_pairs(spark, d), F.pmod(F.col("window") * 3, F.lit(24)))


@query(
    """WITH {s}, z AS (SELECT min(t) + 864000 AS t0 FROM s), bs AS (SELECT node, quantile_cont(level_db, 0.5) AS base FROM s, z WHERE t >= t0 - 864000 AND t < t0 GROUP BY node),
    c AS (SELECT floor((t - t0) / 3600)::BIGINT AS sl, node, quantile_cont(level_db, 0.5) AS l FROM s, z WHERE t >= t0 AND t < t0 + 864000 GROUP BY ALL),
    r AS (SELECT sl, node, l - base AS rise, row_number() OVER (PARTITION BY sl ORDER BY l - base DESC, node) AS rk FROM c JOIN bs USING (node)),
    w AS (SELECT * FROM r WHERE rk = 1 AND rise >= 3), n AS (SELECT *, CASE WHEN node IS NOT DISTINCT FROM lag(node) OVER (ORDER BY sl) THEN 0 ELSE 1 END AS nw FROM w),
    g AS (SELECT *, sum(nw) OVER (ORDER BY sl) AS stay FROM n)
    SELECT stay::BIGINT AS stay, node, round(min(sl) * 3600.0, 6) AS from_s, round((max(sl) + 1) * 3600.0, 6) AS to_s, round(max(rise), 6) AS peak_rise_db FROM g GROUP BY stay, node"""
)
def follow_source(spark, d):
    rows = tables.levels(spark, d)
    start = rows.agg(F.min("t")).first()[0] or 0.0
    start += 864000.0
    out = network.follow(rows, "node", "t", "level_db", start, start + 864000.0, baseline_s=864000.0, slice_s=3600.0, rise_db=3.0)
    return out.withColumns({"stay": F.col("stay").cast("bigint"), "from_s": F.col("from_s") - start, "to_s": F.col("to_s") - start})


USERS = "u AS (SELECT user_id, count(*) AS events, round(avg(value), 6) AS mean_value, max(value) AS top_value FROM events GROUP BY 1)"


@query("WITH " + USERS + " SELECT user_id, mean_value FROM u WHERE mean_value IS NOT NULL ORDER BY mean_value DESC, user_id")
def catalog_rank(spark, d):
    return corpus.rank(tables.users(spark, d), "user_id", "mean_value")


@query(
    "WITH " + USERS + """, x AS (SELECT user_id, mean_value, round((mean_value - avg(mean_value) OVER ()) / stddev_pop(mean_value) OVER (), 2) AS z FROM u)
    SELECT * FROM x WHERE abs(z) >= 1.5"""
)
def catalog_outliers(spark, d):
    return corpus.outliers(tables.users(spark, d), "user_id", "mean_value")


@query(
    "WITH " + USERS + """ SELECT user_id, 'events' AS key, events::DOUBLE AS value FROM u UNION ALL SELECT user_id, 'mean_value', mean_value FROM u
    UNION ALL SELECT user_id, 'top_value', top_value FROM u"""
)
def catalog_long(spark, d):
    return corpus.long_form(tables.users(spark, d), "user_id")


@query(
    "WITH " + USERS + """, l AS (SELECT user_id, 'aci' AS key, 300.0 AS need, 'hard' AS kind, mean_value AS v, events FROM u UNION ALL
    SELECT user_id, 'L50', 60.0, 'soft', top_value, events FROM u)
    SELECT user_id, key, CASE WHEN NOT (events * 5 < need AND kind = 'hard') THEN v END AS value, events * 5 < need AS low_confidence FROM l"""
)
def validity_gate(spark, d):
    rows = tables.users(spark, d).withColumn("duration_s", F.col("events") * 5.0)
    wide = rows.select("user_id", F.col("mean_value").alias("aci"), F.col("top_value").alias("L50"))
    long = corpus.long_form(wide, "user_id").join(rows.select("user_id", "duration_s"), "user_id")
    return corpus.gate(long, "duration_s").select("user_id", "key", "value", "low_confidence")


TREND = """tr AS (SELECT priority, day, price, quantile_cont(price, 0.5) OVER (PARTITION BY priority ORDER BY day
    RANGE BETWEEN INTERVAL 182 DAYS PRECEDING AND INTERVAL 182 DAYS FOLLOWING) AS trend FROM d)"""


@query("WITH {day}, " + TREND + " SELECT priority, day::VARCHAR AS day, round(trend, 6) AS trend FROM tr")
def rolling_trend(spark, d):
    return corpus.rolling_trend(tables.dated(spark, d), ["priority"], "day", "price").select("priority", F.col("day").cast("string").alias("day"), "trend")


@query(
    """WITH {day}, p AS (SELECT DISTINCT priority, unnest(range(1, 13))::INT AS month FROM d), m AS (SELECT priority, month(day)::INT AS month, avg(price) AS mean, count(*) AS n FROM d GROUP BY ALL)
    SELECT priority, month, round(mean, 6) AS mean, coalesce(n, 0) AS n FROM p LEFT JOIN m USING (priority, month)"""
)
def climatology(spark, d):
    return corpus.climatology(tables.dated(spark, d), ["priority"], "day", "price")


@query(
    "WITH {day}, " + TREND + """, r AS (SELECT *, price - trend AS rest, month(day) AS mo FROM tr), mm AS (SELECT priority, mo, avg(rest) AS mn FROM r GROUP BY ALL),
    ce AS (SELECT priority, avg(mn) AS c FROM mm GROUP BY 1)
    SELECT priority, day::VARCHAR AS day, round(trend, 6) AS trend, round(mn - c, 6) AS seasonal, round(rest - (mn - c), 6) AS residual FROM r JOIN mm USING (priority, mo) JOIN ce USING (priority)"""
)
def decompose(spark, d):
    out = corpus.decompose(tables.dated(spark, d), ["priority"], "day", "price")
    return out.select("priority", F.col("day").cast("string").alias("day"), "trend", "seasonal", "residual")


@query("WITH {day} SELECT priority, round(regr_slope(price, (day - DATE '1970-01-01')::DOUBLE) * 365.25, 4) AS per_year, count(*) AS n FROM d GROUP BY 1", digits=4)
def trend_slope(spark, d):
    return corpus.trend_per_year(tables.dated(spark, d), ["priority"], "day", "price")


@query(
    """WITH {band}, x AS (SELECT *, (i - 1) // 10 AS chunk, abs(power - lag(power) OVER (PARTITION BY label, (i - 1) // 10, band ORDER BY i)) AS ch FROM b WHERE (i - 1) // 10 < n // 10),
    r AS (SELECT label, chunk, band, coalesce(sum(ch), 0) / (sum(power) + 1e-20) AS r FROM x GROUP BY ALL), c AS (SELECT label, chunk, sum(r) AS r FROM r GROUP BY ALL)
    SELECT label, round(avg(r), 6) AS aci FROM c GROUP BY label"""
)
def ecology_aci(spark, d):
    return ecology.complexity(tables.spectra(spark, d), ["label"], 10)


FC = ecology.centres(tables.EDGES)


@query(
    """WITH {band}, t AS (SELECT label, max(power) AS top FROM b GROUP BY 1), o AS (SELECT label, floor(fc / 1000) AS bin,
    avg((10 * log10(power / (top + 1e-20) + 1e-20) > -30)::INT) AS occ FROM b JOIN t USING (label) WHERE floor(fc / 1000) < 10 GROUP BY ALL),
    p AS (SELECT label, occ, occ / (sum(occ) OVER (PARTITION BY label) + 1e-20) AS p, row_number() OVER (PARTITION BY label ORDER BY occ, bin) AS r, count(*) OVER (PARTITION BY label) AS n FROM o)
    SELECT label, round(-sum(p * ln(p + 1e-20)) / ln(max(n) + 1e-20), 6) AS adi, round(sum((2 * r - n - 1) * occ) / (max(n) * sum(occ) + 1e-20), 6) AS aei FROM p GROUP BY label"""
)
def ecology_adi_aei(spark, d):
    return ecology.diversity(ecology.occupancy(tables.spectra(spark, d), ["label"], FC, limit_db=-30.0), ["label"])


@query(
    """WITH {band}, m AS (SELECT label, fc, avg(power) AS p FROM b GROUP BY ALL), g AS (SELECT label, sum(CASE WHEN fc >= 1000 AND fc < 2000 THEN p ELSE 0 END) AS a,
    sum(CASE WHEN fc >= 2000 AND fc < 8000 THEN p ELSE 0 END) AS c FROM m GROUP BY 1) SELECT label, round((c - a) / (c + a + 1e-20), 6) AS ndsi FROM g"""
)
def ecology_ndsi(spark, d):
    return ecology.difference_index(tables.spectra(spark, d), ["label"], FC)


@query(
    """WITH {band}, m AS (SELECT label, fc, 10 * log10(avg(power) + 1e-20) AS l FROM b WHERE fc >= 2000 AND fc <= 8000 GROUP BY ALL)
    SELECT label, round(sum(l) - count(*) * min(l), 6) AS bi FROM m GROUP BY label"""
)
def ecology_bi(spark, d):
    return ecology.area_index(tables.spectra(spark, d), ["label"], FC)


@query(
    """WITH {band}, m AS (SELECT label, band, avg(power) AS p FROM b GROUP BY ALL), ps AS (SELECT label, p / (sum(p) OVER (PARTITION BY label) + 1e-20) AS p FROM m),
    hf AS (SELECT label, -sum(p * ln(p + 1e-20)) / ln(count(*)) AS hf FROM ps GROUP BY 1), en AS (SELECT label, i, sum(power) AS w FROM b GROUP BY ALL),
    pe AS (SELECT label, w / (sum(w) OVER (PARTITION BY label) + 1e-20) AS p FROM en), ht AS (SELECT label, -sum(p * ln(p + 1e-20)) / ln(count(*)) AS ht FROM pe GROUP BY 1)
    SELECT label, round(hf * ht, 6) AS acoustic_entropy FROM hf JOIN ht USING (label)"""
)
def ecology_entropy(spark, d):
    return ecology.entropy(tables.spectra(spark, d), ["label"], "energy")


@query(
    """WITH {band}, x AS (SELECT label, band, quantile_cont(CASE WHEN i % 2 = 0 THEN power END, 0.5) AS a, quantile_cont(CASE WHEN i % 2 <> 0 THEN power END, 0.5) AS q FROM b GROUP BY ALL)
    SELECT label, band::INT AS band, round(10 * log10((a + 1e-20) / (q + 1e-20)), 6) AS masking_db FROM x"""
)
def masking_index(spark, d):
    return ecology.masking(tables.spectra(spark, d), ["label"], F.col("i") % 2 == 0)


@query(
    """WITH {band}, pad AS (SELECT label, band, i, n, power FROM b UNION ALL SELECT label, band, 1 - k, n, power FROM b, range(1, 11) r(k) WHERE i = 1
    UNION ALL SELECT label, band, n + k, n, power FROM b, range(1, 11) r(k) WHERE i = n),
    g AS (SELECT label, band, i, n, power, list_sort(list(power) OVER (PARTITION BY label, band ORDER BY i ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING))[3] AS bg FROM pad)
    SELECT label, i, round(sum(CASE WHEN 10 * log10((power + 1e-20) / (bg + 1e-20)) > 3 THEN power ELSE 0 END) / (sum(power) + 1e-20), 6) AS fg_fraction
    FROM g WHERE i BETWEEN 1 AND n GROUP BY label, i"""
)
def foreground_fraction(spark, d):
    return ecology.foreground(tables.spectra(spark, d), ["label"], 21)


def _survey(spark, d):
    rows = tables.read(spark, d, "conversations").where("conv_id is not null and turn is not null")
    scale = lambda k: F.pmod(F.col("conv_id") * (k + 3) + F.col("turn") * (2 * k + 1), F.lit(5)) + 1.0
    return rows.select("role", *[scale(k).alias(c) for k, c in enumerate(corpus.SCALES)])


SURVEY = "q AS (SELECT role, " + ", ".join(
    f"(conv_id * {k + 3} + turn * {2 * k + 1}) % 5 + 1.0 AS {c}" for k, c in enumerate(corpus.SCALES)
) + """ FROM conversations), xy AS (SELECT role,
    ((pleasant - annoying) + 0.7071067811865476 * (calm - chaotic) + 0.7071067811865476 * (vibrant - monotonous)) / (4 * (1 + sqrt(2))) AS p,
    ((eventful - uneventful) - 0.7071067811865476 * (calm - chaotic) + 0.7071067811865476 * (vibrant - monotonous)) / (4 * (1 + sqrt(2))) AS e FROM q),
    g AS (SELECT role, count(*) AS n, avg(p) AS pm, avg(e) AS em, stddev_samp(p) AS ps, stddev_samp(e) AS es, sqrt(var_pop(p) + var_pop(e)) AS disp,
    var_samp(p) AS pp, var_samp(e) AS ee, covar_samp(p, e) AS pe FROM xy GROUP BY role),
    h AS (SELECT *, (pp + ee) / 2 AS md, sqrt(pow((pp - ee) / 2, 2) + pow(pe, 2)) AS rc FROM g)"""


@query(
    "WITH " + SURVEY + """ SELECT role, n, round(pm, 6) AS pleasantness_mean, round(em, 6) AS eventfulness_mean, round(ps, 6) AS pleasantness_sd,
    round(es, 6) AS eventfulness_sd, round(disp, 6) AS dispersion, CASE WHEN em >= 0 THEN CASE WHEN pm >= 0 THEN 'vibrant' ELSE 'chaotic' END
    ELSE CASE WHEN pm >= 0 THEN 'calm' ELSE 'monotonous' END END AS quadrant, round(2 * sqrt(5.9915 * greatest(md + rc, 0)), 6) AS ellipse_width,
    round(2 * sqrt(5.9915 * greatest(md - rc, 0)), 6) AS ellipse_height, round(degrees(atan2(2 * pe, pp - ee) / 2), 6) AS ellipse_angle_deg FROM h"""
)
def survey_summary(spark, d):
    return corpus.survey_summary(corpus.coordinates(_survey(spark, d)), ["role"])


@query(
    """SELECT event_id, CASE WHEN value < 0.5 THEN 'micro' WHEN value < 5 THEN 'meso' WHEN value < 600 THEN 'macro' WHEN value < 21600 THEN 'cyclic'
    WHEN value < 259200 THEN 'circadian' WHEN value < 31536000 THEN 'seasonal' ELSE 'archival' END AS band,
    round(25 + 75 * pow(1 + 1.4 * pow(value / 1000, 2), 0.69), 6) AS critical_hz, round(2 / (value / 4 + 4 / value), 6) AS weight,
    ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][(((round_even(69 + 12 * log2(value / 440), 0)::INT % 12) + 12) % 12) + 1]
    || (floor(round_even(69 + 12 * log2(value / 440), 0) / 12) - 1)::INT AS note,
    round(-(((180 - value * 3) % 360 + 360) % 360 - 180), 6) AS wrapped FROM events"""
)
def scalar_functions(spark, d):
    v = F.col("value")
    return tables.read(spark, d, "events").select(
        "event_id",
        scalars.band_of(v).alias("band"),
        scalars.critical_bandwidth(v).alias("critical_hz"),
        scalars.fluctuation_weight(v).alias("weight"),
        scalars.note_name(v).alias("note"),
        scalars.wrap_degrees(v * 3).alias("wrapped"),
    )


@query("WITH {s} SELECT node, i, n FROM s")
def numbered_series(spark, d):
    return tables.numbered(spark, d).select("node", "i", "n")


@query("WITH {s} SELECT node, i, round(sum(p) OVER (PARTITION BY node ORDER BY i), 3) AS total FROM s", digits=3)
def running_total(spark, d):
    return series.running_sum(tables.numbered(spark, d), NODE, F.col("p"), "total", block=500).select("node", "i", "total")


@query(
    """WITH {s}, x AS (SELECT node, -(((180 - ((t % 360) - 180 + level_db)) % 360 + 360) % 360 - 180) AS e FROM s),
    g AS (SELECT node, count(*) AS n_frames, quantile_cont(abs(e), 0.5) AS md, quantile_cont(abs(e), 0.75) - quantile_cont(abs(e), 0.25) AS iq,
    avg(cos(radians(e))) AS c, avg(sin(radians(e))) AS z, avg((abs(e) <= 20)::INT) AS w FROM x GROUP BY node)
    SELECT node, n_frames, round(md, 4) AS median_abs_deg, round(iq, 4) AS iqr_deg, round(degrees(atan2(z, c)), 4) AS bias_deg,
    round(degrees(sqrt(-2 * ln(greatest(sqrt(c * c + z * z), 1e-20)))), 4) AS circ_sd_deg, round(w, 4) AS within FROM g""",
    digits=4,
)
def bearing_errors(spark, d):
    error = scalars.wrap_degrees(F.pmod(F.col("t"), F.lit(360.0)) - 180 + F.col("level_db"))
    return bearings.error_stats(tables.levels(spark, d).withColumn("e", error), NODE, "e")


@query(
    """WITH {s}, x AS (SELECT node, radians(t % 360) AS b, radians(t % 360) + radians((t * 7) % 360) AS w, p AS k FROM s),
    g AS (SELECT node, sqrt(pow(sum(k * cos(b)), 2) + pow(sum(k * sin(b)), 2)) / (sum(k) + 1e-20) AS r_rig,
    sqrt(pow(sum(k * cos(w)), 2) + pow(sum(k * sin(w)), 2)) / (sum(k) + 1e-20) AS r_world, sqrt((sum(k * k) + 1e-20) / pow(sum(k), 2)) AS r_chance, count(*) AS n FROM x GROUP BY node)
    SELECT node, round(r_rig, 6) AS r_rig, round(r_world, 6) AS r_world, round(r_chance, 6) AS r_chance, n,
    CASE WHEN greatest(r_rig, r_world) <= r_chance THEN 'neither' WHEN r_rig >= r_world THEN 'rig' ELSE 'world' END AS frame FROM g"""
)
def frame_reference(spark, d):
    t = F.col("t")
    return bearings.frame_reference(tables.levels(spark, d), NODE, F.pmod(t, F.lit(360.0)), F.pmod(t * 7, F.lit(360.0)), F.col("p"))


@query(
    """WITH {s}, x AS (SELECT node, floor((i - 1) / 6)::BIGINT AS event, (i - 1) % 6 + 1 AS i, (t / 20) % 360 AS az FROM s),
    st AS (SELECT *, coalesce(-(((180 - (az - lag(az) OVER w)) % 360 + 360) % 360 - 180), az) AS step FROM x WINDOW w AS (PARTITION BY node, event ORDER BY i)),
    u AS (SELECT *, sum(step) OVER (PARTITION BY node, event ORDER BY i) AS uz FROM st),
    g AS (SELECT node, event, count(*) AS rows, regr_slope(uz, i::DOUBLE) AS sl, regr_r2(uz, i::DOUBLE) AS r2 FROM u GROUP BY ALL)
    SELECT node, event, rows, round(sl, 6) AS rate_deg, round(r2, 6) AS r2, round(sl * rows, 6) AS sweep_deg,
    CASE WHEN sl < 0 THEN 'left-to-right' ELSE 'right-to-left' END AS direction FROM g WHERE rows >= 4 AND abs(sl * rows) >= 25 AND r2 >= 0.7"""
)
def pass_by_events(spark, d):
    rows = tables.numbered(spark, d)
    at = F.col("i") - 1
    rows = rows.select(
        "node", F.floor(at / 6).alias("event"), (F.pmod(at, F.lit(6)) + 1).alias("i"), F.pmod(F.col("t") / 20, F.lit(360.0)).alias("az")
    )
    return bearings.pass_bys(rows, ["node", "event"], "az")


@query(
    "WITH " + SHIP + """, z AS (SELECT o_custkey, a, b, row_number() OVER (PARTITION BY o_custkey ORDER BY a, o_orderkey) AS i FROM sp),
    m AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM z)
    SELECT o_custkey, i, sum(CASE WHEN r IS NULL OR a > r + 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY i)::BIGINT AS "row" FROM m"""
)
def clock_rows(spark, d):
    rows = series.number_rows(tables.shipping(spark, d), ["o_custkey"], ["a", "o_orderkey"], "a", 86400.0 * 1000)
    return bearings.clock_rows(rows, ["o_custkey"], "a", "b", 43200.0).select("o_custkey", "i", F.col("row").cast("bigint").alias("row"))


@query(
    """WITH {s}, e AS (SELECT node, quantile_cont(level_db, 0.05) AS lo, max(level_db) AS hi FROM s GROUP BY node)
    SELECT s.node, min(i) FILTER (level_db >= lo + 0.2 * (hi - lo)) AS onset, max(i) FILTER (level_db >= lo + 0.2 * (hi - lo)) AS last FROM s JOIN e ON s.node = e.node GROUP BY s.node"""
)
def onset_span(spark, d):
    return cycles.onset_span(tables.numbered(spark, d), NODE, "i", "level_db")


OCT = """o AS (SELECT label, vec_id, list_transform(embedding[1:10], lambda x: x::DOUBLE * x::DOUBLE) AS q FROM embeddings)"""


def _octaves(spark, d):
    spec = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * x.cast("double"))
    return tables.read(spark, d, "embeddings").select(
        "label", "vec_id", spec.alias("oct_pow"), (F.col("vec_id") % 10 / 10).alias("diffuse"), (F.col("vec_id") % 7 / 10).alias("flatness")
    )


@query(
    "WITH " + OCT + """, x AS (SELECT label, (vec_id % 10) / 10.0 AS psi, (vec_id % 7) / 10.0 AS fl, q[1] + q[2] + q[3] AS lo, q[7] + q[8] + q[9] + q[10] AS hi,
    list_sum(q) AS tot FROM o), g AS (SELECT label, sum(lo) / (sum(tot) + 1e-20) AS lf, sum(hi) / (sum(tot) + 1e-20) AS hf, quantile_cont(psi, 0.5) AS p, quantile_cont(fl, 0.5) AS f FROM x GROUP BY 1)
    SELECT label, round(lf, 6) AS geo_lowfreq_fraction, round(hf, 6) AS geo_highband_fraction, round(least(lf * p, 1), 6) AS geo_wind_index,
    round(least(hf * f, 1), 6) AS geo_rain_index, round(greatest(lf * p, hf * f), 6) AS geophony_index FROM g"""
)
def geophony(spark, d):
    return indices.weather(_octaves(spark, d), ["label"])


@query(
    "WITH " + OCT + """ SELECT label, round(sum(q[1] + q[2] + q[3] + q[4]) / (sum(list_sum(q)) + 1e-20), 6) AS mech_lowfreq_fraction,
    round(10 * log10(avg(q[1] + q[2] + q[3]) + 1e-20), 6) AS mech_rumble_db FROM o GROUP BY label"""
)
def mechanical(spark, d):
    return indices.machines(_octaves(spark, d), ["label"])


@query("WITH " + OCT + " SELECT label, round(sum(q[4] + q[5] + q[6] + q[7]) / (sum(list_sum(q)) + 1e-20), 6) AS anthro_voiceband_fraction FROM o GROUP BY label")
def voice_band(spark, d):
    return indices.voices(_octaves(spark, d), ["label"])


NR_SQL = "[" + ", ".join(f"[{a}, {b}]" for a, b in indices.NR) + "]"


@query(
    "WITH " + OCT + f""", x AS (SELECT label, r.k AS band, quantile_cont(10 * log10(greatest(q[r.k + 1], 1e-12)), 0.5) + 90 AS l FROM o, (SELECT range::INT AS k FROM range(10)) r GROUP BY ALL),
    y AS (SELECT label, band, round((l - {NR_SQL}[band + 1][1]) / {NR_SQL}[band + 1][2], 9) AS nr FROM x WHERE band <= 8)
    SELECT label, round(max(nr), 6) AS nr, arg_max(band, (nr, -band)) AS governing_band FROM y GROUP BY label"""
)
def noise_rating(spark, d):
    return indices.noise_rating(indices.band_levels(_octaves(spark, d), ["label"], offset_db=90.0), ["label"], "band", "level_db")


@query(
    """WITH {s} SELECT node, round(avg((level_db >= 6)::INT), 6) AS coverage, round(avg(p) FILTER (level_db >= 6), 6) AS mean_hz,
    round(stddev_pop(p) FILTER (level_db >= 6), 6) AS sd_hz, round(max(abs(p - 50)) FILTER (level_db >= 6), 6) AS max_dev_hz FROM s GROUP BY node"""
)
def mains_summary(spark, d):
    return indices.mains_summary(tables.levels(spark, d), NODE, "p", "level_db")


from . import further  # noqa: E402, F401  registers its queries

SQL: dict[str, str] = {
    k: v.replace("{s}", SERIES).replace("{seg}", SEGMENTS).replace("{day}", DAY).replace("{band}", BANDS) for k, v in _SQL.items()
}
