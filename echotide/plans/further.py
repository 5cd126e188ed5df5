"""More registered queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import models
from ..functions.dsp import OCTAVES
from ..operators import annotations, circular, corpus, cycles, ecology, events, indices, intervals, levels, network, objects, render, rhythm, spectral, states, tones
from . import series, tables
from .catalogue import NODE, OCT, PAIRS, _octaves, _pairs, _segments, query

BAND_FC = ecology.centres(tables.EDGES)


@query(
    """WITH RECURSIVE {s}, w AS (SELECT node, i, n, quantile_cont(level_db, 0.5) OVER (PARTITION BY node ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS lo,
    stddev_pop(level_db) OVER (PARTITION BY node ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS sd,
    quantile_cont(level_db, 0.5) OVER (PARTITION BY node ORDER BY i ROWS BETWEEN 0 FOLLOWING AND 2 FOLLOWING) AS hi FROM s),
    c AS (SELECT node, i - 1 AS i, lo, hi FROM w WHERE i > 5 AND i <= n - 3 AND lo - hi >= 6 AND sd <= 3),
    x AS (SELECT *, min(i) OVER (PARTITION BY node ORDER BY i RANGE BETWEEN 5 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM c),
    p AS (SELECT node, min(i) AS i FROM x GROUP BY node UNION ALL SELECT x.node, x.nxt FROM p JOIN x ON p.node = x.node AND p.i = x.i WHERE x.nxt IS NOT NULL)
    SELECT c.node, c.i, round(lo, 6) AS before_db, round(hi, 6) AS after_db FROM p JOIN c ON p.node = c.node AND p.i = c.i"""
)
def detect_cessations(spark, d):
    return events.cessations(tables.numbered(spark, d), NODE, before=5, after=3, drop_db=6.0)


# ------------------------------------------------------------------ networks


@query(
    "WITH {s}, " + PAIRS + """, e AS (SELECT "window", a AS node, coupling FROM pr UNION ALL SELECT "window", b, coupling FROM pr)
    SELECT "window", node, round(sum(coupling), 6) AS strength FROM e GROUP BY ALL"""
)
def node_strength(spark, d):
    return network.strength(_pairs(spark, d))


HOURLY = PAIRS + """, dn AS (SELECT "window", ("window" * 3) % 24 AS hour, sum((coupling >= 0.2)::INT) / 10.0 AS density FROM pr GROUP BY ALL),
    hd AS (SELECT hour, quantile_cont(density, 0.5) AS density, count(*) AS n_windows FROM dn GROUP BY hour)"""


@query(
    "WITH {s}, " + HOURLY + """, ends AS (SELECT ("window" * 3) % 24 AS hour, "window", a AS node, coupling FROM pr UNION ALL
    SELECT ("window" * 3) % 24, "window", b, coupling FROM pr), st AS (SELECT hour, "window", node, sum(coupling) AS st FROM ends GROUP BY ALL),
    md AS (SELECT hour, node, round(quantile_cont(st, 0.5), 9) AS strength FROM st GROUP BY ALL),
    hb AS (SELECT hour, arg_max(node, (strength, -rk)) AS hub, max(strength) AS strength FROM
    (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY node) AS rk FROM md) GROUP BY hour)
    SELECT hour, round(density, 6) AS density, n_windows, hub, round(strength, 6) AS strength FROM hd JOIN hb USING (hour)"""
)
def hourly_measures(spark, d):
    return network.hourly(_pairs(spark, d), 5, F.pmod(F.col("window") * 3, F.lit(24)), threshold=0.2)


@query(
    "WITH {s}, " + HOURLY + """, o AS (SELECT *, row_number() OVER (ORDER BY density, hour) - 1 AS k, count(*) OVER () AS c FROM hd)
    SELECT hour, round(density, 6) AS density FROM o WHERE c <= 3 OR k = 0 OR k = c // 2 OR k = c - 1"""
)
def representative_hours(spark, d):
    found = network.hourly(_pairs(spark, d), 5, F.pmod(F.col("window") * 3, F.lit(24)), threshold=0.2)
    return network.representative_hours(found).select("hour", "density")


# ------------------------------------------------------------------ rooms and floors


NC_SQL = "[" + ", ".join(str([float(v) for v in row]) for row in indices.NC) + "]"
LEVELS = OCT + """, lv AS (SELECT label, r.k AS band, quantile_cont(10 * log10(greatest(q[r.k + 1], 1e-12)), 0.5) + 70 AS l
    FROM o, (SELECT range::INT AS k FROM range(10)) r GROUP BY ALL)"""


def _room(spark, d):
    return indices.band_levels(_octaves(spark, d), ["label"], offset_db=70.0)


@query(
    "WITH " + LEVELS + f""", c AS (SELECT label, l, list_transform({NC_SQL}, lambda r: r[band]) AS t FROM lv WHERE band BETWEEN 1 AND 8),
    k AS (SELECT *, len(list_filter(t, lambda x: x <= l)) AS k FROM c)
    SELECT label, round(max(CASE WHEN k = 0 THEN 15 WHEN k = 11 THEN 65 ELSE 10 + 5 * (k + (l - t[k]) / (t[k + 1] - t[k])) END), 6) AS nc FROM k GROUP BY label"""
)
def noise_criterion(spark, d):
    return indices.noise_criterion(_room(spark, d), ["label"], "band", "level_db")


@query(
    "WITH " + LEVELS + """, m AS (SELECT label, avg(l) AS rc FROM lv WHERE band BETWEEN 4 AND 6 GROUP BY label),
    x AS (SELECT label, rc, bool_or(band <= 3 AND l - (rc + 5 * (5 - band)) > 5) AS r, bool_or(band IN (6, 7) AND l - (rc + 5 * (5 - band)) > 3) AS h
    FROM lv JOIN m USING (label) GROUP BY ALL)
    SELECT label, round(rc, 6) AS rc, CASE WHEN r AND h THEN 'RH' WHEN r THEN 'R' WHEN h THEN 'H' ELSE 'N' END AS rc_class FROM x"""
)
def room_criterion(spark, d):
    return indices.room_criterion(_room(spark, d), ["label"], "band", "level_db")


def _octave_series(spark, d):
    return series.number_rows(_octaves(spark, d), ["label"], ["vec_id"], "vec_id", 100_000.0)


@query(
    """WITH o AS (SELECT label, list_transform(embedding[1:10], lambda x: x::DOUBLE * x::DOUBLE) AS q, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i,
    count(*) OVER (PARTITION BY label) AS n FROM embeddings),
    c AS (SELECT label, (i - 1) // 5 AS chunk, r.k AS band, quantile_cont(10 * log10(greatest(q[r.k + 1], 1e-12)), 0.1) AS fl FROM o, (SELECT range::INT AS k FROM range(10)) r
    WHERE (i - 1) // 5 < n // 5 GROUP BY ALL),
    b AS (SELECT label, band, count(*) AS ch, quantile_cont(fl, 0.5) AS md, quantile_cont(fl, 0.5) - quantile_cont(fl, 0.05) AS sp FROM c GROUP BY ALL),
    z AS (SELECT *, [31.5, 63, 125, 250, 500, 1000, 2000, 4000, 8000, 16000][band + 1] AS hz FROM b),
    f AS (SELECT label, min(hz) AS lo, max(hz) AS hi, min(sp) AS sp FROM z WHERE ch >= 3 AND hz >= 2000 AND hz / sqrt(2) < 11025 AND sp < 9 AND md > -119 GROUP BY label)
    SELECT label, f.label IS NOT NULL AS floor_suspect, round_even(lo / sqrt(2), 0)::INT AS floor_suspect_lo_hz,
    CASE WHEN hi IS NOT NULL THEN round_even(least(hi * sqrt(2), 11025), 0)::INT END AS floor_suspect_hi_hz, round(sp, 6) AS floor_spread_db FROM (SELECT DISTINCT label FROM embeddings) LEFT JOIN f USING (label)"""
)
def floor_suspicion(spark, d):
    return levels.floor_suspicion(_octave_series(spark, d), ["label"], "oct_pow", OCTAVES, 11025.0, chunk=5, min_chunks=3, limit_db=9.0)


# ------------------------------------------------------------------ states


@query(
    """WITH {s}, {seg}, l AS (SELECT *, lag(median_db) OVER (PARTITION BY node ORDER BY segment) AS f FROM seg),
    e AS (SELECT node, segment, t0 AS i, f, median_db AS g, median_db - f AS st, greatest(1, 2 * sd_db) AS tol FROM l WHERE f IS NOT NULL AND t0 > 0 AND abs(median_db - f) >= 1e-9),
    m AS (SELECT e.*, s.i - 1 - e.i AS k, level_db AS x FROM e JOIN s ON s.node = e.node AND s.i - 1 - e.i >= -8 AND s.i - 1 - e.i < 20),
    c AS (SELECT node, segment, sum((k < 8 AND (x - f) / st >= 0.1 AND (x - f) / st <= 0.9)::INT)::DOUBLE AS crossing_s FROM m GROUP BY ALL),
    r AS (SELECT node, segment, k, avg((abs(x - g) <= tol)::INT) OVER (PARTITION BY node, segment ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sh FROM m WHERE k >= 0),
    t AS (SELECT node, segment, min(k)::DOUBLE AS settle_s FROM r WHERE sh >= 0.9 GROUP BY ALL)
    SELECT e.node, e.segment, e.i::DOUBLE AS t_s, CASE WHEN st > 0 THEN 'onset' ELSE 'cessation' END AS direction, round(st, 6) AS step_db, crossing_s, settle_s,
    round(tol, 6) AS settle_tol_db, round(f, 6) AS from_db, round(g, 6) AS to_db FROM e JOIN c USING (node, segment) LEFT JOIN t USING (node, segment)"""
)
def state_transitions(spark, d):
    segs = _segments(spark, d).withColumn("segment", F.col("segment").cast("bigint"))
    return states.transitions(tables.numbered(spark, d), segs, NODE, most_s=20.0, around_s=8.0)


@query(
    """WITH {s}, {seg}, u AS (SELECT node, sum(rows) FILTER (state = 'on') AS a, sum(rows) FILTER (state = 'off') AS b,
    quantile_cont(median_db, 0.5) FILTER (state = 'on') AS x, quantile_cont(median_db, 0.5) FILTER (state = 'off') AS y, sum(rows) AS t FROM seg GROUP BY node)
    SELECT seg.node, state, t0::DOUBLE AS a, (t0 + rows)::DOUBLE AS b FROM seg JOIN u ON seg.node = u.node WHERE least(u.a, u.b) >= greatest(20, 0.05 * t) AND abs(x - y) >= 2"""
)
def auto_states(spark, d):
    rows = tables.numbered(spark, d)
    kept = states.auto_states(_segments(spark, d), NODE, rows.groupBy("node").agg(F.max("n").alias("n")), min_rows=20, min_step_db=2.0)
    return states.state_intervals(kept, NODE, labels=("on", "off"))


@query(
    """WITH {s}, m AS (SELECT node, avg(level_db) AS mu FROM s GROUP BY node), x AS (SELECT s.node, i, n, pow(10, level_db / 10) AS e, pow(level_db - mu, 2) AS v FROM s JOIN m ON s.node = m.node),
    w AS (SELECT node, i, n, avg(e) OVER z AS e, avg(v) OVER z AS v FROM x WINDOW z AS (PARTITION BY node ORDER BY i ROWS BETWEEN CURRENT ROW AND 39 FOLLOWING)),
    f AS (SELECT node, i, 10 * log10(greatest(e, 1e-12)) AS l, e, v FROM w WHERE i + 39 <= n), md AS (SELECT node, quantile_cont(l, 0.5) AS md FROM f GROUP BY node),
    b AS (SELECT f.node, arg_min(i, (round(e, 9), i)) AS q, arg_min(i, (round(-v, 9), i)) AS a, arg_min(i, (round(abs(l - md), 9), i)) AS t FROM f JOIN md ON f.node = md.node GROUP BY f.node),
    k AS (SELECT node, 0 AS p, 'quietest' AS kind, q AS i FROM b UNION ALL SELECT node, 1, 'most_active', a FROM b UNION ALL SELECT node, 2, 'typical', t FROM b),
    o AS (SELECT x.node, x.kind, x.p, min((y.p, y.kind, y.i)) AS w FROM k x JOIN k y ON x.node = y.node AND y.p <= x.p AND abs(x.i - y.i) <= 1 GROUP BY ALL)
    SELECT node, w[2] AS kind, w[3]::DOUBLE AS t0, 40.0 AS dur_s, coalesce(string_agg(kind, ',' ORDER BY p) FILTER (kind <> w[2]), '') AS also FROM o GROUP BY node, w"""
)
def pick_segments(spark, d):
    rows = tables.numbered(spark, d).withColumn("t", F.col("i").cast("double"))
    found = levels.pick_segments(rows, NODE, "t", "level_db", 1.0, seg_s=40.0, jump_db=1e9)
    return found.withColumn("also", F.array_join("also", ","))


# ------------------------------------------------------------------ rhythm


@query(
    """WITH {s}, m AS (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128, 256]) AS beats), b AS (SELECT node, beats, (i - 1) // beats AS k, avg(p) AS a FROM s, m WHERE beats <= n // 4
    GROUP BY node, beats, k HAVING count(*) = beats), x AS (SELECT node, beats, a - lag(a) OVER (PARTITION BY node, beats ORDER BY k) AS dv FROM b)
    SELECT node, beats, round(sqrt(0.5 * avg(dv * dv)) * 1e6 / 10, 3) AS ppm FROM x GROUP BY ALL HAVING count(*) >= 3""",
    digits=3,
)
def allan_deviation(spark, d):
    return cycles.allan_of_numbered(tables.numbered(spark, d), NODE, "p", 10.0)


@query(
    """WITH {s}, g AS (SELECT 30000.0 + 600 * range AS period FROM range(40)), x AS (SELECT node, period, 2 * pi() * t / period AS a FROM s, g)
    SELECT node, period, round(sqrt(pow(avg(cos(a)), 2) + pow(avg(sin(a)), 2)) + sqrt(pow(avg(cos(2 * a)), 2) + pow(avg(sin(2 * a)), 2)), 6) AS strength,
    count(*) AS strikes FROM x GROUP BY ALL"""
)
def period_strength(spark, d):
    rows = tables.levels(spark, d)
    return rhythm.concentration(rows, NODE, "t", rhythm.grid_of(rows, 30000.0, 54000.0, 600.0))


@query(
    """WITH {s}, g AS (SELECT 30000.0 + 600 * range AS period FROM range(40)), x AS (SELECT node, period, 2 * pi() * t / period AS a FROM s, g),
    r AS (SELECT node, period, sqrt(pow(avg(cos(a)), 2) + pow(avg(sin(a)), 2)) + sqrt(pow(avg(cos(2 * a)), 2) + pow(avg(sin(2 * a)), 2)) AS st FROM x GROUP BY ALL),
    z AS (SELECT *, lag(st) OVER w AS p, lead(st) OVER w AS q FROM r WINDOW w AS (PARTITION BY node ORDER BY period)),
    b AS (SELECT node, arg_max({k: period, st: st, p: p, q: q}, (round(st, 12), -period)) AS b FROM z GROUP BY node)
    SELECT node, round(b.k + CASE WHEN b.p IS NOT NULL AND b.q IS NOT NULL AND 2 * (b.p - 2 * b.st + b.q) <> 0 THEN (b.p - b.q) / (2 * (b.p - 2 * b.st + b.q)) ELSE 0 END * 600, 3) AS period,
    round(b.st, 3) AS strength FROM b""",
    digits=3,
)
def refined_period(spark, d):
    return rhythm.best_period(tables.levels(spark, d), NODE, "t", 30000.0, 54000.0, 600.0)


@query(
    """WITH {s}, a AS (SELECT node, t FROM s), h AS (SELECT x.node AS a, y.node AS b, count(DISTINCT x.t) AS h FROM a x JOIN a y ON x.node <> y.node AND abs(x.t - y.t) < 60 GROUP BY ALL),
    z AS (SELECT node, count(DISTINCT t) AS n FROM a GROUP BY node) SELECT a, b, round(h / n, 6) AS share FROM h JOIN z ON node = a"""
)
def stream_crosstalk(spark, d):
    return rhythm.crosstalk(tables.levels(spark, d), [], "node", "t", 60.0)


@query(
    """WITH {s}, x AS (SELECT node, t, CASE WHEN t - lag(t) OVER w <= 1.6 * 2000 THEN 0 ELSE 1 END AS nw FROM s WINDOW w AS (PARTITION BY node ORDER BY t, i)),
    r AS (SELECT node, t, sum(nw) OVER (PARTITION BY node ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM x)
    SELECT node, run::BIGINT AS run, count(*) AS ticks, round(min(t), 6) AS first FROM r GROUP BY ALL HAVING count(*) >= 4"""
)
def tick_runs(spark, d):
    found = rhythm.tick_runs(tables.levels(spark, d).select("node", "t"), NODE, "t", F.lit(2000.0))
    return found.groupBy("node", "run").agg(F.count("*").alias("ticks"), F.min("t").alias("first")).withColumn("run", F.col("run").cast("bigint"))


@query(
    """WITH {s}, x AS (SELECT node, t, p, unnest([60.0, 300, 900, 1800, 3600, 86400]) AS period_s FROM s), a AS (SELECT node, period_s, 2 * pi() * ((t / period_s) - floor(t / period_s)) AS a, t FROM x),
    g AS (SELECT node, period_s, atan2(sum(sin(a)), sum(cos(a))) AS m, sqrt(pow(sum(sin(a)), 2) + pow(sum(cos(a)), 2)) / count(*) AS r, count(*) AS n, floor((max(t) - min(t)) / period_s) + 1 AS n_cycles FROM a GROUP BY node, period_s)
    SELECT node, period_s, round((m / (2 * pi()) - floor(m / (2 * pi()))) * period_s, 2) AS phase_s, round(r, 2) AS r, round(sqrt(-2 * ln(greatest(r, 1e-20))) / (2 * pi()) * period_s, 2) AS circ_sd_s,
    round(least(1, exp(sqrt(1 + 4 * n + 4 * (n * n - pow(n * r, 2))) - (1 + 2 * n))), 2) AS rayleigh_p, n, n_cycles::BIGINT AS n_cycles FROM g""",
    digits=2,
)
def civic_periods(spark, d):
    return circular.match_periods(tables.levels(spark, d), NODE, "t")


# ------------------------------------------------------------------ spectra


def _stated(spark, d):
    return tables.spectra(spark, d).withColumn("state", F.when(F.col("i") % 3 == 0, "on").when(F.col("i") % 3 == 1, "off"))


@query(
    """WITH {band}, x AS (SELECT label, band, power, CASE i % 3 WHEN 0 THEN 'on' WHEN 1 THEN 'off' END AS state FROM b),
    y AS (SELECT label, NULL AS state, band, power FROM x UNION ALL SELECT label, state, band, power FROM x WHERE state IS NOT NULL)
    SELECT label, state, band, round(10 * log10(quantile_cont(power, 0.5) + 1e-12), 6) AS level_db FROM y GROUP BY ALL"""
)
def spectrum_by_state(spark, d):
    return spectral.ltas_by_state(_stated(spark, d), ["label"], "spec", "state")


@query(
    """WITH x AS (SELECT vec_id, r.k AS band, sqrt(pow(embedding[3 * r.k + 1]::DOUBLE, 2) + pow(embedding[3 * r.k + 2]::DOUBLE, 2) + pow(embedding[3 * r.k + 3]::DOUBLE, 2)) AS v,
    abs(embedding[31 + r.k]::DOUBLE) * 4 AS p, label FROM embeddings, (SELECT range::INT AS k FROM range(10)) r)
    SELECT label, band, round(quantile_cont(least(greatest(v / (p + 1e-12), 0), 1), 0.5), 6) AS directness FROM x GROUP BY ALL"""
)
def field_directness(spark, d):
    rows = tables.read(spark, d, "embeddings")
    wide = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.transform(F.slice("embedding", 3 * k + 1, F.lit(3)), lambda x: x.cast("double")))
    power = F.transform(F.slice("embedding", 31, 10), lambda x: F.abs(x.cast("double")) * 4)
    found = spectral.directness(rows.select("label", "vec_id", wide.alias("v"), power.alias("p")), ["label", "vec_id"], "v", "p")
    return spectral.median_directness(found, ["label"])


BLOCKED = """bk AS (SELECT label, band, i // 20 AS blk, quantile_cont(power, 0.1) AS bg FROM b GROUP BY ALL),
    ex AS (SELECT b.label, (b.i // 7)::BIGINT AS object, b.band, greatest(avg(power) - avg(bg), 0) AS e FROM b JOIN bk ON b.label = bk.label AND b.band = bk.band AND b.i // 20 = bk.blk GROUP BY ALL)"""


def _excess(spark, d):
    rows = spectral.block_background(tables.spectra(spark, d), ["label"], "i", "spec", block=20)
    return spectral.excess_spectrum(rows.withColumn("object", F.floor(F.col("i") / 7)), ["label", "object"], "spec", "background")


@query("WITH {band}, " + BLOCKED + " SELECT label, object, band, round(e, 6) AS excess FROM ex")
def excess_spectrum(spark, d):
    return _excess(spark, d).select("label", "object", F.posexplode("excess").alias("band", "excess"))


@query(
    "WITH {band}, " + BLOCKED + """, l AS (SELECT label, object, list(e ORDER BY band) AS x FROM ex GROUP BY ALL), m AS (SELECT *, list_max(x) * 1e-4 AS lo, list_sum(x) AS tot FROM l),
    v AS (SELECT *, list_transform(x, lambda e: 10 * log10(greatest(e, lo))) AS lv FROM m WHERE tot > 0), p AS (SELECT *, list_concat(list_concat([lv[1], lv[1], lv[1], lv[1], lv[1]], lv), [lv[64], lv[64], lv[64], lv[64], lv[64]]) AS pd FROM v),
    u AS (SELECT label, object, tot, x, lo, list_sum(list_transform(range(1, 65), lambda k: CASE WHEN lv[k] - list_sort(pd[k:k + 10])[6] >= 6 THEN x[k] ELSE 0 END)) / tot AS sh,
    list_sum(list_transform(range(1, 65), lambda k: x[k] * (k - 1) / 10.0)) / tot AS m1, list_sum(list_transform(range(1, 65), lambda k: x[k] * pow((k - 1) / 10.0, 2))) / tot AS m2 FROM p),
    z AS (SELECT *, sqrt(greatest(m2 - m1 * m1, 0)) AS sp FROM u)
    SELECT label, object, CASE WHEN sh >= 0.5 THEN 'tonic' WHEN sh >= 0.2 THEN 'tonic-complex' WHEN sp >= 1.2 THEN 'noise' ELSE 'complex' END AS mass, round(sh, 6) AS peak_share,
    round(sp, 6) AS spread_oct, round(exp(list_avg(list_transform(x, lambda e: ln(greatest(e, lo))))) / list_avg(list_transform(x, lambda e: greatest(e, lo))), 6) AS flatness FROM z"""
)
def object_mass(spark, d):
    return _excess(spark, d).select("label", "object", objects.mass(F.col("excess")).alias("m")).select("label", "object", "m.*").where("mass is not null")


BIRD = "bd AS (SELECT label, vec_id, i, n, sum(CASE WHEN fc >= 2000 AND fc <= 11000 THEN power ELSE 0 END) AS p FROM b GROUP BY ALL)"


def _birds(spark, d):
    return tables.spectra(spark, d).withColumn("p", indices.band_power(F.col("spec"), BAND_FC))


@query("WITH {band}, " + BIRD + ", t AS (SELECT label, p / (sum(p) OVER (PARTITION BY label) + 1e-12) AS q FROM bd) SELECT label, round(-sum(q * ln(q + 1e-12)) / ln(count(*)), 6) AS entropy FROM t GROUP BY label")
def bird_entropy(spark, d):
    return spectral.band_entropy(_birds(spark, d), ["label"], F.col("p"))


ACTIVE = BIRD + """, pd AS (SELECT label, i, n, p FROM bd UNION ALL SELECT label, 1 - k, n, p FROM bd, range(1, 8) r(k) WHERE i = 1 UNION ALL SELECT label, n + k, n, p FROM bd, range(1, 8) r(k) WHERE i = n),
    bg AS (SELECT label, i, n, p, list_sort(list(10 * log10(p + 1e-20)) OVER (PARTITION BY label ORDER BY i ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING))[2] AS g FROM pd),
    ac AS (SELECT label, i, p, 10 * log10(p + 1e-20) > g + 3 AS act FROM bg WHERE i BETWEEN 1 AND n)"""


@query(
    "WITH {band}, " + ACTIVE + """, r AS (SELECT *, i - row_number() OVER (PARTITION BY label, act ORDER BY i) AS g FROM ac), u AS (SELECT label, count(*) AS dur FROM r WHERE act GROUP BY label, g),
    ev AS (SELECT label, count(*) AS events, quantile_cont(dur, 0.5) AS m FROM u GROUP BY label), aa AS (SELECT label, avg(act::INT) AS activity, count(*) / 60 AS mn FROM ac GROUP BY label)
    SELECT label, round(activity, 6) AS activity, coalesce(events, 0) AS events, round(m, 6) AS median_dur_s, round(coalesce(events, 0) / mn, 6) AS events_per_min FROM aa LEFT JOIN ev USING (label)"""
)
def bird_activity(spark, d):
    return indices.birds(_birds(spark, d).select("label", "vec_id", "p"), ["label"], "vec_id", "p", window=15)


@query(
    "WITH {band}, " + ACTIVE + """, x AS (SELECT label, (i * 37) % 360 - 180.0 AS az, (i * 11) % 90 - 45.0 AS el, CASE WHEN act THEN p ELSE 0 END AS w FROM ac),
    c AS (SELECT label, least(floor((az + 180) / 10), 35) AS cell, sum(w) AS w FROM x GROUP BY ALL), q AS (SELECT label, w / sum(w) OVER (PARTITION BY label) AS q FROM c),
    en AS (SELECT label, -sum(CASE WHEN q > 0 THEN q * ln(q) END) / ln(36) AS en FROM q GROUP BY label),
    h AS (SELECT label, sum(CASE WHEN el > 10 THEN w ELSE 0 END) / (sum(w) + 1e-20) AS up, sum(CASE WHEN el < -10 THEN w ELSE 0 END) / (sum(w) + 1e-20) AS dn FROM x GROUP BY label)
    SELECT label, round(en, 6) AS directional_entropy, round(up, 6) AS above_horizon_fraction, round(dn, 6) AS below_horizon_fraction FROM en JOIN h USING (label)"""
)
def bird_dispersion(spark, d):
    rows = _birds(spark, d).select("label", "vec_id", "p", (F.pmod(F.col("i") * 37, F.lit(360)) - 180.0).alias("az"), (F.pmod(F.col("i") * 11, F.lit(90)) - 45.0).alias("el"))
    return indices.dispersion(rows, ["label"], "vec_id", "p", window=15)


@query(
    """WITH {band}, m AS (SELECT label, band, band * 1.0 AS hz, 10 * log10(quantile_cont(power, 0.5) + 1e-12) AS l FROM b GROUP BY ALL), f AS (SELECT unnest([6.0, 7.5, 11.0, 13.0]) AS f0),
    h AS (SELECT f0, unnest(range(greatest(1, ceil(10 / f0)::INT), floor(60 / f0)::INT + 1)) AS n FROM f),
    r AS (SELECT label, f0, n, CASE WHEN sum((abs(hz - n * f0) > 1.5 AND abs(hz - n * f0) <= 6)::INT) >= 8 THEN max(l) FILTER (abs(hz - n * f0) <= 0.6)
    - quantile_cont(l, 0.5) FILTER (abs(hz - n * f0) > 1.5 AND abs(hz - n * f0) <= 6) END AS rung FROM m, h WHERE abs(hz - n * f0) <= 6 GROUP BY ALL)
    SELECT label, f0, round(CASE WHEN count(rung) >= 3 THEN avg(rung) END, 6) AS family_db, count(rung) AS rungs FROM r GROUP BY ALL"""
)
def line_families(spark, d):
    bins = objects.median_spectrum(tables.spectra(spark, d), ["label"], "spec").withColumn("hz", F.col("bin").cast("double"))
    some = spark.createDataFrame([(6.0,), (7.5,), (11.0,), (13.0,)], "f0 double")
    return tones.family_prominence(bins, ["label"], "hz", "level_db", some, band=(10.0, 60.0), half=0.6)


@query(
    """WITH {band}, lv AS (SELECT label, vec_id, i, n, 10 * log10(sum(power)) AS l FROM b GROUP BY ALL), md AS (SELECT label, quantile_cont(l, 0.5) AS m FROM lv GROUP BY label),
    pf AS (SELECT label, band, quantile_cont(10 * log10(power + 1e-12), 0.1) AS q FROM b GROUP BY ALL), w AS (SELECT label, unnest(range(0, (greatest(max(n) - 12, 0) // 4) * 4 + 1, 4)) AS w FROM lv GROUP BY label),
    r AS (SELECT w.label, w, band, quantile_cont(10 * log10(power + 1e-12), 0.5) AS m FROM w JOIN b ON b.label = w.label AND i - 1 >= w AND i - 1 < w + 12 GROUP BY ALL),
    ds AS (SELECT r.label, w, avg(abs(r.m - q)) AS dist FROM r JOIN pf ON r.label = pf.label AND r.band = pf.band GROUP BY ALL),
    ev AS (SELECT w.label, w, min(vec_id)::DOUBLE AS t0, avg((l > m + 6)::INT) AS ev FROM w JOIN lv ON lv.label = w.label AND i - 1 >= w AND i - 1 < w + 12 JOIN md ON md.label = w.label GROUP BY ALL),
    sc AS (SELECT *, dist + 20 * ev AS sc FROM ds JOIN ev USING (label, w)), o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(sc, 9), w) AS k FROM sc)
    SELECT label, t0, round(dist, 6) AS distance_db, round(ev, 6) AS eventful, round(sc, 6) AS score FROM o WHERE k = 1"""
)
def characteristic_excerpt(spark, d):
    rows = tables.spectra(spark, d).withColumns({"t": F.col("vec_id").cast("double"), "level_db": 10 * F.log10("energy")})
    return render.characteristic_excerpt(rows, ["label"], "spec", size=12, hop=4)


# ------------------------------------------------------------------ intervals, labels, registries


@query(
    """WITH {s}, sp AS (SELECT node, floor(t / 7200) * 7200 AS a, floor(t / 7200) * 7200 + 1800 AS b, 'even' AS kind FROM s GROUP BY ALL)
    SELECT s.event_id, kind FROM s JOIN sp ON s.node = sp.node AND t >= a AND t < b"""
)
def labelled_rows(spark, d):
    rows = tables.levels(spark, d)
    a = F.floor(F.col("t") / 7200) * 7200.0
    spans = rows.select("node", a.alias("a"), (a + 1800).alias("b"), F.lit("even").alias("kind")).distinct()
    return intervals.labelled(rows, spans, NODE, "t", "kind").select("event_id", "kind")


@query(
    """WITH {s}, sp AS (SELECT DISTINCT node, floor(t / 20000) * 20000 AS a FROM s)
    SELECT sp.node, a, a + 5000 AS b, round(quantile_cont(level_db, 0.5), 6) AS level_db FROM sp LEFT JOIN s ON s.node = sp.node AND t >= a AND t < a + 5000 GROUP BY ALL"""
)
def span_levels(spark, d):
    rows = tables.levels(spark, d)
    a = F.floor(F.col("t") / 20000) * 20000.0
    spans = rows.select("node", a.alias("a"), (a + 5000).alias("b")).distinct()
    return annotations.span_levels(rows, spans, NODE)


@query(
    """WITH {s}, h AS (SELECT node, quantile_cont(level_db, 0.5) AS m, quantile_cont(level_db, 0.05) AS lo, quantile_cont(level_db, 0.99) AS hi FROM s GROUP BY node)
    SELECT node, round(m, 6) AS median_db, round(lo - m, 6) AS low_db, round(greatest(hi - m, lo - m + 6), 6) AS high_db FROM h"""
)
def level_context(spark, d):
    return annotations.level_context(tables.levels(spark, d), NODE)


TOP = "sc AS (SELECT user_id, event_type AS label, max(value) / 500 AS score FROM events GROUP BY ALL)"


def _scores(spark, d):
    return tables.read(spark, d, "events").groupBy("user_id", F.col("event_type").alias("label")).agg((F.max("value") / 500).alias("score"))


@query("WITH " + TOP + ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, label) AS k FROM sc WHERE score >= 0.1) SELECT user_id, label, round(score, 6) AS score FROM r WHERE k <= 3")
def top_labels(spark, d):
    return models.top_labels(_scores(spark, d), ["user_id"])


@query("WITH " + TOP + " SELECT label, count(*) AS n, round(max(score), 6) AS max_score FROM sc WHERE score >= 0.25 GROUP BY label")
def label_tally(spark, d):
    return models.tally(_scores(spark, d), [])


REGISTERED = "rg AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', '{t}', {'NULL' if m is None else m}, {'NULL' if kind is None else repr(kind)})" for k, t, m, kind in corpus.REGISTRY
) + ") v(key, tier, min_s, kind))"


@query("WITH " + REGISTERED + " SELECT key, tier, min_s::DOUBLE AS min_s, kind FROM rg")
def descriptor_registry(spark, d):
    return corpus.registry(spark.range(1))


@query("WITH " + REGISTERED + " SELECT tier, count(*) AS count FROM rg GROUP BY tier")
def tier_counts(spark, d):
    return corpus.tier_counts(spark.range(1))


KEYED = REGISTERED + ", ks AS (SELECT event_id, user_id, (SELECT list(key ORDER BY key) FROM rg)[(event_id % 71) + 1] AS key, value FROM events)"


def _keyed(spark, d):
    names = F.array(*[F.lit(k) for k in sorted(r[0] for r in corpus.REGISTRY)])
    return tables.read(spark, d, "events").select("user_id", F.get(names, F.pmod("event_id", F.lit(71)).cast("int")).alias("key"), "value")


@query(
    "WITH " + KEYED + """ SELECT user_id, coalesce(string_agg(DISTINCT key, ',' ORDER BY key) FILTER (tier = 'PD'), '') AS defined, count(*) FILTER (tier = 'PM') AS n_motivated
    FROM ks JOIN rg USING (key) GROUP BY user_id"""
)
def tier_cautions(spark, d):
    return corpus.cautions(_keyed(spark, d), ["user_id"]).withColumn("defined", F.array_join("defined", ","))


@query(
    """WITH q AS (SELECT role, count(*) AS n FROM conversations GROUP BY role), sh AS (SELECT c.role, (turn % 4)::VARCHAR AS label, count(*) / n AS share FROM conversations c JOIN q ON q.role = c.role GROUP BY c.role, label, n),
    o AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY share DESC, label) AS k FROM sh)
    SELECT role, coalesce(' — during: ' || string_agg(label || ' ' || round_even(100 * share, 0)::INT || '%', ', ' ORDER BY k) FILTER (k <= 3 AND share >= 0.05), '') AS suffix FROM o GROUP BY role"""
)
def activity_suffix(spark, d):
    rows = tables.read(spark, d, "conversations").withColumn("label", F.pmod("turn", F.lit(4)).cast("string"))
    total = F.count("*").over(Window.partitionBy("role"))
    shares = rows.withColumn("_n", total).groupBy("role", "label", "_n").agg((F.count("*") / F.col("_n")).alias("share"))
    return annotations.suffix(shares, ["role"], "label")
