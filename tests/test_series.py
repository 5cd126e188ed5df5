"""Blocks of series against plain loops: results don't depend on the block size."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotide.functions import dsp
from echotide.operators import cycles, events, levels, states
from echotide.plans import catalogue, series


@pytest.fixture(scope="module")
def walks():
    rng = np.random.default_rng(3)
    return {k: np.round(np.cumsum(rng.normal(0, 2, n)) + 5 * rng.normal(size=n), 3) for k, n in (("a", 211), ("b", 1), ("c", 40), ("d", 2))}


@pytest.fixture(scope="module")
def df(spark, walks):
    rows = [(k, i + 1, len(x), float(i), float(v)) for k, x in walks.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "node string, i bigint, n bigint, t double, level_db double").repartition(3)


def by_node(rows, column):
    out = {}
    for r in sorted(rows, key=lambda r: (r.node, r.i)):
        out.setdefault(r.node, []).append(r[column])
    return out


@pytest.mark.parametrize("block", [7, 30, 1000])
def test_scans(df, walks, block):
    got = series.running_sum(df, ["node"], F.col("level_db"), "s", block).collect()
    for k, v in by_node(got, "s").items():
        assert np.allclose(v, np.cumsum(walks[k]))
    got = series.previous(df, ["node"], {"p": "level_db"}, block).collect()
    for k, v in by_node(got, "p").items():
        assert v == [None, *walks[k][:-1]]
    got = series.last_value(df, ["node"], F.when(F.col("level_db") > 0, F.col("i")), "l", block).collect()
    for k, v in by_node(got, "l").items():
        want, last = [], None
        for i, x in enumerate(walks[k]):
            last = i + 1 if x > 0 else last
            want.append(last)
        assert v == want


@pytest.mark.parametrize("size, pct, block", [(3, 50, 5), (11, 10, 20), (61, 10, 64), (61, 90, 1000)])
def test_rank_filter(df, walks, size, pct, block):
    got = series.rank_filter(df, ["node"], "level_db", size, pct, "f", block).collect()
    assert len(got) == sum(map(len, walks.values()))
    for k, v in by_node(got, "f").items():
        assert np.allclose(v, dsp.rank_filter(walks[k], size, pct))


@pytest.mark.parametrize("n", [1, 4, 31, 500])
def test_floor(df, walks, n):
    for k, v in by_node(levels.noise_floor(df, ["node"], n).collect(), "floor_db").items():
        x = walks[k]
        want = [x.min() if n >= len(x) else x[max(0, i - n // 2) : i + n - n // 2].min() for i in range(len(x))]
        assert np.allclose(v, np.array(want) + 1.5)


@pytest.mark.parametrize("left, right", [(5, -1), (-2, 4), (3, 2)])
def test_frames_beside_their_row(df, walks, left, right):
    got = series.framed(df, ["node"], left, right, {"m": lambda w: F.max("level_db").over(w)}, block=7).collect()
    assert len(got) == sum(map(len, walks.values()))
    for k, v in by_node(got, "m").items():
        x = walks[k]
        want = [x[max(0, i - left) : max(0, i + right + 1)] for i in range(len(x))]
        assert v == [w.max() if len(w) else None for w in want]


def test_cessation_at_the_end_of_a_block(spark):
    n, at = series.BLOCK + 50, series.BLOCK - 2  # the frame from here on holds the last row of a block
    level = {at: 9.0, at + 1: 3.0, at + 2: 3.0}
    df = spark.createDataFrame([("a", i + 1, n, level.get(i, 10.0)) for i in range(n)], "node string, i bigint, n bigint, level_db double")
    got = events.cessations(df, ["node"], before=5, after=3, drop_db=6.0).collect()
    assert [(r.i, r.before_db, r.after_db) for r in got] == [(at, 10.0, 3.0)]


def test_number_rows(spark):
    rows = [("a", float(t % 50), t) for t in range(100)] + [("b", 3.0, 0)]
    df = spark.createDataFrame(rows, "node string, t double, id int")
    got = series.number_rows(df, ["node"], ["t", "id"], "t", 7.0).collect()
    want = sorted(r[1:] for r in rows if r[0] == "a")
    assert [(r.t, r.id) for r in sorted((r for r in got if r.node == "a"), key=lambda r: r.i)] == want
    assert {(r.node, r.n) for r in got} == {("a", 100), ("b", 1)}


@pytest.mark.parametrize("min_rows", [1, 4, 12])
def test_segments(spark, df, walks, min_rows):
    thresholds = spark.createDataFrame([(k, float(np.median(x))) for k, x in walks.items()], "node string, threshold_db double")
    got = states.segments(df, ["node"], thresholds, smooth=5, hysteresis_db=2.0, min_rows=min_rows).collect()
    for k, x in walks.items():
        smooth, th = dsp.rank_filter(x, 5, 50), np.median(x)
        on, now = [], smooth[0] > th
        for v in smooth:
            now = False if now and v < th - 1 else True if not now and v > th + 1 else now
            on.append(now)
        cuts = [0, *[i for i in range(1, len(on)) if on[i] != on[i - 1]], len(on)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a < min_rows and a > 0 and b < len(on):
                on[a:b] = [on[a - 1]] * (b - a)
        cuts = [0, *[i for i in range(1, len(on)) if on[i] != on[i - 1]], len(on)]
        want = [(a, b - a, "on" if on[a] else "off") for a, b in zip(cuts, cuts[1:], strict=False)]
        assert sorted((r.t0, r.rows, r.state) for r in got if r.node == k) == want


def test_events_and_cessations(df, walks):
    got = events.detect(df, ["node"], size=21, min_frames=2, rise_db=3.0).collect()
    x = walks["a"]
    above = x > dsp.rank_filter(x, 21, 10) + 3
    want, i = [], 0
    while i < len(x):
        j = i
        while j < len(x) and above[j]:
            j += 1
        if j - i >= 2:
            want.append((i, j - 1, i + int(x[i:j].argmax())))
        i = max(j, i + 1)
    assert sorted((r.i0, r.i1, r.ipk) for r in got if r.node == "a") == want
    got = events.cessations(df, ["node"], before=6, after=3, drop_db=6.0).collect()
    want, i = [], 6
    while i < len(x) - 3:
        lo, hi = np.median(x[i - 6 : i]), np.median(x[i : i + 3])
        if lo - hi >= 6 and x[i - 6 : i].std() <= 3:
            want.append(i)
            i += 6
        else:
            i += 1
    assert sorted(r.i for r in got if r.node == "a") == want


def allan(x, m):
    """By plain loops; None is no beat."""
    mean = []
    for k in range(len(x) // m):
        some = [v for v in x[k * m : k * m + m] if v is not None]
        mean.append(sum(some) / len(some) if some else None)
    steps = [b - a for a, b in zip(mean, mean[1:], strict=False) if a is not None and b is not None]
    return np.sqrt(0.5 * np.mean(np.square(steps))) / 0.5 * 1e6 if steps else None


def test_allan_deviation_in_blocks(spark):
    rng = np.random.default_rng(8)
    beats = {k: (1 + rng.normal(0, 1e-3, n)).tolist() for k, n in (("a", 2 * series.BLOCK + 77), ("b", series.BLOCK), (None, 1025), ("d", 4), ("e", 3))}
    beats["a"][series.BLOCK - 300 : series.BLOCK + 20] = [None] * 320  # whole stretches, over the edge of a block
    beats["f"] = [None] * 9
    rows = [(k, float(i) ** 3, i + 1, len(x), v) for k, x in beats.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "node string, t double, i bigint, n bigint, x double").repartition(5)
    want = {(k, 1 << p): allan(x, 1 << p) for k, x in beats.items() for p in range(9) if 1 << p <= len(x) // 4}
    for found in (cycles.allan_of_numbered(df, ["node"], "x", 0.5), cycles.allan_deviation(df.drop("i", "n"), ["node"], "t", "x", 0.5)):
        assert found.schema["beats"].dataType.simpleString() == "int"
        got = {(r.node, r.beats): r.ppm for r in found.collect()}
        assert set(got) == set(want)
        assert all(got[k] is None if v is None else np.isclose(got[k], v, rtol=1e-9) for k, v in want.items())


def test_allan_deviation_holds_no_whole_series(spark):
    found = catalogue.QUERIES["allan_deviation"](spark, "/root/testdata/sf0.001")
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("order", [[None, 3.0, 1.0, 2.0, float("nan"), 2.5], [7.0, 7.0, 7.0], [float("inf"), 1.0, 2.0], [1, 5, 4, None], [-1e9, 0.0, 1.0, 2.0]])
def test_number_evenly(spark, order, monkeypatch):
    monkeypatch.setattr(series, "BLOCK", 2)
    df = spark.createDataFrame([("a", v) for v in order], f"node string, o {'bigint' if 5 in order else 'double'}")
    got = sorted(series.number_evenly(df, ["node"], "o").collect(), key=lambda r: r.i)
    assert [(r.i, r.n) for r in got] == [(k + 1, len(order)) for k in range(len(order))]
    assert [repr(r.o) for r in got] == [repr(r.o) for r in df.orderBy("o").collect()]
