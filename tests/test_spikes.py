"""Judged readings against a brute-force version with exact quantiles, on sources of known character."""

import random

import numpy as np

from gnomon.operators.spikes import CALM, EXPAND, _pooled, judge_readings, thin

READINGS = "db string, namespace string, metric string, timestamp long, value double, name string, stuck int"
LIMITS = "db string, namespace string, metric string, value_low double, value_high double"


def brute(series, low, high):
    """Flags by (name, timestamp): of the whole source's scatter, with the sketch's fallback for coarse readings."""
    out = {}
    for name, points in series.items():
        points = sorted(set(points))
        t, v = np.array([p[0] for p in points]), np.array([p[1] for p in points])
        bad = (v < low) | (v > high)
        run = np.concatenate([[0], np.cumsum(np.diff(v) != 0)])
        size = np.bincount(run)
        length = size[run]
        levels = size[size < 12].max(initial=0) > 5 or size[size >= 12].sum() > 0.5 * len(v)
        ok = np.flatnonzero(~bad & (length < 12))
        first = [max(0, min(i - 8, len(ok) - 17)) for i in range(len(ok))]
        near = [np.sort(v[ok[f : f + 17]]) for f in first]
        res = np.array([v[ok[i]] - np.median(near[i]) for i in range(len(ok))])
        step = [min(d[d > 0], default=0.0) for d in map(np.diff, near)]
        spread = res + np.array(step) * (np.random.default_rng(0).random(len(res)) - 0.5)
        q = np.quantile(spread, [0.25, 0.75, 0.05, 0.95]) if len(res) >= 5 else np.array([0, 1e300, 0, 1e300])
        fence = EXPAND * max(q[1] - q[0], (q[3] - q[2]) / 3.3)
        far, calm = np.abs(res) > fence, np.abs(res) <= CALM * fence
        spike = set()
        i = 0
        while i < len(ok):
            j = i
            while j < len(ok) and far[j]:
                j += 1
            if 0 < j - i <= 3 and i > 0 and j < len(ok) and calm[i - 1] and calm[j]:
                spike |= set(ok[i:j].tolist())
            i = max(j, i + 1)
        for k in range(len(v)):
            out[name, int(t[k])] = (bool(bad[k]), k in spike and not levels, bool(length[k] >= 12) and not levels)
    return out


def made(seed=0):
    rng = random.Random(seed)
    s = {}
    s["calm"] = [(i * 600_000, 20 + rng.gauss(0, 0.2)) for i in range(240)]
    s["wave"] = [(i * 600_000, 20 + 8 * np.sin(i / 30) + rng.gauss(0, 0.3)) for i in range(240)]
    s["step"] = [(i * 600_000, (20 if i < 100 else 35) + rng.gauss(0, 0.3)) for i in range(240)]
    s["levels"] = [(i * 600_000, [10.0, 30.0, 20.0, 15.0][i // 37 % 4]) for i in range(240)]
    s["coarse"] = [(i * 600_000, float(rng.choice([5, 5, 5, 6, 4]))) for i in range(240)]
    for n in ("calm", "wave", "step"):
        p = s[n]
        p[30] = (p[30][0], p[30][1] + 9)
        p[60], p[61], p[62] = ((p[i][0], p[i][1] - 12) for i in (60, 61, 62))
        for i in range(150, 165):
            p[i] = (p[i][0], 21.25)
        p[200] = (p[200][0], 9999.0)
    s["late step"] = [(i * 600_000, (20 if i < 234 else 35) + rng.gauss(0, 0.3)) for i in range(240)]
    s["few"] = [(0, 1.0), (1, 50.0), (2, 1.0)]
    return s


def frame(spark, series):
    rows = [("d", "n", "m", t, float(v), name, 0) for name, p in series.items() for t, v in p]
    return spark.createDataFrame(rows + rows[:100] + [("d", "n", "m", 5, None, "calm", 0), ("d", "n", "m", 5, 1.0, None, 0), ("d", "n", "m", None, 1.0, "calm", 0)], READINGS)


def result(df):
    return {(r["name"], r["timestamp"]): (r["impossible"], r["spike"], r["stuck"]) for r in df.collect()}


def test_against_brute_force(spark):
    series = made()
    limits = spark.createDataFrame([("d", "n", "m", -50.0, 500.0)], LIMITS)
    got, want = result(judge_readings(frame(spark, series), limits)), brute(series, -50, 500)
    assert got == want
    assert sum(f[1] for (n, _), f in got.items()) == 12 and not any(any(f) for (n, _), f in got.items() if n in ("levels", "few", "late step"))


def test_chunks_change_nothing(spark):
    series = {"calm": [(i * 600_000, 20 + random.Random(i).gauss(0, 0.2) + (15 if i % 97 == 0 else 0)) for i in range(3000)]}
    limits = spark.createDataFrame([], LIMITS)
    df = frame(spark, series)
    assert result(judge_readings(df, limits, rows_per_chunk=900)) == result(judge_readings(df, limits))


def test_empty(spark):
    assert judge_readings(spark.createDataFrame([], READINGS), spark.createDataFrame([], LIMITS)).collect() == []


def test_rate(spark):
    """A leap is too fast by the source's own rates; the same change in small steps, or in a source that always leaps, isn't."""
    rng = random.Random(2)
    series = {n: [(i * 1000, 20 + rng.gauss(0, 0.3)) for i in range(300)] for n in ("leap", "slow", "wild")}
    series["leap"] = [(t, v + (30 if t >= 150_000 else 0)) for t, v in series["leap"]]
    series["slow"] = [(t, v + t / 10_000) for t, v in series["slow"]]
    series["wild"] = [(t, v + 30 * rng.random()) for t, v in series["wild"]]
    df, none = frame(spark, series), spark.createDataFrame([], LIMITS)
    for size in (500_000, 50):
        got = judge_readings(df, none, rows_per_chunk=size).where("too_fast").collect()
        assert [(r["name"], r["timestamp"]) for r in got] == [("leap", 150_000)]


def long_and_stuck():
    """A source with stuck stretches of many lengths, impossible ones among them, and spikes right beside."""
    rng = random.Random(11)
    p = [(i * 20_000, round(20 + rng.gauss(0, 0.5), 2)) for i in range(3000)]
    for a, b, v in ((300, 305, 20.0), (600, 1095, 21.25), (1100, 1105, 21.25), (1300, 1330, 9999.0), (1330, 1390, 19.0), (1990, 2002, 22.0), (2400, 2990, 20.5)):
        for i in range(a, b):
            p[i] = (p[i][0], v)
    for i in (299, 598, 1097, 1098, 1294, 1400, 1988, 2005, 2393, 2995):
        p[i] = (p[i][0], p[i][1] + 30)
    return p


def test_cuts_beside_stuck_stretches_change_nothing(spark, rows):
    series = {"s": long_and_stuck(), "t": [(t + 7, v) for t, v in long_and_stuck()[500:1200]], "short": [(i, float(i % 3)) for i in range(30)]}
    df, limits = frame(spark, series), spark.createDataFrame([("d", "n", "m", -50.0, 500.0)], LIMITS)
    columns = ["name", "timestamp", "value", "baseline", "impossible", "spike", "stuck", "too_fast"]
    whole = rows(judge_readings(df, limits).select(*columns))
    assert sum(r[5] for r in whole) > 8 and sum(r[6] for r in whole) > 1000
    for size in (40, 350, 1000):  # under 180 readings an hour, milliseconds cut
        assert rows(judge_readings(df, limits, rows_per_chunk=size).select(*columns)) == whole


def test_hours_without_a_context_are_pooled():
    chunk, hour = np.array([0] * 9 + [1] * 3), np.array([0, 1, 2, 5, 6, 7, 8, 9, 10, 3, 4, 5])
    count = np.array([2, 2, 2, 2, 2, 30, 20, 2, 2, 1, 1, 1])
    # 7 and 8 have over 48 around them; 6 and 9 are counted into theirs; 0 and 10, 3 and 5 are at ends, with their neighbours
    assert _pooled(chunk, hour, count).tolist() == [False, False, True, True, False, False, False, False, False, False, False, False]


def test_thin_ends():
    rng = random.Random(5)
    for _ in range(200):
        v = []
        while len(v) < 300:
            v += [float(rng.randrange(50))] * rng.choice([1, 1, 1, 2, 5, 11, 12, 13, 40])
        v = np.array(v)
        bad, gap = np.array([rng.random() < 0.1 for _ in v]), np.zeros(len(v), bool)
        keep, gaps, full = thin(np.arange(len(v)), v, bad, gap)
        run = np.cumsum(np.append(True, v[1:] != v[:-1])) - 1
        length = np.bincount(run)[run]
        usable = np.flatnonzero(~bad & (length < 12))
        kept = keep[~gaps]
        assert set(usable[usable <= keep[-1]]) <= set(kept) and (full or keep[-1] == len(v) - 1)
        assert (v[keep[: min(12, length[0])]] == v[0]).all() and (not full or len(usable[usable <= keep[-1]]) >= 40) and len(keep) < 250


def test_a_run_by_chance_or_a_repeated_sentinel_hides_no_spike(spark):
    rng = random.Random(4)
    series = {n: [(i * 600_000, 20 + rng.gauss(0, 0.3)) for i in range(240)] for n in ("run", "sentinel")}
    for n, p in series.items():
        p[30] = (p[30][0], p[30][1] + 15)
        for i in range(100, 106):
            p[i] = (p[i][0], 20.25 if n == "run" else 9999.0)
    # set levels held for 8 readings each stay no case
    series["short holds"] = [(i * 600_000, [10.0, 30.0, 20.0, 15.0][i // 8 % 4] + (40 if i == 131 else 0)) for i in range(240)]
    got = result(judge_readings(frame(spark, series), spark.createDataFrame([("d", "n", "m", -50.0, 500.0)], LIMITS)))
    assert {k for k, f in got.items() if f[1]} == {("run", 30 * 600_000), ("sentinel", 30 * 600_000)}
    assert sum(f[0] for f in got.values()) == 6 and not any(f[2] for f in got.values())


def test_a_dead_sensor_holds_no_set_levels(spark):
    rng = random.Random(5)
    series = {"dead": [(i * 600_000, 20 + rng.gauss(0, 0.3) if i < 100 else 20.25) for i in range(250)]}
    series["dead"][30] = (30 * 600_000, 40.0)
    series["on and off"] = [(i * 600_000, float(i // 40 % 2)) for i in range(250)]
    series["constant"] = [(i * 600_000, 3.0) for i in range(250)]
    limits = spark.createDataFrame([("d", "n", "m", -50.0, 500.0)], LIMITS)
    for chunk in (500_000, 60):  # the dead stretch over several chunks too
        got = result(judge_readings(frame(spark, series), limits, rows_per_chunk=chunk))
        assert {k for k, f in got.items() if f[1]} == {("dead", 30 * 600_000)}
        assert {k for k, f in got.items() if f[2]} == {("dead", i * 600_000) for i in range(100, 250)}
