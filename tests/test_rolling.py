"""Rolling totals against brute force, and the cases that mustn't break them."""

import datetime as dt
import random

from gnomon.operators.rolling import rolling_totals

SCHEMA = "row_id long, timestamp long, value long, name string, city string, ingested_at long"
DAY = 86_400_000


def brute(rows, windows=(7, 30)):
    bits = {(t, v, n, c) for _, t, v, n, c, _ in rows if n is not None and t is not None}
    out = {}
    for name in {b[2] for b in bits}:
        own = [(t // DAY, v) for t, v, n, _ in bits if n == name]
        for d in range(min(x[0] for x in own), max(x[0] for x in own) + 1):
            r = [sum(x == d for x, _ in own)]
            for w in windows:
                inside = [v for x, v in own if d - w < x <= d]
                known = [v for v in inside if v is not None]
                r += [sum(known), len(inside), sum(known) / w, sum(known) / len(known) if known else None]
            out[name, (dt.date(1970, 1, 1) + dt.timedelta(d)).isoformat()] = tuple(r)
    return out


def result(df):
    return {(r[0], r[1]): tuple(int(x) if i in (0, 1, 2, 5, 6) else x for i, x in enumerate(r[2:])) for r in df.collect()}


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(-40 * DAY, 90 * DAY), rng.choice([None, -5, 0, 3, 10**15]), rng.choice(["a", "b", "", None]), rng.choice(["x", None]), i) for i in range(120)]
    rows += [(1000 + i, *r[1:5], 7) for i, r in enumerate(rows[:40])]  # copies
    rows += [(2000, None, 1, "a", "x", 0), (2001, 5 * DAY - 1, 1, "late", None, 0), (2002, 5 * DAY, 1, "late", None, 0)]
    assert result(rolling_totals(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_empty_and_clashing_columns(spark):
    assert rolling_totals(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, 0, 5, "a", 1, 2, "z", 9)], "row_id long, timestamp long, value int, name string, total_7 int, bits int, day_utc string, _e int")
    r = rolling_totals(df).first()
    assert (r["name"], r["day_utc"], r["bits"], r["total_7"]) == ("a", "1970-01-01", 1, 5)


def test_huge_and_real_values(spark):
    big = (1 << 63) - 1
    df = spark.createDataFrame([(i, i, big, "a", "c", 0) for i in range(5)], SCHEMA)
    assert rolling_totals(df).first()["total_7"] == 5 * big
    real = spark.createDataFrame([(0, 1.5, "a"), (40 * DAY, 2.5, "a")], "timestamp long, value double, name string")
    got = {r["day_utc"]: r["total_30"] for r in rolling_totals(real).collect()}
    assert len(got) == 41 and got["1970-01-30"] == 1.5 and got["1970-01-31"] == 0.0 and got["1970-02-10"] == 2.5
