import random

from gnomon.operators.grid import regular_grid

READINGS = "row_id long, db string, namespace string, metric string, timestamp long, value double, name string, upper_bound int"
GRIDS = "query_id long, db string, namespace string, metric string, interval_ms long, upper_ms long"


def brute(rows, w, u, limit):
    out = {}
    for name in {r[6] for r in rows if r[6] is not None}:
        own = sorted({(r[4], r[5]) for r in rows if r[6] == name and r[4] is not None and r[5] is not None and r[4] <= u})
        if not own:
            continue
        k = [(u - t) // w for t, _ in own]
        for p in range(min(k), max(k) + 1):
            ub = u - p * w
            before, after = [x for x in own if x[0] <= ub], [x for x in own if x[0] > ub]
            a, b = before[-1], after[0] if after else None
            seen = p in k
            near = b is not None and b[0] - a[0] <= limit * w
            v = a[1] if a[0] == ub else a[1] + (b[1] - a[1]) * ((ub - a[0]) / (b[0] - a[0])) if near else a[1] if seen else None
            out[name, ub] = (None if v is None else round(v, 9), "observed" if seen else "interpolated" if near else "missing")
    return out


def result(df):
    return {(r["name"], r["upper_bound"]): (None if r["value"] is None else round(r["value"], 9), r["status"]) for r in df.collect()}


def rows(seed=1, n=200):
    rng = random.Random(seed)
    return [(i, "d", "n", "m", rng.choice([None, *range(0, 5000, 3)]), rng.choice([None, 1.0, 2.5, -3.0]), rng.choice(["a", "b", "", None]), 1) for i in range(n)] + [
        (900, "d", "n", "m", 5000, 4.0, "edge", 1), (901, "d", "n", "m", 9000, 4.0, "above", 1), (902, "d", "x", "m", 10, 4.0, "a", 1)]


def test_against_brute_force(spark):
    data = rows()
    grid = spark.createDataFrame([(1, "d", "n", "m", 40, 5000), (2, "d", "n", "other", 10, 10), (3, "d", "n", "m2", 0, 10)], GRIDS)
    got = result(regular_grid(spark.createDataFrame(data, READINGS), grid, gap_limit=3))
    assert got == brute([r for r in data if r[2] == "n"], 40, 5000, 3)


def test_chunks_change_nothing(spark):
    data = rows(2, 400)
    grid = spark.createDataFrame([(1, "d", "n", "m", 1, 5001)], GRIDS)
    df = spark.createDataFrame(data, READINGS)
    assert result(regular_grid(df, grid, rows_per_chunk=20)) == result(regular_grid(df, grid)) == brute([r for r in data if r[2] == "n"], 1, 5001, 5)


def test_long_gap_and_empty(spark):
    grid = spark.createDataFrame([(1, "d", "n", "m", 1, 100_000)], GRIDS)
    df = spark.createDataFrame([(0, "d", "n", "m", 1, 1.0, "a", 1), (1, "d", "n", "m", 99_999, 2.0, "a", 1)], READINGS)
    g = regular_grid(df, grid)
    assert g.count() == 99_999 and g.where("status = 'missing'").count() == 99_997
    assert regular_grid(spark.createDataFrame([], READINGS), grid).collect() == []
    assert regular_grid(df, spark.createDataFrame([], GRIDS)).collect() == []
