import random

import numpy as np
import pytest

from gnomon.operators.percentiles import marked_runs, merge_marks, merge_runs, percentiles, seal, value_marks, value_runs
from gnomon.operators.skew import heavy_keys, per_key

SCHEMA = "row_id long, k string, j long, timestamp long, value double, name string, n int, _part int"


def rows(seed=5, n=3000):
    rng = random.Random(seed)
    out = [(i, rng.choice(["hot"] * 30 + ["a", "b", None, ""]), rng.choice([1, None]), rng.randrange(10**6), rng.choice([None, 0.0, -0.0, rng.gauss(0, 1e3), float("nan"), 7.0]), rng.choice(["x", "y", None]), 1, 2) for i in range(n)]
    return out + [(10**6 + i, *r[1:]) for i, r in enumerate(out[:500])]


QS = (0.0, 0.01, 0.25, 0.5, 0.999, 1.0)


def test_percentiles_are_exact(spark):
    data = rows()
    got = {r["k"]: r for r in percentiles(value_runs(spark.createDataFrame(data, SCHEMA), ["k"]), QS).collect()}
    once = {r[1:] if r[4] == r[4] else (*r[1:4], "nan", *r[5:]) for r in data}
    for k in ("hot", "a", "b", ""):
        v = [r[3] for r in once if r[0] == k and r[3] is not None and r[3] != "nan"]
        assert got[k]["n"] == len(v)
        for q, c in zip(QS, ("p0", "p1", "p25", "p50", "p99_9", "p100")):
            assert got[k][c] == pytest.approx(np.quantile(v, q), rel=1e-12, abs=1e-12)
    assert set(got) == {"hot", "a", "b", ""}


def test_runs_of_days_combine(spark):
    df = spark.createDataFrame(rows(), SCHEMA).dropDuplicates(["k", "j", "timestamp", "value", "name"])
    parts = [value_runs(df.where(f"timestamp % 3 = {d}"), ["k"]) for d in range(3)]
    one, many = percentiles(value_runs(df, ["k"])), percentiles(merge_runs(*parts))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_copies_across_files_count_once(spark):
    data = rows()
    rng = random.Random(8)
    files = [data[i::3] for i in range(3)]
    files = [f + [(2 * 10**6 + i, *r[1:]) for i, r in enumerate(rng.sample(data, 400))] for f in files]  # copies of the others' rows
    one = sorted(map(tuple, percentiles(value_runs(spark.createDataFrame(data, SCHEMA), ["k"])).collect()))
    marks = [value_marks(spark.createDataFrame(f, SCHEMA), ["k"], timestamp="timestamp") for f in files]
    assert sorted(map(tuple, percentiles(marked_runs(merge_marks(*marks))).collect())) == one
    runs, still_open = seal(merge_marks(*marks[:2], marks[2]), 500_000)  # nothing before that comes again
    late = value_marks(spark.createDataFrame([r for r in data if r[3] >= 500_000][:300], SCHEMA), ["k"], timestamp="timestamp")
    assert sorted(map(tuple, percentiles(merge_runs(runs, marked_runs(merge_marks(still_open, late)))).collect())) == one


def test_marks_tell_nulls_apart(spark):
    df = spark.createDataFrame([(1, "a", "x", None), (2, "a", None, "x"), (3, "a", "", "x"), (4, "a", "x", ""), (5, "a", "x", None)], "row_id long, k string, p string, q string").selectExpr("*", "1.5D AS value")
    assert value_runs(df, ["k"]).first()["n"] == 4


def test_one_value_everywhere(spark):
    df = spark.createDataFrame([(i, "k", 1, i, 5.0, "x", 1, 1) for i in range(1000)], SCHEMA)
    r = percentiles(value_runs(df, ["k"])).first()
    assert r["n"] == 1000 and r["p1"] == r["p50"] == r["p99"] == 5.0
    assert percentiles(value_runs(df.where("false"), ["k"])).collect() == []


def test_heavy_keys(spark):
    data = [("a", None)] * 500 + [("b", 1)] * 50 + [(None, None)] * 100 + [("t%d" % i, i) for i in range(349)] + [("edge", 0)]
    df = spark.createDataFrame(data, "k string, j int")
    assert {(r["k"], r["j"], r["n"]) for r in heavy_keys(df, ["k", "j"]).collect()} == {("a", None, 500), ("b", 1, 50), (None, None, 100)}
    assert heavy_keys(df.where("false"), ["k"]).collect() == []


def test_per_key(spark):
    data = [r for r in rows() if r[4] is None or r[4] == r[4]]
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r["k"], r["j"]): r for r in per_key(df, ["k", "j"]).collect()}
    for apart in (0.001, 0.04, 0.9):  # how keys are routed changes nothing but rounding
        other = {(r["k"], r["j"]): r for r in per_key(df, ["k", "j"], apart=apart).collect()}
        assert {k: (r["n_rows"], r["n_bits"], r["n_names"], r["last_timestamp"], r["heavy"]) for k, r in other.items()} == {k: (r["n_rows"], r["n_bits"], r["n_names"], r["last_timestamp"], r["heavy"]) for k, r in got.items()}
    assert set(got) == {(r[1], r[2]) for r in data}
    for key, r in got.items():
        mine = [x for x in data if (x[1], x[2]) == key]
        once = {x[1:] for x in mine}
        values = [x[3] for x in once if x[3] is not None]
        last = max(((x[2], x[3] is not None, x[3] or 0.0) for x in once))
        assert (r["n_rows"], r["n_bits"], r["n_values"], r["n_names"]) == (len(mine), len(once), len(values), len({x[4] for x in once} - {None}))
        assert r["total"] == pytest.approx(sum(values), rel=1e-9, abs=1e-6)
        assert (r["last_timestamp"], r["last_value"] or 0.0) == (last[0], last[2])
        assert r["heavy"] == (len(mine) >= 0.05 * len(data))
    assert per_key(spark.createDataFrame([], SCHEMA), ["k"]).collect() == []
