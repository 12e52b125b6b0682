"""The change feed against a step-by-step replay; folding in any order and in parts."""

import random

import pytest

from gnomon.operators.changes import apply_changes, current_bits, fold_changes

SCHEMA = "row_id long, db string, namespace string, metric string, ts long, entry_no int, action string, bit_id long, bit_timestamp long, bit_value double, bit_name string, location_from long, location_to long, arrived_at long"


def replay(rows):
    bits = {}
    for _, db, ns, m, ts, no, action, bit, t, v, n, lo, hi, _ in sorted({r[1:-1] and (0, *r[1:-1], 0) for r in rows}, key=lambda r: (r[4], r[5])):
        if action == "PersistedEntryAction" and bit is not None:
            bits[bit] = (db, ns, m, ts, no, t, v, n)
        elif action == "DeleteAction":
            bits.pop(bit, None)
        else:
            for b, x in list(bits.items()):
                if x[:2] != (db, ns):
                    continue
                if action == "DeleteNamespaceAction" or x[2] == m and (action == "DeleteMetricAction" or action == "EvictShardAction" and x[5] is not None and lo is not None and lo <= x[5] < hi):
                    del bits[b]
    return bits


def feed(seed, n=700):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        action = rng.choices(["PersistedEntryAction", "DeleteAction", "EvictShardAction", "DeleteMetricAction", "DeleteNamespaceAction", "ReceivedEntryAction"], [60, 15, 15, 2, 1, 7])[0]
        lo = rng.randrange(0, 900)
        rows.append((i, "d", rng.choice("pq"), None if action == "DeleteNamespaceAction" else rng.choice("mno"), i // 3, i % 3, action,
                     None if "Shard" in action or action.startswith("DeleteM") or action.startswith("DeleteN") else rng.randrange(120),
                     rng.choice([None, *range(0, 1000, 7)]) if action == "PersistedEntryAction" else None, float(i), rng.choice([None, "x"]), lo, lo + rng.choice([1, 30, 31, 64, 500]), i))
    rows += [(n + i, *r[1:-1], 9999) for i, r in enumerate(rng.sample(rows, n // 4))]
    rng.shuffle(rows)
    return rows


def result(df):
    return {r["bit_id"]: tuple(r[c] for c in ("db", "namespace", "metric", "ts", "entry_no", "bit_timestamp", "bit_value", "bit_name")) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_replay(spark, seed):
    rows = feed(seed)
    assert result(apply_changes(spark.createDataFrame(rows, SCHEMA))) == replay(rows)


def test_parts_in_any_order(spark):
    rows = feed(3)
    parts = [spark.createDataFrame(rows[i::3], SCHEMA) for i in range(3)]
    state = None
    for p in parts:
        state = fold_changes(p, state)
    assert result(current_bits(state)) == replay(rows)
    state = None
    for p in [*parts[::-1], parts[0]]:
        state = fold_changes(p, state)
    assert result(current_bits(state)) == replay(rows)


def test_odd_entries(spark):
    rows = [
        (0, "d", "n", "m", 5, 0, "PersistedEntryAction", None, 1, 1.0, "a", None, None, 0),
        (1, None, None, None, 5, 0, "PersistedEntryAction", 1, None, None, None, None, None, 0),
        (2, "d", "n", "m", None, None, "PersistedEntryAction", 2, 1, 1.0, "a", None, None, 0),
        (3, "d", "n", "m", 4, 0, "DeleteAction", 3, None, None, None, None, None, 0),
        (4, "d", "n", "m", 9, 0, "EvictShardAction", None, None, None, None, None, None, 0),
        (5, "d", "n", "m", 9, 0, "UnheardOf", 2, None, None, None, None, None, 0),
        (6, "d", "n", "m", 9, 1, "EvictShardAction", None, None, None, None, -5, 1, 0),
        (7, "d", "n", "m", 3, 0, "PersistedEntryAction", 4, -1, 1.0, "a", None, None, 0),
    ]
    assert set(result(apply_changes(spark.createDataFrame(rows, SCHEMA)))) == {1, 2}
    assert apply_changes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_an_evicted_range_with_half_of_all_bits_is_spread(spark):
    """Without broadcasts, the join on ranges moves the bits of one hot range to many tasks."""
    hot = [(i, "d", "p", "m", 1, i, "PersistedEntryAction", i, 500, 1.0, None, None, None, i) for i in range(4000)]
    rest = [(10_000 + i, "d", "p", f"m{i % 400}", 1, i, "PersistedEntryAction", 10_000 + i, i, 1.0, None, None, None, i) for i in range(4000)]
    evict = [(90_000, "d", "p", "m", 2, 0, "EvictShardAction", None, None, None, None, 0, 1000, 0), (90_001, "d", "p", "m7", 2, 0, "EvictShardAction", None, None, None, None, 0, 1000, 0)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = current_bits(fold_changes(spark.createDataFrame(hot + rest + evict, SCHEMA)))
        assert {r.bit_id for r in got.select("bit_id").collect()} == {r[7] for r in rest if not (r[3] == "m7" and r[8] < 1000)}
        plan = got._jdf.queryExecution().executedPlan().toString()
        keys = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "hashpartitioning(" in line and "_bucket" in line]
        assert len(keys) >= 2 and all("_salt" in k for k in keys)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
