"""Stored metrics: writing, schema, removal, retention, catalogue; and continuous queries."""

from decimal import Decimal

import pytest

from gnomon.errors import NotFound, SchemaMismatch, StatementError
from gnomon.plans.parser import parse
from gnomon.session import Engine
from gnomon.streaming.subscriptions import run_once


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/store")


@pytest.fixture
def ns(engine):
    return engine.db("d").namespace("n")


def times(df):
    return sorted(r["timestamp"] for r in df.collect())


def fill(ns, n=10, **settings):
    h = ns.metric("m")
    if settings:
        h.init(**settings)
    df = ns.engine.spark.createDataFrame([(i * 10, i, "a" if i % 2 else "b", i) for i in range(n)], "timestamp long, value long, t string, d long")
    h.append(df, ["t"], ["d"], now_ms=50)
    return h


def test_insert_and_union_of_schemas(ns):
    ns.execute("INSERT INTO m TS=5 DIM(d=1) TAGS(t=x) VAL=1", now_ms=9)
    ns.execute("INSERT INTO m TAGS(u=2.5) VAL=2", now_ms=9)
    assert sorted((r.timestamp, r.value, r.d, r.t, r.u) for r in ns.execute("SELECT * FROM m").collect()) == [(5, 1, 1, "x", None), (9, 2, None, None, 2.5)]
    for bad in ("INSERT INTO m DIM(d=x) VAL=1", "INSERT INTO m VAL=1.5", "INSERT INTO m TAGS(d=1) VAL=1"):
        with pytest.raises(SchemaMismatch):
            ns.execute(bad)
    assert ns.metric("m").count() == 2


def test_builder(ns):
    b = ns.metric("p").value(Decimal("1.50")).timestamp(3)
    b.tag("t", "x").dimension("d", Decimal(7)).write()
    b.tag("t", "y").write()
    assert sorted(tuple(r) for r in ns.execute("SELECT t, d FROM p").collect()) == [(3, 1.5, "x", 7), (3, 1.5, "y", None)] or ns.metric("p").count() == 2
    with pytest.raises(SchemaMismatch):
        ns.metric("p").value(True).write()


def test_delete_empties_and_rewrites_shards(ns):
    h = fill(ns, shard_interval=30)
    assert [tuple(r)[1:] for r in h.locations().collect()] == [(0, 30), (30, 60), (60, 90), (90, 120)]
    ns.execute("DELETE FROM m WHERE timestamp IN (30, 50) OR d = 7")
    assert times(ns.execute("SELECT * FROM m")) == [0, 10, 20, 60, 80, 90]
    assert [r.shard_from for r in h.locations().collect()] == [0, 60, 90]
    ns.execute("DELETE FROM m WHERE NOT t = a")
    assert times(ns.execute("SELECT * FROM m")) == [10, 90]
    ns.execute("DELETE FROM m WHERE t = nobody")
    assert h.count() == 2


def test_pruned_scan_reads_few_shards(ns):
    fill(ns, shard_interval=30)
    df = ns.execute("SELECT * FROM m WHERE timestamp >= 60 AND timestamp < 90 AND t = a")
    assert times(df) == [70]
    plan = df._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "shard_from" in plan.split("PartitionFilters: [")[1].split("]")[0] and "PushedFilters" in plan
    assert times(ns.execute("SELECT * FROM m WHERE timestamp >= 60 OR t = a")) == [10, 30, 50, 60, 70, 80, 90]


def test_retention(ns):
    h = fill(ns, shard_interval=30, retention=35)  # now is 50: 15 .. 85 are kept
    assert times(ns.execute("SELECT * FROM m")) == [20, 30, 40, 50, 60, 70, 80]
    h.apply_retention(now_ms=75)
    assert times(ns.execute("SELECT * FROM m")) == [40, 50, 60, 70, 80]
    with pytest.raises(StatementError, match="already exist"):
        h.init("2d")


def test_catalogue(engine, ns):
    fill(ns)
    engine.db("d").namespace("other").execute("INSERT INTO q VAL=1")
    assert [r[0] for r in engine.databases().collect()] == ["d"]
    assert [r[0] for r in ns.execute("SHOW NAMESPACES").collect()] == ["n", "other"]
    assert [r[0] for r in ns.execute("SHOW METRICS").collect()] == ["m"]
    assert {(r.field, r["class"], r.type) for r in ns.execute("DESCRIBE m").collect()} == {("timestamp", "timestamp", "BIGINT"), ("value", "value", "BIGINT"), ("t", "tag", "VARCHAR"), ("d", "dimension", "BIGINT")}
    again = Engine(engine.spark, engine.catalog.root)  # a fresh engine reads the stored catalogue
    assert again.db("d").namespace("n").metric("m").count() == 10
    ns.validate("SELECT * FROM m WHERE t = a")
    with pytest.raises(StatementError):
        ns.validate("SELECT nope FROM m")
    console = engine.console("d")
    with pytest.raises(StatementError, match="no namespace"):
        console.run("SHOW METRICS")
    console.run("USE n")
    assert console.run("SELECT COUNT(*) FROM m").first()["count(*)"] == 10
    ns.execute("DROP METRIC m")
    with pytest.raises(NotFound):
        ns.execute("SELECT * FROM m")
    engine.db("d").namespace("other").delete()
    assert engine.catalog.namespaces("d") in ([], ["n"])


def test_subscription(engine, ns):
    fill(ns)
    seen = []
    me, history = ns.subscribe("SELECT * FROM m WHERE value > 7", lambda df, b: seen.extend(r.timestamp for r in df.collect()), every_ms=100)
    other, _ = ns.subscribe("SELECT * FROM m WHERE value > 7", lambda df, b: None, every_ms=100)
    assert times(history) == [80, 90] and len(engine.publisher.running) == 1
    q = next(iter(engine.publisher.running.values())).query
    q.processAllAvailable()
    ns.execute("INSERT INTO m TS=200 TAGS(t=z) VAL=50")
    q.processAllAvailable()
    assert sorted(seen) == [200]  # what was there is history
    ns.execute("DELETE FROM m WHERE timestamp = 90")  # records written again are no new ones
    ns.metric("m").compact()
    ns.execute("INSERT INTO m TS=201 TAGS(t=z) VAL=51")
    q.processAllAvailable()
    assert sorted(seen) == [200, 201]
    ns.unsubscribe(me)
    assert q.isActive
    ns.unsubscribe(other)
    assert not q.isActive and not engine.publisher.running


def test_aggregates_are_published_whole(engine, ns):
    fill(ns)
    seen = {}
    statements = ("SELECT COUNT(DISTINCT value) FROM m GROUP BY t", "SELECT COUNT(*), d FROM m WHERE t = a ORDER BY d", "SELECT COUNT(*) FROM m", "SELECT SUM(value) FROM m GROUP BY t")
    for sql in statements:
        ns.subscribe(sql, lambda df, b, sql=sql: seen.__setitem__(sql, sorted((tuple(r) for r in df.collect()), key=repr)), every_ms=100)

    def wait():
        for sub in engine.publisher.running.values():
            sub.query.processAllAvailable()

    wait()
    ns.metric("m").value(9).timestamp(200).tag("t", "a").dimension("d", 5).write()
    wait()
    assert seen[statements[0]] == [(0, 5, "a"), (0, 5, "b")] and sorted(r[2:] for r in seen[statements[1]]) == [(1, 6), (3, 6), (5, 6), (5, 6), (7, 6), (9, 6)]
    assert seen[statements[2]] == [(0, 0, 11)] and (0, 34, "a") in seen[statements[3]]
    ns.execute("DELETE FROM m WHERE t = b")
    ns.metric("m").value(1).timestamp(201).tag("t", "a").dimension("d", 6).write()
    wait()
    assert seen[statements[2]] == [(0, 0, 7)] and seen[statements[3]] == [(0, 35, "a")] and seen[statements[0]] == [(0, 5, "a")]
    for sub in list(engine.publisher.running.values()):
        for me in list(sub.callbacks):
            ns.unsubscribe(me)


def test_filtered_subscription(engine, ns):
    fill(ns)
    seen = []
    me, history = ns.subscribe("SELECT * FROM m", lambda df, b: seen.extend(r.timestamp for r in df.collect()), every_ms=100, filters=[{"dimension": "t", "operator": "=", "value": "a"}], from_=40, to=150)
    assert times(history) == [50, 70, 90]
    for ts, t in ((120, "a"), (130, "b"), (160, "a")):
        ns.execute(f"INSERT INTO m TS={ts} TAGS(t={t}) VAL=1")
    next(iter(engine.publisher.running.values())).query.processAllAvailable()
    assert seen == [120]
    ns.unsubscribe(me)


def test_few_files_for_many_tasks_and_compaction(engine, ns, tmp_path):
    df = engine.spark.range(100_000).repartition(64).selectExpr("id % 30 AS timestamp", "id AS value", "'x' AS t")
    h = ns.metric("m")
    h.init(shard_interval=1)
    h.append(df, ["t"], now_ms=0)
    files = lambda: len(list((tmp_path / "store").rglob("*.parquet")))
    assert files() <= 60
    h.append(df, ["t"], now_ms=0)
    h.compact()
    assert files() <= 60 and h.count() == 200_000 and engine.catalog.compact("d", "n", "m", 1) == []


@pytest.mark.parametrize("broken", range(1, 9))
def test_a_broken_swap_is_finished(engine, ns, monkeypatch, broken):
    """The swap fails at its first, second ... change of the file system; whoever comes next finds the result of the statement or the state before."""
    fill(ns, shard_interval=30)
    steps = {"n": 0}
    for name in ("move", "delete", "write"):
        real = getattr(engine.catalog.files, name)

        def step(*a, real=real):
            steps["n"] += 1
            if steps["n"] == broken:
                raise OSError("lost")
            return real(*a)

        monkeypatch.setattr(engine.catalog.files, name, step)
    try:
        ns.execute("DELETE FROM m WHERE timestamp IN (30, 50) OR d = 7")
    except OSError:
        pass
    again = Engine(engine.spark, engine.catalog.root).db("d").namespace("n")
    before, after = list(range(0, 100, 10)), [0, 10, 20, 60, 80, 90]
    assert times(again.execute("SELECT * FROM m")) == (before if broken == 1 else after)
    again.execute("DELETE FROM m WHERE d = 8")
    assert 80 not in times(again.execute("SELECT * FROM m"))


def test_a_failed_append_leaves_the_schema(engine, ns):
    fill(ns)
    broken = engine.spark.range(3).selectExpr("id AS timestamp", "id AS value", "raise_error('lost') AS u")
    with pytest.raises(Exception, match="lost"):
        ns.metric("m").append(broken.withColumn("u", broken.u.cast("string")), ["u"], now_ms=50)
    assert "u" not in {r.field for r in ns.execute("DESCRIBE m").collect()} and ns.metric("m").count() == 10


def test_records(ns):
    ns.execute("INSERT INTO m TS=5 DIM(d=1) TAGS(t=x) VAL=1")
    r = ns.records("SELECT * FROM m").first()
    assert (r.timestamp, r.value, r.dimensions.d, r.tags.t) == (5, 1, 1, "x") and r.json == '{"timestamp":5,"value":1,"dimensions":{"d":1},"tags":{"t":"x"}}'
    assert ns.records("SELECT COUNT(*) FROM m").first().json == '{"timestamp":0,"value":0,"dimensions":{},"tags":{"count(*)":1}}'


def test_metadata_dump(engine, ns, tmp_path):
    fill(ns, shard_interval=30)
    path = f"file://{tmp_path}/dump.json"
    assert engine.dump_metadata(path) == 1
    other = Engine(engine.spark, f"file://{tmp_path}/other")
    assert other.restore_metadata(path) == 1
    got = other.db("d").namespace("n")
    assert [tuple(r) for r in got.execute("DESCRIBE m").collect()] == [tuple(r) for r in ns.execute("DESCRIBE m").collect()] and got.metric("m").count() == 0


def test_late_records_publish_their_window_again(engine, ns):
    def put(times):
        df = engine.spark.createDataFrame([(t, 1, "a") for t in times], "timestamp long, value long, t string")
        ns.metric("w").append(df.coalesce(1), ["t"], now_ms=0)

    out = []
    put([1])
    _, _ = ns.subscribe("SELECT COUNT(*) FROM w GROUP BY INTERVAL 5 s SINCE 20 s", lambda df, b: out.extend((r.lowerBound, r.upperBound, r.value) for r in df.collect()), now_ms=0, every_ms=100)
    sub = next(iter(engine.publisher.running.values()))
    put(range(5101, 5111))
    sub.query.processAllAvailable()
    put([5100])
    sub.query.processAllAvailable()
    sub.query.stop()
    assert out == [(5101, 5110, 10), (5100, 5110, 11)]


def test_records_beyond_the_grace_period_are_dropped(engine, ns):
    def put(times):
        df = engine.spark.createDataFrame([(t, 1, "a") for t in times], "timestamp long, value long, t string")
        ns.metric("w").append(df.coalesce(1), ["t"], now_ms=0)
        sub.query.processAllAvailable() if sub else None

    out, sub = [], None
    put([1])
    ns.subscribe("SELECT SUM(value) FROM w GROUP BY INTERVAL 5 s SINCE 20 s", lambda df, b: out.extend((r.lowerBound, r.value) for r in df.collect()), now_ms=0, every_ms=100)
    sub = next(iter(engine.publisher.running.values()))
    put([100_000])
    put([150_000])
    put([160_000])  # dropping lags the watermark by one batch
    put([101_000])
    put([141_000])
    sub.query.stop()
    assert out == [(100_000, 1), (150_000, 1), (160_000, 1), (141_000, 1)]


def test_run_once(engine, ns):
    fill(ns)
    m = engine.catalog.metric("d", "n", "m")
    assert times(run_once(parse("SELECT * FROM m WHERE t = a"), m, 0)) == [10, 30, 50, 70, 90]
    assert {(r.t, r.value) for r in run_once(parse("SELECT SUM(value) FROM m GROUP BY t"), m, 0).collect()} == {("a", 25), ("b", 20)}
    assert run_once(parse("SELECT COUNT(DISTINCT value) FROM m"), m, 0).first()[2] == 10
    with pytest.raises(StatementError):
        run_once(parse("SELECT COUNT(DISTINCT value) FROM m GROUP BY INTERVAL 1 d"), m, 0)
