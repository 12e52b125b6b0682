"""Golden results of the statement language on small metrics."""

import pytest

from gnomon import errors as X
from gnomon.errors import StatementError
from gnomon.session import Engine
from gnomon.sources.metric import from_frame

LONG = [(1, 1, "John", "Doe"), (2, 2, "John", "Doe"), (4, 3, "J", ""), (6, 4, "Bill", "Doe"), (8, 5, "Frank", "Doe"), (10, 6, "Frankie", "Doe")]
AGG = [(2, 2, "John", 15, 30.5), (3, 2, "John", 15, 30.5), (4, 3, "John", 20, 30.5), (5, 3, "John", 20, 30.5), (6, 5, "Bill", 15, 31.0), (7, 5, "Bill", 16, 31.0), (8, 1, "Frank", None, 32.0), (9, 1, "Frank", 15, 32.0), (10, 4, "Frankie", 15, 32.0)]
NEG = [(2, -2.0, "Bill", -15, -30.5), (3, -2.0, "John", 15, 30.5), (4, -3.0, "John", -20, -30.5), (5, -3.0, "John", 20, 30.5), (6, -5.0, "John", -16, -31.0), (7, -6.0, "Bill", 17, -31.0), (8, -1.0, "Frank", -17, 32.0), (9, -1.0, "Frank", 18, -32.0), (10, -4.0, "Frankie", -18, 32.0)]
TIME = [(150000, 2, "John"), (120000, 3, "John"), (90000, 5, "John"), (60000, 7, "Bill"), (30000, 4, "Frank"), (0, 1, "Frankie")]
CHARS = [(150000, 2, "Is this a question? Really"), (120000, 3, "Is this an empathized question?! Or not?"), (90000, 5, "Is this a double question??"), (60000, 7, "a_:m?!-e"), (30000, 4, "a_:m-e"), (0, 1, "John")]
NOW = 160000


@pytest.fixture(scope="module")
def ask(spark, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('store')}")
    tall = "timestamp long, value {}, name string, age long, height double"
    early = {"shards_of": lambda: [(0, 5), (6, 10)]}
    late = {"shards_of": lambda: [(0, 90000), (100000, 190000)]}
    frames = {
        "longMetric": (spark.createDataFrame(LONG, "timestamp long, value long, name string, surname string"), ["name"], ["surname"], early),
        "aggMetric": (spark.createDataFrame(AGG, tall.format("long")), ["name", "age", "height"], [], early),
        "aggDouble": (spark.createDataFrame([(t, float(v), n, a or 15, h) for t, v, n, a, h in AGG], tall.format("double")), ["name", "age", "height"], [], early),
        "negMetric": (spark.createDataFrame(NEG, tall.format("double")), ["name", "age", "height"], [], early),
        "timeMetric": (spark.createDataFrame(TIME, "timestamp long, value long, name string"), ["name"], [], late),
        "charMetric": (spark.createDataFrame(CHARS, "timestamp long, value long, textTag string"), ["textTag"], [], late),
        "emptyMetric": (spark.createDataFrame([], "timestamp long, value long, name string"), ["name"], [], {}),
    }
    for name, (df, tags, dims, more) in frames.items():
        e.register(from_frame(name, df, tags, dims, **more))
    return lambda sql, **how: e.db("db").namespace("ns").execute(sql, now_ms=NOW, **how)


def got(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


@pytest.mark.parametrize(
    "agg, how, expected",
    [
        ("COUNT(*)", "INTERVAL 20 s", [(0, 10, 1), (10, 30, 1), (30, 50, 0), (50, 70, 1), (70, 90, 1), (90, 110, 0), (110, 130, 1), (130, 150, 1), (150, 170, 0), (170, 190, 0)]),
        ("COUNT(*)", "INTERVAL 30 s", [(0, 10, 1), (10, 40, 1), (40, 70, 1), (70, 100, 1), (100, 130, 1), (130, 160, 1), (160, 190, 0)]),
        ("COUNT(*)", "INTERVAL 60 s", [(0, 10, 1), (10, 70, 2), (70, 130, 2), (130, 190, 1)]),
        ("COUNT(*)", "INTERVAL 100 s", [(0, 90, 4), (90, 190, 2)]),
        ("COUNT(*)", "INTERVAL 30 s LIMIT 2", [(130, 160, 1), (160, 190, 0)]),
        ("COUNT(*)", "INTERVAL 30 s SINCE 50 s", [(110, 130, 1), (130, 160, 1), (160, 190, 0)]),
        ("SUM(value)", "INTERVAL 30 s SINCE 80 s", [(80, 100, 5), (100, 130, 3), (130, 160, 2)]),
        ("AVG(value)", "INTERVAL 30 s SINCE 80 s", [(80, 100, 5.0), (100, 130, 3.0), (130, 160, 2.0)]),
        ("MIN(value)", "INTERVAL 30 s", [(0, 10, 1), (10, 40, 4), (40, 70, 7), (70, 100, 5), (100, 130, 3), (130, 160, 2)]),
        ("MIN(value)", "INTERVAL 60 s", [(0, 10, 1), (10, 70, 4), (70, 130, 3), (130, 190, 2)]),
        ("MAX(value)", "INTERVAL 60 s", [(0, 10, 1), (10, 70, 7), (70, 130, 5), (130, 190, 2)]),
        ("AVG(value)", "INTERVAL 60 s", [(0, 10, 1.0), (10, 70, 5.5), (70, 130, 4.0), (130, 190, 2.0)]),
        ("COUNT(DISTINCT value)", "INTERVAL 30 s", [(0, 10, 1), (10, 40, 1), (40, 70, 1), (70, 100, 1), (100, 130, 1), (130, 160, 1)]),
    ],
)
def test_buckets(ask, agg, how, expected):
    out = got(ask(f"SELECT {agg} FROM timeMetric GROUP BY {how}"), "lowerBound", "upperBound", "value")
    assert out == [(a * 1000, b * 1000, v) for a, b, v in expected]


def test_buckets_with_conditions(ask):
    count = "SELECT COUNT(*) FROM timeMetric WHERE timestamp {} GROUP BY INTERVAL {} s"
    bounds = ("lowerBound", "upperBound", "value")
    assert got(ask(count.format(">= 60000", 30)), *bounds) == [(60000, 70000, 1), (70000, 100000, 1), (100000, 130000, 1), (130000, 160000, 1), (160000, 190000, 0)]
    assert got(ask(count.format("< 60000", 30)), *bounds) == [(0, 29999, 1), (29999, 59999, 1)]
    assert got(ask(count.format(">= 60000", 100)), *bounds) == [(60000, 90000, 2), (90000, 190000, 2)]
    assert got(ask(count.format(">= 200000", 30)), *bounds) == []
    up = got(ask("SELECT COUNT(*) FROM timeMetric GROUP BY INTERVAL 30 s"), *bounds)
    assert got(ask("SELECT COUNT(*) FROM timeMetric GROUP BY INTERVAL 30 s ORDER BY timestamp DESC"), *bounds) == up[::-1]
    assert got(ask("SELECT COUNT(*) FROM timeMetric GROUP BY INTERVAL 30 s ORDER BY timestamp DESC LIMIT 2"), *bounds) == up[:2][::-1]
    assert got(ask("SELECT COUNT(*) FROM emptyMetric GROUP BY INTERVAL 30 s"), *bounds) == []


@pytest.mark.parametrize(
    "sql, key, expected",
    [
        ("SELECT COUNT(*) FROM aggMetric GROUP BY age ORDER BY value", "age", [(16, 1), (20, 2), (15, 5)]),
        ("SELECT SUM(value) FROM aggMetric GROUP BY age ORDER BY age", "age", [(15, 14), (16, 5), (20, 6)]),
        ("SELECT COUNT(*) FROM aggMetric GROUP BY height ORDER BY value DESC", "height", [(30.5, 4), (32.0, 3), (31.0, 2)]),
        ("SELECT SUM(value) FROM aggMetric GROUP BY height ORDER BY height", "height", [(30.5, 10), (31.0, 10), (32.0, 6)]),
        ("SELECT MAX(value) FROM aggMetric GROUP BY height ORDER BY height LIMIT 2", "height", [(30.5, 3), (31.0, 5)]),
        ("SELECT MIN(value) FROM aggMetric GROUP BY height ORDER BY height", "height", [(30.5, 2), (31.0, 5), (32.0, 1)]),
        ("SELECT AVG(value) FROM aggMetric GROUP BY height ORDER BY height", "height", [(30.5, 2.5), (31.0, 5.0), (32.0, 2.0)]),
        ("SELECT SUM(value) FROM negMetric GROUP BY name ORDER BY value DESC", "name", [("Frank", -2.0), ("Frankie", -4.0), ("Bill", -8.0), ("John", -13.0)]),
        ("SELECT MAX(value) FROM negMetric GROUP BY height ORDER BY height", "height", [(-32.0, -1.0), (-31.0, -5.0), (-30.5, -2.0), (30.5, -2.0), (32.0, -1.0)]),
        ("SELECT AVG(value) FROM negMetric GROUP BY name ORDER BY name", "name", [("Bill", -4.0), ("Frank", -1.0), ("Frankie", -4.0), ("John", -3.25)]),
        ("SELECT COUNT(DISTINCT age) FROM aggMetric GROUP BY name ORDER BY name", "name", [("Bill", 2), ("Frank", 1), ("Frankie", 1), ("John", 2)]),
    ],
)
def test_groups(ask, sql, key, expected):
    assert got(ask(sql), key, "value") == expected


def test_first_last_and_limits(ask):
    assert got(ask("SELECT FIRST(value) FROM aggMetric GROUP BY height ORDER BY height"), "height", "timestamp", "value") == [(30.5, 2, 2), (31.0, 6, 5), (32.0, 8, 1)]
    assert got(ask("SELECT LAST(value) FROM aggMetric GROUP BY height ORDER BY height"), "height", "timestamp", "value") == [(30.5, 5, 3), (31.0, 7, 5), (32.0, 10, 4)]
    assert got(ask("SELECT SUM(value) FROM longMetric GROUP BY name ORDER BY value LIMIT 2"), "value") == [3, 3]


def test_global(ask):
    one = lambda sql: ask(sql).first().asDict()
    assert one("SELECT COUNT(*) FROM longMetric")["count(*)"] == 6
    assert one("SELECT COUNT(*) FROM longMetric LIMIT 4")["count(*)"] == 4
    assert one("SELECT COUNT(DISTINCT value) FROM aggMetric")["count(distinct *)"] == 5
    assert one("SELECT COUNT(DISTINCT height) FROM aggMetric")["count(distinct *)"] == 3
    assert one("SELECT AVG(*) FROM longMetric LIMIT 4") == {"timestamp": 0, "value": 0, "avg(*)": 3.5}
    assert one("SELECT MIN(*), MAX(*), SUM(*) FROM aggDouble") == {"timestamp": 0, "value": 0.0, "min(*)": 1.0, "max(*)": 5.0, "sum(*)": 26.0}
    assert one("SELECT COUNT(*), AVG(*), MIN(*), MAX(*), SUM(*), COUNT(DISTINCT name) FROM emptyMetric") == {"timestamp": 0, "value": 0, "count(*)": 0, "avg(*)": 0.0, "min(*)": None, "max(*)": None, "sum(*)": 0, "count(distinct *)": None}
    rows = ask("SELECT COUNT(*), name FROM longMetric LIMIT 6").collect()
    assert len(rows) == 6 and {r["count(*)"] for r in rows} == {6} and {r["name"] for r in rows} == {x[2] for x in LONG}


def test_plain(ask):
    assert got(ask("SELECT * FROM longMetric ORDER BY timestamp DESC LIMIT 2"), "timestamp") == [10, 8]
    assert ask("SELECT surname FROM longMetric").columns == ["timestamp", "value", "surname"]
    assert got(ask("SELECT DISTINCT name FROM longMetric ORDER BY name"), "timestamp", "value", "name") == [(0, 0, n) for n in ("Bill", "Frank", "Frankie", "J", "John")]
    assert sorted(got(ask("SELECT * FROM charMetric WHERE textTag LIKE $?$"), "timestamp")) == [60000, 90000, 120000, 150000]
    assert got(ask("SELECT * FROM longMetric WHERE surname = ''"), "timestamp") == [4]
    assert sorted(got(ask("SELECT * FROM aggMetric WHERE NOT age = 15"), "timestamp")) == [4, 5, 7, 8]
    assert sorted(got(ask("SELECT * FROM aggMetric WHERE age IS NULL"), "timestamp")) == [8]
    assert got(ask("SELECT name FROM aggMetric ORDER BY age LIMIT 1"), "timestamp")[0] in (2, 3, 6, 9, 10)
    assert got(ask("SELECT name FROM aggMetric ORDER BY age DESC LIMIT 1"), "timestamp") == [8]
    assert got(ask("SELECT name FROM longMetric WHERE name = John", filters=[{"dimension": "value", "operator": ">", "value": 1}]), "timestamp") == [2]
    assert sorted(got(ask("SELECT name FROM longMetric", from_=4, to=8), "timestamp")) == [4, 6, 8]
    assert sorted(got(ask("SELECT name FROM longMetric", from_=8), "timestamp")) == [8, 10]


def test_unknown_filter_operator_warns(ask):
    with pytest.warns(UserWarning):
        assert ask("SELECT name FROM longMetric", filters=[{"dimension": "name", "operator": "~", "value": 1}]).count() == 6


@pytest.mark.parametrize(
    "sql, message",
    [
        ("SELECT * FROM longMetric WHERE nope = 1", "field nope does not exist"),
        ("SELECT nope FROM longMetric", "field [nope] does not exist"),
        ("SELECT * FROM longMetric WHERE name > 1", X.not_usable(">", "numerical")),
        ("SELECT * FROM longMetric WHERE value LIKE a", X.not_usable("like", "varchar")),
        ("SELECT * FROM longMetric WHERE value = 0.5", "cannot use '0.5' as BIGINT in the condition on value"),
        ("SELECT SUM(name) FROM longMetric", X.AGGREGATION_NOT_ALLOWED),
        ("SELECT COUNT(surname) FROM longMetric", X.AGGREGATION_NOT_ALLOWED),
        ("SELECT COUNT(*), COUNT(name) FROM longMetric", X.MULTIPLE_COUNT_AGGREGATIONS),
        ("SELECT * FROM longMetric SINCE 2 h", X.GRACE_PERIOD_NOT_ALLOWED),
        ("SELECT SUM(value) FROM longMetric GROUP BY name ORDER BY surname", X.SORT_DIMENSION_NOT_IN_GROUP),
        ("SELECT name FROM longMetric GROUP BY name", X.NO_AGGREGATION_GROUP_BY),
        ("SELECT * FROM longMetric GROUP BY name", X.NO_AGGREGATION_GROUP_BY),
        ("SELECT SUM(value), name FROM longMetric GROUP BY name", X.MORE_FIELDS_GROUP_BY),
        ("SELECT DISTINCT name FROM longMetric GROUP BY name", X.GROUP_BY_DISTINCT),
        ("SELECT SUM(value) FROM longMetric GROUP BY surname", X.SIMPLE_AGGREGATION_NOT_ON_TAG),
        ("SELECT FIRST(value) FROM longMetric", X.NO_GROUP_BY_AGGREGATION),
        ("SELECT DISTINCT * FROM longMetric", X.MORE_FIELDS_DISTINCT),
        ("SELECT DISTINCT name, value FROM longMetric", X.MORE_FIELDS_DISTINCT),
        ("SELECT FIRST(value) FROM longMetric GROUP BY INTERVAL 1 d", "FIRST has no meaning per interval"),
        ("SELECT * FROM nope", "Metric nope does not exist"),
    ],
)
def test_refused(ask, sql, message):
    with pytest.raises(StatementError) as e:
        ask(sql)
    assert str(e.value) == message
