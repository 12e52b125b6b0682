"""The registered queries of the statement language over the test tables, and the DuckDB SQL of each."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StatementError
from ..runtime import scratch_path, scratch_root
from ..session import Engine
from ..sources.adapters import TAGS, metric
from ..streaming.subscriptions import run_once
from .parser import parse

#: NOW of every registered query: 2024-01-25 00:00 UTC, within the events.
NOW = 1706140800000
DAY = 86_400_000

#: Column names of the language that the driver's queries have under plainer ones (fixed values).
PLAIN = {"count(*)": "count_all", "count(distinct *)": "count_distinct", "sum(*)": "sum_value", "avg(*)": "avg_value", "min(*)": "min_value", "max(*)": "max_value", "lowerBound": "lower_bound", "upperBound": "upper_bound"}


def _engine(spark: SparkSession, sf: str, *names: str) -> Engine:
    e = Engine(spark, f"{scratch_root(spark)}/gnomon-engine")
    for name in names or TAGS:
        e.register(metric(spark, sf, name))
    return e


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(PLAIN)


def _ask(sql: str, **how):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _plain(_engine(spark, sf, parse(sql).metric).db("db").namespace("ns").execute(sql, now_ms=NOW, **how))

    return query


_E = "epoch_us(ts) // 1000"
_EVENTS = f"SELECT {_E} AS timestamp, value, event_type, user_id, nullif(event_type, 'error') AS maybe_tag, event_id, props, nullif(event_type, 'error') AS maybe_type FROM events"
_LINES = "SELECT epoch_us(l_shipdate) // 1000 AS timestamp, l_quantity AS value, * EXCLUDE (l_shipdate, l_quantity) FROM lineitem"
_ORDERS = "SELECT epoch_us(o_orderdate) // 1000 AS timestamp, o_custkey AS value, * EXCLUDE (o_orderdate, o_custkey) FROM orders"
_SHARD = 30 * DAY


def _where(condition: str) -> str:
    return f"SELECT timestamp, value, event_id FROM ({_EVENTS}) WHERE {condition}"


def _avg(x: str, n: str = "count(value)") -> str:
    return f"CAST(printf('%.9e', sum({x}) / {n}) AS DOUBLE)"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, dsl: str, sql: str | None, **how) -> None:
    QUERIES[name] = _ask(dsl, **how)
    if sql is not None:
        ORACLES[name] = sql


_add("select_all", "SELECT * FROM events", _EVENTS)
_add("select_all_lineitem", "SELECT * FROM lineitem", _LINES)
_add("select_fields", "SELECT event_type, user_id FROM events", f"SELECT timestamp, value, event_type, user_id FROM ({_EVENTS})")
for _name, _dsl, _sql in (
    ("where_eq_varchar", "event_type = click", "event_type = 'click'"),
    ("where_eq_quoted", "event_type = 'click'", "event_type = 'click'"),
    ("where_eq_bigint", "user_id = 7", "user_id = 7"),
    ("where_gt", "value > 100", "value > 100"),
    ("where_gte", "user_id >= 7", "user_id >= 7"),
    ("where_lt", "value < 10.5", "value < 10.5"),
    ("where_lte", "user_id <= 7", "user_id <= 7"),
    ("where_ne_extension", "event_type <> click", "event_type <> 'click'"),
    ("where_in_range", "user_id IN (3, 7)", "user_id BETWEEN 3 AND 7"),
    ("where_like", "event_type LIKE $i$", "event_type LIKE '%i%'"),
    # as wildcards, these would leave click and view out
    ("where_like_literal_signs", "NOT (event_type LIKE '%i%' OR event_type LIKE '_iew')", "NOT (contains(event_type, '%i%') OR event_type = '_iew')"),
    ("where_is_null", "maybe_type IS NULL", "maybe_type IS NULL"),
    ("where_is_not_null", "maybe_type IS NOT NULL", "maybe_type IS NOT NULL"),
    ("where_not", "NOT maybe_type = click", "NOT coalesce(maybe_type = 'click', false)"),
    ("where_not_greedy", "NOT maybe_type = click OR user_id = 7", "NOT (coalesce(maybe_type = 'click', false) OR user_id = 7)"),
    ("where_and_or_right_assoc", "event_type = click AND user_id > 10 OR value > 100", "event_type = 'click' AND (user_id > 10 OR value > 100)"),
    ("where_or_and_right_assoc", "event_type = click OR user_id > 10 AND value > 100", "event_type = 'click' OR (user_id > 10 AND value > 100)"),
    ("where_brackets", "(event_type = click AND user_id > 10) OR value > 100", "(event_type = 'click' AND user_id > 10) OR value > 100"),
    ("where_now_relative", "timestamp >= NOW - 10d", f"timestamp >= {NOW - 10 * DAY}"),
    ("where_now_range", "timestamp IN (NOW - 10 day, NOW - 36 h)", f"timestamp BETWEEN {NOW - 10 * DAY} AND {NOW - 36 * 3_600_000}"),
):
    _add(_name, f"SELECT event_id FROM events WHERE {_dsl}", _where(_sql))

_add("where_eq_decimal", "SELECT l_linenumber FROM lineitem WHERE l_discount = 0.05", f"SELECT timestamp, value, l_linenumber FROM ({_LINES}) WHERE l_discount = 0.05")
_add("dynamic_filters", "SELECT event_id FROM events WHERE event_type = click OR event_type = view", _where("(event_type = 'click' OR event_type = 'view') AND user_id >= 5 AND value < 80 AND maybe_type IS NOT NULL AND event_type LIKE 'c%'"),
     filters=[{"dimension": "user_id", "operator": ">=", "value": 5}, {"dimension": "value", "operator": "<", "value": 80}, {"dimension": "maybe_type", "operator": "ISNOTNULL"}, {"dimension": "event_type", "operator": "LIKE", "value": "c$"}])
_add("dynamic_time_range", "SELECT event_id FROM events WHERE event_type = click", _where(f"event_type = 'click' AND timestamp BETWEEN {NOW - 8 * DAY} AND {NOW - 2 * DAY}"), from_=NOW - 8 * DAY, to=NOW - 2 * DAY)

_ZERO = "CAST(0 AS BIGINT) AS timestamp, CAST(0 AS DOUBLE) AS value"
_add("distinct_tag", "SELECT DISTINCT event_type FROM events", f"SELECT DISTINCT {_ZERO}, event_type FROM events")
_add("distinct_nullable_tag", "SELECT DISTINCT maybe_tag FROM events", f"SELECT DISTINCT {_ZERO}, maybe_tag FROM ({_EVENTS}) WHERE maybe_tag IS NOT NULL")
_add("distinct_numeric_tag", "SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 20", f"SELECT DISTINCT {_ZERO}, user_id FROM events ORDER BY user_id LIMIT 20")
_add("distinct_dimension", "SELECT DISTINCT maybe_type FROM events", f"SELECT DISTINCT {_ZERO}, maybe_type FROM ({_EVENTS}) WHERE maybe_type IS NOT NULL")

_add("order_desc_limit", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 10", f"SELECT timestamp, value, event_id FROM ({_EVENTS}) ORDER BY event_id DESC LIMIT 10")
_add("order_asc_limit", "SELECT user_id FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 25", f"SELECT timestamp, value, user_id FROM ({_EVENTS}) WHERE event_id > 100 ORDER BY event_id LIMIT 25")
_add("order_by_timestamp", "SELECT event_id FROM events WHERE user_id = 7 ORDER BY timestamp DESC", _where("user_id = 7"))

for _f, _v in (("count", "count(*)"), ("sum", "round(sum(value), 6)"), ("min", "min(value)"), ("max", "max(value)"), ("avg", _avg("value"))):
    _add(f"group_{_f}", f"SELECT {_f}(value) FROM events GROUP BY event_type", f"SELECT CAST(0 AS BIGINT) AS timestamp, {_v} AS value, event_type FROM events GROUP BY event_type")
    _add(f"group_{_f}_orders", f"SELECT {_f}(*) FROM orders GROUP BY o_orderpriority", f"SELECT CAST(0 AS BIGINT) AS timestamp, {'CAST(sum(o_custkey) AS BIGINT)' if _f == 'sum' else _v.replace('value', 'o_custkey')} AS value, o_orderpriority FROM orders GROUP BY o_orderpriority")
_add("group_count_distinct", "SELECT count(DISTINCT value) FROM events GROUP BY event_type", "SELECT CAST(0 AS BIGINT) AS timestamp, count(DISTINCT value) AS value, event_type FROM events GROUP BY event_type")
_add("group_count_distinct_tag", "SELECT count(DISTINCT user_id) FROM events GROUP BY event_type", "SELECT CAST(0 AS BIGINT) AS timestamp, count(DISTINCT user_id) AS value, event_type FROM events GROUP BY event_type")
for _f, _m in (("first", "min"), ("last", "max")):
    _add(f"group_{_f}", f"SELECT {_f}(value) FROM events GROUP BY event_type",
         f"SELECT p.t AS timestamp, p.v AS value, event_type FROM (SELECT event_type, {_m}(struct_pack(t := {_E}, v := value)) AS p FROM events GROUP BY event_type)")
_add("group_null_key_dropped", "SELECT count(*) FROM events GROUP BY maybe_tag", f"SELECT CAST(0 AS BIGINT) AS timestamp, count(*) AS value, maybe_tag FROM ({_EVENTS}) WHERE maybe_tag IS NOT NULL GROUP BY maybe_tag")
_add("group_bigint_key", "SELECT max(value) FROM events GROUP BY user_id", "SELECT CAST(0 AS BIGINT) AS timestamp, max(value) AS value, user_id FROM events GROUP BY user_id")
_add("group_order_value_limit", "SELECT sum(value) FROM events GROUP BY user_id ORDER BY value DESC LIMIT 5", "SELECT CAST(0 AS BIGINT) AS timestamp, round(sum(value), 6) AS value, user_id FROM events GROUP BY user_id ORDER BY value DESC LIMIT 5")
_add("group_order_key_limit", "SELECT count(*) FROM events WHERE value > 20 GROUP BY user_id ORDER BY user_id LIMIT 5", "SELECT CAST(0 AS BIGINT) AS timestamp, count(*) AS value, user_id FROM events WHERE value > 20 GROUP BY user_id ORDER BY user_id LIMIT 5")

for _n, _c, _v in (
    ("count", "count_all", "count(*)"), ("count_distinct", "count_distinct", "nullif(count(DISTINCT value), 0)"), ("sum", "sum_value", "round(coalesce(sum(value), 0), 6)"),
    ("min", "min_value", "min(value)"), ("max", "max_value", "max(value)"), ("avg", "avg_value", f"coalesce({_avg('value', 'nullif(count(value), 0)')}, 0)"),
):
    _call = "count(DISTINCT value)" if _n == "count_distinct" else f"{_n}(*)"
    _add(f"global_{_n}", f"SELECT {_call} FROM events", f"SELECT {_ZERO}, {_v} AS {_c} FROM events")
    _add(f"global_{_n}_where", f"SELECT {_call} FROM events WHERE event_type = click", f"SELECT {_ZERO}, {_v} AS {_c} FROM events WHERE event_type = 'click'")
_add("global_count_limit", "SELECT count(*) FROM events LIMIT 4", f"SELECT {_ZERO}, least(count(*), 4) AS count_all FROM events")
_add("global_empty", "SELECT count(*), sum(*), avg(*), min(*), max(*) FROM events WHERE event_type = nothing", f"SELECT {_ZERO}, CAST(0 AS BIGINT) AS count_all, 0.0::DOUBLE AS sum_value, 0.0::DOUBLE AS avg_value, NULL::DOUBLE AS min_value, NULL::DOUBLE AS max_value")
_add("global_mixed_fields", "SELECT count(*), max(value), event_type FROM events", f"SELECT timestamp, value, event_type, (SELECT count(*) FROM events) AS count_all, (SELECT max(value) FROM events) AS max_value FROM ({_EVENTS})")
_add("global_mixed_aggregates", "SELECT count(*), count(DISTINCT user_id), min(value), max(value) FROM events", f"SELECT {_ZERO}, count(*) AS count_all, count(DISTINCT user_id) AS count_distinct, min(value) AS min_value, max(value) AS max_value FROM events")


def _buckets(agg: str, ms: int, *, where: str = "true", lower: str | None = None, upper: str | None = None, empty: str | None = "0", future: bool = False, tail: str = "") -> str:
    """SQL of a temporal query: shards of 30 days, the spine back from their end or the condition's bound."""
    span = f"SELECT min(s) AS lo, max(s) + {_SHARD} AS hi FROM (SELECT timestamp // {_SHARD} * {_SHARD} AS s FROM e WHERE {lower or 0} <= timestamp // {_SHARD} * {_SHARD} + {_SHARD} AND timestamp // {_SHARD} * {_SHARD} <= {upper or NOW * 2})"
    return f"""WITH e AS ({_EVENTS}),
shards AS ({span}),
b AS (SELECT {upper or 'hi'} AS u, {lower or ('lo' if upper is None else '0')} AS l, lo, hi FROM shards),
n AS (SELECT u, l, lo, hi, greatest(1, (u - l + {ms} - 1) // {ms}) AS n FROM b),
spine AS (SELECT unnest(range(0, n)) AS k, u, l, lo, hi FROM n),
agg AS (SELECT least((u - timestamp) // {ms}, n - 1) AS k, {agg} AS v FROM e, n WHERE timestamp BETWEEN l AND u AND ({where}) GROUP BY 1),
r AS (SELECT u - k * {ms} AS ub, greatest(u - (k + 1) * {ms}, l) AS lb, v FROM spine {'JOIN' if empty is None else 'LEFT JOIN'} agg USING (k) WHERE u - k * {ms} >= lo AND greatest(u - (k + 1) * {ms}, l) < hi)
SELECT ub AS timestamp, coalesce(v, {empty or 'NULL'}) AS value, lb AS lower_bound, ub AS upper_bound FROM r {'' if future else f'WHERE lb < {NOW}'} {tail}"""


_add("temporal_count", "SELECT count(*) FROM events GROUP BY INTERVAL 1 d", _buckets("count(*)", DAY, future=True))
_add("temporal_sum", "SELECT sum(value) FROM events GROUP BY INTERVAL day", _buckets("round(sum(value), 6)", DAY))
_add("temporal_avg", "SELECT avg(value) FROM events GROUP BY INTERVAL 12 h", _buckets(_avg("value"), DAY // 2))
_add("temporal_min", "SELECT min(value) FROM events GROUP BY INTERVAL 1 d", _buckets("min(value)", DAY))
_add("temporal_max", "SELECT max(value) FROM events GROUP BY INTERVAL 1 d", _buckets("max(value)", DAY))
_add("temporal_count_distinct", "SELECT count(DISTINCT event_type) FROM events GROUP BY INTERVAL 6 h", _buckets("count(DISTINCT event_type)", DAY // 4, empty=None))
_T = NOW - 7 * DAY
_add("temporal_where_gte", f"SELECT count(*) FROM events WHERE timestamp >= {_T} GROUP BY INTERVAL 1 d", _buckets("count(*)", DAY, lower=str(_T), future=True))
_add("temporal_where_lt", f"SELECT count(*) FROM events WHERE timestamp < {_T} GROUP BY INTERVAL 7 d", _buckets("count(*)", 7 * DAY, upper=str(_T - 1), future=True))
_add("temporal_where_range", f"SELECT sum(value) FROM events WHERE timestamp IN ({_T}, {NOW}) GROUP BY INTERVAL 5 h", _buckets("round(sum(value), 6)", 5 * 3_600_000, lower=str(_T), upper=str(NOW)))
_OR = ((NOW - 20 * DAY, NOW - 15 * DAY - 1), (NOW - 5 * DAY, NOW - DAY), (NOW - 12 * DAY, NOW - 11 * DAY))
_add("temporal_where_or", "SELECT sum(value) FROM events WHERE " + " OR ".join(f"timestamp IN ({a}, {b})" for a, b in _OR) + " GROUP BY INTERVAL 7 h",
     " UNION ALL ".join(f"SELECT * FROM ({_buckets('round(sum(value), 6)', 7 * 3_600_000, lower=str(a), upper=str(b))})" for a, b in _OR))
_add("temporal_since", "SELECT count(*) FROM events GROUP BY INTERVAL 6 h SINCE 5 d", _buckets("count(*)", DAY // 4, lower=str(NOW - 5 * DAY), future=True))
_add("temporal_limit", "SELECT count(*) FROM events GROUP BY INTERVAL 1 d LIMIT 3", _buckets("count(*)", DAY, future=True, tail="ORDER BY ub DESC LIMIT 3"))
_add("temporal_desc_limit", "SELECT count(*) FROM events GROUP BY INTERVAL 1 d ORDER BY timestamp DESC LIMIT 3", _buckets("count(*)", DAY, future=True, tail="ORDER BY ub LIMIT 3"))
_add("temporal_empty_buckets", "SELECT max(value) FROM events WHERE user_id = 7 GROUP BY INTERVAL 1 h", _buckets("max(value)", 3_600_000, where="user_id = 7"))


def _rounded(name: str, column: str = "value") -> None:
    ask = QUERIES[name]
    QUERIES[name] = lambda spark, sf: ask(spark, sf).withColumn(column, F.round(column, 6))


for _n in ("group_sum", "group_order_value_limit", "temporal_sum", "temporal_where_range", "temporal_where_or"):
    _rounded(_n)
for _n in ("global_sum", "global_sum_where"):
    _rounded(_n, "sum_value")


# -- statements that write, on a scratch store
DIMENSIONS = ["event_id", "props", "maybe_type"]


def _stored(spark: SparkSession, sf: str, parts: list[DataFrame] | None = None, **settings):
    """The events as a stored metric of a fresh engine, appended at once or in ``parts``."""
    e = Engine(spark, scratch_path(spark, "store"))
    h = e.db("db").namespace("ns").metric("events")
    if settings:
        h.init(**settings)
    for df in parts or [metric(spark, sf, "events").rows()]:
        h.append(df, TAGS["events"], DIMENSIONS, now_ms=NOW)
    return h


def delete_where(spark, sf):
    h = _stored(spark, sf, shard_interval="7d")
    h.query(f"DELETE FROM events WHERE event_type = click AND timestamp < {_T}", now_ms=NOW)
    return h.query("SELECT event_id FROM events", now_ms=NOW)


def retention_write(spark, sf):
    return _stored(spark, sf, shard_interval="7d", retention="10d").query("SELECT event_id FROM events", now_ms=NOW)


def retention_apply(spark, sf):
    h = _stored(spark, sf, shard_interval="7d", retention="20d")
    h.apply_retention(now_ms=NOW + 12 * DAY)
    return h.query("SELECT event_id FROM events", now_ms=NOW)


def insert_union(spark, sf):
    h = _stored(spark, sf)
    h.query(f"INSERT INTO events TS={NOW} TAGS(event_type=insert, city=Aurora) VAL=12.5", now_ms=NOW)
    h.value(7.25).timestamp(NOW + 1).tag("event_type", "written").dimension("weight", 3).write(now_ms=NOW)
    return h.query("SELECT event_type, city, weight FROM events WHERE event_type = insert OR event_type = written OR event_type = click", now_ms=NOW)


def stored_pruned_scan(spark, sf):
    return _stored(spark, sf, shard_interval="1d").query(f"SELECT event_id FROM events WHERE timestamp IN ({_T}, {NOW}) AND event_type = view", now_ms=NOW)


def stored_temporal(spark, sf):
    return _plain(_stored(spark, sf, shard_interval="30d").query("SELECT count(*) FROM events GROUP BY INTERVAL 1 d", now_ms=NOW))


def drop_metric(spark, sf):
    h = _stored(spark, sf)
    h.home.execute("INSERT INTO other TAGS(a=b) VAL=1", now_ms=NOW)
    h.home.execute("DROP METRIC events")
    return h.home.execute("SHOW METRICS")


def describe_metric(spark, sf):
    return _stored(spark, sf).home.execute("DESCRIBE events")


def show_metrics(spark, sf):
    return _engine(spark, sf).db("db").namespace("ns").execute("SHOW METRICS")


def show_namespaces(spark, sf):
    return _engine(spark, sf).db("db").namespace("ns").execute("SHOW NAMESPACES")


def show_locations(spark, sf):
    return _stored(spark, sf, shard_interval="7d").locations()


def count_records(spark, sf):
    h = _stored(spark, sf, shard_interval="7d")
    return spark.createDataFrame([(h.count(), len(h.home.engine.catalog.metric("db", "ns", "events").shards()))], "records bigint, shards bigint")


def compacted(spark, sf):
    """Records appended in four parts, then compacted: as before, in at most one file a shard."""
    h = _stored(spark, sf, _parts(spark, sf, 4), shard_interval="7d")
    h.compact()
    c = h.home.engine.catalog
    most = c._files(f"{c._dir('db', 'ns', 'events')}/data").groupBy("shard_from").count().agg(F.max("count").alias("most_files"))
    return h.query("SELECT event_id FROM events", now_ms=NOW).crossJoin(F.broadcast(most))  # one row


def delete_namespace(spark, sf):
    h = _stored(spark, sf)
    other = h.home.engine.db("db").namespace("other")
    other.execute("INSERT INTO m TAGS(a=b) VAL=1", now_ms=NOW)
    h.home.delete()
    return h.home.engine.db("db").namespaces()


def show_databases(spark, sf):
    e = _engine(spark, sf)
    e.register(replace(metric(spark, sf, "orders"), db="archive"))
    return e.databases()


def use_namespace(spark, sf):
    console = _engine(spark, sf).console("db")
    console.run("USE ns")
    return _plain(console.run("SELECT count(*) FROM orders", now_ms=NOW))


def restored_metadata(spark, sf):
    h = _stored(spark, sf, shard_interval="7d", retention="400d")
    path = scratch_path(spark, "dump") + "/metadata.json"
    h.home.engine.dump_metadata(path)
    fresh = Engine(spark, scratch_path(spark, "store"))
    fresh.restore_metadata(path)
    return fresh.db("db").namespace("ns").execute("DESCRIBE events")


def records(spark, sf):
    return _engine(spark, sf, "orders").db("db").namespace("ns").records("SELECT o_orderkey, o_orderstatus FROM orders", now_ms=NOW).select("timestamp", F.col("dimensions.o_orderkey").alias("o_orderkey"), F.col("tags.o_orderstatus").alias("o_orderstatus"), "json")


#: Statements that can't be run, and what is said of them (fixed values).
REFUSED = {
    "SELECT nothing FROM events": "field [nothing] does not exist",
    "SELECT * FROM events WHERE nothing = 1": "field nothing does not exist",
    "SELECT event_type FROM events GROUP BY event_type": "cannot execute a groupField by query without an aggregation",
    "SELECT sum(value), count(value) FROM events GROUP BY event_type": "cannot execute a groupField by query with more than a aggregateField",
    "SELECT DISTINCT event_type, user_id FROM events": "cannot execute a select distinct projecting more than one field",
    "SELECT first(value) FROM events": "cannot execute a query with a non global aggregation without a groupBy field",
    "SELECT DISTINCT event_type FROM events GROUP BY event_type": "cannot execute a query with a group by and a distinct clause",
    "SELECT sum(value) FROM events GROUP BY event_id": "cannot execute a groupBy query grouping by a field that is not a tag",
    "SELECT sum(user_id) FROM events": "Count And Count Distinct Aggregation can be applied to the value and to a tag. Other aggregations can be applied only on the value",
    "SELECT count(*), count(value) FROM events": "Only one Count and one Count Distinct is allowed",
    "SELECT sum(value) FROM events GROUP BY event_type ORDER BY user_id": "cannot sort group by query result by a field not in group by clause",
    "SELECT * FROM events SINCE 2 d": "grace period clause is allowed only in temporal group by queries",
    "SELECT * FROM events WHERE event_type > 5": "cannot use > operator on dimension different from numerical",
    "SELECT * FROM events WHERE user_id LIKE a$": "cannot use like operator on dimension different from varchar",
    "SELECT * FROM events WHERE event_type IN (1, 2)": "cannot use range operator on dimension different from numerical",
    "SELECT first(value) FROM events GROUP BY INTERVAL 1 d": "FIRST has no meaning per interval",
    "SELECT * FROM gone": "Metric gone does not exist",
}


def refused_statements(spark, sf):
    """What validation says of every statement; null where it says nothing."""
    ns = _engine(spark, sf).db("db").namespace("ns")
    said = []
    for sql in [*REFUSED, "SELECT count(*) FROM events GROUP BY INTERVAL 1 d SINCE 2 d"]:
        try:
            ns.validate(sql, NOW)
            said.append((sql, None))
        except StatementError as e:
            said.append((sql, str(e)))
    return spark.createDataFrame(said, "statement string, said string")


# -- live subscriptions: the earlier events are stored, a query is subscribed to, then the later ones come
_HALF = NOW - 7 * DAY


def _parts(spark: SparkSession, sf: str, n: int) -> list[DataFrame]:
    """The events in ``n`` appends, by time."""
    rows, step = metric(spark, sf, "events").rows(), 30 * DAY // n
    k = F.least(F.greatest(F.floor((F.col("timestamp") - (NOW - 24 * DAY)) / step), F.lit(0)), F.lit(n - 1))
    return [rows.where(k == i) for i in range(n)]


def _live(sql: str, *, first=None, then=(), **how):
    """What a subscription publishes last of each: appended records, windows by their start, whole results."""

    def query(spark, sf):
        rows = metric(spark, sf, "events").rows()
        h = _stored(spark, sf, [rows.where(first) if first is not None else rows.limit(0)])
        place, ran = scratch_path(spark, "published"), []

        def keep(frame, batch):
            frame.write.parquet(f"{place}/batch={len(ran)}")
            ran.append(frame.schema)

        me, _ = h.home.subscribe(sql, keep, every_ms=50, **({"now_ms": NOW} | how))
        live = next(iter(h.home.engine.publisher.running.values())).query
        for part in then:
            h.append(rows.where(part), TAGS["events"], DIMENSIONS, now_ms=NOW)
            live.processAllAvailable()
        h.home.unsubscribe(me)
        all_ = spark.read.schema(T.StructType([*ran[-1].fields, T.StructField("batch", T.IntegerType())])).parquet(place)
        if "window" in ran[-1].names:
            latest = all_.groupBy("window").agg(F.max_by(F.struct(*ran[-1].names), "batch").alias("p"))
            return _plain(latest.select("p.*").drop("window"))
        whole = "count" in sql
        return _plain((all_.where(F.col("batch") == len(ran) - 1) if whole else all_).select(*ran[-1].names))

    return query


# -- continuous queries over all present records
def _stream(sql: str, origin_ms: int = 0):
    def query(spark, sf):
        return _plain(run_once(parse(sql), metric(spark, sf, "events"), NOW, origin_ms))

    return query


_W = "CAST({0} // 86400000 AS BIGINT)"
QUERIES |= {
    "delete_where": delete_where, "retention_write": retention_write, "retention_apply": retention_apply, "insert_union": insert_union,
    "stored_pruned_scan": stored_pruned_scan, "stored_temporal": stored_temporal, "drop_metric": drop_metric, "describe_metric": describe_metric,
    "show_metrics": show_metrics, "show_namespaces": show_namespaces, "show_locations": show_locations,
    "stream_plain": _stream("SELECT event_id FROM events WHERE event_type = click AND value > 50"),
    "stream_group": _stream("SELECT count(*) FROM events GROUP BY event_type"),
    "stream_global": _stream("SELECT count(*), max(value) FROM events WHERE event_type = view"),
    "stream_window": _stream("SELECT count(*) FROM events GROUP BY INTERVAL 1 d SINCE 40 d"),
    "count_records": count_records, "compacted": compacted, "delete_namespace": delete_namespace, "show_databases": show_databases, "use_namespace": use_namespace,
    "restored_metadata": restored_metadata, "records": records, "refused_statements": refused_statements,
    "stream_new_only": _live("SELECT event_id FROM events WHERE event_type = click", first=f"timestamp < {_HALF}", then=[f"timestamp >= {_HALF}"]),
    "stream_filtered": _live("SELECT * FROM events", first=f"timestamp < {_HALF}", then=[f"timestamp >= {_HALF}"], filters=[{"dimension": "event_type", "operator": "=", "value": "view"}], from_=NOW - 9 * DAY, to=NOW),
    "stream_count_distinct": _live("SELECT count(DISTINCT value) FROM events GROUP BY event_type", first=f"timestamp < {_HALF}", then=[f"timestamp >= {_HALF}"]),
    "stream_mixed": _live("SELECT count(*), max(value), event_type FROM events", first=f"timestamp < {_HALF}", then=[f"timestamp >= {_HALF}"]),
    "stream_late": _live("SELECT count(*) FROM events GROUP BY INTERVAL 1 d SINCE 40 d", then=[f"timestamp >= {_HALF}", f"timestamp < {_HALF}"], now_ms=0),
    "stream_too_late": _live("SELECT count(*) FROM events GROUP BY INTERVAL 1 d SINCE 1 h", then=[f"timestamp >= {_HALF} AND timestamp < {NOW}", f"timestamp >= {NOW}", f"timestamp < {_HALF}"], now_ms=0),
}
_EV = "SELECT timestamp, value, event_id FROM e"
ORACLES |= {
    "delete_where": f"WITH e AS ({_EVENTS}) {_EV} WHERE NOT (event_type = 'click' AND timestamp < {_T})",
    "retention_write": f"WITH e AS ({_EVENTS}) {_EV} WHERE abs(timestamp - {NOW}) <= {10 * DAY}",
    "retention_apply": f"WITH e AS ({_EVENTS}) {_EV} WHERE abs(timestamp - {NOW}) <= {20 * DAY} AND timestamp >= {NOW - 8 * DAY}",
    "insert_union": f"""WITH e AS ({_EVENTS}) SELECT timestamp, value, event_type, NULL::VARCHAR AS city, NULL::BIGINT AS weight FROM e WHERE event_type = 'click'
UNION ALL SELECT {NOW}, 12.5, 'insert', 'Aurora', NULL UNION ALL SELECT {NOW + 1}, 7.25, 'written', NULL, 3""",
    "stored_pruned_scan": f"WITH e AS ({_EVENTS}) {_EV} WHERE timestamp BETWEEN {_T} AND {NOW} AND event_type = 'view'",
    "stored_temporal": _buckets("count(*)", DAY, future=True),
    "drop_metric": "SELECT 'other' AS metric",
    "describe_metric": f"""SELECT * FROM (VALUES ('timestamp', 'timestamp', 'BIGINT'), ('value', 'value', 'DECIMAL'), ('event_id', 'dimension', 'BIGINT'), ('props', 'dimension', 'VARCHAR'), ('maybe_type', 'dimension', 'VARCHAR'),
('event_type', 'tag', 'VARCHAR'), ('user_id', 'tag', 'BIGINT'), ('maybe_tag', 'tag', 'VARCHAR')) AS t(field, class, type), (SELECT CAST({_SHARD} AS BIGINT) AS shard_interval, CAST(0 AS BIGINT) AS retention)""",
    "show_metrics": "SELECT unnest(['events', 'lineitem', 'orders']) AS metric",
    "show_namespaces": "SELECT 'ns' AS namespace",
    "show_locations": f"SELECT DISTINCT 'events' AS metric, timestamp // {7 * DAY} * {7 * DAY} AS shard_from, timestamp // {7 * DAY} * {7 * DAY} + {7 * DAY} AS shard_to FROM ({_EVENTS})",
    "stream_plain": f"{_EVENTS} WHERE event_type = 'click' AND value > 50",
    "stream_group": "SELECT CAST(0 AS BIGINT) AS timestamp, count(*) AS value, event_type FROM events GROUP BY event_type",
    "stream_global": f"SELECT {_ZERO}, count(*) AS count_all, max(value) AS max_value FROM events WHERE event_type = 'view'",
    "stream_window": f"SELECT max({_E}) AS timestamp, count(*) AS value, min({_E}) AS lower_bound, max({_E}) AS upper_bound FROM events GROUP BY {_E} // {DAY}",
}
_FIELDS = ORACLES["describe_metric"]
ORACLES |= {
    "count_records": f"SELECT count(*) AS records, count(DISTINCT {_E} // {7 * DAY}) AS shards FROM events",
    "compacted": f"WITH e AS ({_EVENTS}) SELECT timestamp, value, event_id, CAST(1 AS BIGINT) AS most_files FROM e",
    "delete_namespace": "SELECT 'other' AS namespace",
    "show_databases": "SELECT unnest(['archive', 'db']) AS db",
    "use_namespace": f"SELECT CAST(0 AS BIGINT) AS timestamp, CAST(0 AS BIGINT) AS value, count(*) AS count_all FROM orders",
    "restored_metadata": _FIELDS.replace(f"{_SHARD} AS BIGINT) AS shard_interval", f"{7 * DAY} AS BIGINT) AS shard_interval").replace("CAST(0 AS BIGINT) AS retention", f"CAST({400 * DAY} AS BIGINT) AS retention"),
    "records": """SELECT timestamp, o_orderkey, o_orderstatus, '{"timestamp":' || timestamp || ',"value":' || value || ',"dimensions":{"o_orderkey":' || o_orderkey || '},"tags":{"o_orderstatus":"' || o_orderstatus || '"}}' AS json FROM ("""
    + _ORDERS + ")",
    "refused_statements": "SELECT * FROM (VALUES "
    + ", ".join("('{}', '{}')".format(a.replace("'", "''"), b.replace("'", "''")) for a, b in REFUSED.items())
    + ", ('SELECT count(*) FROM events GROUP BY INTERVAL 1 d SINCE 2 d', NULL)) AS t(statement, said)",
    "stream_new_only": f"SELECT * FROM ({_EVENTS}) WHERE event_type = 'click' AND timestamp >= {_HALF}",
    "stream_filtered": f"SELECT * FROM ({_EVENTS}) WHERE event_type = 'view' AND timestamp >= {_HALF} AND timestamp <= {NOW}",
    "stream_count_distinct": ORACLES["group_count_distinct"],
    "stream_mixed": ORACLES["global_mixed_fields"],
    "stream_late": ORACLES["stream_window"],
    "stream_too_late": f"SELECT max({_E}) AS timestamp, count(*) AS value, min({_E}) AS lower_bound, max({_E}) AS upper_bound FROM events WHERE {_E} >= {_HALF} GROUP BY {_E} // {DAY}",
}
