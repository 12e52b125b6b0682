"""Continuous queries: the select of a subscription over a metric's arriving records."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import StatementError
from ..functions.scalars import average
from ..plans import ast as A
from ..plans.analyzer import check
from ..plans.compiler import compile_select, predicate
from ..runtime import kept, remove, scratch_path
from ..sources.metric import Metric


def _window_value(i: A.Item) -> Column:
    v = F.col("value")
    if i.distinct:
        raise StatementError("COUNT DISTINCT isn't possible in a continuous query by interval")
    return {"count": lambda: F.count("*"), "sum": lambda: F.sum(v), "min": lambda: F.min(v), "max": lambda: F.max(v), "avg": lambda: average(F.sum(v), F.count(v))}[i.agg]()


def continuous(s: A.Select, m: Metric, now_ms: int, origin_ms: int = 0, only_new: bool = False) -> tuple[DataFrame, str]:
    """The streaming DataFrame of a select and its output mode. NOW is the time of subscription.

    - plain: every new record that meets the condition, whole; order and limit don't apply (append);
    - aggregates, global or by tag: the full result again on every trigger (complete); those that no state can keep (COUNT
      DISTINCT, fields beside aggregates): the new records, upon which the statement is run again (rerun);
    - by interval: tumbling windows of event time from ``origin_ms`` on, value and least and greatest timestamp; SINCE is
      how late a record may come, its window is then published again; later ones are dropped (update).

    ``only_new``: plain records and windows are of records that come after the call, else of all.
    """
    check(s, m, now_ms)
    source = m.news if only_new else m.stream
    if source is None:
        raise StatementError(f"metric {m.name} has no stream")

    def met(rows: DataFrame) -> DataFrame:
        return rows if s.where is None else rows.where(predicate(s.where, m, now_ms))

    names = ["timestamp", "value", *m.dimensions, *m.tags]
    if isinstance(s.group, A.Interval):
        value = _window_value(s.items[0])
        late = f"{s.since_ms or 0} milliseconds"
        start = f"{origin_ms % s.group.ms} milliseconds"
        rows = met(source()).where(F.col("timestamp") >= origin_ms - (s.since_ms or 0))
        timed = rows.select("timestamp", "value", F.timestamp_millis("timestamp").alias("event_time")).withWatermark("event_time", late)
        grouped = timed.groupBy(F.window("event_time", f"{s.group.ms} milliseconds", startTime=start))
        out = grouped.agg(value.alias("value"), F.min("timestamp").alias("lowerBound"), F.max("timestamp").alias("upperBound"))
        return out.select(F.col("upperBound").alias("timestamp"), "value", "lowerBound", "upperBound", F.unix_millis("window.start").alias("window")), "update"
    if s.group is not None or any(i.agg for i in s.items or ()):
        if any(i.distinct or (s.group is None and not i.agg) for i in s.items):
            return met(source()).select("timestamp"), "rerun"
        streaming = Metric(m.db, m.namespace, m.name, m.fields, lambda: met(m.stream()), m.shard_ms)
        plain = A.Select(s.metric, s.items, group=s.group, order=s.order, limit=s.limit)
        return compile_select(plain, streaming, now_ms), "complete"
    return met(source()).select(*names), "append"


class Subscription:
    """A running continuous query with its subscribers; it stops with its last one."""

    def __init__(self, query: StreamingQuery, callbacks: dict[str, Callable], spark: SparkSession, place: str) -> None:
        self.query, self.callbacks, self.spark, self.place = query, callbacks, spark, place


class Publisher:
    """Subscribers of one engine. Equal statements on one metric share one streaming query."""

    def __init__(self) -> None:
        self.running: dict[str, Subscription] = {}

    def subscribe(self, s: A.Select, m: Metric, callback: Callable[[DataFrame, int], None], now_ms: int, every_ms: int = 5000) -> tuple[str, DataFrame]:
        """Call ``callback(frame, batch)`` with each publication; returns a subscriber id and the historical result.

        The history has what is stored at the call; records and windows published later are of records that come
        after it. A record that comes during the call may be in both. Aggregates are published whole; once
        stored records were removed or written again, by running the statement again instead of from the running state.
        """
        key, me = f"{m.db}.{m.namespace}.{s.to_dict()}", uuid.uuid4().hex
        if key in self.running:
            self.running[key].callbacks[me] = callback
            return me, compile_select(s, m, now_ms)
        out, mode = continuous(s, m, now_ms, now_ms, only_new=True)
        history = compile_select(s, m, now_ms)
        callbacks = {me: callback}

        def publish(frame: DataFrame, batch: int) -> None:
            if mode == "rerun" and frame.isEmpty():
                return
            now = m.current() if mode in ("rerun", "complete") and m.current is not None else m
            state = frame.persist() if mode in ("complete", "update") or len(callbacks) > 1 else None
            try:
                if state is not None:
                    state.count()  # all of it, whatever the subscribers read: the state is kept by whole batches
                if mode == "rerun" or now.rewrites != m.rewrites:
                    frame = compile_select(s, now, now_ms)
                for c in list(callbacks.values()):
                    c(frame, batch)
            finally:
                if state is not None:
                    state.unpersist()

        place = scratch_path(out.sparkSession, "subscription")
        writer = out.writeStream.outputMode("append" if mode == "rerun" else mode).option("checkpointLocation", place)
        q = writer.foreachBatch(publish).trigger(processingTime=f"{every_ms} milliseconds").start()
        self.running[key] = Subscription(q, callbacks, out.sparkSession, place)
        return me, history

    def unsubscribe(self, me: str) -> None:
        for key, sub in list(self.running.items()):
            if sub.callbacks.pop(me, None) is not None and not sub.callbacks:
                sub.query.stop()
                remove(sub.spark, sub.place)
                del self.running[key]


def run_once(s: A.Select, m: Metric, now_ms: int, origin_ms: int = 0) -> DataFrame:
    """What a subscription has published once all present records have gone through it: appended records, the last
    complete result, or the last publication of each window. Batches go to the shared folder, not to the driver."""
    out, mode = continuous(s, m, now_ms, origin_ms)
    if mode == "rerun":
        return compile_select(s, m if m.current is None else m.current(), now_ms)
    spark = out.sparkSession
    place, checkpoint = scratch_path(spark, "published"), scratch_path(spark, "stream")
    ran: list[int] = []

    def keep(frame: DataFrame, batch: int) -> None:
        frame.write.mode("overwrite").parquet(f"{place}/batch={batch}")
        ran.append(batch)

    q = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    remove(spark, checkpoint)
    schema = out.schema
    if not ran:
        return spark.createDataFrame([], schema)
    if mode == "complete":
        return kept(spark.read.schema(schema).parquet(f"{place}/batch={max(ran)}"), place)
    all_ = kept(spark.read.parquet(place), place)
    if mode == "append":
        return all_.select(*schema.names)
    latest = all_.groupBy("window").agg(F.max_by(F.struct(*schema.names), "batch").alias("p"))
    return latest.select("p.*").drop("window")
