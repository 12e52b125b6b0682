"""The engine as a user meets it: ``Engine(spark, root).db("d").namespace("n").metric("m").query("select ...")``."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from .errors import StatementError
from .plans import ast as A
from .plans.analyzer import check, check_condition, with_filters
from .plans.compiler import compile_select
from .plans.parser import parse
from .sources.catalog import Catalog, scalar
from .sources.metric import Metric, as_records
from .streaming.subscriptions import Publisher


def now() -> int:
    return int(time.time() * 1000)


class Engine:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.catalog, self.publisher = spark, Catalog(spark, root), Publisher()

    def db(self, name: str) -> Database:
        return Database(self, name)

    def register(self, metric: Metric) -> Metric:
        return self.catalog.register(metric)

    def databases(self) -> DataFrame:
        return self.spark.createDataFrame([(d,) for d in self.catalog.databases()], "db string")

    def dump_metadata(self, path: str) -> int:
        return self.catalog.dump_metadata(path)

    def restore_metadata(self, path: str) -> int:
        return self.catalog.restore_metadata(path)

    @staticmethod
    def parse(sql: str) -> A.Node:
        """The statement as an AST; ``.to_dict()`` echoes it as plain data."""
        return parse(sql)

    def console(self, db: str) -> Console:
        return Console(self, db)


@dataclass(frozen=True)
class Database:
    engine: Engine
    name: str

    def namespace(self, name: str) -> Namespace:
        return Namespace(self.engine, self.name, name)

    def namespaces(self) -> DataFrame:
        return self.engine.spark.createDataFrame([(n,) for n in self.engine.catalog.namespaces(self.name)], "namespace string")


@dataclass(frozen=True)
class Namespace:
    engine: Engine
    db: str
    name: str

    def metric(self, name: str) -> MetricHandle:
        return MetricHandle(self, name)

    def metrics(self) -> DataFrame:
        return self.engine.spark.createDataFrame([(m,) for m in self.engine.catalog.metrics(self.db, self.name)], "metric string")

    def delete(self) -> None:
        self.engine.catalog.delete_namespace(self.db, self.name)

    def execute(self, sql: str, now_ms: int | None = None, filters=(), from_: int | None = None, to: int | None = None) -> DataFrame | None:
        """Run a statement; selects and descriptions give a DataFrame, the others None. NOW is ``now_ms``, by default the clock."""
        t = now() if now_ms is None else now_ms
        s, c = parse(sql), self.engine.catalog
        match s:
            case A.Select():
                s = replace(s, where=with_filters(s.where, filters, from_, to))
                return compile_select(s, c.metric(self.db, self.name, s.metric), t)
            case A.Insert():
                return c.insert(self.db, self.name, s, t)
            case A.Delete():
                return c.delete(self.db, self.name, s, t)
            case A.Drop():
                return c.drop(self.db, self.name, s.metric)
            case A.ShowMetrics():
                return self.metrics()
            case A.ShowNamespaces():
                return Database(self.engine, self.db).namespaces()
            case A.Describe():
                return c.describe(self.db, self.name, s.metric)
        raise StatementError(f"{type(s).__name__} needs a console")

    def validate(self, sql: str, now_ms: int = 0) -> None:
        """StatementError if the statement can't be run; nothing is run."""
        s = parse(sql)
        if isinstance(s, A.Select):
            check(s, self.engine.catalog.metric(self.db, self.name, s.metric), now_ms)
        elif isinstance(s, A.Delete):
            check_condition(s.where, self.engine.catalog.metric(self.db, self.name, s.metric), now_ms)

    query = execute

    def records(self, sql: str, **how) -> DataFrame:
        """The result of a select as records: timestamp, value, ``dimensions{}``, ``tags{}``, and the same as ``json``."""
        s = parse(sql)
        if not isinstance(s, A.Select):
            raise StatementError("only a select has records")
        return as_records(self.execute(sql, **how), self.engine.catalog.metric(self.db, self.name, s.metric))

    def subscribe(
        self, sql: str, callback: Callable[[DataFrame, int], None], now_ms: int | None = None, every_ms: int = 5000, filters=(), from_: int | None = None, to: int | None = None
    ) -> tuple[str, DataFrame]:
        """The historical result, and from then on a publication per trigger; the id ends it in ``unsubscribe``. Filters and
        times restrict both, as in ``execute``."""
        s = parse(sql)
        if not isinstance(s, A.Select):
            raise StatementError("only a select can be subscribed to")
        s = replace(s, where=with_filters(s.where, filters, from_, to))
        return self.engine.publisher.subscribe(s, self.engine.catalog.metric(self.db, self.name, s.metric), callback, now() if now_ms is None else now_ms, every_ms)

    def unsubscribe(self, subscriber: str) -> None:
        self.engine.publisher.unsubscribe(subscriber)


@dataclass(frozen=True)
class MetricHandle:
    home: Namespace
    name: str

    def _c(self) -> tuple[str, str, str]:
        return self.home.db, self.home.name, self.name

    def query(self, sql: str, **how) -> DataFrame | None:
        return self.home.execute(sql, **how)

    def value(self, v) -> Bit:
        return Bit(self, v)

    def init(self, shard_interval: int | str = 0, retention: int | str = 0) -> None:
        self.home.engine.catalog.init_metric(*self._c(), shard_interval, retention)

    def append(self, df: DataFrame, tags: list[str], dimensions: list[str] | None = None, now_ms: int | None = None) -> None:
        """Append many records: a DataFrame with timestamp, value, tags and dimensions. The way to load."""
        self.home.engine.catalog.append(*self._c(), df, tags, dimensions or [], now() if now_ms is None else now_ms)

    def compact(self) -> None:
        """Put the small files of each shard together."""
        self.home.engine.catalog.compact(*self._c())

    def apply_retention(self, now_ms: int | None = None) -> None:
        self.home.engine.catalog.apply_retention(*self._c(), now() if now_ms is None else now_ms)

    def describe(self) -> DataFrame:
        return self.home.engine.catalog.describe(*self._c())

    def locations(self) -> DataFrame:
        return self.home.engine.catalog.locations(*self._c())

    def count(self) -> int:
        return self.home.engine.catalog.count(*self._c())

    def drop(self) -> None:
        self.home.engine.catalog.drop(*self._c())


@dataclass(frozen=True)
class Bit:
    """A record being built; every step gives a new one."""

    of: MetricHandle
    value: object
    time: int | None = None
    dimensions: tuple = ()
    tags: tuple = ()

    def timestamp(self, ms: int) -> Bit:
        return replace(self, time=ms)

    def dimension(self, name: str, value) -> Bit:
        return replace(self, dimensions=(*self.dimensions, (name, value)))

    def tag(self, name: str, value) -> Bit:
        return replace(self, tags=(*self.tags, (name, value)))

    def write(self, now_ms: int | None = None) -> None:
        h = self.of.home
        s = A.Insert(self.of.name, scalar(self.value), self.time, dict(self.dimensions), dict(self.tags))
        h.engine.catalog.insert(h.db, h.name, s, now() if now_ms is None else now_ms, int_fields=False)


class Console:
    """A session with a current namespace, as a command line has: SHOW, USE, DESCRIBE and statements."""

    def __init__(self, engine: Engine, db: str) -> None:
        self.engine, self.db, self.namespace = engine, db, None

    def run(self, sql: str, **how) -> DataFrame | None:
        s = parse(sql)
        if isinstance(s, A.Use):
            self.namespace = s.namespace
            return None
        if isinstance(s, A.ShowNamespaces):
            return self.engine.db(self.db).namespaces()
        if self.namespace is None:
            raise StatementError("no namespace selected")
        return self.engine.db(self.db).namespace(self.namespace).execute(sql, **how)
