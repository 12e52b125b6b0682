"""The catalog: databases, namespaces and metrics kept as time-sharded Parquet, with their schemas and settings.

Layout: root/db/namespace/metric/_metric.json and root/db/namespace/metric/data/shard_from=.../*.parquet. A shard holds
[shard_from, shard_from + interval), so a timestamp has one place. Files of appended records are called part-*, of records
that were written again (after a removal or a compaction) kept-*. A metric has one writer at a time.
"""

from __future__ import annotations

import json
import re
import uuid
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NotFound, SchemaMismatch, StatementError
from ..functions.scalars import type_name
from ..operators.common import floor_div
from ..plans import ast as A
from ..plans.analyzer import check_condition
from ..plans.compiler import predicate, scan
from ..runtime import write_scratch
from .files import Files
from .metric import DEFAULT_SHARD_MS, Field, Metric

TYPES = {"INT": T.IntegerType(), "BIGINT": T.LongType(), "DECIMAL": T.DoubleType(), "VARCHAR": T.StringType()}
_DURATION = re.compile(r"\s*(\d+)\s*([A-Za-z]+)\s*\Z")
#: Bytes that a shard's files should have, on average, at least; a compaction writes files of about twice that.
SMALL_FILE = 64 << 20
#: How far back files may have begun that are yet to appear, in days.
IN_FLIGHT_DAYS = 1
#: Units of durations in settings, in milliseconds (fixed values).
_UNITS = {"ms": 1, "s": 1000, "second": 1000, "seconds": 1000, "min": 60_000, "minute": 60_000, "minutes": 60_000, "h": 3_600_000, "hour": 3_600_000, "hours": 3_600_000, "d": 86_400_000, "day": 86_400_000, "days": 86_400_000}


def duration_ms(x: int | str) -> int:
    """Milliseconds of a number of them or of text like '2d'."""
    if isinstance(x, int):
        return x
    m = _DURATION.match(x)
    if m is None or m.group(2).lower() not in _UNITS:
        raise StatementError(f"{x!r} is no duration")
    return int(m.group(1)) * _UNITS[m.group(2).lower()]


def scalar(x: object) -> object:
    """A client's value as one of the four types: decimals with a scale are DECIMAL, others BIGINT."""
    if isinstance(x, Decimal):
        return float(x) if x.as_tuple().exponent < 0 else int(x)
    if isinstance(x, bool) or not isinstance(x, (int, float, str)):
        raise SchemaMismatch(f"{x!r} is of no supported type")
    return x


def _tail(path):
    """Shard and name of a file, which tell it from all others of its metric."""
    return F.regexp_extract(path, "([^/]+/[^/]+)$", 1)


class Catalog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.views: dict[tuple[str, str, str], Metric] = {}

    # -- what there is
    def register(self, metric: Metric) -> Metric:
        """Make a metric over a DataFrame queryable under its coordinates, without storing it."""
        self.views[metric.db, metric.namespace, metric.name] = metric
        return metric

    def databases(self) -> list[str]:
        return sorted({k[0] for k in self.views} | set(self.files.names(self.root)))

    def namespaces(self, db: str) -> list[str]:
        return sorted({k[1] for k in self.views if k[0] == db} | set(self.files.names(f"{self.root}/{db}")))

    def metrics(self, db: str, namespace: str) -> list[str]:
        stored = [m for m in self.files.names(f"{self.root}/{db}/{namespace}") if self.files.exists(self._json(db, namespace, m))]
        return sorted({k[2] for k in self.views if k[:2] == (db, namespace)} | set(stored))

    def _dir(self, db: str, namespace: str, metric: str) -> str:
        return f"{self.root}/{db}/{namespace}/{metric}"

    def _json(self, *c: str) -> str:
        return f"{self._dir(*c)}/_metric.json"

    def _info(self, *c: str) -> dict | None:
        return json.loads(self.files.read(self._json(*c))) if self.files.exists(self._json(*c)) else None

    def _save(self, c: tuple[str, str, str], info: dict) -> None:
        self.files.write(self._json(*c), json.dumps(info, indent=1))

    def metric(self, db: str, namespace: str, name: str) -> Metric:
        if (db, namespace, name) in self.views:
            return self.views[db, namespace, name]
        self._recover(self._dir(db, namespace, name))
        info = self._info(db, namespace, name)
        if info is None or not info["fields"]:
            raise NotFound(f"Metric {name} does not exist")
        fields = {n: Field(n, TYPES[t], role) for n, (t, role) in info["fields"].items()}
        interval, data = info["shard_ms"], f"{self._dir(db, namespace, name)}/data"
        schema = T.StructType([T.StructField(f.name, f.type) for f in fields.values()] + [T.StructField("shard_from", T.LongType())])

        def starts() -> list[tuple[int, int]]:
            return sorted((s, s + interval) for s in (int(n.split("=")[1]) for n in self.files.names(data) if n.startswith("shard_from=")))

        def rows() -> DataFrame:
            return self.spark.read.schema(schema).parquet(data) if self.files.names(data) else self.spark.createDataFrame([], schema)

        def stream() -> DataFrame:
            return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(self.files.make(data))

        def news() -> DataFrame:
            """The stream of records appended after this call. Files that were there before are left out by time, which the scan
            prunes by, and the youngest of them, beside which others may yet appear, by name."""
            df = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).option("pathGlobFilter", "part-*.parquet").parquet(self.files.make(data))
            files = self._files(data)
            newest = files.agg(F.max("modificationTime")).first()[0]
            if newest is None:
                return df
            since = F.lit(newest) - F.expr(f"interval {IN_FLIGHT_DAYS} days")
            names = files.where(F.col("modificationTime") >= since).select(_tail(F.col("path")).alias("_file"))
            tagged = df.where(F.col("_metadata.file_modification_time") >= since).select("*", _tail(F.col("_metadata.file_path")).alias("_file"))
            return tagged.join(write_scratch(names, "files"), "_file", "left_anti").drop("_file")

        def current() -> Metric:
            return self.metric(db, namespace, name)

        return Metric(db, namespace, name, fields, rows, interval, info["retention_ms"], "shard_from", starts, stream=stream, news=news, current=current, rewrites=info.get("rewrites", 0))

    def _files(self, data: str) -> DataFrame:
        """One row for each file of a metric: path, modificationTime, length; listed by executors, none is read."""
        if not any(n.startswith("shard_from=") for n in self.files.names(data)):
            return self.spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, shard_from bigint")
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(data)
        return found.select("path", "modificationTime", "length", F.col("shard_from").cast("bigint").alias("shard_from"))

    # -- settings and records
    def init_metric(self, db: str, namespace: str, name: str, shard_interval: int | str = 0, retention: int | str = 0) -> None:
        """Set shard interval (0: 30 days) and retention (0: for ever) once, before any record."""
        if self._info(db, namespace, name) is not None:
            raise StatementError("metric info already exist")
        self._save((db, namespace, name), {"shard_ms": duration_ms(shard_interval) or DEFAULT_SHARD_MS, "retention_ms": duration_ms(retention), "fields": {}})

    def append(self, db: str, namespace: str, name: str, df: DataFrame, tags: list[str], dimensions: list[str], now_ms: int) -> None:
        """Append records; their fields join the schema. A field of another type or role is refused, nothing is written then.

        With a retention, records further than it from now, past or future, are accepted but not kept. Records are
        rebalanced by shard before the write: a shard gets files by its size, however many tasks there were.
        """
        c = (db, namespace, name)
        info = self._info(*c) or {"shard_ms": DEFAULT_SHARD_MS, "retention_ms": 0, "fields": {}}
        roles = {"timestamp": "timestamp", "value": "value"} | dict.fromkeys(dimensions, "dimension") | dict.fromkeys(tags, "tag")
        fields = dict(info["fields"])
        for n, role in roles.items():
            t = type_name(df.schema[n].dataType)
            if t not in TYPES or (role == "value" and t == "VARCHAR"):
                raise SchemaMismatch(f"field {n} is of the unsupported type {t}")
            if n in fields and fields[n][0] != t:
                raise SchemaMismatch(f"mismatch type for field {n}: {fields[n][0]} before, now {t}")
            if n in fields and fields[n][1] != role:
                raise SchemaMismatch(f"field {n} is a {fields[n][1]}, not a {role}")
            fields[n] = [t, role]
        rows = df.select(*roles).where("timestamp is not null and value is not null")
        if info["retention_ms"]:
            rows = rows.where((F.col("timestamp") >= now_ms - info["retention_ms"]) & (F.col("timestamp") <= now_ms + info["retention_ms"]))
        rows = rows.withColumn("shard_from", floor_div(F.col("timestamp"), info["shard_ms"]) * info["shard_ms"])
        before = self._info(*c)
        self._save(c, info | {"fields": fields})  # before the write: records of unknown fields would be invisible
        try:
            rows.hint("rebalance", "shard_from").write.mode("append").partitionBy("shard_from").parquet(f"{self._dir(*c)}/data")
        except BaseException:
            if before is None:
                self.files.delete(self._json(*c))
            else:
                self._save(c, before)
            raise

    def insert(self, db: str, namespace: str, s: A.Insert, now_ms: int, int_fields: bool = True) -> None:
        """One record. Whole numbers in a statement's assignments are INT, those of clients BIGINT."""
        dims = {k: scalar(v) for k, v in s.dimensions.items()}
        tags = {k: scalar(v) for k, v in s.tags.items()}
        whole = T.IntegerType() if int_fields else T.LongType()

        def kind(v: object, i: T.DataType) -> T.DataType:
            return T.StringType() if isinstance(v, str) else T.DoubleType() if isinstance(v, float) else i

        value = scalar(s.value)
        if isinstance(value, str):
            raise SchemaMismatch("the value must be a number")
        record = {"timestamp": now_ms if s.timestamp is None else s.timestamp, "value": value} | dims | tags
        schema = T.StructType([T.StructField(k, T.LongType() if k == "timestamp" else kind(v, T.LongType() if k == "value" else whole)) for k, v in record.items()])
        self.append(db, namespace, s.metric, self.spark.createDataFrame([tuple(record.values())], schema), list(tags), list(dims), now_ms)

    # -- removal
    def _rewrite(self, m: Metric, touched: list[int], keep) -> None:
        """Replace the shards ``touched`` by their rows that ``keep`` passes: written aside first, then swapped.

        The list of shards is metadata, one number for each. A swap that breaks off is finished by whoever opens the metric next.
        """
        if not touched:
            return
        base = self._dir(m.db, m.namespace, m.name)
        staging = f"{base}/_staging-{uuid.uuid4().hex}"
        rows = keep(m.rows().where(F.col("shard_from").isin(touched)))
        rows.hint("rebalance", "shard_from").write.option("mapreduce.output.basename", "kept").partitionBy("shard_from").parquet(f"{staging}/new")
        kept = [n for n in self.files.names(f"{staging}/new") if n.startswith("shard_from=")]
        self.files.write(f"{staging}/_ready.json", json.dumps({"touched": [f"shard_from={s}" for s in touched], "kept": kept}))
        self._swap(base, staging)

    def _swap(self, base: str, staging: str) -> None:
        """Put the written shards in place of the old ones, which are moved aside before anything is deleted. Every step may be the last before a
        failure, and all of them may be repeated."""
        ready = json.loads(self.files.read(f"{staging}/_ready.json"))
        for shard in ready["touched"]:
            new, here, old = f"{staging}/new/{shard}", f"{base}/data/{shard}", f"{staging}/old/{shard}"
            waiting = self.files.exists(new)
            if self.files.exists(here) and not self.files.exists(old) and (waiting or shard not in ready["kept"]):
                self.files.move(here, old)
            if waiting:
                self.files.move(new, here)
        c = tuple(base[len(self.root) + 1 :].split("/"))
        info = self._info(*c)
        self._save(c, info | {"rewrites": info.get("rewrites", 0) + 1})
        self.files.delete(staging)

    def _recover(self, base: str) -> None:
        """Finish the swaps that a failed writer left, and remove what it hadn't written in full."""
        for n in self.files.names(base):
            if n.startswith("_staging-"):
                if self.files.exists(f"{base}/{n}/_ready.json"):
                    self._swap(base, f"{base}/{n}")
                else:
                    self.files.delete(f"{base}/{n}")

    @staticmethod
    def _shards_with(df: DataFrame) -> list[int]:
        return sorted(r[0] for r in df.select("shard_from").distinct().collect())

    def compact(self, db: str, namespace: str, name: str, small: int = SMALL_FILE) -> list[int]:
        """Write the shards again that hold several files of less than ``small`` bytes on average; returns them."""
        m = self._stored(db, namespace, name)
        sizes = self._files(f"{self._dir(db, namespace, name)}/data").groupBy("shard_from").agg(F.count("*").alias("n"), F.avg("length").alias("size"))
        touched = self._shards_with(sizes.where((F.col("n") > 1) & (F.col("size") < small)))
        self._rewrite(m, touched, lambda df: df)
        return touched

    def delete(self, db: str, namespace: str, s: A.Delete, now_ms: int) -> None:
        """Remove the records that meet the condition. Only shards with such records are rewritten."""
        m = self._stored(db, namespace, s.metric)
        check_condition(s.where, m, now_ms)
        self._rewrite(m, self._shards_with(scan(m, s.where, now_ms)), lambda df: df.where(~F.coalesce(predicate(s.where, m, now_ms), F.lit(False))))

    def apply_retention(self, db: str, namespace: str, name: str, now_ms: int) -> None:
        """Drop shards that lie wholly outside of the retention around now; in the others remove what is too old."""
        m = self._stored(db, namespace, name)
        if not m.retention_ms:
            return
        low, high = now_ms - m.retention_ms, now_ms + m.retention_ms
        gone = [a for a, b in m.shards() if b <= low or a >= high]
        if gone:
            c = (db, namespace, name)
            self._save(c, (info := self._info(*c)) | {"rewrites": info.get("rewrites", 0) + 1})
        for a in gone:
            self.files.delete(f"{self._dir(db, namespace, name)}/data/shard_from={a}")
        edge = [a for a, b in m.shards_of() if a < low < b]
        if edge:
            old = m.rows().where(F.col("shard_from").isin(edge) & (F.col("timestamp") < low))
            self._rewrite(m, self._shards_with(old), lambda df: df.where(F.col("timestamp") >= low))

    def drop(self, db: str, namespace: str, name: str) -> None:
        if self.views.pop((db, namespace, name), None) is None:
            self._stored(db, namespace, name)
            self.files.delete(self._dir(db, namespace, name))

    def delete_namespace(self, db: str, namespace: str) -> None:
        for k in [k for k in self.views if k[:2] == (db, namespace)]:
            del self.views[k]
        self.files.delete(f"{self.root}/{db}/{namespace}")

    def _stored(self, db: str, namespace: str, name: str) -> Metric:
        m = self.metric(db, namespace, name)
        if m.partition is None:
            raise StatementError(f"metric {name} is read-only")
        return m

    # -- descriptions as frames
    def describe(self, db: str, namespace: str, name: str) -> DataFrame:
        """One row per field: name, class, type; and the metric's shard interval and retention."""
        m = self.metric(db, namespace, name)
        rows = [(f.name, f.role, type_name(f.type), m.shard_ms, m.retention_ms) for f in m.fields.values()]
        return self.spark.createDataFrame(rows, "field string, class string, type string, shard_interval bigint, retention bigint")

    def locations(self, db: str, namespace: str, name: str) -> DataFrame:
        return self.spark.createDataFrame([(name, a, b) for a, b in self.metric(db, namespace, name).shards()], "metric string, shard_from bigint, shard_to bigint")

    # -- settings and schemas as a file
    def dump_metadata(self, path: str) -> int:
        """Write the coordinates, settings and schemas of all stored metrics to one file; returns how many there are."""
        all_ = [(d, n, m) for d in self.files.names(self.root) for n in self.files.names(f"{self.root}/{d}") for m in self.files.names(f"{self.root}/{d}/{n}") if self.files.exists(self._json(d, n, m))]
        self.files.write(path, json.dumps([{"db": c[0], "namespace": c[1], "metric": c[2]} | self._info(*c) for c in all_], indent=1))
        return len(all_)

    def restore_metadata(self, path: str) -> int:
        """Take over what ``dump_metadata`` wrote: coordinates, settings and schemas; records stay as they are. Entries replace those of equal
        coordinates. Returns how many there are."""
        entries = json.loads(self.files.read(path))
        for e in entries:
            self._save((e["db"], e["namespace"], e["metric"]), {k: v for k, v in e.items() if k not in ("db", "namespace", "metric")})
        return len(entries)

    def count(self, db: str, namespace: str, name: str) -> int:
        return self.metric(db, namespace, name).rows().count()
