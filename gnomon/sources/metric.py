"""Metrics: named series of records with a schema, wherever their rows come from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import floor_div

DEFAULT_SHARD_MS = 30 * 86_400_000


@dataclass(frozen=True)
class Field:
    name: str
    type: T.DataType
    role: str  # timestamp value dimension tag


@dataclass
class Metric:
    """``rows()`` gives timestamp BIGINT, value, and one typed column per dimension and tag.

    ``shards()`` gives the (from, to) of the storage shards; by default they are read off the
    timestamps, one column of one aggregation, once per object. ``stream()`` has all records, then those that come;
    ``news()`` only those that come.
    """

    db: str
    namespace: str
    name: str
    fields: dict[str, Field]
    rows: Callable[[], DataFrame]
    shard_ms: int = DEFAULT_SHARD_MS
    retention_ms: int = 0
    partition: str | None = None  # physical column with the shard's start, where storage is partitioned by it
    shards_of: Callable[[], list[tuple[int, int]]] | None = None
    within: Callable[[list[tuple[int, int]]], DataFrame] | None = None  # rows() without, at least, shards or files outside of some spans of time
    stream: Callable[[], DataFrame] | None = None
    news: Callable[[], DataFrame] | None = None  # the stream of what comes after the call
    current: Callable[[], Metric] | None = None  # the metric as it is at the call
    rewrites: int = 0  # how often stored records were removed or written again
    _known: list[tuple[int, int]] | None = field(default=None, repr=False)

    def shards(self) -> list[tuple[int, int]]:
        if self._known is None:
            if self.shards_of is not None:
                self._known = self.shards_of()
            else:
                start = floor_div(F.col("timestamp"), self.shard_ms) * self.shard_ms
                self._known = sorted((r[0], r[0] + self.shard_ms) for r in self.rows().select(start.alias("s")).where("s is not null").distinct().collect())
        return self._known

    @property
    def tags(self) -> list[str]:
        return [f.name for f in self.fields.values() if f.role == "tag"]

    @property
    def dimensions(self) -> list[str]:
        return [f.name for f in self.fields.values() if f.role == "dimension"]


def fields_of(df: DataFrame, tags: list[str], dimensions: list[str]) -> dict[str, Field]:
    """The schema of rows that already have the physical layout."""
    roles = {"timestamp": "timestamp", "value": "value"} | dict.fromkeys(tags, "tag") | dict.fromkeys(dimensions, "dimension")
    return {n: Field(n, df.schema[n].dataType, r) for n, r in roles.items()}


def from_frame(name: str, df: DataFrame, tags: list[str], dimensions: list[str] | None = None, db: str = "db", namespace: str = "ns", **more) -> Metric:
    """A metric over a DataFrame with columns timestamp, value, tags and dimensions."""
    dims = dimensions or []
    keep = df.select("timestamp", "value", *tags, *dims)
    return Metric(db, namespace, name, fields_of(keep, tags, dims), lambda: keep, **more)


def as_records(df: DataFrame, m: Metric) -> DataFrame:
    """Results as records: timestamp, value, ``dimensions`` and ``tags``, each a struct; ``json`` the whole record without
    absent fields. What is neither a dimension of the metric nor a bound, aggregates too, is a tag."""
    dims = [c for c in df.columns if c in m.dimensions]
    tags = [c for c in df.columns if c not in ("timestamp", "value", *dims)]

    def group(names: list[str]):
        return F.struct(*[F.col(f"`{n}`") for n in names]) if names else F.from_json(F.lit("{}"), T.StructType([]))

    out = df.select("timestamp", "value", group(dims).alias("dimensions"), group(tags).alias("tags"))
    return out.withColumn("json", F.to_json(F.struct("timestamp", "value", "dimensions", "tags")))
