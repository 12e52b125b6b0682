"""The test tables as metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Files
from .metric import Metric, fields_of


#: Times beyond these, in milliseconds, bound nothing: no stored time lies beyond them.
EARLIEST, LATEST = -62_000_000_000_000, 250_000_000_000_000


def _ms(c: str):
    return F.unix_millis(F.col(c).cast("timestamp"))


def shape(name: str, df: DataFrame) -> DataFrame:
    """The rows of a test table in a metric's layout."""
    if name == "events":
        unless_error = F.nullif(F.col("event_type"), F.lit("error"))
        return df.select(_ms("ts").alias("timestamp"), "value", "event_type", "user_id", unless_error.alias("maybe_tag"), "event_id", "props", unless_error.alias("maybe_type"))
    if name == "lineitem":
        dims = ["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax"]
        return df.select(_ms("l_shipdate").alias("timestamp"), F.col("l_quantity").alias("value"), "l_returnflag", "l_linestatus", "l_suppkey", *dims)
    if name == "orders":
        return df.select(_ms("o_orderdate").alias("timestamp"), F.col("o_custkey").alias("value"), "o_orderstatus", "o_orderpriority", "o_orderkey", "o_totalprice")
    raise KeyError(name)


TAGS = {"events": ["event_type", "user_id", "maybe_tag"], "lineitem": ["l_returnflag", "l_linestatus", "l_suppkey"], "orders": ["o_orderstatus", "o_orderpriority"]}
TIMES = {"events": "ts", "lineitem": "l_shipdate", "orders": "o_orderdate"}


def metric(spark: SparkSession, sf_dir: str, name: str) -> Metric:
    path = f"{sf_dir}/{name}.parquet"
    raw = spark.read.parquet(path)
    df = shape(name, raw)
    dims = [c for c in df.columns if c not in ("timestamp", "value", *TAGS[name])]

    def within(times: list[tuple[int, int]]) -> DataFrame:
        """Rows that may lie in ``times``, by bounds on the stored column, which reach the scan; up to its precision too many."""
        c, kind = F.col(TIMES[name]), raw.schema[TIMES[name]].dataType

        def bound(ms: int):
            return F.timestamp_millis(F.lit(ms).cast("bigint")).cast(kind)

        meets = F.lit(False)
        for lo, hi in times:
            meets = meets | ((c >= bound(lo) if lo > EARLIEST else c.isNotNull()) & (c <= bound(hi + 1) if hi < LATEST else c.isNotNull()))
        return shape(name, raw.where(meets))

    def stream() -> DataFrame:
        reader = spark.readStream.schema(raw.schema)
        if Files(spark).is_directory(path):
            return shape(name, reader.parquet(path))
        return shape(name, reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir))  # streams read folders

    return Metric("db", "ns", name, fields_of(df, TAGS[name], dims), lambda: df, stream=stream, within=within)
