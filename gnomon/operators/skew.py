"""Per-key results where a few keys hold most records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ARRIVAL

#: A key with this share of all rows is treated apart.
HEAVY = 0.05
#: The least share that a key can be told apart by: the sketch takes up to a million counters.
LEAST = 1 / 60_000


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float = HEAVY) -> DataFrame:
    """The keys with at least ``share`` of all rows, copies included: keys, ``n``, ``total``.

    A frequent-items sketch, merged over all partitions, names every key that can have the share: with
    m counters it underestimates a key by at most 3.5 / m of the rows, and m is set so that this is
    under half the share. The named keys, at most 2 / share of them whatever the input, are then
    counted exactly over all rows. Shares under 1 / 60,000 count as that. Null keys are keys like others. Empty input has no heavy keys.
    """
    keys = list(keys)
    named = _named(df, keys, share)
    counted = df.select(*keys, _as_text(keys).alias("_key")).join(F.broadcast(named), "_key").groupBy("_key", *keys).agg(F.count("*").alias("n"), F.first("_total").alias("total"))
    return counted.where(F.col("n") >= F.lit(max(share, LEAST)) * F.col("total")).select(*keys, "n", "total")


def _as_text(keys: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]), {"ignoreNullFields": "false"})


def _named(df: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """All keys that can have the share, by the sketch, and perhaps some with at least half of it: ``_key`` as text, ``_total`` of all rows."""
    share = max(share, LEAST)
    most = max(1, int(2 / share))
    counters = 1 << max(6, int(8 / share).bit_length())
    sketch = df.select(_as_text(keys).alias("_key")).agg(F.expr(f"approx_top_k(_key, {most}, {counters})").alias("_top"), F.count("*").alias("_total"))
    return sketch.select("_total", F.explode("_top").alias("_x")).where(F.col("_x.count") >= F.lit(share / 2) * F.col("_total")).select(F.col("_x.item").alias("_key"), "_total")


def per_key(df: DataFrame, keys: Sequence[str], name: str = "name", timestamp: str = "timestamp", value: str = "value", share: float = HEAVY, apart: float | None = None) -> DataFrame:
    """Rows, totals, distinct names and the last bit of every key, without heavy keys holding up the rest.

    Keys that by the sketch may have ``apart`` of all rows (default: what half a shuffle partition would hold on average, at most
    ``share``), a set bounded by 2 / apart, are told apart by a broadcast join.

    - Their rows never meet by key: copies fold on an exchange of all columns, then (key, name) parts, folded
      before each exchange, then those parts. Each step is spread evenly, whatever the key's size.
    - All other rows take one ordinary exchange by key; copies, names and totals fold where they lie.

    Result: keys, ``n_rows`` (deliveries, copies included), ``n_bits`` (without), ``total`` and ``n_values`` of the
    non-null values, ``n_names`` (distinct, null is none), ``last_timestamp``, ``last_value`` (of the bit with the
    greatest timestamp; of equal ones the greatest value, nulls least), ``heavy`` (at least ``share`` of all rows). Null
    keys are kept as keys. Totals of doubles are sums of doubles. Empty input gives no rows.
    """
    keys = list(keys)
    apart = min(share, 1 / (2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if apart is None else apart)
    k = [f"_k{i}" for i in range(len(keys))]
    skip = {c.lower() for c in ARRIVAL} | {c.lower() for c in keys}
    rest = [c for c in df.columns if c.lower() not in skip]
    flat = df.select(*[F.col(c).alias(a) for c, a in zip(keys, k)], *[F.col(c).alias(f"_c{i}") for i, c in enumerate(rest)])
    at = {c: f"_c{i}" for i, c in enumerate(rest)}
    texts = F.from_json("_key", ", ".join(f"k{i} string" for i in range(len(k))))
    heavy = _named(flat, k, apart).withColumn("_x", texts).select(*[F.col(f"_x.k{i}").cast(flat.schema[c].dataType).alias(c) for i, c in enumerate(k)], F.col("_total").alias("_all"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in k]
    told = flat.alias("a").join(F.broadcast(heavy.alias("b")), on, "left").select("a.*", "b._all")
    last = F.struct(F.col(at[timestamp]).cast("bigint").alias("t"), F.col(at[value]).cast("double").alias("v"))

    def fold(rows: DataFrame) -> DataFrame:
        by = [*k, "_all"]
        once = rows.groupBy(*by, *at.values()).agg(F.count("*").alias("_n"))
        v: Column = F.col(at[value]).cast("double")
        by_name = once.groupBy(*by, at[name]).agg(
            F.sum("_n").alias("_n"), F.count("*").alias("_bits"), F.sum(v).alias("_total"), F.count(v).alias("_values"), F.max(last).alias("_last")
        )
        return by_name.groupBy(*by).agg(
            F.sum("_n").alias("_n"), F.sum("_bits").alias("_bits"), F.sum("_total").alias("_total"), F.sum("_values").alias("_values"), F.count(at[name]).alias("_names"), F.max("_last").alias("_last")
        )

    light = fold(told.where("_all is null").repartition(*k))
    large = fold(told.where("_all is not null"))
    is_heavy = F.coalesce(F.col("_n") >= F.lit(share) * F.col("_all"), F.lit(False))  # the sketch names every key with the share
    return light.unionByName(large).select(
        *[F.col(a).alias(c) for c, a in zip(keys, k)], F.col("_n").alias("n_rows"), F.col("_bits").alias("n_bits"), F.coalesce("_total", F.lit(0.0)).alias("total"),
        F.col("_values").alias("n_values"), F.col("_names").alias("n_names"), F.col("_last.t").alias("last_timestamp"), F.col("_last.v").alias("last_value"), is_heavy.alias("heavy"),
    )
