"""Exact percentiles per group by a full distributed sort, from runs that can be combined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import write_scratch
from .common import ARRIVAL


def value_marks(df: DataFrame, keys: Sequence[str], value: str = "value", timestamp: str | None = None) -> DataFrame:
    """One row for each bit with a value: keys, ``value``, two numbers that tell the bit from all others (``mark_1``, ``mark_2``:
    a 128-bit hash of the whole row but its arrival), and with ``timestamp`` that of the bit (``mark_time``).

    Marks are what files are combined by while a bit may come again in another file: ``merge_marks`` counts a copy once, in
    whichever files it lies. Only these few columns move, folded before the exchange; the marks spread evenly, whatever
    the key. Null and NaN values and rows with a null key are left out; -0.0 is 0.0.
    """
    rest = [c for c in df.columns if c.lower() not in {a.lower() for a in ARRIVAL}]
    absent = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "0").otherwise("1") for c in rest])  # hashes pass over nulls
    marks = [F.xxhash64(F.lit(seed), absent, *[F.col(f"`{c}`") for c in rest]).alias(f"mark_{seed}") for seed in (1, 2)]
    v = F.col(value).cast("double")
    good = F.col(value).isNotNull() & ~F.isnan(v)
    for k in keys:
        good = good & F.col(k).isNotNull()
    time = [] if timestamp is None else [F.col(timestamp).cast("bigint").alias("mark_time")]
    return df.where(good).select(*keys, (v + F.lit(0.0)).alias("value"), *marks, *time).distinct()


def merge_marks(*marks: DataFrame) -> DataFrame:
    """Marks of several inputs as one: each bit once."""
    all_ = marks[0]
    for m in marks[1:]:
        all_ = all_.unionByName(m)
    return all_.distinct()


def marked_runs(marks: DataFrame) -> DataFrame:
    """The runs of marked bits: keys, ``value``, ``n``."""
    keys = [c for c in marks.columns if c not in ("value", "mark_1", "mark_2", "mark_time")]
    return marks.groupBy(*keys, "value").agg(F.count("*").alias("n"))


def seal(marks: DataFrame, before: int) -> tuple[DataFrame, DataFrame]:
    """The runs of bits from before ``before`` (milliseconds), which no file will bring again, and the marks of the others:
    what has to be kept to combine further files with stays as small as the time in which copies come."""
    return marked_runs(marks.where(F.col("mark_time") < before)), marks.where(F.col("mark_time") >= before)


def value_runs(df: DataFrame, keys: Sequence[str], value: str = "value", copies: bool = False) -> DataFrame:
    """A group's values as runs, how often each value occurs: (keys, ``value``, ``n``).

    Runs combine with ``merge_runs`` without loss, so percentiles of a month are those of its days' runs, where no
    bit is delivered in two of them; where one may be, combine ``value_marks`` instead. Null and NaN values and
    rows with a null key are left out; -0.0 is 0.0. Copies count once, unless ``copies``. A value that fills a third of all
    rows is folded before the exchange.
    """
    if not copies:
        return marked_runs(value_marks(df, keys, value))
    v = F.col(value).cast("double")
    good = F.col(value).isNotNull() & ~F.isnan(v)
    for k in keys:
        good = good & F.col(k).isNotNull()
    return df.where(good).select(*keys, (v + F.lit(0.0)).alias("value")).groupBy(*keys, "value").agg(F.count("*").alias("n"))


def merge_runs(*runs: DataFrame) -> DataFrame:
    """Runs of several inputs as one."""
    all_ = runs[0]
    for r in runs[1:]:
        all_ = all_.unionByName(r)
    keys = [c for c in all_.columns if c not in ("value", "n")]
    return all_.groupBy(*keys, "value").agg(F.sum("n").alias("n"))


def percentiles(runs: DataFrame, quantiles: Sequence[float] = (0.01, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """Percentiles per group of ``value_runs``, exact: error 0 against the interpolated order statistics.

    1. One range exchange sorts all runs by (keys, value) over all partitions; a large group lies over
       many of them. The sorted table is written to the shared folder, with its partition's number.
    2. Per-partition counts: the rows of each (group, partition), a table of groups, not rows. Their running
       sum is each part's offset in its group, their total the group's size.
    3. The target positions q * (n - 1) are located in their parts; parts without a target are left.
    4. Within the parts with targets, a running count picks the order statistics at the floor and the ceiling
       of each position, and the two are interpolated linearly.

    Result: keys, ``n`` (values in the group), one column ``p<percent>`` per quantile (0.5: p50, 0.999: p99_9).
    A group of one value has it at every percentile. Empty input gives no rows.
    """
    keys = [c for c in runs.columns if c not in ("value", "n")]
    order = [*keys, "value"]
    sorted_ = runs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    table = write_scratch(sorted_, "sorted")
    parts = table.groupBy(*keys, "_part").agg(F.sum("n").alias("_n"))
    run = Window.partitionBy(*keys).orderBy("_part")
    parts = parts.select(
        *keys, "_part", "_n",
        (F.sum("_n").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
    )
    qs = [float(q) for q in quantiles]
    targets = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(q * (F.col("_total") - 1)), F.ceil(q * (F.col("_total") - 1))) for q in qs])))
    here = F.filter(targets, lambda p: (p >= F.col("_offset")) & (p < F.col("_offset") + F.col("_n")))
    wanted = parts.withColumn("_want", here).where(F.size("_want") > 0).drop("_n")
    inside = Window.partitionBy(*keys, "_part").orderBy("value")
    rows = table.join(wanted, [*keys, "_part"]).withColumn("_to", F.col("_offset") + F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    hits = rows.withColumn("_hit", F.filter("_want", lambda p: (p >= F.col("_to") - F.col("n")) & (p < F.col("_to")))).where(F.size("_hit") > 0)

    def at(position):
        return F.max(F.when(F.array_contains("_hit", position), F.col("value")))

    out = []
    for q in qs:
        p = q * (F.col("_total") - 1)
        out += [at(F.floor(p)).alias(f"_lo{q}"), at(F.ceil(p)).alias(f"_hi{q}")]
    got = hits.groupBy(*keys, "_total").agg(*out)
    named = []
    for q in qs:
        p = q * (F.col("_total") - 1)
        lo, hi = F.col(f"`_lo{q}`"), F.col(f"`_hi{q}`")
        named.append((lo + (hi - lo) * (p - F.floor(p))).alias("p" + f"{q * 100:.6f}".rstrip("0").rstrip(".").replace(".", "_")))
    return got.select(*keys, F.col("_total").alias("n"), *named)
