"""Building blocks that the data-processing operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import write_scratch

DAY_MS = 86_400_000
HOUR_MS = 3_600_000

#: Columns that differ between deliveries of the same row.
ARRIVAL = ("row_id", "ingested_at", "arrived_at")


def floor_div(x: Column, by: int) -> Column:
    """Floor division of BIGINTs, exact for negatives and without going through doubles."""
    d = F.lit(by).cast("bigint")
    q = F.call_function("div", x, d)
    return F.when((x % d) < 0, q - 1).otherwise(q)


def drop_copies(df: DataFrame, arrival: Iterable[str] = ARRIVAL) -> DataFrame:
    """One row per delivery group: rows equal in every column but the ``arrival`` ones.

    The exchange hashes every remaining column, so no key, however frequent, meets in one task
    unless its rows are true copies, and those are folded before the exchange.
    """
    skip = {c.lower() for c in arrival}
    return df.select(*[c for c in df.columns if c.lower() not in skip]).distinct()


def spread(df: DataFrame, source: list[str], bin_: Column, rows_per_chunk: int, halo: int, counted: DataFrame | None = None) -> DataFrame:
    """Cut the rows of frequent sources into time chunks, each with a halo of its neighbours' rows.

    A window over a whole source is one task's work; where a source holds a third of all rows that
    is a third of the input. ``bin_`` is a coarse, order-preserving BIGINT of the ordering column
    (say, the hour). Rows are counted per (source, bin) with map-side aggregation; a source of more
    than ``rows_per_chunk`` rows is cut at bin borders into chunks of about that size, and every bin
    that holds rows among the ``halo`` ones before or after a chunk is sent to that chunk too.

    Adds ``_chunk`` INT and ``_halo`` BOOLEAN (true: only there for its neighbours' sake). Each row
    has exactly one place with ``_halo`` false. Sources below the limit stay whole in chunk 0.
    The chunk table has one row per bin of a frequent source, never one per row. It is made first: where no
    source is that frequent, the rows then need no join and so no exchange. ``counted``: rows to count instead
    of those of ``df``, at least as many in every bin.
    """
    by_bin = (df if counted is None else counted).withColumn("_bin", bin_).groupBy(*source, "_bin").agg(F.count("*").alias("_n"))
    run = Window.partitionBy(*source).orderBy("_bin")
    all_ = Window.partitionBy(*source)
    cut = (
        by_bin.withColumn("_total", F.sum("_n").over(all_))
        .where(F.col("_total") > rows_per_chunk)
        .withColumn("_to", F.sum("_n").over(run.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_from", F.col("_to") - F.col("_n"))
        .withColumn("_c", F.least(F.call_function("div", F.col("_from"), F.lit(rows_per_chunk)), F.greatest(F.call_function("div", F.col("_total"), F.lit(rows_per_chunk)), F.lit(1)) - 1))
        .withColumn("_c", F.dense_rank().over(Window.partitionBy(*source).orderBy("_c")))
        .withColumn("_cfrom", F.min("_from").over(Window.partitionBy(*source, "_c")))
        .withColumn("_cto", F.max("_to").over(Window.partitionBy(*source, "_c")))
    )
    before, after = F.col("_cfrom") + halo > F.col("_from"), F.col("_to") > F.col("_cto") - halo
    places = cut.select(
        *source,
        "_bin",
        F.array_compact(
            F.array(
                F.struct(F.col("_c").alias("_chunk"), F.lit(False).alias("_halo")),
                F.when(before & (F.col("_c") > 1), F.struct((F.col("_c") - 1).alias("_chunk"), F.lit(True).alias("_halo"))),
                F.when(after, F.struct((F.col("_c") + 1).alias("_chunk"), F.lit(True).alias("_halo"))),
            )
        ).alias("_places"),
    )
    places = write_scratch(places, "chunks")
    if places.isEmpty():
        return df.withColumn("_chunk", F.lit(0)).withColumn("_halo", F.lit(False))
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*source, "_bin"]]
    whole = F.array(F.struct(F.lit(0).alias("_chunk"), F.lit(False).alias("_halo")))
    joined = df.withColumn("_bin", bin_).alias("a").join(places.alias("b"), keys, "left").select("a.*", F.explode(F.coalesce("b._places", whole)).alias("_p"))
    return joined.select(*df.columns, F.col("_p._chunk").alias("_chunk"), F.col("_p._halo").alias("_halo"))


def explode_range(df: DataFrame, first: Column, last: Column, name: str, block: int = 4096) -> DataFrame:
    """One row per BIGINT from ``first`` to ``last`` (none if it is before ``first``), as column ``name``.

    In two steps, so that no array is longer than ``block`` or the number of blocks.
    """
    n = last - first
    b = F.explode(F.when(n >= 0, F.sequence(F.lit(0).cast("bigint"), F.call_function("div", n, F.lit(block).cast("bigint"))))).alias("_b")
    step = df.withColumn("_lo", first).withColumn("_hi", last).select("*", b)
    lo = F.col("_lo") + F.col("_b") * block
    return step.select("*", F.explode(F.sequence(lo, F.least(lo + (block - 1), F.col("_hi")))).alias(name)).drop("_b", "_lo", "_hi")
