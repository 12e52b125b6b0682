"""Irregular readings onto a regular grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import explode_range, floor_div, spread

COORDINATES = ["db", "namespace", "metric"]


def regular_grid(readings: DataFrame, grids: DataFrame, gap_limit: int = 5, source: str = "name", rows_per_chunk: int = 500_000) -> DataFrame:
    """One row per period of each source's grid, from its first to its last period that has a reading.

    ``readings``: db, namespace, metric, timestamp, value and the ``source`` column. ``grids``: query_id, db,
    namespace, metric, interval_ms, upper_ms; period k is (upper_ms - (k+1) * interval_ms, upper_ms - k * interval_ms].

    As-of merge: the readings of a period fold, before any shuffle, into its first and last one; sorted by
    period, each grid point then lies between the last reading at or before it and the first one
    after it. ``value`` at the point is interpolated linearly in time between the two if they are at most
    ``gap_limit`` intervals apart; a period with readings falls back to its last reading, one without is
    ``missing`` with a null value. A reading exactly on the point is the value.

    Result: query_id, db, namespace, metric, source, ``upper_bound`` (the grid point), ``value``, ``status``
    ('observed': the period has a reading; 'interpolated'; 'missing').

    Null values, timestamps or sources are no readings; readings above ``upper_ms`` or in metrics without a
    grid have no period; an interval that isn't positive defines no grid. Copies change nothing; of readings
    with equal timestamps the least counts as first, the greatest as last. Extra columns are ignored.
    """
    good = (F.col("interval_ms") > 0) & F.col("upper_ms").isNotNull()
    g = grids.where(good).select("query_id", *COORDINATES, "interval_ms", "upper_ms")
    r = readings.where(F.col("value").isNotNull() & F.col("timestamp").isNotNull() & F.col(source).isNotNull()).select(
        *COORDINATES, F.col(source).alias("_s"), F.col("timestamp").cast("bigint").alias("_t"), F.col("value").cast("double").alias("_v")
    )
    key = ["query_id", *COORDINATES, "_s", "interval_ms", "upper_ms"]
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in COORDINATES]
    placed = (
        r.alias("r").join(g.alias("g"), on).where("_t <= upper_ms")
        .select("query_id", *[f"g.{c}" for c in COORDINATES], "_s", "interval_ms", "upper_ms", "_t", "_v")
        .withColumn("_k", F.call_function("div", F.col("upper_ms") - F.col("_t"), F.col("interval_ms")))
    )
    point = F.struct("_t", "_v")
    periods = placed.groupBy(*key, "_k").agg(F.min(point).alias("_first"), F.max(point).alias("_last"))
    chunked = spread(periods, key, floor_div(-F.col("_k"), 256), rows_per_chunk, 1, counted=placed)
    run = Window.partitionBy(*key, "_chunk").orderBy(F.col("_k").desc())
    steps = chunked.withColumn("_next", F.lead(F.struct("_k", "_first")).over(run)).where("not _halo")
    until = F.coalesce(F.col("_next._k") + 1, F.col("_k"))
    each = explode_range(steps, until, F.col("_k"), "_p")
    ub = F.col("upper_ms") - F.col("_p") * F.col("interval_ms")
    a, b = F.col("_last"), F.col("_next._first")
    span = b["_t"] - a["_t"]
    near = span <= F.lit(gap_limit).cast("bigint") * F.col("interval_ms")
    line = a["_v"] + (b["_v"] - a["_v"]) * ((ub - a["_t"]).cast("double") / span.cast("double"))
    observed = F.col("_p") == F.col("_k")
    value = F.when(a["_t"] == ub, a["_v"]).when(near, line).when(observed, a["_v"])
    return each.select(
        "query_id", *COORDINATES, F.col("_s").alias(source), ub.alias("upper_bound"), value.alias("value"),
        F.when(observed, "observed").when(near, "interpolated").otherwise("missing").alias("status"),
    )
