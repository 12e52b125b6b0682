"""Totals over trailing periods, for every entity and day, silent days included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DAY_MS, drop_copies, explode_range, floor_div

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def rolling_totals(df: DataFrame, entity: str = "name", timestamp: str = "timestamp", value: str = "value", windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Totals and averages of ``value`` over the trailing ``windows`` (in days) of every entity and UTC day.

    Event-contribution deltas: a day's amount counts from that day on and is taken back when it
    leaves the window, so the running sum of the deltas of an entity is its window total. Between
    two delta days nothing changes; the days in between are written out from the earlier one.

    Result: ``entity`` STRING-like as given, ``day_utc`` 'YYYY-MM-DD', ``bits`` of that day (0: silent),
    and for each window w ``total_w``, ``bits_w``, ``avg_day_w`` (total / w) and ``avg_bit_w``
    (total / bits with a value; null without any). Rows from an entity's first to its last bit.

    Copies count once. Rows without entity or timestamp belong to nobody and are left out. A bit with a
    null value is a bit without amount. Whole numbers are totalled exactly as DECIMAL(38, 0); doubles
    with the rounding of doubles. An empty table gives no rows. Extra columns only tell copies apart,
    whatever their names.

    Shuffles: one on all columns for the copies, two of (entity, day) rows. An entity's days, at most
    one row each, are the most that meets in a task, however many bits it has.
    """
    whole = isinstance(df.schema[value].dataType, _WHOLE)
    amount = F.col(value).cast("decimal(20,0)" if whole else "double")
    one = drop_copies(df.where(F.col(entity).isNotNull() & F.col(timestamp).isNotNull())).select(
        F.col(entity).alias("_e"), floor_div(F.col(timestamp).cast("bigint"), DAY_MS).alias("_d"), amount.alias("_v")
    )
    kind = "decimal(38,0)" if whole else "double"
    daily = one.groupBy("_e", "_d").agg(
        F.coalesce(F.sum("_v").cast(kind), F.lit(0).cast(kind)).alias("_a"), F.count("*").alias("_n"), F.count("_v").alias("_k")
    ).repartition("_e")
    zero, none = F.lit(0).cast(kind), F.lit(0).cast("bigint")

    def delta(day, of):
        """The struct of one delta day: ``of`` maps a window to +1 / -1 / 0; the day's own bits only at 0."""
        return F.struct(
            day.alias("_d"),
            (F.col("_n") if of is None else none).alias("_n"),
            *[x for w in windows for x in (
                (F.col("_a") if of is None else -F.col("_a") if of == w else zero).cast(kind).alias(f"_a{w}"),
                (F.col("_n") if of is None else -F.col("_n") if of == w else none).alias(f"_n{w}"),
                (F.col("_k") if of is None else -F.col("_k") if of == w else none).alias(f"_k{w}"),
            )],
        )

    deltas = daily.select("_e", F.explode(F.array(delta(F.col("_d"), None), *[delta(F.col("_d") + w, w) for w in windows])).alias("x")).select("_e", "x.*")
    sums = [f"{p}{w}" for w in windows for p in ("_a", "_n", "_k")]
    days = deltas.groupBy("_e", "_d").agg(F.sum("_n").alias("_n"), *[F.sum(c).cast(kind if c[:2] == "_a" else "bigint").alias(c) for c in sums])
    run = Window.partitionBy("_e").orderBy("_d")
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    state = days.select(
        "_e", "_d", "_n",
        *[F.sum(c).over(upto).cast(kind if c[:2] == "_a" else "bigint").alias(c) for c in sums],
        F.lead("_d").over(run).alias("_next"),
        F.max(F.when(F.col("_n") > 0, F.col("_d"))).over(Window.partitionBy("_e")).alias("_end"),
    ).where(F.col("_d") <= F.col("_end"))
    filled = explode_range(state, F.col("_d"), F.least(F.coalesce(F.col("_next") - 1, F.col("_end")), F.col("_end")), "_day")
    out = [
        F.col("_e").alias(entity),
        F.date_format(F.date_from_unix_date(F.col("_day").cast("int")), "yyyy-MM-dd").alias("day_utc"),
        F.when(F.col("_day") == F.col("_d"), F.col("_n")).otherwise(none).alias("bits"),
    ]
    for w in windows:
        total = F.col(f"_a{w}")
        out += [
            total.alias(f"total_{w}"),
            F.col(f"_n{w}").alias(f"bits_{w}"),
            (total.cast("double") / w).alias(f"avg_day_{w}"),
            F.when(F.col(f"_k{w}") > 0, total.cast("double") / F.col(f"_k{w}")).alias(f"avg_bit_{w}"),
        ]
    return filled.select(*out)
