"""The registered queries of the data-processing operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import apply_changes
from ..operators.grid import regular_grid
from ..operators.percentiles import marked_runs, merge_marks, merge_runs, percentiles, seal, value_marks, value_runs
from ..operators.rolling import rolling_totals
from ..operators.skew import HEAVY, heavy_keys, per_key
from ..operators.spikes import judge_readings

COORDINATES = ["db", "namespace", "metric"]
QUANTILES = (0.01, 0.25, 0.5, 0.75, 0.95, 0.99)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark, sf):
    t = rolling_totals(table(spark, sf, "aggregation_long_metric"))
    return t.where("bits = 0 and total_7 > 0 and 2 * total_7 > total_30").select("name", "day_utc")


def p1_rolling_totals(spark, sf):
    t = rolling_totals(table(spark, sf, "aggregation_long_metric"))
    return t.withColumns({c: F.col(c).cast("bigint") for c in ("total_7", "total_30")})


def p2_found(spark, sf):
    return apply_changes(table(spark, sf, "commit_log")).select("bit_id", "ts", "entry_no")


def p2_current_bits(spark, sf):
    return apply_changes(table(spark, sf, "commit_log"))


def p3_found(spark, sf):
    g = regular_grid(table(spark, sf, "temporal_double_metric"), table(spark, sf, "temporal_queries"))
    return g.where("status <> 'observed'").select("name", "upper_bound")


def p3_regular_grid(spark, sf):
    return regular_grid(table(spark, sf, "temporal_double_metric"), table(spark, sf, "temporal_queries")).withColumn("value", F.round("value", 6))


def _judged(spark, sf):
    return judge_readings(table(spark, sf, "double_metric"), table(spark, sf, "metric_info"))


def p4_found(spark, sf):
    return _judged(spark, sf).where("impossible or spike or stuck").select("name", "timestamp").distinct()


def p4_judged_readings(spark, sf):
    return _judged(spark, sf)


def p4_levels(spark, sf):
    return _judged(spark, sf).select(*COORDINATES, "name", "timestamp", "value", "impossible", "stuck", F.round("baseline", 6).alias("baseline"))


def _percentiles(*keys):
    def query(spark, sf):
        got = percentiles(value_runs(table(spark, sf, "metric_bits"), keys), QUANTILES)
        return got.withColumns({c: F.round(c, 6) for c in got.columns if c[0] == "p" and c[1].isdigit()})

    return query


def p5_percentiles_of_weeks(spark, sf):
    """The bits by week of arrival, in four parts that share copies, each reduced to its marks before they are combined."""
    bits = table(spark, sf, "metric_bits")
    part = F.pmod(F.weekofyear("ingested_at"), F.lit(4))
    marks = [value_marks(bits.where(part.eqNullSafe(F.lit(i))), COORDINATES, timestamp="timestamp") for i in (0, 1, 2, 3)]
    last = bits.agg(F.max("timestamp")).first()[0]
    sealed, still_open = seal(merge_marks(*marks), (last or 0) - 7 * 86_400_000)
    got = percentiles(merge_runs(sealed, marked_runs(still_open)), QUANTILES)
    return got.withColumns({c: F.round(c, 6) for c in got.columns if c[0] == "p" and c[1].isdigit()})


def p6_found(spark, sf):
    return heavy_keys(table(spark, sf, "metric_bits"), COORDINATES, HEAVY).select(*COORDINATES)


def p6_per_coordinates(spark, sf):
    return per_key(table(spark, sf, "metric_bits"), COORDINATES).withColumn("total", F.round("total", 4))


QUERIES = {
    "p1_found": p1_found, "p1_rolling_totals": p1_rolling_totals,
    "p2_found": p2_found, "p2_current_bits": p2_current_bits,
    "p3_found": p3_found, "p3_regular_grid": p3_regular_grid,
    "p4_found": p4_found, "p4_judged_readings": p4_judged_readings, "p4_levels": p4_levels,
    "p5_percentiles_by_coordinates": _percentiles(*COORDINATES), "p5_percentiles_by_name": _percentiles("name"),
    "p5_percentiles_of_weeks": p5_percentiles_of_weeks,
    "p5_percentiles_by_age": _percentiles("age"), "p5_percentiles_by_height": _percentiles("height"),
    "p6_found": p6_found, "p6_per_coordinates": p6_per_coordinates,
}
