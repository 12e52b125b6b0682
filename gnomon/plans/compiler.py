"""Selects to DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import average, like_pattern, literal
from ..sources.metric import Metric
from . import ast as A
from .analyzer import check
from .timerange import HIGH, LOW, Spine, resolve, spans, spines


def predicate(e: A.Expr, m: Metric, now_ms: int, negated: bool = False) -> Column:
    """``e`` as a filter. Logic has two values: what is null holds for no operator, so it does for their negation.

    Without a NOT above, null and false filter alike, and the bare operators reach the scan; only below a NOT
    are they made two-valued.
    """
    if isinstance(e, A.Not):
        return ~predicate(e.of, m, now_ms, True)
    if isinstance(e, A.And):
        return predicate(e.left, m, now_ms, negated) & predicate(e.right, m, now_ms, negated)
    if isinstance(e, A.Or):
        return predicate(e.left, m, now_ms, negated) | predicate(e.right, m, now_ms, negated)
    f = m.fields[e.field]
    c = F.col(f"`{f.name}`")

    def lit(term: A.Term) -> Column:
        return F.lit(literal(resolve(term, now_ms), f.type, f.name)).cast(f.type)

    match e:
        case A.IsNull():
            return c.isNull()
        case A.Like(_, pattern):
            out = c.like(like_pattern(pattern))
        case A.Between(_, low, high):
            out = c.between(lit(low), lit(high))
        case A.Compare(_, op, term):
            v = lit(term)
            out = {"=": c == v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[op]
    return F.coalesce(out, F.lit(False)) if negated else out


def scan(m: Metric, where: A.Expr | None, now_ms: int, since_ms: int | None = None) -> DataFrame:
    """The metric's rows that meet the condition, from the shards that can hold such rows."""
    times = spans(where, now_ms)
    if since_ms is not None:
        times = [(max(lo, now_ms - since_ms), hi) for lo, hi in (times if times is not None else [(LOW, HIGH)])]
    df = m.rows() if times is None or m.within is None else m.within(times)
    if m.partition is not None and times is not None:
        p = F.col(m.partition)
        within = F.lit(False)
        for lo, hi in times:
            within = within | ((p > lo - m.shard_ms if lo > LOW + m.shard_ms else F.lit(True)) & (p <= hi))
        df = df.where(within)
    if since_ms is not None:
        df = df.where(F.col("timestamp") >= now_ms - since_ms)
    return df if where is None else df.where(predicate(where, m, now_ms))


def _sorted(df: DataFrame, column: str, descending: bool) -> DataFrame:
    c = F.col(f"`{column}`")
    return df.orderBy(c.desc_nulls_first() if descending else c.asc_nulls_last())


def _limited(df: DataFrame, n: int | None) -> DataFrame:
    return df if n is None else df.limit(n)


def _label(i: A.Item) -> str:
    return "count(distinct *)" if i.distinct else f"{i.agg}(*)"


def _aggregate(i: A.Item, m: Metric, limit: int | None = None) -> Column:
    """A global or per-bucket aggregate; empty input: 0 for counts, sums and averages, null for the others."""
    f = F.col(f"`{i.field}`")
    zero = F.lit(0).cast(m.fields["value"].type)
    if i.agg == "count":
        if i.distinct:
            return F.nullif(F.count_distinct(f), F.lit(0))
        return F.count("*") if limit is None else F.least(F.count("*"), F.lit(limit).cast("bigint"))
    match i.agg:
        case "sum":
            return F.coalesce(F.sum(f), zero)
        case "avg":
            return F.coalesce(average(F.sum(f), F.nullif(F.count(f), F.lit(0))), F.lit(0.0))
        case "min":
            return F.min(f)
        case "max":
            return F.max(f)
    raise AssertionError(i.agg)


def _plain(s: A.Select, m: Metric, df: DataFrame) -> DataFrame:
    if s.order is not None:
        df = _sorted(df, "value" if s.order.field == "*" else s.order.field, s.order.descending)
    names = [*m.dimensions, *m.tags] if s.items is None else [i.field for i in s.items]
    names = dict.fromkeys(["timestamp", "value", *names])
    return _limited(df, s.limit).select(*[F.col(f"`{n}`") for n in names])


def _distinct(s: A.Select, m: Metric, df: DataFrame) -> DataFrame:
    f = s.items[0].field
    out = df.where(F.col(f"`{f}`").isNotNull()).select(F.col(f"`{f}`")).distinct()
    if s.order is not None:
        out = _sorted(out, f, s.order.descending)
    zero = [] if f in ("timestamp", "value") else [F.lit(0).cast("bigint").alias("timestamp"), F.lit(0).cast(m.fields["value"].type).alias("value")]
    return _limited(out, s.limit).select(*zero, f"`{f}`")


def _global(s: A.Select, m: Metric, df: DataFrame) -> DataFrame:
    aggs = {_label(i): _aggregate(i, m, s.limit) for i in s.items if i.agg}
    fields = [i for i in s.items if not i.agg]
    one = df.agg(*[c.alias(n) for n, c in aggs.items()])
    if fields:
        rows = _plain(A.Select(s.metric, tuple(fields), order=s.order, limit=s.limit), m, df)
        return rows.crossJoin(F.broadcast(one))  # one row
    return one.select(F.lit(0).cast("bigint").alias("timestamp"), F.lit(0).cast(m.fields["value"].type).alias("value"), *[F.col(f"`{n}`") for n in aggs])


def _by_tag(s: A.Select, m: Metric, df: DataFrame) -> DataFrame:
    i, key = s.items[0], s.group
    groups = df.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`"))
    point = F.struct("timestamp", "value")
    if i.agg in ("first", "last"):
        got = groups.agg((F.min(point) if i.agg == "first" else F.max(point)).alias("_p"))
        out = got.select(F.col("_p.timestamp").alias("timestamp"), F.col("_p.value").alias("value"), f"`{key}`")
    else:
        f = F.col(f"`{i.field}`")
        value = F.count_distinct(f) if i.distinct else {"count": F.count("*"), "sum": F.sum(f), "min": F.min(f), "max": F.max(f), "avg": average(F.sum(f), F.nullif(F.count(f), F.lit(0)))}[i.agg]
        out = groups.agg(value.alias("_v")).select(F.lit(0).cast("bigint").alias("timestamp"), F.col("_v").alias("value"), f"`{key}`")
    if s.order is not None:
        out = _sorted(out, "value" if s.order.field == "*" else s.order.field, s.order.descending)
    return _limited(out, s.limit)


def _bucket(spine: Spine) -> Column:
    """The bucket of a row within the spine's bounds, in closed form."""
    k = F.call_function("div", F.lit(spine.upper).cast("bigint") - F.col("timestamp"), F.lit(spine.ms).cast("bigint"))
    return F.least(k, F.lit(spine.n - 1).cast("bigint"))


def _temporal(s: A.Select, m: Metric, df: DataFrame, now_ms: int) -> DataFrame:
    i = s.items[0]
    since = None if s.since_ms is None else now_ms - s.since_ms
    all_ = spines(m.shards(), spans(s.where, now_ms), s.group.ms, since)
    spark = df.sparkSession
    integral = i.agg == "count"
    kind: T.DataType = T.LongType() if integral else T.DoubleType() if i.agg == "avg" else m.fields["value"].type
    if not all_:
        schema = T.StructType([T.StructField("timestamp", T.LongType()), T.StructField("value", kind), T.StructField("lowerBound", T.LongType()), T.StructField("upperBound", T.LongType())])
        return spark.createDataFrame([], schema)

    def each(of) -> Column:
        """What ``of`` gives for the spine that ``_i`` names."""
        out = of(all_[0])
        for n, p in enumerate(all_[1:], 1):
            out = F.when(F.col("_i") == n, of(p)).otherwise(out)
        return out

    # spans don't overlap, so a row has one spine at most, and one pass serves them all
    inside = [(F.col("timestamp") >= p.lower) & (F.col("timestamp") <= p.upper) for p in all_]
    some, which = inside[0], F.lit(0)
    for n, cond in enumerate(inside[1:], 1):
        some, which = some | cond, F.when(cond, n).otherwise(which)
    got = df.where(some).withColumn("_i", which).groupBy("_i", each(_bucket).alias("_k")).agg(_aggregate(i, m).cast(kind).alias("_v"))
    if i.distinct:
        part = got.where(F.col("_v") > 0)
    else:
        spine = None
        for n, p in enumerate(all_):
            for a, b in p.keep:
                run = spark.range(a, b + 1).select(F.lit(n).alias("_i"), F.col("id").alias("_k"))
                spine = run if spine is None else spine.unionByName(run)
        part = spine.join(got, ["_i", "_k"], "left").withColumn("_v", F.coalesce("_v", F.lit(0).cast(kind)))
    ub = each(lambda p: F.lit(p.upper).cast("bigint") - F.col("_k") * p.ms)
    out = part.select(ub.alias("timestamp"), F.col("_v").alias("value"), F.greatest(ub - s.group.ms, each(lambda p: F.lit(p.lower).cast("bigint"))).alias("lowerBound"), ub.alias("upperBound"))
    if i.agg != "count" or i.distinct:  # the future is only counted
        out = out.where(F.col("lowerBound") < now_ms)
    descending = s.order is not None and s.order.field == "timestamp" and s.order.descending
    if s.limit is not None:  # the last ones of the order asked for
        out = _sorted(out, "timestamp", not descending).limit(s.limit)
    return _sorted(out, "timestamp", descending)


def compile_select(s: A.Select, m: Metric, now_ms: int) -> DataFrame:
    """The DataFrame of a select, after all checks. The shape of the statement decides its plan:

    - plain: timestamp, value and the selected fields;
    - distinct: timestamp and value 0, the field; nulls dropped;
    - global aggregates: timestamp and value 0, one column ``agg(*)`` each; with fields, their rows beside them;
    - by tag: timestamp 0 (first, last: the record's), value the aggregate, the tag; null tags dropped;
    - by interval: timestamp the bucket's upper bound, value, lowerBound, upperBound.
    """
    check(s, m, now_ms)
    df = scan(m, s.where, now_ms, s.since_ms)
    if isinstance(s.group, A.Interval):
        return _temporal(s, m, df, now_ms)
    if s.group is not None:
        return _by_tag(s, m, df)
    if s.items and any(i.agg for i in s.items):
        return _global(s, m, df)
    return _distinct(s, m, df) if s.distinct else _plain(s, m, df)
