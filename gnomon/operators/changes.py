"""A change feed of inserts, updates, deletes, evictions and drops, folded into the current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import write_scratch

PERSIST, DELETE, EVICT, DROP_METRIC, DROP_NAMESPACE = (
    "PersistedEntryAction", "DeleteAction", "EvictShardAction", "DeleteMetricAction", "DeleteNamespaceAction",
)

#: A fold state: what is known of one key. ``kind`` bit: the latest persist or delete of a bit; shard, metric,
#: namespace: the latest removal of that scope. ``live`` is false for tombstones.
STATE = "kind string, db string, namespace string, metric string, bit_id bigint, lo bigint, hi bigint, ts bigint, entry_no int, live boolean, bit_timestamp bigint, bit_value double, bit_name string"


def _entries(feed: DataFrame) -> DataFrame:
    a = F.col("action")
    bit = a.isin(PERSIST, DELETE) & F.col("bit_id").isNotNull()
    kind = F.when(bit, "bit").when(a == EVICT, "shard").when(a == DROP_METRIC, "metric").when(a == DROP_NAMESPACE, "namespace")
    live, shard = a == PERSIST, a == EVICT

    def only(cond: Column, c: str, t: str) -> Column:
        return F.when(cond, F.col(c).cast(t)).alias({"location_from": "lo", "location_to": "hi"}.get(c, c))

    return feed.select(
        kind.alias("kind"),
        # a tombstone's own coordinates say nothing: the bit is known by its id
        only(~bit | live, "db", "string"), only(~bit | live, "namespace", "string"), only((~bit & (a != DROP_NAMESPACE)) | live, "metric", "string"),
        only(bit, "bit_id", "bigint"), only(shard, "location_from", "bigint"), only(shard, "location_to", "bigint"),
        F.col("ts").cast("bigint").alias("ts"), F.col("entry_no").cast("int").alias("entry_no"), (bit & live).alias("live"),
        only(live, "bit_timestamp", "bigint"), only(live, "bit_value", "double"), only(live, "bit_name", "string"),
    ).where("kind is not null")


def fold(entries: DataFrame) -> DataFrame:
    """The greatest (ts, entry_no) per key. Commutative, associative and idempotent: order and repetition don't matter.

    Equal sequences of one bit with different contents, which the feed should not hold, are decided
    by the rest of the struct: a persist over a delete, then the greater payload.
    """
    bits = entries.where("kind = 'bit'").groupBy("bit_id").agg(
        F.max(F.struct("ts", "entry_no", "live", "db", "namespace", "metric", "bit_timestamp", "bit_value", "bit_name")).alias("s")
    ).select(
        F.lit("bit").alias("kind"), "s.db", "s.namespace", "s.metric", "bit_id", F.lit(None).cast("bigint").alias("lo"), F.lit(None).cast("bigint").alias("hi"),
        "s.ts", "s.entry_no", "s.live", "s.bit_timestamp", "s.bit_value", "s.bit_name",
    )
    scopes = entries.where("kind <> 'bit'").groupBy("kind", "db", "namespace", "metric", "lo", "hi").agg(F.max(F.struct("ts", "entry_no")).alias("s")).select(
        "kind", "db", "namespace", "metric", F.lit(None).cast("bigint").alias("bit_id"), "lo", "hi", "s.ts", "s.entry_no", F.lit(False).alias("live"),
        F.lit(None).cast("bigint").alias("bit_timestamp"), F.lit(None).cast("double").alias("bit_value"), F.lit(None).cast("string").alias("bit_name"),
    )
    return bits.unionByName(scopes)


def fold_changes(feed: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Fold ``feed`` into a state (columns ``STATE``), tombstones retained, so that a later call with this
    state as ``base`` and changes that come late, again or out of order gives what one call over all would."""
    entries = _entries(feed)
    return fold(entries if base is None else entries.unionByName(base.select(*entries.columns)))


def _class(width: Column) -> Column:
    """The least level l with width <= 2**l: a range of that width meets at most two level-l buckets."""
    return F.when(width <= 1, F.lit(0)).otherwise(F.ceil(F.log2(width.cast("double"))).cast("int"))


#: Rows that all scopes together may be repeated to.
REPEATED = 8_000_000


def _salts(scopes: DataFrame) -> int:
    """As many as keep all cores busy with one scope's bits, 4 to 64, but no more than repeat the scopes to ``REPEATED`` rows."""
    return max(1, min(max(4, min(64, scopes.sparkSession.sparkContext.defaultParallelism)), REPEATED // max(1, scopes.count())))


def current_bits(state: DataFrame, salts: int | None = None) -> DataFrame:
    """The bits that exist in ``state``: live ones without a later removal of their shard range, metric or namespace.

    Removals are matched by equality joins. A shard range goes, by its width, to the one or two
    power-of-two buckets of time that it meets; a bit asks at the levels its metric has. Scope rows, ranges too, are repeated
    over ``salts`` (by default as many as the cluster has cores, 4 to 64, fewer where scopes are very many) and bits salted by id, so that a metric or an
    evicted range with most of the bits is spread over tasks; where scopes are few, the planner broadcasts them by its own size threshold instead. The folded scopes are
    written to the shared folder first, so the feed is read two times, not four, and their size is known.
    """
    seq = F.struct("ts", "entry_no")
    scopes = write_scratch(state.where("kind <> 'bit'"), "scopes")  # read three times below, folded once
    salts = _salts(scopes) if salts is None else salts
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    spaces = scopes.where("kind = 'namespace'").groupBy("db", "namespace").agg(F.max(seq).alias("_space")).select("*", salt)
    level = _class(F.col("hi") - F.col("lo"))
    shards = scopes.where("kind = 'shard' and lo < hi").withColumn("_level", level)
    metrics = scopes.where("kind = 'metric'").select("db", "namespace", "metric", seq.alias("_drop"), F.lit(None).cast("int").alias("_level")).unionByName(
        shards.select("db", "namespace", "metric", F.lit(None).cast("struct<ts:bigint,entry_no:int>").alias("_drop"), "_level")
    ).groupBy("db", "namespace", "metric").agg(F.max("_drop").alias("_drop"), F.collect_set("_level").alias("_levels")).select("*", salt)

    def bucket(x: Column) -> Column:
        return F.call_function("shiftright", x, F.col("_level"))

    ranges = shards.select(
        "db", "namespace", "metric", "_level", "lo", "hi", seq.alias("_evict"),
        F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi") - 1))).alias("_bucket"),
    ).select("*", salt)
    bits = state.where("kind = 'bit' and live").select("bit_id", "db", "namespace", "metric", "ts", "entry_no", "bit_timestamp", "bit_value", "bit_name", seq.alias("_seq"), F.pmod(F.hash("bit_id"), F.lit(salts)).alias("_salt"))

    def match(keys: list[str]) -> list[Column]:
        return [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]

    kept = bits.alias("a").join(spaces.alias("b"), match(["db", "namespace", "_salt"]), "left").select("a.*", "b._space")
    kept = kept.alias("a").join(metrics.alias("b"), match(["db", "namespace", "metric", "_salt"]), "left").select("a.*", "b._drop", "b._levels")
    gone = F.greatest("_space", "_drop")
    kept = kept.where(gone.isNull() | (F.col("_seq") > gone))
    asked = kept.select("*", F.explode_outer("_levels").alias("_level")).withColumn("_bucket", bucket(F.col("bit_timestamp")))
    hit = (F.col("b.lo") <= F.col("a.bit_timestamp")) & (F.col("a.bit_timestamp") < F.col("b.hi")) & (F.col("b._evict") > F.col("a._seq"))
    on = F.col("a._level").eqNullSafe(F.col("b._level")) & (F.col("a._bucket") == F.col("b._bucket")) & (F.col("a._salt") == F.col("b._salt")) & hit
    for c in match(["db", "namespace", "metric"]):
        on = on & c
    judged = asked.alias("a").join(ranges.alias("b"), on, "left").select("a.*", F.col("b._evict").isNotNull().alias("_evicted"))
    payload = ["db", "namespace", "metric", "ts", "entry_no", "bit_timestamp", "bit_value", "bit_name"]
    return (
        judged.groupBy("bit_id").agg(F.max("_evicted").alias("_e"), F.first(F.struct(*payload)).alias("s")).where("not _e").select("bit_id", "s.*")
    )


def apply_changes(feed: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """The bits that exist after all entries of a commit log, with their latest values.

    ``feed`` has db, namespace, metric, ts, entry_no, action, bit_id, bit_timestamp, bit_value, bit_name, location_from,
    location_to, in any order and with copies. Entries apply by (ts, entry_no); the persist that
    comes last decides a bit's values, and a removal counts if it comes after that persist.

    Nulls: a persist or delete without ``bit_id`` names no bit and is ignored; null ``ts`` or ``entry_no`` sorts
    first; a bit with a null ``bit_timestamp`` lies in no shard; null coordinates are equal to each other;
    an eviction without bounds evicts nothing. Unknown actions change no state. Extra columns
    are ignored. An empty feed gives ``base``'s bits, or none.
    """
    return current_bits(fold_changes(feed, base))
