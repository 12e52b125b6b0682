"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .contamination import find_leaks, remove_leaks
from .mixing import mix_sources, short_sources
from .mojibake import character_statistics, find_garbled


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p7_found(spark, sf):
    return find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id").distinct()


def p7_leaked_spans(spark, sf):
    return find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p7_without_leaks(spark, sf):
    return remove_leaks(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "eval_items"))


def p7_cleaned(spark, sf):
    """How many documents and items share a leak before and after the cut."""
    docs, items = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "eval_items")

    def pairs(df, name):
        return find_leaks(df, items).select("doc_id", "item_id").distinct().agg(F.count("*").alias(name))

    return pairs(docs, "pairs_before").crossJoin(F.broadcast(pairs(remove_leaks(docs, items), "pairs_after")))  # one row each


def _mix(spark, sf, **how):
    return mix_sources(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), **how)


def p8_found(spark, sf):
    return short_sources(_mix(spark, sf, total="corpus"))


def p8_mix_report(spark, sf):
    return _mix(spark, sf).plan


def p8_targets_met(spark, sf):
    """Whether every source reaches its share within a hundredth, and no document is used more than its source allows."""
    mix = _mix(spark, sf)
    most = mix.documents.groupBy("source").agg(F.max("copies").alias("most"))
    told = mix.plan.join(most, "source", "left")
    return told.select(
        "source", "target_weight", F.col("max_repeats").cast("int").alias("max_repeats"), "n_docs",
        (F.abs(F.col("share") - F.col("target_weight")) <= 0.01).alias("share_met"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("repeats_kept"),
    )


def p8_mix(spark, sf):
    return _mix(spark, sf).documents.select("doc_id", "source", "tokens", "rate", "copies")


def p8_mix_by_text_alone(spark, sf):
    """Domains by the classifier only: what the fit does where no source is recorded."""
    return _mix(spark, sf, label_trust=0.0, total="corpus").plan.select("source", "target_weight", "target_tokens", "domain_tokens", F.round("expected_tokens", 3).alias("expected_tokens"))


def p9_found(spark, sf):
    return find_garbled(table(spark, sf, "documents")).select("doc_id")


def p9_restored(spark, sf):
    return find_garbled(table(spark, sf, "documents"))


def p9_round_trip(spark, sf):
    """The passages of the test items, clean texts, read wrongly by us, found and restored by the documents' statistics."""
    items = table(spark, sf, "eval_items")
    misread = F.decode(F.encode("passage", "UTF-8"), "ISO-8859-1")
    model = character_statistics(table(spark, sf, "documents"))
    return find_garbled(items.select("item_id", misread.alias("text")), "item_id", model=model).select(F.col("doc_id").alias("item_id"), "restored", "whole")


QUERIES = {
    "p7_found": p7_found, "p7_leaked_spans": p7_leaked_spans, "p7_without_leaks": p7_without_leaks,
    "p8_found": p8_found, "p8_mix_report": p8_mix_report, "p8_targets_met": p8_targets_met, "p8_mix": p8_mix, "p8_mix_by_text_alone": p8_mix_by_text_alone,
    "p7_cleaned": p7_cleaned, "p9_round_trip": p9_round_trip,
    "p9_found": p9_found, "p9_restored": p9_restored,
}
#: Words by a plainer rule (no compatibility forms, texts with doubtful tags read one way), seeds by a join, then every alignment judged word by word.
_LEAKS = r"""WITH texts AS (
  SELECT doc_id AS id, 'doc' AS field, text FROM documents WHERE text IS NOT NULL
), items AS (
  SELECT item_id AS id, 'passage' AS field, passage AS text FROM eval_items WHERE item_id IS NOT NULL UNION ALL SELECT item_id, 'question', question FROM eval_items WHERE item_id IS NOT NULL
),
w AS (
  SELECT src, id, field, regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(text, '</?[A-Za-z][^<>]*>|\]\([^()\s]*\)', ' ', 'g'), '&(amp|lt|gt|quot|nbsp|#39);', ' ', 'g'), '[\x{00AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}]', '', 'g')), '[\p{L}\p{N}\p{M}]+') AS w
  FROM (SELECT 'd' AS src, * FROM texts UNION ALL SELECT 'i', * FROM items)
),
d AS (SELECT id, w FROM w WHERE src = 'd' AND len(w) >= 12), i AS (SELECT id, field, w FROM w WHERE src = 'i' AND len(w) >= 12),
ds AS (SELECT id, unnest(range(1, len(w) - 4)) AS p, w FROM d), dk AS (SELECT id, p, hash(w[p : p + 5]) AS k FROM ds),
ik AS (SELECT id, field, p, hash(w[p : p + 5]) AS k FROM (SELECT id, field, unnest(range(1, len(w) - 4)) AS p, w FROM i)),
shifts AS (SELECT DISTINCT dk.id AS doc_id, ik.id AS item_id, ik.field, dk.p - ik.p AS shift FROM dk JOIN ik USING (k)),
a AS (
  SELECT doc_id, item_id, shifts.field, shift, d.w AS dw, i.w AS iw, greatest(1, 1 - shift) AS lo, least(len(i.w), len(d.w) - shift) AS hi
  FROM shifts JOIN d ON d.id = doc_id JOIN i ON i.id = item_id AND i.field = shifts.field
),
e AS (SELECT doc_id, item_id, field, shift, unnest(range(lo, hi + 1)) AS p, dw, iw FROM a),
q AS (SELECT doc_id, item_id, field, shift, p, dw[p + shift] = iw[p] AS same FROM e),
s AS (
  SELECT *, sum(CASE WHEN same THEN 1 ELSE -7 END) OVER o AS s, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER o AS gaps FROM q
  WINDOW o AS (PARTITION BY doc_id, item_id, field, shift ORDER BY p ROWS UNBOUNDED PRECEDING)
),
exact AS (SELECT DISTINCT doc_id, item_id FROM s WHERE same GROUP BY doc_id, item_id, field, shift, gaps HAVING count(*) >= 12),
sums AS (SELECT doc_id, item_id, field, shift, p, s FROM s UNION ALL SELECT doc_id, item_id, field, shift, min(p) - 1, 0 FROM s GROUP BY ALL),
loose AS (
  SELECT DISTINCT doc_id, item_id FROM (
    SELECT *, min(s) OVER (PARTITION BY doc_id, item_id, field, shift ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND 30 PRECEDING) AS low FROM sums
  ) WHERE low <= s
)
SELECT doc_id, item_id FROM exact UNION SELECT doc_id, item_id FROM loose"""

ORACLES: dict[str, str] = {
    "p7_found": _LEAKS,
    "p7_cleaned": f"SELECT count(*) AS pairs_before, CAST(0 AS BIGINT) AS pairs_after FROM ({_LEAKS})",
    "p9_round_trip": r"SELECT item_id, passage AS restored, true AS whole FROM eval_items WHERE regexp_matches(passage, '[^\x00-\x7F]')",
    "p8_targets_met": "SELECT t.source, t.target_weight, t.max_repeats, count(d.doc_id) AS n_docs, true AS share_met, true AS repeats_kept FROM mix_targets t LEFT JOIN documents d ON d.source = t.source GROUP BY ALL",
    # any common token count gives the same list; SQL has characters
    "p8_found": """WITH size AS (SELECT source, sum(n_chars) AS n FROM documents GROUP BY source)
SELECT t.source FROM mix_targets t LEFT JOIN size s ON s.source = t.source
WHERE coalesce(s.n, 0) * t.max_repeats < t.target_weight * (SELECT sum(n_chars) FROM documents)""",
}
