"""DuckDB SQL for the data-processing queries, over whole tables.

p4_found's fences are from exact quantiles here and from sketches there, with other random numbers to spread coarse readings: the
same readings lie outside as long as none is within a few percent of its fence. p4_levels has what doesn't depend on that.
"""

from __future__ import annotations

_P1 = """
WITH b AS (SELECT DISTINCT timestamp, value, surname, name, age, height FROM aggregation_long_metric WHERE name IS NOT NULL AND timestamp IS NOT NULL),
daily AS (SELECT name, CAST(floor(timestamp / 86400000.0) AS BIGINT) AS d, coalesce(sum(value), 0) AS a, count(*) AS n, count(value) AS k FROM b GROUP BY ALL),
days AS (SELECT name, unnest(range(min(d), max(d) + 1)) AS d FROM daily GROUP BY name),
t AS (
  SELECT days.name, days.d, coalesce(n, 0) AS bits,
    sum(coalesce(a, 0)) OVER w7 AS total_7, sum(coalesce(n, 0)) OVER w7 AS bits_7, sum(coalesce(k, 0)) OVER w7 AS k_7,
    sum(coalesce(a, 0)) OVER w30 AS total_30, sum(coalesce(n, 0)) OVER w30 AS bits_30, sum(coalesce(k, 0)) OVER w30 AS k_30
  FROM days LEFT JOIN daily ON daily.name = days.name AND daily.d = days.d
  WINDOW w7 AS (PARTITION BY days.name ORDER BY days.d RANGE BETWEEN 6 PRECEDING AND CURRENT ROW),
         w30 AS (PARTITION BY days.name ORDER BY days.d RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)
)
"""

_P2 = """
WITH last AS (
  SELECT bit_id, max(struct_pack(a := ts, b := entry_no, c := action = 'PersistedEntryAction')) AS s FROM commit_log
  WHERE action IN ('PersistedEntryAction', 'DeleteAction') AND bit_id IS NOT NULL GROUP BY bit_id
),
p AS (
  SELECT DISTINCT l.bit_id, c.db, c.namespace, c.metric, c.ts, c.entry_no, c.bit_timestamp, c.bit_value, c.bit_name
  FROM last l JOIN commit_log c ON c.bit_id = l.bit_id AND c.ts = l.s.a AND c.entry_no = l.s.b AND c.action = 'PersistedEntryAction' WHERE l.s.c
),
alive AS (
  SELECT * FROM p
  WHERE NOT EXISTS (SELECT 1 FROM commit_log e WHERE e.action = 'DeleteNamespaceAction' AND e.db = p.db AND e.namespace = p.namespace AND (e.ts > p.ts OR e.ts = p.ts AND e.entry_no > p.entry_no))
    AND NOT EXISTS (SELECT 1 FROM commit_log e WHERE e.action = 'DeleteMetricAction' AND e.db = p.db AND e.namespace = p.namespace AND e.metric = p.metric AND (e.ts > p.ts OR e.ts = p.ts AND e.entry_no > p.entry_no))
    AND NOT EXISTS (SELECT 1 FROM commit_log e WHERE e.action = 'EvictShardAction' AND e.db = p.db AND e.namespace = p.namespace AND e.metric = p.metric
                    AND e.location_from <= p.bit_timestamp AND p.bit_timestamp < e.location_to AND (e.ts > p.ts OR e.ts = p.ts AND e.entry_no > p.entry_no))
)
"""

_P3 = """
WITH r AS (
  SELECT q.query_id, q.db, q.namespace, q.metric, q.interval_ms AS w, q.upper_ms AS u, t.name, t.timestamp AS ts, t.value, (q.upper_ms - t.timestamp) // q.interval_ms AS k
  FROM temporal_double_metric t JOIN temporal_queries q USING (db, namespace, metric)
  WHERE t.value IS NOT NULL AND t.name IS NOT NULL AND t.timestamp <= q.upper_ms
),
per AS (SELECT query_id, db, namespace, metric, w, u, name, k, min(struct_pack(t := ts, v := value)) AS f, max(struct_pack(t := ts, v := value)) AS l FROM r GROUP BY ALL),
nxt AS (SELECT *, lead(k) OVER o AS nk, lead(f) OVER o AS nf FROM per WINDOW o AS (PARTITION BY query_id, db, namespace, metric, name ORDER BY k DESC)),
g AS (SELECT *, unnest(range(coalesce(nk + 1, k), k + 1)) AS p FROM nxt),
v AS (SELECT *, u - p * w AS ub, (nf.t - l.t) <= 5 * w AS near FROM g)
"""

_P4 = """
WITH r AS (
  SELECT db, namespace, metric, name, timestamp AS t, value AS v, coalesce(value < value_low, false) OR coalesce(value > value_high, false) AS bad
  FROM (SELECT DISTINCT db, namespace, metric, name, timestamp, value FROM double_metric WHERE value IS NOT NULL AND timestamp IS NOT NULL AND name IS NOT NULL)
  LEFT JOIN metric_info USING (db, namespace, metric)
),
c AS (SELECT *, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS fresh FROM r WINDOW w AS (PARTITION BY db, namespace, metric, name ORDER BY t, v)),
d AS (SELECT *, sum(fresh) OVER (PARTITION BY db, namespace, metric, name ORDER BY t, v ROWS UNBOUNDED PRECEDING) AS run FROM c),
e AS (SELECT *, count(*) OVER (PARTITION BY db, namespace, metric, name, run) AS len FROM d),
runs AS (SELECT db, namespace, metric, name, v, count(*) AS n, min(t) // 3600000 AS h FROM e WHERE NOT bad AND len > 5 GROUP BY db, namespace, metric, name, run, v),
longest AS (SELECT db, namespace, metric, name, max(struct_pack(n := n, v := v)) AS x FROM runs GROUP BY db, namespace, metric, name, h),
tops AS (SELECT db, namespace, metric, name, max(n) AS top FROM (SELECT db, namespace, metric, name, x.v AS v, sum(x.n) AS n FROM longest GROUP BY ALL) GROUP BY ALL),
s AS (
  SELECT db, namespace, metric, name, count(*) FILTER (NOT bad) AS n, count(*) FILTER (NOT bad AND len > 5) AS held, coalesce(max(len) FILTER (len < 12), 0) > 5 AS other,
    list(v ORDER BY t, v) FILTER (NOT bad AND len < 12) AS usable
  FROM e GROUP BY ALL
),
q AS (
  SELECT e.*, other, usable, held - coalesce(top, 0) > 0.5 * (n - coalesce(top, 0)) OR coalesce(top, 0) >= n AS levels,
    CASE WHEN NOT bad AND len < 12 THEN row_number() OVER (PARTITION BY db, namespace, metric, name, NOT bad AND len < 12 ORDER BY t, v) END AS i
  FROM e JOIN s USING (db, namespace, metric, name) LEFT JOIN tops USING (db, namespace, metric, name)
),
w AS (SELECT *, list_sort(usable[greatest(least(i - 9, len(usable) - 17), 0) + 1 : greatest(least(i - 9, len(usable) - 17), 0) + 17]) AS near FROM q)
"""

_P4_SPIKES = """,
x AS (
  SELECT db, namespace, metric, name, t, v, i, levels, t // 3600000 AS h, v - base AS res,
    v - base + coalesce(list_min(list_filter(list_transform(range(1, len(near)), lambda j: near[j + 1] - near[j]), lambda y: y > 0)), 0) * (hash(t, v) / 18446744073709551616.0 - 0.5) AS spread
  FROM (SELECT *, CASE WHEN len(near) >= 5 THEN (near[len(near) // 2 + 1] + near[(len(near) - 1) // 2 + 1]) / 2 END AS base FROM w WHERE i IS NOT NULL)
),
whole AS (
  SELECT db, namespace, metric, name, CASE WHEN count(spread) >= 5 THEN greatest(quantile_disc(spread, 0.75) - quantile_disc(spread, 0.25), (quantile_disc(spread, 0.95) - quantile_disc(spread, 0.05)) / 3.3) END AS scatter
  FROM x GROUP BY ALL
),
around AS (SELECT db, namespace, metric, name, h + unnest([-1, 0, 1]) AS h, spread FROM x WHERE spread IS NOT NULL),
local AS (SELECT db, namespace, metric, name, h, quantile_disc(spread, 0.75) - quantile_disc(spread, 0.25) AS iqr FROM around GROUP BY db, namespace, metric, name, h HAVING count(*) >= 48),
f AS (
  SELECT x.*, 7.3 * CASE WHEN iqr IS NOT NULL THEN greatest(iqr, scatter / 2) ELSE scatter END AS fence
  FROM x JOIN whole USING (db, namespace, metric, name) LEFT JOIN local USING (db, namespace, metric, name, h)
),
o AS (SELECT *, coalesce(abs(res) > fence, false) AS far, coalesce(abs(res) <= 0.7 * fence, false) AS calm FROM f),
u AS (SELECT *, lag(far) OVER (PARTITION BY db, namespace, metric, name ORDER BY i) AS before FROM o),
k AS (SELECT *, sum(CASE WHEN far = before THEN 0 ELSE 1 END) OVER (PARTITION BY db, namespace, metric, name ORDER BY i ROWS UNBOUNDED PRECEDING) AS stretch FROM u),
g AS (SELECT db, namespace, metric, name, stretch, min(i) - 1 AS a, max(i) + 1 AS b FROM k WHERE far AND NOT levels GROUP BY db, namespace, metric, name, stretch HAVING count(*) <= 3),
spikes AS (
  SELECT k.name, k.t FROM g JOIN k USING (db, namespace, metric, name, stretch)
  JOIN o l ON l.db = g.db AND l.namespace = g.namespace AND l.metric = g.metric AND l.name = g.name AND l.i = g.a AND l.calm
  JOIN o r ON r.db = g.db AND r.namespace = g.namespace AND r.metric = g.metric AND r.name = g.name AND r.i = g.b AND r.calm
)
SELECT name, t AS timestamp FROM w WHERE bad OR (len >= 12 AND NOT levels AND NOT other) UNION SELECT name, t FROM spikes
"""

_COORDINATES = "db, namespace, metric"


def _percentiles(keys: str) -> str:
    qs = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    cols = ", ".join(f"round(quantile_cont(value, {q}), 6) AS {c}" for c, q in qs.items())
    given = " AND ".join(f"{k.strip()} IS NOT NULL" for k in keys.split(","))
    return f"""WITH b AS (SELECT DISTINCT db, namespace, metric, timestamp, value, surname, name, age, height FROM metric_bits)
SELECT {keys}, count(*) AS n, {cols} FROM b WHERE value IS NOT NULL AND {given} GROUP BY {keys}"""


ORACLES = {
    "p1_found": _P1 + "SELECT name, strftime(DATE '1970-01-01' + CAST(d AS INT), '%Y-%m-%d') AS day_utc FROM t WHERE bits = 0 AND total_7 > 0 AND 2 * total_7 > total_30",
    "p1_rolling_totals": _P1
    + """SELECT name, strftime(DATE '1970-01-01' + CAST(d AS INT), '%Y-%m-%d') AS day_utc, CAST(bits AS BIGINT) AS bits,
  CAST(total_7 AS BIGINT) AS total_7, CAST(bits_7 AS BIGINT) AS bits_7, CAST(total_7 AS DOUBLE) / 7 AS avg_day_7, CASE WHEN k_7 > 0 THEN CAST(total_7 AS DOUBLE) / k_7 END AS avg_bit_7,
  CAST(total_30 AS BIGINT) AS total_30, CAST(bits_30 AS BIGINT) AS bits_30, CAST(total_30 AS DOUBLE) / 30 AS avg_day_30, CASE WHEN k_30 > 0 THEN CAST(total_30 AS DOUBLE) / k_30 END AS avg_bit_30
FROM t""",
    "p2_found": _P2 + "SELECT bit_id, ts, entry_no FROM alive",
    "p2_current_bits": _P2 + "SELECT bit_id, db, namespace, metric, ts, entry_no, bit_timestamp, bit_value, bit_name FROM alive",
    "p3_found": _P3 + "SELECT name, ub AS upper_bound FROM v WHERE p <> k",
    "p3_regular_grid": _P3
    + """SELECT query_id, db, namespace, metric, name, ub AS upper_bound,
  round(CASE WHEN l.t = ub THEN l.v WHEN near THEN l.v + (nf.v - l.v) * (CAST(ub - l.t AS DOUBLE) / CAST(nf.t - l.t AS DOUBLE)) WHEN p = k THEN l.v END, 6) AS value,
  CASE WHEN p = k THEN 'observed' WHEN near THEN 'interpolated' ELSE 'missing' END AS status
FROM v""",
    "p4_found": _P4.rstrip() + _P4_SPIKES,
    "p4_levels": _P4 + """SELECT db, namespace, metric, name, t AS timestamp, v AS value, bad AS impossible, len >= 12 AND NOT levels AND NOT other AS stuck,
  round(CASE WHEN i IS NOT NULL AND len(near) >= 5 THEN (near[len(near) // 2 + 1] + near[(len(near) - 1) // 2 + 1]) / 2 END, 6) AS baseline FROM w""",
    "p5_percentiles_by_coordinates": _percentiles(_COORDINATES),
    "p5_percentiles_of_weeks": _percentiles(_COORDINATES),
    "p5_percentiles_by_name": _percentiles("name"),
    "p5_percentiles_by_age": _percentiles("age"),
    "p5_percentiles_by_height": _percentiles("height"),
    "p6_found": "SELECT db, namespace, metric FROM metric_bits GROUP BY ALL HAVING count(*) >= 0.05 * (SELECT count(*) FROM metric_bits)",
    "p6_per_coordinates": """WITH b AS (SELECT db, namespace, metric, timestamp, value, surname, name, age, height, count(*) AS c FROM metric_bits GROUP BY ALL),
g AS (
  SELECT db, namespace, metric, CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_bits, coalesce(sum(value), 0) AS total, count(value) AS n_values, count(DISTINCT name) AS n_names,
    max(struct_pack(t := timestamp, v := coalesce(value, '-infinity'::DOUBLE))) AS last
  FROM b GROUP BY ALL
)
SELECT db, namespace, metric, n_rows, n_bits, round(total, 4) AS total, n_values, n_names, last.t AS last_timestamp, nullif(last.v, '-infinity'::DOUBLE) AS last_value,
  n_rows >= 0.05 * (SELECT count(*) FROM metric_bits) AS heavy FROM g""",
}
