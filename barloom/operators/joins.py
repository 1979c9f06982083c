"""Joins between timeframes: exact, as-of, membership and bucket audits, as SQL over the base tables."""

from __future__ import annotations

from barloom.operators.indicators import before, last, over

SQL: dict[str, str] = {}
SQL["signal_to_entry_bar"] = """
SELECT a.symbol, a.i, a.close_ms + 1 AS signal_ms, b.o AS entry_open, b.i AS entry_i FROM {bars_4h} a LEFT JOIN {bars_5m} b ON b.symbol = a.symbol AND b.open_ms = a.close_ms + 1"""
SQL["alignment_4h_from_1h"] = """
WITH g AS (SELECT symbol, CAST(floor(open_ms / 14400000) * 14400000 AS BIGINT) AS bucket, count(*) AS members, min_by(o, i) AS o, max(h) AS h, min(l) AS l, max_by(c, i) AS c, CAST(sum(v) AS BIGINT) AS v FROM {bars_1h} GROUP BY symbol, CAST(floor(open_ms / 14400000) * 14400000 AS BIGINT))
SELECT coalesce(a.symbol, g.symbol) AS symbol, count(*) AS buckets, count(*) FILTER (WHERE a.symbol IS NULL) AS lower_only, count(*) FILTER (WHERE g.symbol IS NULL) AS upper_only, count(*) FILTER (WHERE g.members < 4) AS incomplete,
  count(*) FILTER (WHERE a.o <> g.o) AS open_differs, count(*) FILTER (WHERE a.h <> g.h) AS high_differs, count(*) FILTER (WHERE a.l <> g.l) AS low_differs, count(*) FILTER (WHERE a.c <> g.c) AS close_differs, count(*) FILTER (WHERE a.v <> g.v) AS volume_differs
FROM {bars_4h} a FULL OUTER JOIN g ON g.symbol = a.symbol AND g.bucket = a.open_ms GROUP BY coalesce(a.symbol, g.symbol)"""
SQL["bucket_membership"] = """
WITH m AS (SELECT symbol, CAST(floor(open_ms / 900000) AS BIGINT) AS b, count(*) AS members FROM {bars_5m} GROUP BY symbol, CAST(floor(open_ms / 900000) AS BIGINT)),
u AS (SELECT symbol, CAST(floor(open_ms / 900000) AS BIGINT) AS b FROM {bars_15m})
SELECT coalesce(u.symbol, m.symbol) AS symbol, CASE WHEN u.b IS NULL THEN 'orphan' WHEN m.members = 3 THEN 'complete' ELSE 'gap_affected' END AS state, count(*) AS buckets
FROM u FULL OUTER JOIN m ON m.symbol = u.symbol AND m.b = u.b GROUP BY coalesce(u.symbol, m.symbol), CASE WHEN u.b IS NULL THEN 'orphan' WHEN m.members = 3 THEN 'complete' ELSE 'gap_affected' END"""
SQL["asof_closed_4h"] = """
WITH s AS (SELECT symbol, CAST(floor(open_ms / 14400000) AS BIGINT) AS slot, c, CASE WHEN c > avg(c) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) THEN 1 ELSE 0 END AS state FROM {bars_4h})
SELECT b.symbol, b.i, b.open_ms, s.slot, s.state FROM {bars_1h} b LEFT JOIN s ON s.symbol = b.symbol AND s.slot = CAST(floor(b.open_ms / 14400000) AS BIGINT) - 1"""
SQL["asof_last_known_4h"] = """
WITH u AS (SELECT symbol, close_ms AS at_ms, 0 AS kind, c FROM {bars_4h} UNION ALL SELECT symbol, open_ms AS at_ms, 1 AS kind, NULL AS c FROM {bars_1h}),
f AS (SELECT symbol, at_ms, kind, max(CASE WHEN kind = 0 THEN at_ms END) OVER (PARTITION BY symbol ORDER BY at_ms, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state_ms FROM u)
SELECT f.symbol, f.at_ms AS open_ms, f.state_ms, s.c AS state_close FROM f LEFT JOIN {bars_4h} s ON s.symbol = f.symbol AND s.close_ms = f.state_ms WHERE f.kind = 1"""
SQL["trigger_overlap"] = f"""
WITH d AS (SELECT symbol, i, o, h, l, c, c - lag(c) {over()} AS d, max(h) {before(20)} AS hi FROM {{bars_1h}}), s AS (SELECT *, stddev_samp(d) {last(20)} AS vol20 FROM d),
a AS (SELECT symbol, i FROM s WHERE i >= 20 AND c > hi), b AS (SELECT symbol, i FROM s WHERE i >= 20 AND c > o AND round((c - o) / nullif(vol20, 0), 9) >= 2)
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) x UNION ALL SELECT 'first_only' AS part, count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM b) y UNION ALL SELECT 'second_only' AS part, count(*) AS n FROM (SELECT * FROM b EXCEPT SELECT * FROM a) z"""
SQL["missing_slots_except"] = """
WITH span AS (SELECT symbol, min(open_ms) AS from_ms, max(open_ms) AS to_ms FROM {bars_1h} GROUP BY symbol)
SELECT symbol, missing_ms FROM (SELECT symbol, unnest(generate_series(from_ms, to_ms, 3600000)) AS missing_ms FROM span) g EXCEPT SELECT symbol, open_ms AS missing_ms FROM {bars_1h}"""
SQL["distinct_keep_first"] = "SELECT symbol, day_id, first_i, c FROM (SELECT symbol, CAST(floor(open_ms / 86400000) AS BIGINT) AS day_id, i AS first_i, c, row_number() OVER (PARTITION BY symbol, floor(open_ms / 86400000) ORDER BY i) AS r FROM {bars_1h}) t WHERE r = 1"
#: The state of the 4h slot before a bar's has closed at its open; that of the bar's own slot has not.
SQL["causality_check"] = """
SELECT b.symbol, a.back, count(*) AS pairs, count(*) FILTER (WHERE s.close_ms >= b.open_ms) AS violations FROM {bars_1h} b JOIN (VALUES (0), (1)) AS a(back) ON true
JOIN {bars_4h} s ON s.symbol = b.symbol AND floor(s.open_ms / 14400000) = floor(b.open_ms / 14400000) - a.back GROUP BY b.symbol, a.back"""
