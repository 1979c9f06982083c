"""Scans, filters, validation and gaps over candles, as SQL over the base tables."""

from __future__ import annotations

from barloom.sources.frames import TIMEFRAMES

#: Faults put into known bars, so that the rules have something to find.
FAULTY = """
faulty AS (
  SELECT symbol, i, open_ms, close_ms + CASE WHEN i % 101 = 7 THEN 1 ELSE 0 END AS close_ms,
         o, CASE WHEN i % 97 = 3 THEN l - 1 ELSE h END AS h, CASE WHEN i % 89 = 5 THEN h + 1 ELSE l END AS l, c,
         CASE WHEN i % 83 = 11 THEN -1 ELSE v END AS v, tc,
         CASE WHEN i % 79 = 13 THEN open_ms + 1 ELSE open_ms END AS at_ms
  FROM {bars_1h})"""

RULES = [
    ("invalid_high", "h < greatest(o, c)"),
    ("invalid_low", "l > least(o, c)"),
    ("invalid_range", "h < l"),
    ("negative_volume", "v < 0"),
    ("non_positive_price", "least(o, h, l, c) <= 0"),
    ("invalid_close_time", "close_ms <> open_ms + 3599999"),
    ("misaligned_timestamp", "at_ms % 3600000 <> 0"),
]

SQL = {f"candles_{tf}": f"SELECT * FROM {{candles_{tf}}}" for tf in TIMEFRAMES}

SQL["candle_range_newest"] = """
SELECT symbol, open_ms, o, h, l, c, v FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_ms DESC) AS r FROM {bars_1h}
  WHERE open_ms >= 1704412800000 AND open_ms < 1706140800000) t
WHERE r <= 100"""

SQL["latest_bar"] = "SELECT symbol, max(open_ms) AS latest_ms, count(*) AS n FROM {candles_5m} GROUP BY symbol"
SQL["dataset_bounds"] = """
SELECT symbol, min(open_ms) AS first_ms, max(close_ms) AS last_ms, count(*) AS n_bars,
       CAST(floor((max(open_ms) - min(open_ms)) / 3600000) + 1 AS BIGINT) AS expected_bars FROM {candles_1h} GROUP BY symbol"""

SQL["loader_counters"] = """
SELECT symbol, count(*) AS read, count(*) FILTER (WHERE open_ms < 1704412800000) AS before_interval,
       count(*) FILTER (WHERE open_ms >= 1706140800000) AS after_interval,
       count(*) FILTER (WHERE open_ms >= 1704412800000 AND open_ms < 1706140800000) AS kept,
       count(*) FILTER (WHERE h < greatest(o, c) OR l > least(o, c)) AS ohlc_invalid
FROM {bars_1h} GROUP BY symbol"""

SQL["upsert_latest_wins"] = """
WITH versions AS (
  SELECT symbol, open_ms, c, 1 AS version FROM {bars_1h}
  UNION ALL SELECT symbol, open_ms, c + 1 AS c, 2 AS version FROM {bars_1h} WHERE i % 7 = 0
  UNION ALL SELECT symbol, open_ms, c + 2 AS c, 3 AS version FROM {bars_1h} WHERE i % 21 = 0)
SELECT symbol, open_ms, c, CAST(version AS BIGINT) AS version FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, open_ms ORDER BY version DESC) AS r FROM versions) t WHERE r = 1"""

SQL["validate_hard_rules"] = "WITH " + FAULTY + " " + "\nUNION ALL ".join(
    f"SELECT symbol, open_ms, '{code}' AS code FROM faulty WHERE {cond}" for code, cond in RULES
)
SQL["validation_summary"] = "WITH " + FAULTY + """,
flagged AS (SELECT symbol, """ + ", ".join(f"CASE WHEN {cond} THEN 1 ELSE 0 END AS {code}" for code, cond in RULES) + """ FROM faulty)
SELECT symbol, count(*) AS bars, """ + ", ".join(f"CAST(sum({code}) AS BIGINT) AS {code}" for code, _ in RULES) + """,
       CAST(sum(CASE WHEN """ + " + ".join(code for code, _ in RULES) + """ > 0 THEN 1 ELSE 0 END) AS BIGINT) AS invalid_bars,
       max(""" + " + ".join(code for code, _ in RULES) + """) = 0 AS passed
FROM flagged GROUP BY symbol"""

SQL["duplicate_bars"] = """
WITH arrivals AS (
  SELECT symbol, open_ms, 2 * i AS arrival FROM {bars_1h}
  UNION ALL SELECT symbol, open_ms, 2 * i + 1 AS arrival FROM {bars_1h} WHERE i % 89 = 0)
SELECT symbol, open_ms, arrival, r > 1 AS dropped FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, open_ms ORDER BY arrival) AS r FROM arrivals) t"""

SQL["wrong_order"] = """
WITH arrivals AS (SELECT symbol, open_ms, CASE WHEN i % 50 = 10 THEN i + 3 ELSE i END * 2 + CASE WHEN i % 50 = 10 THEN 1 ELSE 0 END AS arrival FROM {bars_1h})
SELECT symbol, arrival, open_ms, before_ms FROM (
  SELECT *, lag(open_ms) OVER (PARTITION BY symbol ORDER BY arrival) AS before_ms FROM arrivals) t
WHERE before_ms > open_ms"""

SQL["missing_bars"] = """
SELECT symbol, before_ms, open_ms, CAST(floor((open_ms - before_ms) / 300000) - 1 AS BIGINT) AS missing FROM (
  SELECT symbol, open_ms, lag(open_ms) OVER (PARTITION BY symbol ORDER BY open_ms) AS before_ms FROM {bars_5m}) t
WHERE open_ms - before_ms > 300000"""

SQL["missing_slot_runs"] = """
WITH slots AS (
  SELECT symbol, CAST(floor(open_ms / 300000) AS BIGINT) AS slot FROM {bars_5m}),
islands AS (SELECT symbol, slot, slot - row_number() OVER (PARTITION BY symbol ORDER BY slot) AS island FROM slots),
runs AS (SELECT symbol, min(slot) AS first_slot, max(slot) AS last_slot, count(*) AS present FROM islands GROUP BY symbol, island)
SELECT symbol, last_slot + 1 AS from_slot, next_slot - 1 AS to_slot, next_slot - last_slot - 1 AS missing FROM (
  SELECT *, lead(first_slot) OVER (PARTITION BY symbol ORDER BY first_slot) AS next_slot FROM runs) t
WHERE next_slot IS NOT NULL"""

SQL["zero_volume_runs"] = """
WITH z AS (SELECT symbol, i, open_ms FROM {bars_5m} WHERE v = 0),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY symbol ORDER BY i) AS island FROM z)
SELECT symbol, min(open_ms) AS from_ms, max(open_ms) AS to_ms, count(*) AS bars FROM islands GROUP BY symbol, island"""

SQL["return_anomalies_mad"] = """
WITH r AS (SELECT symbol, i, open_ms, ln(c / lag(c) OVER (PARTITION BY symbol ORDER BY i)) AS ret FROM {bars_1h}),
m AS (SELECT symbol, quantile_cont(ret, 0.5) AS med, count(ret) AS k FROM r GROUP BY symbol),
d AS (SELECT r.symbol, quantile_cont(abs(ret - med), 0.5) AS mad FROM r JOIN m ON r.symbol = m.symbol GROUP BY r.symbol)
SELECT r.symbol, r.i, r.open_ms, round(0.6745 * abs(ret - med) / mad, 6) AS score
FROM r JOIN m ON r.symbol = m.symbol JOIN d ON r.symbol = d.symbol
WHERE k >= 5 AND mad > 0 AND 0.6745 * abs(ret - med) / mad > 12"""

SQL["usable_bars"] = """
SELECT symbol, open_ms, o, h, l, c FROM {bars_5m}
WHERE v > 0 AND tc > 0 AND h >= greatest(o, c) AND l <= least(o, c) AND o > 0 AND open_ms % 300000 = 0"""

SQL["quality_scan"] = """
SELECT symbol, count(*) AS bars, count(*) FILTER (WHERE open_ms % 300000 <> 0) AS off_grid, count(*) FILTER (WHERE v = 0) AS zero_volume,
       count(*) FILTER (WHERE v = 0 AND h = l) AS zero_volume_flat, count(*) FILTER (WHERE tc = 0) AS zero_trades,
       count(*) FILTER (WHERE h < greatest(o, c) OR l > least(o, c)) AS invalid_ohlc,
       count(*) FILTER (WHERE least(o, h, l, c) <= 0) AS non_positive, count(*) FILTER (WHERE close_ms <> open_ms + 299999) AS bad_close_time
FROM {bars_5m} GROUP BY symbol"""

SQL["grid_check_4h"] = """
SELECT symbol, CAST(floor(open_ms / 3600000) % 24 AS BIGINT) AS hour, count(*) AS bars, count(*) FILTER (WHERE floor(open_ms / 3600000) % 4 <> 0) AS off_grid
FROM {bars_4h} GROUP BY symbol, CAST(floor(open_ms / 3600000) % 24 AS BIGINT)"""

SQL["session_completeness"] = """
SELECT symbol, CAST(floor(open_ms / 28800000) AS BIGINT) AS session_id, count(*) AS slots, count(*) = 32 AS full_session
FROM {bars_15m} WHERE v > 0 GROUP BY symbol, CAST(floor(open_ms / 28800000) AS BIGINT)"""

SQL["split_assignment"] = """
SELECT symbol, CASE WHEN open_ms < 1705276800000 THEN 'development' WHEN open_ms < 1706140800000 THEN 'validation' ELSE 'oos' END AS split,
       count(*) AS bars, min(open_ms) AS first_ms, max(open_ms) AS last_ms
FROM {bars_1h} GROUP BY symbol, CASE WHEN open_ms < 1705276800000 THEN 'development' WHEN open_ms < 1706140800000 THEN 'validation' ELSE 'oos' END"""

SQL["split_filter_reasons"] = """
WITH marked AS (
  SELECT symbol, i, CASE WHEN open_ms < 1704412800000 OR open_ms >= 1706140800000 THEN 'outside_split'
    WHEN i - first_value(i) OVER (PARTITION BY symbol, CASE WHEN open_ms < 1704412800000 THEN 0 WHEN open_ms < 1706140800000 THEN 1 ELSE 2 END ORDER BY i) < 50 THEN 'warm_up'
    WHEN open_ms + 13 * 3600000 >= 1706140800000 THEN 'window_crosses_boundary' ELSE 'kept' END AS reason
  FROM {bars_1h})
SELECT symbol, reason, count(*) AS events FROM marked GROUP BY symbol, reason"""

SQL["entry_classification"] = """
SELECT symbol, i, CASE WHEN open_ms < 1704412800000 THEN 'outside_interval' WHEN nxt IS NULL THEN 'no_bar' WHEN nxt <= 0 THEN 'bad_price'
       WHEN l >= nxt THEN 'bad_stop' ELSE 'ok' END AS label
FROM (SELECT *, lead(o) OVER (PARTITION BY symbol ORDER BY i) AS nxt FROM {bars_4h}) t"""

SQL["gap_exclusions"] = """
WITH gaps AS (
  SELECT symbol, before_ms AS left_ms FROM (SELECT symbol, open_ms, lag(open_ms) OVER (PARTITION BY symbol ORDER BY open_ms) AS before_ms FROM {bars_1h}) t
  WHERE open_ms - before_ms > 3600000)
SELECT b.symbol, b.i, count(*) FILTER (WHERE g.left_ms < b.open_ms + 3600000) AS gap_before_entry,
       count(*) FILTER (WHERE g.left_ms >= b.open_ms + 3600000) AS gap_inside_window
FROM {bars_1h} b JOIN gaps g ON g.symbol = b.symbol AND g.left_ms >= b.open_ms AND g.left_ms < b.open_ms + 13 * 3600000
GROUP BY b.symbol, b.i"""

SQL["entry_diagnostics"] = """
SELECT symbol, i, concat_ws(',', CASE WHEN v = 0 THEN 'zero_volume' END, CASE WHEN tc < 2 THEN 'partial' END, CASE WHEN h = l THEN 'flat' END) AS labels FROM {bars_5m}"""

SQL["segments_plan"] = """
SELECT symbol, CAST(floor(open_ms / 604800000) AS BIGINT) AS block, min(open_ms) AS first_ms, max(open_ms) AS last_ms, count(*) AS bars
FROM {bars_1h} GROUP BY symbol, CAST(floor(open_ms / 604800000) AS BIGINT)"""

SQL["point_in_time"] = "SELECT symbol, max(i) AS last_i, max_by(c, i) AS last_close, max(h) AS high_to_date, count(*) AS bars FROM {bars_1h} WHERE close_ms <= 1705622400000 GROUP BY symbol"
