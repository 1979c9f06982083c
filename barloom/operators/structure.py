"""Market structure: swings, labels, breaks, levels and sweeps, as SQL over the base tables.

A swing at bar i is known k bars later; whatever reads it keeps to that.
Tolerances are compared in whole cents, never by dividing.
"""

from __future__ import annotations

from barloom.operators.indicators import _BY, over

K = 5


def swings_sql(bars: str, k: int = K) -> str:
    return f"""
pivots AS (
  SELECT symbol, i, n, open_ms, h, l,
         CASE WHEN i >= {k} AND i < n - {k} AND h > max(h) OVER ({_BY} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AND h > max(h) OVER ({_BY} ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING) THEN 1 ELSE 0 END AS is_high,
         CASE WHEN i >= {k} AND i < n - {k} AND l < min(l) OVER ({_BY} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AND l < min(l) OVER ({_BY} ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING) THEN 1 ELSE 0 END AS is_low
  FROM {{{bars}}}),
found AS (
  SELECT symbol, i, i + {k} AS conf, open_ms, 'high' AS kind, h AS price, 0 AS rank FROM pivots WHERE is_high = 1
  UNION ALL SELECT symbol, i, i + {k} AS conf, open_ms, 'low' AS kind, l AS price, 1 AS rank FROM pivots WHERE is_low = 1),
swings AS (SELECT symbol, i, conf, open_ms, kind, price, row_number() OVER (PARTITION BY symbol ORDER BY conf, i, rank) - 1 AS s FROM found)"""


_S = "PARTITION BY symbol ORDER BY s"
SQL: dict[str, str] = {}
for _tf in ("1h", "4h"):
    SQL[f"swings_{_tf}"] = f"WITH {swings_sql(f'bars_{_tf}')} SELECT symbol, i, conf, open_ms, kind, price, CAST(s AS BIGINT) AS seq FROM swings"

LABELS = f"""
labelled AS (
  SELECT *, CASE WHEN kind <> lag(kind) OVER ({_S}) OR lag(kind) OVER ({_S}) IS NULL THEN NULL
    WHEN kind = 'high' THEN CASE WHEN price > lag(price) OVER ({_S}) THEN 'HH' ELSE 'LH' END
    ELSE CASE WHEN price > lag(price) OVER ({_S}) THEN 'HL' ELSE 'LL' END END AS label FROM swings)"""
SQL["swing_labels"] = f"WITH {swings_sql('bars_1h')}, {LABELS} SELECT symbol, i, conf, kind, price, label, lag(label) OVER ({_S}) AS previous_label FROM labelled WHERE label IS NOT NULL"

#: A swing beyond the price of one of the five swings before it of the other kind; the earliest of these counts.
BREAKS = """
hits AS (
  SELECT a.symbol, a.s, a.i, a.conf, a.kind, a.price, b.s AS ref_s, b.price AS ref_price, row_number() OVER (PARTITION BY a.symbol, a.s ORDER BY b.s) AS r
  FROM swings a JOIN swings b ON a.symbol = b.symbol AND b.s >= a.s - 5 AND b.s < a.s AND b.kind <> a.kind
   AND ((a.kind = 'high' AND a.price > b.price) OR (a.kind = 'low' AND a.price < b.price)) WHERE a.s >= 2),
breaks AS (
  SELECT symbol, i, conf, kind, price, CAST(ref_s AS BIGINT) AS broken_seq, ref_price AS broken_level, round(abs(price - ref_price), 2) AS penetration,
         CASE WHEN kind = 'high' THEN 'long' ELSE 'short' END AS direction FROM hits WHERE r = 1)"""
SQL["break_of_structure"] = f"WITH {swings_sql('bars_1h')}, {BREAKS} SELECT * FROM breaks"

#: The swing that turns two of its kind the other way; it stands one before the swing that the window ends with.
SHIFTS = f"""
p AS (SELECT *, lag(i) OVER ({_S}) AS i1, lag(conf) OVER ({_S}) AS conf1, lag(kind) OVER ({_S}) AS k1, lag(price) OVER ({_S}) AS p1, lag(kind, 2) OVER ({_S}) AS k2, lag(price, 2) OVER ({_S}) AS p2, lag(kind, 3) OVER ({_S}) AS k3, lag(price, 3) OVER ({_S}) AS p3 FROM swings),
st AS (SELECT *, CASE WHEN k3 = k2 AND k2 = k1 THEN CASE WHEN p2 > p3 THEN 'up' ELSE 'down' END END AS was,
              CASE WHEN k3 = k2 AND k2 = k1 THEN CASE WHEN p1 > p2 THEN 'up' ELSE 'down' END END AS now_is FROM p),
shifts AS (SELECT symbol, i1 AS i, conf1 AS conf, p1 AS price, was AS previous_state, now_is AS new_state FROM st WHERE was IN ('up', 'down') AND now_is IN ('up', 'down') AND was <> now_is)"""
SQL["structure_shift"] = f"WITH {swings_sql('bars_1h')}, {SHIFTS} SELECT * FROM shifts"

RANGE_LEVELS = f"""
rolled AS (
  SELECT symbol, i, n, open_ms, max(h) {over('ROWS BETWEEN 19 PRECEDING AND CURRENT ROW')} AS hi, min(l) {over('ROWS BETWEEN 19 PRECEDING AND CURRENT ROW')} AS lo FROM {{bars_1h}}),
changed AS (
  SELECT *, CASE WHEN i = 19 OR hi <> lag(hi) {over()} THEN 1 ELSE 0 END AS new_hi, CASE WHEN i = 19 OR lo <> lag(lo) {over()} THEN 1 ELSE 0 END AS new_lo FROM rolled),
range_levels AS (
  SELECT symbol, i AS creation, hi AS price, 'range_high' AS level_type, 'high' AS side FROM changed WHERE i >= 19 AND i < n - 1 AND new_hi = 1
  UNION ALL SELECT symbol, i AS creation, lo AS price, 'range_low' AS level_type, 'low' AS side FROM changed WHERE i >= 19 AND i < n - 1 AND new_lo = 1)"""


def period_levels(name: str, ms: int) -> str:
    """The high and low of each finished period, known at the first bar of the next one."""
    return f"""
{name}_p AS (SELECT symbol, floor(open_ms / {ms}) AS p, max(h) AS hi, min(l) AS lo, max(i) AS last_i FROM {{bars_1h}} GROUP BY symbol, floor(open_ms / {ms})),
{name}_levels AS (
  SELECT symbol, last_i + 1 AS creation, hi AS price, '{name}_high' AS level_type, 'high' AS side FROM (SELECT *, lead(p) OVER (PARTITION BY symbol ORDER BY p) AS nxt FROM {name}_p) t WHERE nxt IS NOT NULL
  UNION ALL SELECT symbol, last_i + 1 AS creation, lo AS price, '{name}_low' AS level_type, 'low' AS side FROM (SELECT *, lead(p) OVER (PARTITION BY symbol ORDER BY p) AS nxt FROM {name}_p) t WHERE nxt IS NOT NULL)"""


LEVEL_PARTS = f"{RANGE_LEVELS}, {period_levels('day', 86_400_000)}, {period_levels('session', 21_600_000)}"
#: All three kinds are equally specific.
SIX_LEVELS = " UNION ALL ".join(f"SELECT *, 1 AS specificity FROM {t}_levels" for t in ("range", "day", "session"))
LEVELS = f"{LEVEL_PARTS}, levels AS ({SIX_LEVELS})"

SQL["range_levels"] = f"WITH {RANGE_LEVELS} SELECT symbol, creation, price, level_type FROM range_levels"
SQL["day_levels"] = f"WITH {period_levels('day', 86_400_000)} SELECT symbol, creation, price, level_type FROM day_levels"
SQL["session_levels"] = f"WITH {period_levels('session', 21_600_000)} SELECT symbol, creation, price, level_type FROM session_levels"
SQL["levels_union"] = f"WITH {LEVELS} SELECT symbol, creation, price, level_type, CAST(specificity AS BIGINT) AS specificity FROM levels"
SQL["first_levels"] = f"WITH {LEVELS} SELECT symbol, creation, price, level_type FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY creation, price, level_type) AS r FROM levels) t WHERE r <= 10"
SQL["level_touches"] = f"""
WITH {period_levels('day', 86_400_000)}
SELECT v.symbol, v.creation, v.level_type, v.price, count(*) AS touches FROM day_levels v JOIN {{bars_1h}} b
  ON b.symbol = v.symbol AND b.i <= v.creation AND ((v.side = 'high' AND b.h >= v.price) OR (v.side = 'low' AND b.l <= v.price))
GROUP BY v.symbol, v.creation, v.level_type, v.price"""

_C = "CAST(round({} * 100) AS BIGINT)".format
#: A bar is beyond a high level if price * 1001 < high * 1000, beyond a low one if price * 999 > low * 1000.
SWEEPS = f"""
stepped AS (
  SELECT symbol, i, n, open_ms, o, h, l, c, v, lead(c) {over()} AS next_close, {_C('h')} AS hc, {_C('l')} AS lc, lag({_C('h')}) {over()} AS hp, lag({_C('l')}) {over()} AS lp FROM {{bars_1h}}),
cents AS (SELECT symbol, creation, level_type, side, specificity, price, {_C('price')} AS pc FROM levels),
crossed AS (
  SELECT b.symbol, b.i, b.open_ms, b.o, b.h, b.l, b.c, b.v, b.next_close, v.side, v.price, v.level_type, v.creation, v.specificity,
         row_number() OVER (PARTITION BY b.symbol, b.i, v.side, v.price ORDER BY v.specificity DESC, v.creation DESC, v.level_type DESC) AS r
  FROM stepped b JOIN cents v ON v.symbol = b.symbol AND v.creation < b.i
   AND ((v.side = 'high' AND v.pc * 1001 >= b.hp * 1000 AND v.pc * 1001 < b.hc * 1000) OR (v.side = 'low' AND v.pc * 999 <= b.lp * 1000 AND v.pc * 999 > b.lc * 1000))
  WHERE b.i >= 1 AND b.i <= b.n - 2),
sweeps AS (SELECT * FROM crossed WHERE r = 1)"""
SQL["liquidity_sweeps"] = f"WITH {LEVELS}, {SWEEPS} SELECT symbol, i, i + 1 AS conf, side, price, level_type, creation, next_close FROM sweeps"
SQL["sweep_measures"] = f"""
WITH {LEVELS}, {SWEEPS}
SELECT symbol, i, side, price, level_type,
  round(CASE WHEN side = 'high' THEN (h - price) / price ELSE (price - l) / price END, 9) AS penetration,
  CASE WHEN next_close > price THEN 1 ELSE 0 END AS closes_above, CASE WHEN next_close < price THEN 1 ELSE 0 END AS closes_below,
  round(CASE WHEN side = 'high' THEN (h - next_close) / nullif(h - price, 0) ELSE (next_close - l) / nullif(price - l, 0) END, 6) AS recovery_ratio,
  round(CASE WHEN side = 'high' THEN (h - greatest(o, c)) / nullif(h - l, 0) ELSE (least(o, c) - l) / nullif(h - l, 0) END, 6) AS wick_ratio, v AS volume
FROM sweeps"""
#: Structure known within LOOKBACK bars before a sweep is met by blocks of as many bars.
LOOKBACK = 100
SQL["sweep_structure_context"] = f"""
WITH {LEVELS}, {SWEEPS}, {swings_sql('bars_1h')}, {LABELS}, {BREAKS}, {SHIFTS},
known AS (
  SELECT symbol, conf, i, broken_level, direction FROM breaks
  UNION ALL SELECT symbol, conf, i, NULL AS broken_level, NULL AS direction FROM labelled WHERE label IS NOT NULL
  UNION ALL SELECT symbol, conf, i, NULL AS broken_level, NULL AS direction FROM shifts),
asked AS (SELECT w.symbol, w.i, w.side, w.price, floor(w.i / {LOOKBACK}) - d.k AS block FROM sweeps w JOIN (VALUES (0), (1), (2)) AS d(k) ON true),
near AS (
  SELECT w.symbol, w.i, w.side, w.price, count(k.conf) AS known,
         count(*) FILTER (WHERE abs(k.broken_level - w.price) * 100 <= w.price AND ((w.side = 'high' AND k.direction = 'long') OR (w.side = 'low' AND k.direction = 'short'))) AS breaks
  FROM asked w LEFT JOIN known k ON k.symbol = w.symbol AND floor(k.conf / {LOOKBACK}) = w.block AND k.conf <= w.i AND w.i - k.conf <= {LOOKBACK}
  GROUP BY w.symbol, w.i, w.side, w.price)
SELECT symbol, i, side, price, known, breaks,
       CASE WHEN known = 0 THEN NULL WHEN breaks = 0 THEN 'no_prior_break' WHEN side = 'high' THEN 'prior_break_long' ELSE 'prior_break_short' END AS label FROM near"""
SQL["sweep_sides_overlap"] = f"""
WITH {LEVELS}, {SWEEPS}, hi AS (SELECT DISTINCT symbol, i FROM sweeps WHERE side = 'high'), lo AS (SELECT DISTINCT symbol, i FROM sweeps WHERE side = 'low')
SELECT coalesce(hi.symbol, lo.symbol) AS symbol, count(*) FILTER (WHERE hi.i IS NOT NULL AND lo.i IS NOT NULL) AS both_sides, count(*) FILTER (WHERE lo.i IS NULL) AS high_only, count(*) FILTER (WHERE hi.i IS NULL) AS low_only
FROM hi FULL OUTER JOIN lo ON hi.symbol = lo.symbol AND hi.i = lo.i GROUP BY coalesce(hi.symbol, lo.symbol)"""
#: Levels whose bar has closed when a 4h bar closes.
SQL["known_levels_at"] = f"""
WITH {LEVELS},
steps AS (
  SELECT v.symbol, b.close_ms AS at_ms, 0 AS kind, CAST(NULL AS BIGINT) AS i, v.price FROM levels v JOIN {{bars_1h}} b ON b.symbol = v.symbol AND b.i = v.creation
  UNION ALL SELECT symbol, close_ms AS at_ms, 1 AS kind, i, NULL AS price FROM {{bars_4h}}),
run AS (
  SELECT *, count(price) OVER (PARTITION BY symbol ORDER BY at_ms, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known,
         max(price) OVER (PARTITION BY symbol ORDER BY at_ms, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS highest,
         min(price) OVER (PARTITION BY symbol ORDER BY at_ms, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lowest FROM steps)
SELECT symbol, i, known, highest, lowest FROM run WHERE kind = 1"""
