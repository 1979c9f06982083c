"""Event detectors, forward outcomes and barrier resolution, as SQL over the base tables."""

from __future__ import annotations

from barloom.operators.indicators import _BY, RANKED, TR, WARM_UP, before, last, over
from barloom.operators.structure import BREAKS, LABELS, LEVELS, SHIFTS, SWEEPS, swings_sql

SQL: dict[str, str] = {}

VOL = f"""
diffs AS (SELECT symbol, i, n, open_ms, o, h, l, c, v, c - lag(c) {over()} AS d, {TR} AS tr FROM {{bars_1h}}),
vols AS (SELECT *, CASE WHEN i >= 20 THEN stddev_samp(d) {last(20)} END AS vol20, CASE WHEN i >= 5 THEN stddev_samp(d) {last(5)} END AS vol5,
         lag(c, 50) {over()} AS c50, avg(h - l) {before(20)} AS range20, avg(CAST(v AS DOUBLE)) {before(20)} AS mean_v FROM diffs)"""

DISPLACEMENT = f"""{VOL},
displacements AS (
  SELECT symbol, i, least(i + 1, n - 1) AS conf, open_ms, c, CASE WHEN c > o THEN 'up' ELSE 'down' END AS direction, round(abs(c - o) / nullif(vol20, 0), 6) AS strength,
         round(abs(c - o) / nullif(h - l, 0), 6) AS body_ratio, round(v / nullif(mean_v, 0), 6) AS volume_ratio
  FROM vols WHERE i >= 20 AND round(abs(c - o) / nullif(vol20, 0), 9) >= 2 AND round(abs(c - o) / nullif(h - l, 0), 9) >= 0.5)"""
SQL["displacement"] = f"WITH {DISPLACEMENT} SELECT * FROM displacements"

SQL["volatility_expansion"] = f"""
WITH {VOL}, p AS (SELECT symbol, i, n, open_ms, vol20, lag(vol20, 20) {over()} AS was FROM vols)
SELECT symbol, i, open_ms, round(vol20, 6) AS vol, round(vol20 / nullif(was, 0), 6) AS ratio FROM p WHERE i <= n - 2 AND round(vol20 / nullif(was, 0), 9) >= 2"""

REGIMES = f"""{VOL},
states AS (
  SELECT symbol, i, open_ms, CASE WHEN round(c - c50, 6) > round(vol20, 6) THEN 'up' WHEN round(c - c50, 6) < round(-vol20, 6) THEN 'down' ELSE 'flat' END AS trend,
         CASE WHEN round(vol20, 6) > 0 AND round(vol20, 6) >= list_extract(list_sort(list(round(vol20, 6)) {last(20)}), 11) THEN 'high' ELSE 'low' END AS vol_state FROM vols WHERE i >= 20),
marked AS (SELECT symbol, i, open_ms, concat(trend, '/', vol_state) AS state FROM states WHERE i >= 50)"""
SQL["regime_transitions"] = f"""
WITH {REGIMES}, p AS (SELECT *, lag(state) {over()} AS was FROM marked)
SELECT symbol, i, open_ms, was AS previous_state, state FROM p WHERE was IS NOT NULL AND was <> state"""
SQL["regime_counts"] = f"WITH {REGIMES} SELECT symbol, state, count(*) AS bars FROM marked GROUP BY symbol, state"

TIGHT = f"""{VOL},
tight AS (SELECT symbol, i, n, open_ms, h, l, c, range20, round(vol5 / nullif(vol20, 0), 6) AS ratio, CASE WHEN i >= 25 AND round(vol5 / nullif(vol20, 0), 6) <= 0.6 AND round(v / nullif(mean_v, 0), 6) <= 0.8 THEN 1 ELSE 0 END AS is_tight FROM vols),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY symbol, is_tight ORDER BY i) AS run FROM tight)"""
SQL["compression_runs"] = f"""
WITH {TIGHT} SELECT symbol, min(i) AS from_i, max(i) AS to_i, count(*) AS bars, min(ratio) AS least_ratio, max(h) AS hi, min(l) AS lo FROM runs WHERE is_tight = 1 GROUP BY symbol, run"""
#: The first close over an episode's high before the next episode begins; a bar that is not tight belongs to the episode before it.
SQL["compression_breakouts"] = f"""
WITH {TIGHT}, episodes AS (SELECT symbol, min(i) AS from_i, max(i) AS to_i, max(h) AS hi, min(l) AS lo FROM runs WHERE is_tight = 1 GROUP BY symbol, run),
after AS (SELECT symbol, i, c, is_tight, max(CASE WHEN is_tight = 1 THEN i END) {over('ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} AS to_i FROM tight)
SELECT e.symbol, e.from_i, e.to_i, e.hi, min(t.i) AS break_i, min_by(t.c, t.i) AS break_close, min(t.i) - e.to_i <= 6 AS within_6
FROM episodes e JOIN after t ON t.symbol = e.symbol AND t.to_i = e.to_i AND t.is_tight = 0 AND t.c > e.hi GROUP BY e.symbol, e.from_i, e.to_i, e.hi""".replace("bars_1h", "bars_4h")
RELEASES = f"""
coils AS (
  SELECT symbol, i, ratio, is_tight, min(CASE WHEN is_tight = 0 AND round(h - l, 6) > round(range20, 6) THEN i END) {over('ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS release_i FROM tight),
releases AS (
  SELECT symbol, release_i, count(*) AS coil_bars, min(ratio) AS least_ratio, min_by(i, ratio * 1000000 + i) AS coil_i FROM coils WHERE is_tight = 1 AND release_i IS NOT NULL GROUP BY symbol, release_i)"""
SQL["compression_release"] = f"WITH {TIGHT}, {RELEASES} SELECT * FROM releases"

ZONES = f"""
based AS (
  SELECT d.symbol, d.i, d.conf, d.direction, max(s.i) AS pivot_i FROM displacements d JOIN swings s
    ON s.symbol = d.symbol AND s.i >= d.i - 20 AND s.i < d.i AND s.conf <= d.conf AND ((d.direction = 'up' AND s.kind = 'low') OR (d.direction = 'down' AND s.kind = 'high'))
  GROUP BY d.symbol, d.i, d.conf, d.direction),
zones AS (SELECT z.symbol, z.i, z.conf, CASE WHEN z.direction = 'up' THEN 'demand' ELSE 'supply' END AS zone_kind, z.pivot_i, max(b.h) AS zone_high, min(b.l) AS zone_low
FROM based z JOIN {{bars_1h}} b ON b.symbol = z.symbol AND b.i < z.i AND b.i >= greatest(z.pivot_i, z.i - 5)
GROUP BY z.symbol, z.i, z.conf, z.direction, z.pivot_i HAVING max(b.h) > min(b.l))"""
SQL["supply_demand_zones"] = f"WITH {DISPLACEMENT}, {swings_sql('bars_1h', 3)}, {ZONES} SELECT * FROM zones"

#: Bars after a zone is known over which it is measured.
MEASURED = 24
#: Depth runs from 0 at the far edge to 1 at the near one for the wick and the close alike: a wick beyond the band counts as
#: at its edge, one that does not reach it has none, and a close outside the band has depth 0.
SQL["zone_measures"] = f"""
WITH {DISPLACEMENT}, {swings_sql('bars_1h', 3)}, {ZONES},
seen AS (SELECT z.*, b.i AS at_i, b.h, b.l, b.c, zone_high - zone_low AS height FROM (SELECT zones.*, conf + v.k AS next_i FROM zones JOIN (VALUES {', '.join(f'({k})' for k in range(1, MEASURED + 1))}) AS v(k) ON true) z
  JOIN {{bars_1h}} b ON b.symbol = z.symbol AND b.i = z.next_i)
SELECT symbol, i, zone_kind, at_i, at_i - i AS age, round(height, 2) AS height, round(CASE WHEN c > zone_high THEN c - zone_high WHEN c < zone_low THEN c - zone_low ELSE 0E0 END, 2) AS distance,
  round(CASE WHEN zone_kind = 'supply' THEN CASE WHEN h >= zone_low THEN (zone_high - least(h, zone_high)) / height END ELSE CASE WHEN l <= zone_high THEN (greatest(l, zone_low) - zone_low) / height END END, 6) AS wick_depth,
  round(CASE WHEN c < zone_low OR c > zone_high THEN 0E0 WHEN zone_kind = 'supply' THEN (zone_high - c) / height ELSE (c - zone_low) / height END, 6) AS close_depth FROM seen"""

#: The swings of structure shifts, beside the narrower ones of zones.
_WIDER = swings_sql("bars_1h")
for _name in ("pivots", "found", "swings"):
    _WIDER = _WIDER.replace(_name, f"wider_{_name}")
_STRUCTURE = ", ".join(x.replace("FROM swings", "FROM wider_swings").replace("JOIN swings", "JOIN wider_swings") for x in (LABELS, BREAKS, SHIFTS))
#: Structure events in one form: their direction is told, and kept apart from what happened.
SQL["structure_events"] = f"""
WITH {swings_sql('bars_1h')}, {LABELS}, {BREAKS}, {SHIFTS},
every AS (
  SELECT symbol, i, conf, label AS event_type, price, NULL AS broken_level, NULL AS penetration, lag(label) OVER (PARTITION BY symbol ORDER BY s) AS previous_state, label AS new_state, NULL AS direction FROM labelled WHERE label IS NOT NULL
  UNION ALL SELECT symbol, i, conf, 'BOS' AS event_type, price, broken_level, penetration, NULL AS previous_state, NULL AS new_state, direction FROM breaks
  UNION ALL SELECT symbol, i, conf, 'structure_shift' AS event_type, price, NULL AS broken_level, NULL AS penetration, previous_state, new_state, NULL AS direction FROM shifts)
SELECT e.*, b.c AS confirmation_close, b.close_ms AS confirmation_ms FROM every e JOIN {{bars_1h}} b ON b.symbol = e.symbol AND b.i = e.conf"""
#: Every detector's events in one order: by the bar at which they are known, then by kind, side and first bar.
SQL["events_union"] = f"""
WITH {DISPLACEMENT}, {REGIMES.removeprefix(VOL + ',')}, {TIGHT.removeprefix(VOL + ',')}, {RELEASES}, {LEVELS}, {SWEEPS}, {swings_sql('bars_1h', 3)}, {ZONES}, {_WIDER}, {_STRUCTURE},
turns AS (SELECT *, lag(state) {over()} AS was FROM marked),
grown AS (SELECT symbol, i, n, round(vol20 / nullif(lag(vol20, 20) {over()}, 0), 9) AS ratio FROM vols),
every AS (
  SELECT symbol, conf, i, 'displacement' AS kind, direction AS side, NULL AS price FROM displacements
  UNION ALL SELECT symbol, i + 1 AS conf, i, 'sweep' AS kind, side, price FROM sweeps
  UNION ALL SELECT symbol, i AS conf, i, 'volatility_expansion' AS kind, NULL AS side, NULL AS price FROM grown WHERE i <= n - 2 AND ratio >= 2
  UNION ALL SELECT symbol, i AS conf, i, 'regime' AS kind, state AS side, NULL AS price FROM turns WHERE was IS NOT NULL AND was <> state
  UNION ALL SELECT symbol, release_i AS conf, coil_i AS i, 'compression' AS kind, NULL AS side, NULL AS price FROM releases
  UNION ALL SELECT symbol, conf, i, 'structure_shift' AS kind, new_state AS side, price FROM shifts
  UNION ALL SELECT symbol, conf, i, 'structure_break' AS kind, direction AS side, price FROM breaks
  UNION ALL SELECT symbol, conf, i, 'structure_label' AS kind, label AS side, price FROM labelled WHERE label IS NOT NULL
  UNION ALL SELECT symbol, conf, i, 'zone' AS kind, zone_kind AS side, zone_high AS price FROM zones)
SELECT symbol, conf, i, kind, side, price, row_number() OVER (PARTITION BY symbol ORDER BY conf, kind, coalesce(side, ''), i, coalesce(price, 0)) AS seq FROM every"""

#: Entry at the next open after confirmation (the last bar's, if there is none); stop at the sweep bar's extreme.
OUTCOMES = f"""{LEVELS}, {SWEEPS},
entries AS (
  SELECT s.symbol, s.i, s.price, s.side AS swept, CASE WHEN s.side = 'low' THEN 'long' ELSE 'short' END AS side, b.i AS entry_i, b.n, b.o AS entry,
         CASE WHEN s.side = 'low' THEN s.l ELSE s.h END AS stop
  FROM sweeps s JOIN {{bars_1h}} b ON b.symbol = s.symbol AND b.i = least(s.i + 2, b.n - 1)),
risked AS (SELECT *, CASE WHEN side = 'long' THEN entry - stop ELSE stop - entry END AS dist FROM entries),
targets AS (SELECT r.*, t.target_r, CASE WHEN side = 'long' THEN entry + target_r * dist ELSE entry - target_r * dist END AS target
            FROM risked r JOIN (VALUES (0.5E0), (1E0), (1.5E0), (2E0)) AS t(target_r) ON r.dist > 0.005),
scan AS (
  SELECT t.symbol, t.i, t.price, t.swept, t.target_r, t.k, b.o AS bar_open,
    CASE WHEN t.side = 'long' THEN CASE WHEN b.o <= t.stop THEN 1 WHEN b.o >= t.target THEN 2 WHEN b.l <= t.stop THEN 3 WHEN b.h >= t.target THEN 4 END
         ELSE CASE WHEN b.o >= t.stop THEN 1 WHEN b.o <= t.target THEN 2 WHEN b.h >= t.stop THEN 3 WHEN b.l <= t.target THEN 4 END END AS hit,
    CASE WHEN t.side = 'long' THEN b.l <= t.stop AND b.h >= t.target ELSE b.h >= t.stop AND b.l <= t.target END AS both_hit, t.stop, t.target
  FROM (SELECT targets.*, k.k, entry_i + k.k AS at_i FROM targets JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11)) AS k(k) ON true) t
  JOIN {{bars_1h}} b ON b.symbol = t.symbol AND b.i = t.at_i),
first_hit AS (SELECT *, row_number() OVER (PARTITION BY symbol, i, price, swept, target_r ORDER BY k) AS r FROM scan WHERE hit IS NOT NULL),
resolved AS (
  SELECT t.symbol, t.i, t.price, t.swept, t.side, t.entry, t.stop, t.dist, t.target_r, t.entry_i, t.n, f.k AS bars_to_resolve, f.hit, f.both_hit,
         CASE f.hit WHEN 1 THEN f.bar_open WHEN 2 THEN f.bar_open WHEN 3 THEN f.stop WHEN 4 THEN f.target END AS exit_price
  FROM targets t LEFT JOIN first_hit f ON f.symbol = t.symbol AND f.i = t.i AND f.price = t.price AND f.swept = t.swept AND f.target_r = t.target_r AND f.r = 1)"""
SQL["barrier_outcomes"] = f"""
WITH {OUTCOMES} SELECT symbol, i, price, side, target_r, round(entry, 2) AS entry, round(stop, 2) AS stop, CAST(bars_to_resolve AS BIGINT) AS bars_to_resolve,
  CASE WHEN hit IN (2, 4) THEN true WHEN hit IN (1, 3) THEN false END AS target_before_stop, coalesce(both_hit AND hit = 3, false) AS ambiguous_bar, round(exit_price, 4) AS exit_price, entry_i + 12 > n AS truncated FROM resolved"""
SQL["target_stats"] = f"""
WITH {OUTCOMES}, r AS (SELECT *, CASE WHEN side = 'long' THEN exit_price - entry ELSE entry - exit_price END / dist AS realised FROM resolved)
SELECT side, target_r, count(*) AS events, count(*) FILTER (WHERE hit IN (2, 4)) AS wins, count(*) FILTER (WHERE hit IN (1, 3)) AS losses, count(*) FILTER (WHERE hit = 3 AND both_hit) AS ambiguous,
  count(*) FILTER (WHERE hit IS NULL) AS unresolved, round(count(*) FILTER (WHERE hit IN (2, 4)) * 1.0E0 / nullif(count(*) FILTER (WHERE hit IS NOT NULL), 0), 9) AS win_rate,
  round(avg(realised), 6) AS average_r, round(quantile_cont(realised, 0.5), 6) AS median_r, round(avg(CAST(bars_to_resolve AS DOUBLE)), 6) AS mean_bars FROM r GROUP BY side, target_r"""
SQL["setup_funnel"] = f"""
WITH {LEVELS}, {SWEEPS},
m AS (SELECT symbol, i, (next_close - l) / nullif(price - l, 0) AS recovery, (least(o, c) - l) / nullif(h - l, 0) AS wick FROM sweeps WHERE side = 'low'),
w AS (SELECT symbol, CASE WHEN recovery IS NULL OR wick IS NULL THEN 'undefined' WHEN recovery < 0.5 THEN 'weak_recovery' WHEN wick < 0.5 THEN 'small_wick' ELSE 'accepted' END AS stage FROM m)
SELECT symbol, stage, count(*) AS events, round(count(*) * 1.0E0 / sum(count(*)) OVER (PARTITION BY symbol), 9) AS share FROM w GROUP BY symbol, stage"""
SQL["outcome_cells"] = f"""
WITH {OUTCOMES}, f AS (SELECT r.symbol, r.side, r.i, h.horizon, CASE WHEN r.side = 'long' THEN b.c / r.entry - 1 ELSE 1 - b.c / r.entry END AS ret
  FROM (SELECT DISTINCT symbol, side, i, entry, entry_i FROM risked) r JOIN (VALUES (1), (3), (6), (12)) AS h(horizon) ON true JOIN {{bars_1h}} b ON b.symbol = r.symbol AND b.i = r.entry_i + h.horizon)
SELECT side, CAST(horizon AS BIGINT) AS horizon, count(*) AS n, round(avg(ret), 9) AS mean, round(stddev_samp(ret), 9) AS sd, round(stddev_samp(ret) / sqrt(count(*)), 9) AS standard_error FROM f GROUP BY side, horizon"""
SQL["all_bars_baseline"] = """
WITH f AS (SELECT b.symbol, h.horizon, e.c / b.c - 1 AS ret FROM {bars_1h} b JOIN (VALUES (1), (3), (6), (12)) AS h(horizon) ON true JOIN {bars_1h} e ON e.symbol = b.symbol AND e.i = b.i + h.horizon)
SELECT symbol, CAST(horizon AS BIGINT) AS horizon, count(*) AS n, CASE WHEN count(*) >= 30 THEN round(avg(ret), 9) END AS mean, CASE WHEN count(*) >= 30 THEN round(count(*) FILTER (WHERE ret > 0) * 1.0E0 / count(*), 9) END AS win_rate FROM f GROUP BY symbol, horizon"""
SQL["buy_and_hold"] = "SELECT symbol, min_by(o, i) AS first_open, max_by(c, i) AS last_close, round(max_by(c, i) / min_by(o, i) - 1, 9) AS total_return FROM {bars_1d} GROUP BY symbol"
SQL["event_minus_baseline"] = f"""
WITH {DISPLACEMENT}, f AS (SELECT b.symbol, b.i, e.c / b.c - 1 AS ret FROM {{bars_1h}} b JOIN {{bars_1h}} e ON e.symbol = b.symbol AND e.i = b.i + 6),
ev AS (SELECT f.symbol, avg(ret) AS m, count(*) AS n FROM f JOIN displacements d ON d.symbol = f.symbol AND d.i = f.i GROUP BY f.symbol), ba AS (SELECT symbol, avg(ret) AS m FROM f GROUP BY symbol)
SELECT ev.symbol, ev.n AS events, round(ev.m, 9) AS event_mean, round(ba.m, 9) AS baseline_mean, round(ev.m - ba.m, 9) AS difference FROM ev JOIN ba ON ev.symbol = ba.symbol"""
#: The return must reach half the hourly ATR of the session's second hour, and the last closed 4h bar's ATR must rank between 25 and 80 of the last 540.
SQL["session_momentum"] = f"""
WITH b AS (SELECT symbol, floor(open_ms / 28800000) AS sid, row_number() OVER (PARTITION BY symbol, floor(open_ms / 28800000) ORDER BY open_ms) AS k, open_ms, o, h, l, c, v, (h + l + c) / 3 AS tp FROM {{bars_15m}}),
s AS (SELECT symbol, sid, count(*) AS bars, min_by(o, k) AS p0, max_by(c, k) AS p8, sum(tp * v) / nullif(sum(v), 0) AS vwap, max(open_ms) + 900000 AS signal_ms FROM b WHERE k <= 8 GROUP BY symbol, sid),
e AS (SELECT symbol, sid, o AS entry FROM b WHERE k = 9),
t AS (SELECT symbol, i, open_ms, {TR} AS tr FROM {{bars_1h}}), hourly AS (SELECT symbol, open_ms, CASE WHEN i >= 13 THEN avg(tr) {last(14)} END AS atr FROM t),
t4 AS (SELECT symbol, i, open_ms, {TR} AS tr FROM {{bars_4h}}), a4 AS (SELECT symbol, i, open_ms, floor(i / {RANKED}) AS block, round(avg(tr) {last(14)}, 9) AS atr FROM t4),
budget AS (
  SELECT x.symbol, x.open_ms, count(*) FILTER (WHERE y.atr < x.atr) * 100.0E0 / {RANKED} AS pct
  FROM (SELECT a4.*, block - d.k AS asked FROM a4 JOIN (VALUES (0), (1)) AS d(k) ON true WHERE i >= {WARM_UP}) x
  JOIN a4 y ON y.symbol = x.symbol AND y.block = x.asked AND y.i > x.i - {RANKED} AND y.i <= x.i GROUP BY x.symbol, x.open_ms)
SELECT s.symbol, CAST(s.sid AS BIGINT) AS session_id, round(s.p8 / s.p0 - 1, 9) AS session_return, round(0.5E0 * h.atr / s.p0, 9) AS threshold, round(g.pct, 6) AS budget,
  CASE WHEN s.bars < 8 THEN 'incomplete' WHEN h.atr IS NULL THEN 'no_atr' WHEN round(s.p8 / s.p0 - 1, 9) < round(0.5E0 * h.atr / s.p0, 9) THEN 'weak' WHEN g.pct IS NULL THEN 'no_budget'
       WHEN g.pct < 25 OR g.pct > 80 THEN 'out_of_band' WHEN s.p8 <= s.vwap THEN 'below_vwap' WHEN e.entry IS NULL THEN 'no_entry' ELSE 'signal' END AS label, e.entry
FROM s LEFT JOIN e ON e.symbol = s.symbol AND e.sid = s.sid LEFT JOIN hourly h ON h.symbol = s.symbol AND h.open_ms = s.sid * 28800000 + 3600000
LEFT JOIN budget g ON g.symbol = s.symbol AND g.open_ms = (floor(s.signal_ms / 14400000) - 1) * 14400000"""
SQL["expansion_candidates"] = f"""
WITH {VOL}, x AS (SELECT symbol, i, open_ms, o, h, l, c, avg(tr) {before(14)} AS atr, max(h) {before(20)} AS hi FROM vols)
SELECT symbol, i, open_ms, c, hi, round((h - l) / nullif(atr, 0), 6) AS expansion FROM x WHERE i >= 20 AND round(h - l, 6) >= round(1.5E0 * atr, 6) AND c > hi AND (c - l) >= 0.7 * (h - l)"""
SQL["fill_next_open"] = f"SELECT symbol, i, lead(o, 1) OVER ({_BY}) AS fill_1, lead(o, 2) OVER ({_BY}) AS fill_2, round(lead(o, 1) OVER ({_BY}) * 1.0005, 6) AS buy_fill FROM {{bars_4h}}"

#: A trade whose bar reaches stop and target is resolved again under each convention; the others keep their R.
SQL["tie_conventions"] = f"""
WITH {OUTCOMES}, r AS (SELECT side, target_r, hit = 3 AND both_hit AS tied, CASE WHEN side = 'long' THEN exit_price - entry ELSE entry - exit_price END / dist AS realised FROM resolved WHERE hit IS NOT NULL)
SELECT convention, target_r, count(*) AS trades, count(*) FILTER (WHERE tied) AS tied_trades,
  round(avg(CASE WHEN NOT tied THEN realised WHEN convention = 'stop_first' THEN -1E0 WHEN convention = 'tie_win' THEN target_r ELSE (target_r - 1) / 2 END), 6) AS mean_r
FROM r JOIN (VALUES ('stop_first'), ('tie_win'), ('tie_split')) AS t(convention) ON true GROUP BY convention, target_r"""
