"""4h permission, outcomes of events under three stop models, a frozen signal under tie conventions, and the full metrics of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.operators.events import DISPLACEMENT
from barloom.operators.indicators import last
from barloom.operators.ledger_stats import EQUITY
from barloom.operators.resampling import block_bootstrap, bootstrap_body
from barloom.plans.sql import spark_query, with_tables

SQL: dict[str, str] = {}

# -- permission ---------------------------------------------------------------


def regime_sql(ranked: int = 540, sma: int = 50, slope: int = 6, atr: int = 14, step_ms: int = 14_400_000, bars: str = "bars_4h") -> str:
    """Of each bar: its mean of closes, the change of that over ``slope`` bars, the rank of its ATR, and what they permit.

    All windows start anew after a missing bar. ``pct`` is the share of the last
    ``ranked`` ATRs below the bar's, in percent. permission is 1 if the close is over
    its mean, the mean rises and 20 <= pct <= 95, budget if 25 <= pct <= 80; -1 while
    something is not known. Bars in a row that permit make a run, numbered from 0;
    others have run -1.
    """
    p = "PARTITION BY symbol, segment ORDER BY i"
    rows = lambda n: f"OVER ({p} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    all_before = "OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
WITH gaps AS (SELECT *, CASE WHEN open_ms - lag(open_ms) OVER (PARTITION BY symbol ORDER BY i) = {step_ms} THEN 0 ELSE 1 END AS starts FROM {{{bars}}}),
parts AS (SELECT symbol, i, open_ms, h, l, c, sum(starts) {all_before} AS segment FROM gaps),
ranges AS (
  SELECT *, row_number() OVER ({p}) - 1 AS place, coalesce(greatest(h - l, abs(h - lag(c) OVER ({p})), abs(l - lag(c) OVER ({p}))), h - l) AS tr FROM parts),
means AS (
  SELECT *, CASE WHEN place >= {atr - 1} THEN round(avg(tr) {rows(atr)}, 9) END AS atr, CASE WHEN place >= {sma - 1} THEN round(avg(c) {rows(sma)}, 9) END AS mean, floor(place / {ranked}) AS block FROM ranges),
slopes AS (SELECT *, round(mean - lag(mean, {slope}) OVER ({p}), 9) AS slope FROM means),
ranks AS (
  SELECT x.symbol, x.i, count(*) FILTER (WHERE y.atr < x.atr) * 100.0E0 / {ranked} AS pct
  FROM (SELECT m.*, block - d.k AS asked FROM means m JOIN (VALUES (0), (1)) AS d(k) ON true WHERE place >= {ranked + atr - 2}) x
  JOIN means y ON y.symbol = x.symbol AND y.segment = x.segment AND y.block = x.asked AND y.place > x.place - {ranked} AND y.place <= x.place GROUP BY x.symbol, x.i),
states AS (
  SELECT s.symbol, s.i, s.open_ms, s.mean, s.slope, r.pct, CASE WHEN r.pct IS NULL OR mean IS NULL OR slope IS NULL THEN -1 WHEN c > mean AND slope > 0 AND r.pct >= 20 AND r.pct <= 95 THEN 1 ELSE 0 END AS permission,
         CASE WHEN r.pct IS NULL OR mean IS NULL OR slope IS NULL THEN -1 WHEN r.pct >= 25 AND r.pct <= 80 THEN 1 ELSE 0 END AS budget FROM slopes s LEFT JOIN ranks r ON r.symbol = s.symbol AND r.i = s.i),
begun AS (SELECT *, CASE WHEN permission = 1 AND coalesce(lag(permission) OVER (PARTITION BY symbol ORDER BY i), -1) <> 1 THEN 1 ELSE 0 END AS begins FROM states)
SELECT symbol, i, open_ms, round(mean, 6) AS sma, round(slope, 6) AS slope, pct, CAST(permission AS BIGINT) AS permission, CAST(budget AS BIGINT) AS budget,
       CAST(CASE WHEN permission = 1 THEN sum(begins) {all_before} - 1 ELSE -1 END AS BIGINT) AS run_id FROM begun"""


SQL["regime_4h"] = regime_sql()
SQL["atr_percent_rank"] = f"SELECT symbol, i, pct FROM ({regime_sql()}) r"

def decile_sql(pct: str) -> str:
    """The tenth of 100 that a percentage lies in, as text; 100 and more belong to the last, null, NaN and less than 0 are unknown."""
    tenth = f"CAST(floor({pct} / 10) AS INTEGER)"
    return f"""CASE WHEN {pct} IS NULL OR isnan({pct}) OR {pct} < 0 THEN 'unknown' WHEN {pct} >= 100 THEN '90-100' ELSE concat(CAST({tenth} * 10 AS VARCHAR(3)), '-', CAST(({tenth} + 1) * 10 AS VARCHAR(3))) END"""


#: Bars by the decile of their true range among those of their symbol, with the move to the next close.
SQL["range_deciles"] = f"""
WITH t AS (SELECT symbol, i, h - l AS size, lead(c) OVER (PARTITION BY symbol ORDER BY i) - c AS move FROM {{bars_1h}}),
p AS (SELECT symbol, move, 100 * percent_rank() OVER (PARTITION BY symbol ORDER BY round(size, 2)) AS pct FROM t)
SELECT symbol, {decile_sql('pct')} AS decile, count(*) AS bars, count(move) AS moves, round(avg(abs(move)), 6) AS mean_move FROM p GROUP BY symbol, {decile_sql('pct')}"""

# -- outcomes -----------------------------------------------------------------

#: Multiple of the mean true range of so many bars, share of the entry, and bars that a barrier is waited for.
ATR_TIMES, ATR_BARS, SHARE, WAIT = 1.5, 20, 0.005, 12
#: Entry at the open after the bar that confirms (the last bar's, if there is none). The stop is that bar's extreme, or
#: lies by range or share away from the entry; an open beyond stop or target comes first, then the stop, then the target.
OUTCOMES = f"""{DISPLACEMENT},
ranges AS (SELECT symbol, i, n, h, l, CASE WHEN i >= {ATR_BARS} THEN round(avg(tr) {last(ATR_BARS)}, 9) END AS atr FROM vols),
known AS (SELECT d.symbol, d.i, d.conf, r.l AS low, r.h AS high, r.atr, r.n FROM displacements d JOIN ranges r ON r.symbol = d.symbol AND r.i = d.conf),
entered AS (SELECT k.*, b.i AS entry_i, b.o AS entry, b.open_ms AS entry_ms FROM known k JOIN {{bars_1h}} b ON b.symbol = k.symbol AND b.i = least(k.conf + 1, k.n - 1)),
sided AS (
  SELECT e.*, m.model, x.side, x.d, CASE m.model WHEN 'swing' THEN CASE x.side WHEN 'long' THEN low ELSE high END WHEN 'atr' THEN entry - x.d * {ATR_TIMES}E0 * atr ELSE entry - x.d * {SHARE}E0 * entry END AS stop
  FROM entered e JOIN (VALUES ('swing'), ('atr'), ('fixed_percent')) AS m(model) ON true JOIN (VALUES ('long', 1E0), ('short', -1E0)) AS x(side, d) ON true),
risked AS (SELECT *, d * (entry - stop) AS dist FROM sided),
aimed AS (SELECT r.*, t.target_r, entry + d * target_r * dist AS target FROM risked r JOIN (VALUES (0.5E0), (1E0), (1.5E0), (2E0)) AS t(target_r) ON r.dist > 0.000001),
met AS (
  SELECT a.*, b.o AS bar_open, CASE a.side WHEN 'long' THEN b.l ELSE b.h END AS against, CASE a.side WHEN 'long' THEN b.h ELSE b.l END AS toward
  FROM (SELECT aimed.*, v.k, entry_i + v.k AS at_i FROM aimed JOIN (VALUES {', '.join(f'({k})' for k in range(WAIT))}) AS v(k) ON true) a
  JOIN {{bars_1h}} b ON b.symbol = a.symbol AND b.i = a.at_i),
hits AS (
  SELECT *, CASE WHEN d * (bar_open - stop) <= 0 THEN 1 WHEN d * (bar_open - target) >= 0 THEN 2 WHEN d * (against - stop) <= 0 THEN 3 WHEN d * (toward - target) >= 0 THEN 4 END AS hit,
         d * (against - stop) <= 0 AND d * (toward - target) >= 0 AS both_hit FROM met),
first_hits AS (
  SELECT symbol, i, conf, model, side, d, target_r, entry_i, entry_ms, n, entry, stop, dist, target, min(k) FILTER (WHERE hit IS NOT NULL) AS bars, min_by(hit, k) FILTER (WHERE hit IS NOT NULL) AS hit,
         min_by(bar_open, k) FILTER (WHERE hit IS NOT NULL) AS bar_open, min_by(both_hit, k) FILTER (WHERE hit IS NOT NULL) AS both_hit
  FROM hits GROUP BY symbol, i, conf, model, side, d, target_r, entry_i, entry_ms, n, entry, stop, dist, target),
resolved AS (SELECT *, CASE hit WHEN 1 THEN bar_open WHEN 2 THEN bar_open WHEN 3 THEN stop WHEN 4 THEN target END AS exit_price, coalesce(hit = 3 AND both_hit, false) AS tied FROM first_hits)"""
_R = "d * (exit_price - entry) / dist"
SQL["event_outcomes"] = f"""
WITH {OUTCOMES} SELECT symbol, i, conf, model, side, target_r, round(entry, 2) AS entry, round(stop, 6) AS stop, round(dist, 6) AS stop_distance, CAST(bars AS BIGINT) AS bars_to_resolve,
  CASE WHEN hit IN (2, 4) THEN true WHEN hit IN (1, 3) THEN false END AS target_before_stop, tied AS ambiguous_bar, round(exit_price, 6) AS exit_price, round({_R}, 6) AS r, entry_i + {WAIT} >= n AS truncated FROM resolved"""
SQL["stop_model_stats"] = f"""
WITH {OUTCOMES} SELECT model, side, target_r, count(*) AS events, count(*) FILTER (WHERE hit IN (2, 4)) AS wins, count(*) FILTER (WHERE hit IN (1, 3)) AS losses, count(*) FILTER (WHERE tied) AS ambiguous,
  count(*) FILTER (WHERE hit IS NULL) AS unresolved, count(*) FILTER (WHERE entry_i + {WAIT} >= n) AS truncated, round(avg({_R}), 6) AS average_r, round(quantile_cont({_R}, 0.5), 6) AS median_r FROM resolved GROUP BY model, side, target_r"""

#: One signal: longs with the bar's low as stop and a target of one risk. R in millionths, whole days as episodes.
_SIGNAL = f"""WITH {OUTCOMES}, trades AS (SELECT *, {_R} AS r, CAST(floor(entry_ms / 86400000) AS BIGINT) AS block FROM resolved WHERE model = 'swing' AND side = 'long' AND target_r = 1)"""
_CONVENTIONS = "(VALUES ('stop_first', -1E0), ('tie_win', 1E0), ('tie_split', 0E0), ('non_ambiguous', 0E0)) AS c(convention, tied_r)"
_VALUES = f"""{_SIGNAL}
SELECT convention AS g, block, CAST(round(CASE WHEN tied THEN tied_r ELSE r END * 1000000) AS BIGINT) AS v FROM trades JOIN {_CONVENTIONS} ON true WHERE hit IS NOT NULL AND NOT (tied AND convention = 'non_ambiguous')"""
_COUNTS = f"""{_SIGNAL}
SELECT convention, count(*) AS trades, count(*) FILTER (WHERE hit IS NOT NULL) AS resolved, count(*) FILTER (WHERE hit IS NULL) AS censored, count(*) FILTER (WHERE hit IS NULL AND entry_i + {WAIT} < n) AS censored_by_time,
       count(*) FILTER (WHERE tied) AS ambiguous FROM trades JOIN {_CONVENTIONS} ON true GROUP BY convention"""


def frozen_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal's resolved trades under each tie convention and without tied ones, with intervals over whole days; censored trades are counted, never resolved."""
    counts = spark_query(_COUNTS)(spark, sf_dir)
    return counts.join(block_bootstrap(spark_query(_VALUES)(spark, sf_dir), "g", "block", "v").withColumnRenamed("g", "convention"), "convention")


# -- metrics ------------------------------------------------------------------

#: Days that a run must span for annual figures, days of a year of daily steps, and the capital at its start.
LEAST_SPAN, YEAR, CAPITAL = 30, 365, 10_000_000_000
SQL["run_metrics"] = "WITH " + EQUITY + f""",
steps AS (
  SELECT run_id, exit_day, eq, CAST(eq - lag(eq) OVER (PARTITION BY run_id ORDER BY exit_day) AS DOUBLE) / nullif(lag(eq) OVER (PARTITION BY run_id ORDER BY exit_day), 0) AS ret,
         greatest(max(eq) OVER (PARTITION BY run_id ORDER BY exit_day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), {CAPITAL}) AS peak FROM equity),
curve AS (
  SELECT run_id, max_by(eq, exit_day) AS final, max(exit_day) - min(exit_day) AS span, coalesce(avg(ret), 0) AS mean_ret, coalesce(stddev_samp(ret), 0) AS sd,
         coalesce(sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END)), 0) AS down, coalesce(min(CAST(eq - peak AS DOUBLE) / peak), 0) AS drawdown FROM steps GROUP BY run_id),
reach AS (SELECT run_id, entry_day, exit_day, coalesce(max(exit_day) OVER (PARTITION BY run_id ORDER BY entry_day, exit_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), entry_day) AS before_day FROM {{ledger}}),
held AS (SELECT run_id, CAST(sum(greatest(exit_day - greatest(entry_day, before_day), 0)) AS BIGINT) AS covered, max(exit_day) - min(entry_day) AS whole FROM reach GROUP BY run_id),
t AS (
  SELECT run_id, count(*) AS trades, count(*) FILTER (WHERE net_u > 0) AS wins, count(*) FILTER (WHERE net_u < 0) AS losses, CAST(sum(greatest(net_u, 0)) AS BIGINT) AS gain, CAST(-sum(least(net_u, 0)) AS BIGINT) AS loss,
         CAST(sum(net_u) AS BIGINT) AS net, avg(net_r) AS r, CAST(sum(fee_u) AS BIGINT) AS fees, CAST(sum(2 * notional_u + CASE side WHEN 'long' THEN gross_u ELSE -gross_u END) AS BIGINT) AS turnover,
         CAST(sum(exit_day - entry_day) AS BIGINT) AS days, max(net_u) AS best, min(net_u) AS worst FROM {{ledger}} GROUP BY run_id),
m AS (SELECT *, CASE WHEN span >= {LEAST_SPAN} THEN sqrt({YEAR}E0) ELSE 1E0 END AS scale, CASE WHEN span >= {LEAST_SPAN} AND final > 0 THEN power(CAST(final AS DOUBLE) / {CAPITAL}, 365.25E0 / span) - 1 ELSE 0E0 END AS cagr FROM curve)
SELECT m.run_id, CAST({CAPITAL} AS BIGINT) AS initial_u, final AS final_u, round(CAST(final AS DOUBLE) / {CAPITAL} - 1, 9) AS total_return, round(cagr, 9) AS cagr, round(sd * scale, 9) AS volatility,
  CASE WHEN sd > 0 THEN round(mean_ret / sd * scale, 6) ELSE 0E0 END AS sharpe, CASE WHEN down > 0 THEN round(mean_ret / down * scale, 6) ELSE 0E0 END AS sortino, round(drawdown, 9) AS max_drawdown,
  CASE WHEN drawdown < 0 AND span >= {LEAST_SPAN} THEN round(cagr / -drawdown, 6) ELSE 0E0 END AS calmar, CASE WHEN loss > 0 THEN round(CAST(gain AS DOUBLE) / loss, 6) ELSE 0E0 END AS profit_factor,
  round(CAST(wins AS DOUBLE) / trades, 9) AS win_rate, trades AS trade_count, CASE WHEN wins > 0 THEN round(CAST(gain AS DOUBLE) / wins, 3) ELSE 0E0 END AS average_win, CASE WHEN losses > 0 THEN round(-CAST(loss AS DOUBLE) / losses, 3) ELSE 0E0 END AS average_loss,
  round(CAST(net AS DOUBLE) / trades, 3) AS expectancy, round(r, 6) AS average_r, fees AS total_fees, turnover AS total_turnover, round(CAST(days AS DOUBLE) / trades, 6) AS average_days_held,
  round(CAST(covered AS DOUBLE) / nullif(whole, 0), 9) AS exposure, best AS best_trade, worst AS worst_trade, span < {LEAST_SPAN} AS insufficient_sample, span AS span_days FROM m JOIN t ON t.run_id = m.run_id JOIN held ON held.run_id = m.run_id"""
SQL["monthly_returns"] = "WITH " + EQUITY + f""", ends AS (SELECT run_id, exit_month AS month_id, max_by(eq, exit_day) AS eq FROM equity GROUP BY run_id, exit_month)
SELECT run_id, month_id, round(CAST(eq AS DOUBLE) / coalesce(lag(eq) OVER (PARTITION BY run_id ORDER BY month_id), {CAPITAL}) - 1, 9) AS ret FROM ends"""

QUERIES = {"frozen_signal": frozen_signal}
ORACLES = {"frozen_signal": "WITH counts AS (" + with_tables(_COUNTS) + "), boot AS (" + with_tables(bootstrap_body(_VALUES, "convention")) + ") SELECT counts.*, boot.* EXCLUDE (convention) FROM counts JOIN boot USING (convention)"}
