"""Scalar functions and ordered-series indicators over bars, as SQL over the base tables.

Windows run along a symbol. Every frame ends at the current bar or before it, so
no value uses what was not known at its bar.
"""

from __future__ import annotations

_BY = "PARTITION BY symbol ORDER BY i"


def over(rows: str = "") -> str:
    return f"OVER ({_BY} {rows})"


def last(n: int) -> str:
    """The n bars up to the current one."""
    return over(f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW")


def before(n: int) -> str:
    """The n bars before the current one."""
    return over(f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING")


#: True range; the first bar has its own range.
TR = f"coalesce(greatest(h - l, abs(h - lag(c) {over()}), abs(l - lag(c) {over()})), h - l)"

SQL: dict[str, str] = {}

SQL["scalar_bar_functions"] = """
SELECT symbol, i, CASE WHEN h = l THEN 0.5 ELSE round((c - l) / (h - l), 6) END AS close_location,
       round(abs(c - o), 2) AS body, round(h - l, 2) AS bar_range,
       concat('session_', lpad(CAST(CAST(floor(open_ms / 21600000) % 4 * 6 AS BIGINT) AS VARCHAR(2)), 2, '0')) AS session_slot,
       CAST(floor(open_ms / 86400000) AS BIGINT) AS day_id, CAST(floor(floor(open_ms / 86400000) / 14) AS BIGINT) AS block_14d
FROM {bars_1h}"""

SQL["fill_and_size"] = """
WITH fills AS (SELECT symbol, i, o, l, ceil(round(o * 1.0003, 6) * 100) / 100 AS buy_fill, floor(round(o * 0.9997, 6) * 100) / 100 AS sell_fill FROM {bars_4h})
SELECT symbol, i, round(buy_fill, 2) AS buy_fill, round(sell_fill, 2) AS sell_fill,
       round(26 * o / nullif(o - l, 0) / 10000, 6) AS cost_r,
       CASE WHEN buy_fill > l THEN round(floor(least(100 / (buy_fill - l), 10000 / (buy_fill * 1.001)) * 100000) / 100000, 5) END AS size
FROM fills"""

SQL["true_range"] = f"SELECT symbol, i, round({TR}, 2) AS tr FROM {{bars_1h}}"
SQL["realized_vol"] = f"""
WITH d AS (SELECT symbol, i, c - lag(c) {over()} AS d FROM {{bars_1h}})
SELECT symbol, i, CASE WHEN i >= 20 THEN round(stddev_samp(d) {last(20)}, 6) END AS vol20 FROM d"""
SQL["atr_inclusive"] = f"WITH t AS (SELECT symbol, i, {TR} AS tr FROM {{bars_1h}}) SELECT symbol, i, CASE WHEN i >= 14 THEN round(avg(tr) {last(14)}, 6) END AS atr FROM t"
SQL["atr_prior"] = f"WITH t AS (SELECT symbol, i, {TR} AS tr FROM {{bars_1h}}) SELECT symbol, i, CASE WHEN i >= 14 THEN round(avg(tr) {before(14)}, 6) END AS atr FROM t"
SQL["sma"] = f"SELECT symbol, i, CASE WHEN i >= 19 THEN round(avg(c) {last(20)}, 6) END AS sma20, CASE WHEN i >= 49 THEN round(avg(c) {last(50)}, 6) END AS sma50 FROM {{bars_1h}}"
SQL["trailing_mean_prior"] = f"SELECT symbol, i, CASE WHEN i >= 20 THEN round(avg(CAST(v AS DOUBLE)) {before(20)}, 6) END AS mean_volume FROM {{bars_1h}}"
SQL["zscore_prior"] = f"""
SELECT symbol, i, CASE WHEN i >= 20 THEN round((v - avg(CAST(v AS DOUBLE)) {before(20)}) / nullif(stddev_samp(CAST(v AS DOUBLE)) {before(20)}, 0), 6) END AS z FROM {{bars_1h}}"""
SQL["sma_slope_regime"] = f"""
WITH s AS (SELECT symbol, i, c, CASE WHEN i >= 49 THEN avg(c) {last(50)} END AS sma FROM {{bars_1h}}),
d AS (SELECT *, sma - lag(sma, 24) {over()} AS slope FROM s)
SELECT symbol, i, round(sma, 6) AS sma, round(slope, 6) AS slope, CASE WHEN slope IS NULL THEN NULL WHEN c > sma AND slope > 0 THEN 1 ELSE 0 END AS regime FROM d"""
#: ATRs that the last one is ranked among, and the first bar with so many behind it.
RANKED, WARM_UP = 540, 552
SQL["regime_runs"] = f"""
WITH s AS (SELECT symbol, i, open_ms, CASE WHEN i >= 19 THEN CASE WHEN c > avg(c) {last(20)} THEN 1 ELSE 0 END ELSE -1 END AS state FROM {{bars_4h}}),
f AS (SELECT *, CASE WHEN state = lag(state) {over()} THEN 0 ELSE 1 END AS starts FROM s),
g AS (SELECT *, sum(starts) {over('ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} AS run FROM f)
SELECT symbol, CAST(run AS BIGINT) AS run_id, CAST(max(state) AS BIGINT) AS state, min(open_ms) AS from_ms, max(open_ms) AS to_ms, count(*) AS bars FROM g GROUP BY symbol, run"""
SQL["donchian"] = f"""
SELECT symbol, i, CASE WHEN i >= 20 THEN max(h) {before(20)} END AS upper, CASE WHEN i >= 20 THEN min(l) {before(20)} END AS lower,
       CASE WHEN i >= 20 AND c > max(h) {before(20)} THEN 1 WHEN i >= 20 AND c < min(l) {before(20)} THEN -1 ELSE 0 END AS signal FROM {{bars_1h}}"""
SQL["breakout_census"] = f"""
WITH t AS (SELECT symbol, i, open_ms, c, h, {TR} AS tr FROM {{bars_1h}}),
s AS (SELECT symbol, i, open_ms, c, max(h) {before(20)} AS hi, avg(c) {last(200)} AS sma, avg(tr) {last(20)} AS atr FROM t)
SELECT symbol, i, open_ms, c, hi, round(c - 1.5E0 * atr, 6) AS stop, round(10 * c / nullif(1.5E0 * atr, 0) / 10000, 6) AS cost_r FROM s WHERE i >= 200 AND c > hi AND c > sma"""
SQL["vwap_session"] = """
WITH b AS (SELECT symbol, CAST(floor(open_ms / 28800000) AS BIGINT) AS session_id, row_number() OVER (PARTITION BY symbol, floor(open_ms / 28800000) ORDER BY open_ms) AS k, (h + l + c) / 3 AS tp, v FROM {bars_15m})
SELECT symbol, session_id, round(sum(tp * v) / nullif(sum(v), 0), 6) AS vwap, CAST(sum(v) AS BIGINT) AS volume FROM b WHERE k <= 8 GROUP BY symbol, session_id"""
SQL["forward_returns"] = "SELECT symbol, i, " + ", ".join(f"round(lead(c, {k}) OVER ({_BY}) / c - 1, 9) AS r{k}" for k in (1, 3, 6, 12)) + " FROM {bars_1h}"
SQL["mfe_mae"] = f"""
SELECT symbol, i, round(max(h) OVER ({_BY} ROWS BETWEEN 2 FOLLOWING AND 13 FOLLOWING) - lead(o) OVER ({_BY}), 2) AS mfe,
       round(lead(o) OVER ({_BY}) - min(l) OVER ({_BY} ROWS BETWEEN 2 FOLLOWING AND 13 FOLLOWING), 2) AS mae, i + 13 > n - 1 AS truncated FROM {{bars_1h}}"""
SQL["close_regime"] = f"""
WITH r AS (SELECT symbol, i, c / lag(c) {over()} - 1 AS ret FROM {{bars_1h}}),
w AS (SELECT symbol, i, avg(abs(ret)) {last(19)} AS mean_abs, sum(ret) {last(19)} AS total FROM r)
SELECT symbol, i, CASE WHEN i < 19 THEN 'UNKNOWN' WHEN mean_abs < 0.0005 THEN 'RANGE' WHEN total > 0.005 THEN 'TREND_UP' WHEN total < -0.005 THEN 'TREND_DOWN' ELSE 'UNKNOWN' END AS regime FROM w"""
SQL["step_returns_drawdown"] = f"""
WITH e AS (SELECT symbol, i, c, c / lag(c) {over()} - 1 AS ret, max(c) {over('ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} AS peak FROM {{bars_1d}})
SELECT symbol, i, round(ret, 9) AS ret, peak, round(peak - c, 2) AS drawdown, round((peak - c) / peak, 9) AS drawdown_fraction FROM e"""
SQL["volume_profile_extremes"] = "SELECT symbol, max_by(open_ms, v * 1000000 - i) AS busiest_ms, max(v) AS most, min(v) AS least, round(avg(CAST(v AS DOUBLE)), 6) AS mean_volume FROM {bars_1h} GROUP BY symbol"
