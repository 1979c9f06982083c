"""Analytics of a trade ledger: costs, R distributions, tails, segments, streaks and clusters, as SQL over the base tables.

Amounts are whole ten-thousandths; sums are exact and ratios are doubles rounded
at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators.ordered import LAGS, lag_sums, longest_streaks, quantiles
from barloom.runtime import cut
from barloom.sources.frames import FRAMES

SQL: dict[str, str] = {}
_U = "CAST(sum({0}) AS BIGINT) AS {1}".format
_ORDER = "exit_day, entry_day, trade_key, line, part_key, supp_key, net_u, notional_u, cost_u"

SQL["cost_sums_by_run"] = "SELECT run_id, count(*) AS trades, " + ", ".join(_U(c, c) for c in ("gross_u", "fee_u", "spread_u", "slip_u", "cost_u", "net_u")) + " FROM {ledger} GROUP BY run_id"
SQL["exit_reasons"] = "SELECT run_id, exit_reason, count(*) AS trades, " + _U("net_u", "net_u") + " FROM {ledger} GROUP BY run_id, exit_reason"
SQL["trades_in_range"] = "SELECT run_id, trade_key, line, entry_day, side, net_u FROM {ledger} WHERE entry_day >= 10000 AND entry_day < 10100"
SQL["run_list"] = "SELECT run_id, count(*) AS trades, min(entry_day) AS first_day, max(exit_day) AS last_day, " + _U("net_u", "net_u") + ", rank() OVER (ORDER BY max(exit_day) DESC, run_id) * 1 AS r FROM {ledger} GROUP BY run_id"
SQL["trade_stats"] = """
SELECT run_id, count(*) AS trades, count(*) FILTER (WHERE net_u > 0) AS wins, count(*) FILTER (WHERE net_u < 0) AS losses, count(*) FILTER (WHERE net_u = 0) AS scratches,
  round(count(*) FILTER (WHERE net_u > 0) * 1.0E0 / count(*), 9) AS win_rate,
  round(avg(CAST(net_u AS DOUBLE)) FILTER (WHERE net_u > 0) / nullif(-avg(CAST(net_u AS DOUBLE)) FILTER (WHERE net_u < 0), 0), 6) AS payoff,
  round(CAST(sum(net_u) FILTER (WHERE net_u > 0) AS DOUBLE) / nullif(-CAST(sum(net_u) FILTER (WHERE net_u < 0) AS DOUBLE), 0), 6) AS profit_factor,
  round(CAST(sum(cost_u) AS DOUBLE) / nullif(CAST(sum(gross_u) FILTER (WHERE gross_u > 0) AS DOUBLE), 0), 6) AS cost_share, round(avg(net_r), 6) AS mean_r,
  round(sqrt(count(*) FILTER (WHERE net_u > 0) * 1.0E0 / count(*) * (1 - count(*) FILTER (WHERE net_u > 0) * 1.0E0 / count(*)) / count(*)), 9) AS win_rate_se
FROM {ledger} GROUP BY run_id"""
SQL["r_distribution"] = "SELECT run_id, side, count(*) AS n, round(avg(net_r), 6) AS mean, round(stddev_samp(net_r), 6) AS sd, " + ", ".join(
    f"round(quantile_cont(net_r, {q}), 6) AS p{int(q * 100):02d}" for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
) + " FROM {ledger} GROUP BY run_id, side HAVING count(*) >= 30"
SQL["r_shape"] = """
WITH m AS (SELECT run_id, avg(net_r) AS mu, count(*) AS n FROM {ledger} GROUP BY run_id),
p AS (SELECT l.run_id, max(m.n) AS n, avg(power(net_r - mu, 2)) AS m2, avg(power(net_r - mu, 3)) AS m3, avg(power(net_r - mu, 4)) AS m4 FROM {ledger} l JOIN m ON m.run_id = l.run_id GROUP BY l.run_id)
SELECT run_id, n, round(sqrt(n * (n - 1.0E0)) / (n - 2) * m3 / power(m2, 1.5), 6) AS skew_g1, round((n - 1.0E0) / ((n - 2.0E0) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6), 6) AS kurtosis_g2 FROM p"""
SQL["tail_risk"] = """
WITH o AS (SELECT run_id, net_r, row_number() OVER (PARTITION BY run_id ORDER BY net_r) AS r, count(*) OVER (PARTITION BY run_id) AS n FROM {ledger})
SELECT run_id, max(n) AS n, round(max(net_r) FILTER (WHERE r <= ceil(0.05 * n)), 6) AS value_at_risk, round(avg(net_r) FILTER (WHERE r <= ceil(0.05 * n)), 6) AS expected_shortfall,
  round(sqrt(avg(CASE WHEN net_r < 0 THEN net_r * net_r ELSE 0 END)), 6) AS downside_deviation, round(quantile_cont(net_r, 0.95) / nullif(abs(quantile_cont(net_r, 0.05)), 0), 6) AS tail_ratio,
  round(sum(net_r) FILTER (WHERE r <= ceil(0.05 * n) AND net_r < 0) / nullif(sum(net_r) FILTER (WHERE net_r < 0), 0), 6) AS tail_loss_share FROM o GROUP BY run_id"""
SQL["top5_concentration"] = """
WITH o AS (SELECT run_id, net_u, row_number() OVER (PARTITION BY run_id ORDER BY net_u DESC) AS r FROM {ledger} WHERE net_u > 0)
SELECT run_id, CAST(sum(net_u) FILTER (WHERE r <= 5) AS BIGINT) AS top5_u, CAST(sum(net_u) AS BIGINT) AS profit_u, round(CAST(sum(net_u) FILTER (WHERE r <= 5) AS DOUBLE) / CAST(sum(net_u) AS DOUBLE), 9) AS share FROM o GROUP BY run_id"""
SQL["cost_sensitivity"] = """
SELECT run_id, m, round(CAST(sum(gross_u) AS DOUBLE) - m * CAST(sum(cost_u) AS DOUBLE), 2) AS net,
  round(avg((CAST(gross_u AS DOUBLE) - m * CAST(cost_u AS DOUBLE)) / CAST(risk_u AS DOUBLE)), 6) AS mean_r,
  round(CAST(sum(gross_u) AS DOUBLE) / nullif(CAST(sum(cost_u) AS DOUBLE), 0), 9) AS break_even
FROM {ledger} JOIN (VALUES (0E0), (0.5E0), (1E0), (1.5E0), (2E0)) AS t(m) ON true GROUP BY run_id, m"""
SQL["fragility_flags"] = """
SELECT run_id, sum(gross_u - cost_u) > 0 AND sum(2 * gross_u - 3 * cost_u) <= 0 AS cost_fragile, sum(gross_u) > 0 AS gross_positive, min(risk_u) > 0 AS r_complete, max(exit_day) - min(entry_day) AS observation_days FROM {ledger} GROUP BY run_id"""
SQL["bps_sensitivity"] = """
SELECT bps, count(*) AS trades, count(*) FILTER (WHERE bps * notional_u / 10000E0 / risk_u <= 0.2) AS passing, round(quantile_cont(bps * notional_u / 10000E0 / risk_u, 0.5), 6) AS median_cost_r
FROM {ledger} JOIN (VALUES (10E0), (26E0), (39E0), (52E0)) AS t(bps) ON true GROUP BY bps"""
SQL["cost_buckets"] = """
WITH x AS (SELECT 26E0 * notional_u / 10000E0 / risk_u AS v FROM {ledger})
SELECT CASE WHEN v <= 0.1 THEN '<=.10' WHEN v <= 0.2 THEN '(.10,.20]' WHEN v <= 0.3 THEN '(.20,.30]' WHEN v <= 0.5 THEN '(.30,.50]' ELSE '>.50' END AS bucket, count(*) AS trades FROM x
GROUP BY CASE WHEN v <= 0.1 THEN '<=.10' WHEN v <= 0.2 THEN '(.10,.20]' WHEN v <= 0.3 THEN '(.20,.30]' WHEN v <= 0.5 THEN '(.30,.50]' ELSE '>.50' END"""
SQL["monthly_segments"] = """
SELECT run_id, entry_month, count(*) AS trades, CAST(sum(net_u) AS BIGINT) AS net_u, round(count(*) FILTER (WHERE net_u > 0) * 1.0E0 / count(*), 9) AS win_rate, count(*) < 10 AS thin,
  round(CAST(sum(net_u) FILTER (WHERE net_u > 0) AS DOUBLE) / nullif(-CAST(sum(net_u) FILTER (WHERE net_u < 0) AS DOUBLE), 0), 6) AS profit_factor FROM {ledger} GROUP BY run_id, entry_month"""
SQL["calendar_counts"] = """
SELECT CAST(floor(entry_month / 12) AS BIGINT) AS y, CAST(floor(entry_month % 12 / 3) + 1 AS BIGINT) AS q, entry_month AS m, count(*) AS trades
FROM {ledger} GROUP BY GROUPING SETS ((CAST(floor(entry_month / 12) AS BIGINT)), (CAST(floor(entry_month / 12) AS BIGINT), CAST(floor(entry_month % 12 / 3) + 1 AS BIGINT)), (entry_month))"""
SQL["year_table"] = """
SELECT run_id, CAST(floor(entry_month / 12) AS BIGINT) AS y, count(*) AS trades, round(avg(CAST(gross_u AS DOUBLE) / risk_u), 6) AS gross_r, round(avg(net_r), 6) AS net_r, round(sum(net_r), 4) AS total_r FROM {ledger} GROUP BY run_id, CAST(floor(entry_month / 12) AS BIGINT)"""
EQUITY = "daily AS (SELECT run_id, exit_day, max(exit_month) AS exit_month, CAST(sum(net_u) AS BIGINT) AS net_u FROM {ledger} GROUP BY run_id, exit_day), equity AS (SELECT run_id, exit_day, exit_month, net_u, CAST(10000000000 + sum(net_u) OVER (PARTITION BY run_id ORDER BY exit_day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS eq FROM daily)"
SQL["equity_drawdown"] = "WITH " + EQUITY + ", p AS (SELECT *, max(eq) OVER (PARTITION BY run_id ORDER BY exit_day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM equity) SELECT run_id, exit_day, eq, peak, peak - eq AS drawdown_u, round(CAST(peak - eq AS DOUBLE) / peak, 9) AS drawdown FROM p"
SQL["performance_metrics"] = "WITH " + EQUITY + """, p AS (SELECT *, CAST(eq AS DOUBLE) / lag(eq) OVER (PARTITION BY run_id ORDER BY exit_day) - 1 AS ret, max(eq) OVER (PARTITION BY run_id ORDER BY exit_day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM equity)
SELECT run_id, count(*) AS days, round(CAST(max_by(eq, exit_day) AS DOUBLE) / 10000000000 - 1, 9) AS total_return, round(stddev_samp(ret) * sqrt(365), 9) AS volatility, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(365), 6) AS sharpe,
  round(avg(ret) / nullif(sqrt(avg(CASE WHEN ret < 0 THEN ret * ret WHEN ret IS NOT NULL THEN 0 END)), 0) * sqrt(365), 6) AS sortino, round(max(CAST(peak - eq AS DOUBLE) / peak), 9) AS max_drawdown FROM p GROUP BY run_id"""
SQL["period_returns"] = "WITH " + EQUITY + ", y AS (SELECT run_id, CAST(floor(exit_month / 12) AS BIGINT) AS period, max_by(eq, exit_day) AS eq FROM equity GROUP BY run_id, CAST(floor(exit_month / 12) AS BIGINT)) SELECT run_id, period, eq, round(CAST(eq AS DOUBLE) / lag(eq) OVER (PARTITION BY run_id ORDER BY period) - 1, 9) AS ret FROM y"
SQL["monthly_pnl"] = "SELECT run_id, exit_month AS month_id, CAST(sum(net_u) AS BIGINT) AS net_u, count(*) AS trades FROM {ledger} GROUP BY run_id, exit_month"
SQL["streaks"] = f"""
WITH o AS (SELECT run_id, CASE WHEN net_u > 0 THEN 1 WHEN net_u < 0 THEN -1 ELSE 0 END AS s, row_number() OVER (PARTITION BY run_id ORDER BY {_ORDER}) AS k FROM {{ledger}}),
g AS (SELECT run_id, s, k - row_number() OVER (PARTITION BY run_id, s ORDER BY k) AS g FROM o), c AS (SELECT run_id, s, count(*) AS n FROM g GROUP BY run_id, s, g)
SELECT run_id, max(CASE WHEN s = 1 THEN n END) AS longest_wins, max(CASE WHEN s = -1 THEN n END) AS longest_losses FROM c GROUP BY run_id"""
SQL["autocorrelation"] = f"""
WITH m AS (SELECT run_id, avg(net_r) AS mu FROM {{ledger}} GROUP BY run_id), o AS (SELECT l.run_id, net_r - mu AS x, row_number() OVER (PARTITION BY l.run_id ORDER BY {_ORDER}) AS k FROM {{ledger}} l JOIN m ON m.run_id = l.run_id),
p AS (SELECT *, {', '.join(f'lead(x, {j}) OVER (PARTITION BY run_id ORDER BY k) AS x{j}' for j in range(1, 6))} FROM o)
SELECT run_id, count(*) AS n, {', '.join(f'round(sum(x * x{j}) / nullif(sum(x * x), 0), 6) AS lag{j}' for j in range(1, 6))}, round(2 / sqrt(count(*)), 9) AS threshold FROM p GROUP BY run_id"""
SQL["peak_concurrency"] = """
WITH e AS (SELECT run_id, entry_day AS t, 1 AS d FROM {ledger} UNION ALL SELECT run_id, exit_day AS t, -1 AS d FROM {ledger}),
g AS (SELECT run_id, t, d, sum(d) AS n FROM e GROUP BY run_id, t, d), r AS (SELECT run_id, sum(n) OVER (PARTITION BY run_id ORDER BY t, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM g)
SELECT run_id, CAST(max(held) AS BIGINT) AS peak FROM r GROUP BY run_id"""
SQL["kish_clusters"] = """
WITH c AS (SELECT run_id, entry_month, count(*) AS n FROM {ledger} GROUP BY run_id, entry_month)
SELECT run_id, CAST(sum(n) AS BIGINT) AS trades, count(*) AS clusters, max(n) AS largest, round(CAST(sum(n) AS DOUBLE) * CAST(sum(n) AS DOUBLE) / CAST(sum(n * n) AS DOUBLE), 6) AS n_eff, round(CAST(max(n) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 9) AS largest_share FROM c GROUP BY run_id"""
SQL["capital_geometry"] = """
WITH x AS (SELECT run_id, 100E0 * notional_u / risk_u AS implied FROM {ledger})
SELECT run_id, count(*) AS trades, count(*) FILTER (WHERE implied > 10000) AS above_1x, count(*) FILTER (WHERE implied > 20000) AS above_2x, round(quantile_cont(implied, 0.5), 4) AS median_notional FROM x GROUP BY run_id"""
SQL["spacing"] = """
WITH d AS (SELECT DISTINCT run_id, entry_day FROM {ledger}), g AS (SELECT run_id, entry_day - lag(entry_day) OVER (PARTITION BY run_id ORDER BY entry_day) AS gap FROM d)
SELECT run_id, count(gap) AS gaps, max(gap) AS longest, round(quantile_cont(gap, 0.5), 6) AS median_gap, round(avg(CAST(gap AS DOUBLE)), 6) AS mean_gap FROM g GROUP BY run_id"""
SQL["canonical_collapse"] = """
SELECT run_id, entry_day, part_key, count(*) AS events, count(DISTINCT side) AS sides, min(net_u) AS least_net, max(net_u) AS most_net, count(DISTINCT net_u) > 1 AS conflict FROM {ledger} GROUP BY run_id, entry_day, part_key HAVING count(*) > 1"""
SQL["regime_table"] = "SELECT run_id, regime, side, count(*) AS trades, round(avg(net_r), 6) AS mean_r FROM {ledger} GROUP BY run_id, regime, side"
SQL["standard_errors"] = "SELECT run_id, regime, count(*) AS n, round(stddev_samp(net_r) / sqrt(count(*)), 9) AS se, round(2.801585E0 / sqrt(count(*)), 9) AS detectable, CAST(greatest(2, least(50, round(power(count(*), 1.0E0 / 3)))) AS BIGINT) AS block_length FROM {ledger} GROUP BY run_id, regime"
SQL["mc_export"] = "SELECT run_id, trade_key, line, part_key, supp_key, side, entry_day, exit_day, net_r, net_r AS net_R_alias, notional_u, net_u FROM {ledger} WHERE net_r IS NOT NULL"
SQL["mc_export_counts"] = "SELECT run_id, count(net_r) AS exported, count(*) FILTER (WHERE net_r IS NULL) AS skipped FROM {ledger} GROUP BY run_id"
SQL["mc_summary"] = """
WITH o AS (SELECT run_id, net_r, row_number() OVER (PARTITION BY run_id ORDER BY net_r) - 1 AS k, count(*) OVER (PARTITION BY run_id) AS n FROM {ledger})
SELECT run_id, max(n) AS n, round(avg(net_r), 6) AS mean, round(max(CASE WHEN k = floor(n / 2) THEN net_r END), 9) AS upper_median, round(min(net_r), 9) AS least, round(max(net_r), 9) AS most FROM o GROUP BY run_id"""
SQL["run_comparison"] = """
WITH s AS (SELECT run_id, CAST(sum(net_u) AS BIGINT) AS net_u, avg(net_r) AS mean_r FROM {ledger} GROUP BY run_id)
SELECT a.run_id AS run_a, b.run_id AS run_b, b.net_u - a.net_u AS net_delta, round(b.mean_r - a.mean_r, 6) AS mean_r_delta FROM s a JOIN s b ON a.run_id < b.run_id"""
SQL["ledger_integrity"] = """
SELECT run_id, count(*) AS trades, count(*) FILTER (WHERE gross_u - cost_u <> net_u) AS residual, count(*) FILTER (WHERE exit_day <= entry_day) AS not_held, count(*) FILTER (WHERE risk_u <= 0) AS no_risk, bool_and(gross_u - cost_u = net_u) AS reconciles FROM {ledger} GROUP BY run_id"""
SQL["audit_sample"] = """
SELECT run_id, exit_reason, trade_key, line, part_key, supp_key FROM (SELECT *, row_number() OVER (PARTITION BY run_id, exit_reason ORDER BY trade_key * 7919 % 10007, trade_key, line, part_key, supp_key) AS r FROM {ledger}) t WHERE r <= 5"""
SQL["evidence_verdict"] = """
WITH s AS (SELECT run_id, count(*) AS n, avg(net_r) AS mean_r, stddev_samp(net_r) / sqrt(count(*)) AS se FROM {ledger} GROUP BY run_id)
SELECT run_id, n, CASE WHEN n < 30 THEN 'insufficient' WHEN mean_r > 2 * se THEN 'positive' WHEN mean_r < -2 * se THEN 'negative' ELSE 'inconclusive' END AS verdict FROM s"""
SQL["stage_ladder"] = """
WITH f AS (SELECT count(*) AS s0, count(*) FILTER (WHERE side = 'long') AS s1, count(*) FILTER (WHERE side = 'long' AND gross_u > 0) AS s2, count(*) FILTER (WHERE side = 'long' AND net_u > 0) AS s3 FROM {ledger}),
l AS (SELECT 0 AS stage, s0 AS n FROM f UNION ALL SELECT 1 AS stage, s1 AS n FROM f UNION ALL SELECT 2 AS stage, s2 AS n FROM f UNION ALL SELECT 3 AS stage, s3 AS n FROM f)
SELECT CAST(stage AS BIGINT) AS stage, n, n - lag(n) OVER (ORDER BY stage) AS change, round(n * 1.0E0 / lag(n) OVER (ORDER BY stage), 9) AS share FROM l"""


# -- queries whose SQL would hold a run, or all values of a group, in one task ----------

#: Shares of r_distribution.
SHARES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
#: Basis points of bps_sensitivity.
BPS = (10.0, 26.0, 39.0, 52.0)


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FRAMES["ledger"][0](spark, sf_dir)


def r_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(_trades(spark, sf_dir).select("run_id", "side", "net_r"), "net-r")
    stats = rows.groupBy("run_id", "side").agg(F.count("*").alias("n"), F.round(F.avg("net_r"), 6).alias("mean"), F.round(F.stddev_samp("net_r"), 6).alias("sd")).where("n >= 30")
    found = quantiles(rows, ["run_id", "side"], "net_r", SHARES).select(F.col("run_id").alias("__run"), F.col("side").alias("__side"), "q")
    joined = stats.join(found, F.col("run_id").eqNullSafe(F.col("__run")) & F.col("side").eqNullSafe(F.col("__side")), "left")
    return joined.select("run_id", "side", "n", "mean", "sd", *[F.round(F.col("q")[j], 6).alias(f"p{int(q * 100):02d}") for j, q in enumerate(SHARES)])


def bps_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(_trades(spark, sf_dir).select("notional_u", "risk_u"), "costs")
    costs = rows.withColumn("bps", F.explode(F.array(*map(F.lit, BPS)))).select("bps", F.expr("bps * notional_u / 10000E0 / risk_u").alias("cost_r"))
    counts = costs.groupBy("bps").agg(F.count("*").alias("trades"), F.count_if(F.col("cost_r") <= 0.2).alias("passing"))
    return counts.join(quantiles(costs, ["bps"], "cost_r", [0.5]), "bps", "left").select("bps", "trades", "passing", F.round(F.col("q")[0], 6).alias("median_cost_r"))


def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("net_u") > 0, 1).when(F.col("net_u") < 0, -1).otherwise(0)
    found = longest_streaks(_trades(spark, sf_dir), "run_id", _ORDER.split(", "), sign)
    return found.select("run_id", F.col("wins").alias("longest_wins"), F.col("losses").alias("longest_losses"))


def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = _ORDER.split(", ")
    rows = cut(_trades(spark, sf_dir).select("run_id", "net_r", *order), "net-r")
    means = rows.groupBy(F.col("run_id").alias("__run")).agg(F.avg("net_r").alias("mu"))
    found = lag_sums(rows.join(F.broadcast(means), F.col("run_id") == F.col("__run")), "run_id", order, F.col("net_r") - F.col("mu"))
    lags = [F.round(F.col("sums")[j] / F.nullif("squares", F.lit(0.0)), 6).alias(f"lag{j + 1}") for j in range(LAGS)]
    return found.select("run_id", "n", *lags, F.round(2 / F.sqrt("n"), 9).alias("threshold"))


def stage_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of all stages are taken in one pass; the window has a row for each stage."""
    long_ = F.col("side") == "long"
    counts = _trades(spark, sf_dir).agg(F.count("*").alias("s0"), F.count_if(long_).alias("s1"), F.count_if(long_ & (F.col("gross_u") > 0)).alias("s2"), F.count_if(long_ & (F.col("net_u") > 0)).alias("s3"))
    stages = counts.select(F.posexplode(F.array("s0", "s1", "s2", "s3")).alias("stage", "n"))
    was = F.lag("n").over(Window.orderBy("stage"))
    return stages.select(F.col("stage").cast("long").alias("stage"), "n", (F.col("n") - was).alias("change"), F.round(F.col("n") * F.lit(1.0) / was, 9).alias("share"))


QUERIES = {"r_distribution": r_distribution, "bps_sensitivity": bps_sensitivity, "streaks": streaks, "autocorrelation": autocorrelation, "stage_ladder": stage_ladder}
