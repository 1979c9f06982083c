"""Block bootstraps of trade statistics and matched random controls, drawn from hashes.

A draw is a hash of a seed, a group and its number, so every engine and every
partitioning draws the same; what is resampled are sums of blocks, a row each,
never trades.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.simulation import false_discovery
from barloom.plans.sql import spark_query, with_tables
from barloom.runtime import cut, prefix_sums

RESAMPLES, SEED, BLOCK_DAYS = 2000, 20240101, 14
#: Hexadecimal digits of a hash that make a number.
_DIGITS = 15


def hashed(*parts: Column | str | int) -> Column:
    """A number below 2^60 from the MD5 of the parts as text."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") if isinstance(p, str) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("long")


def _hashed_sql(*parts: str) -> str:
    return f"CAST(concat('0x', substr(md5(concat_ws(':', {', '.join(parts)})), 1, {_DIGITS})) AS BIGINT)"


# -- block bootstrap ----------------------------------------------------------


def blocks(rows: DataFrame, group: str, block: str, value: str) -> DataFrame:
    """(g, at, n, wins, gain, loss): sums of each block, numbered from 0 in order of block within its group.

    ``value`` is a whole number; null ones are no trades. Summed before the shuffle.
    """
    v = F.col("v")
    sums = rows.select(F.col(group).alias("g"), F.col(block).alias("b"), F.col(value).cast("long").alias("v")).where("v is not null").groupBy("g", "b").agg(
        F.count("*").alias("n"), F.count_if(v > 0).alias("wins"), F.sum(F.greatest(v, F.lit(0))).alias("gain"), F.sum(F.least(v, F.lit(0))).alias("loss")
    )
    return prefix_sums(sums, ["b"], {"at": F.lit(1).cast("long")}, keys=["g"], tag="blocks").drop("b")


def draws(sums: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(g, r, at): for each resample as many draws of whole blocks, with replacement, as the group has blocks."""
    sizes = sums.groupBy("g").agg(F.count("*").alias("m"))
    each = sums.select("g", F.col("at").alias("j")).join(sizes, "g").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    return each.select("g", "r", (hashed(seed, "g", "r", "j") % F.col("m")).alias("at"))


def block_bootstrap(rows: DataFrame, group: str, block: str, value: str, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """A row for each group: mean, win rate, profit factor and total of ``value``, each with a 95 % percentile interval, and a p-value.

    Whole blocks (episodes, fixed spans of days, calendar months) are drawn with
    replacement, as many as the group has, so that trades that hang together stay
    together. ``value`` is a whole number. The profit factor is the sum of gains over
    that of losses; resamples without losses have none and stay out of its interval.
    The p-value of the mean is (extreme + 1) / (resamples + 1), where the extreme
    resamples are those whose mean is at least as far from 0 as the observed one;
    they are not centred. It is null for fewer than two trades.
    Columns: the group, n, n_blocks, mean, lower, upper, win_rate, win_lower,
    win_upper, profit_factor, pf_lower, pf_upper, total, total_lower, total_upper,
    p_value. A group of one block has intervals of no width. No rows give no groups.
    """
    sums = cut(blocks(rows, group, block, value), "block-sums")
    drawn = draws(sums, resamples, seed).join(sums, ["g", "at"]).groupBy("g", "r").agg(*[F.sum(c).alias(c) for c in ("n", "wins", "gain", "loss")])
    mean, rate = (F.col("gain") + F.col("loss")) / F.col("n"), F.col("wins") / F.col("n")
    factor = F.when(F.col("loss") < 0, F.col("gain") / -F.col("loss"))
    total = F.col("gain") + F.col("loss")
    point = sums.groupBy("g").agg(F.count("*").alias("n_blocks"), *[F.sum(c).alias(c) for c in ("n", "wins", "gain", "loss")]).select(
        "g", "n", "n_blocks", mean.alias("mean"), rate.alias("win_rate"), factor.alias("profit_factor"), total.alias("total")
    )
    replicas = drawn.select("g", mean.alias("m"), rate.alias("w"), factor.alias("f"), total.cast("double").alias("t")).join(point.select("g", F.col("mean").alias("seen")), "g")
    ends = {"m": ("lower", "upper"), "w": ("win_lower", "win_upper"), "f": ("pf_lower", "pf_upper"), "t": ("total_lower", "total_upper")}
    spread = replicas.groupBy("g").agg(
        *[F.percentile(c, F.lit(q)).alias(name) for c, names in ends.items() for q, name in zip((0.025, 0.975), names)],
        F.count_if(F.round(F.abs("m"), 6) >= F.round(F.abs("seen"), 6)).alias("extreme"),
    )
    rounded = ["mean", "lower", "upper", "win_rate", "win_lower", "win_upper", "profit_factor", "pf_lower", "pf_upper"]
    out = point.join(spread, "g").withColumns({c: F.round(c, 6) for c in rounded} | {c: F.round(c, 3) for c in ("total_lower", "total_upper")})
    return out.select(
        F.col("g").alias(group), "n", "n_blocks", *rounded, "total", "total_lower", "total_upper",
        F.when(F.col("n") >= 2, F.round((F.col("extreme") + 1) / F.lit(resamples + 1), 9)).alias("p_value"),
    )


#: Name of a block -> its number, from the day of a trade's exit.
BLOCKS = {"days": f"CAST(floor(exit_day / {BLOCK_DAYS}) AS BIGINT)", "month": "exit_month"}


def _bootstrap_query(kind: str):
    return lambda spark, sf_dir: block_bootstrap(spark_query(f"SELECT run_id, {BLOCKS[kind]} AS block, net_u FROM {{ledger}}")(spark, sf_dir), "run_id", "block", "net_u")


#: A run's longs and shorts apart.
_CELL = "concat(run_id, '/', side)"


def benjamini_hochberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month-block p-values of each run's longs and shorts, adjusted together."""
    rows = spark_query(f"SELECT {_CELL} AS cell, exit_month, net_u FROM {{ledger}}")(spark, sf_dir)
    tests = block_bootstrap(rows, "cell", "exit_month", "net_u").select("cell", "n", "mean", "p_value")
    return false_discovery(tests, "p_value", ["cell"]).withColumn("q", F.round("q", 9))


def bootstrap_body(source: str, name: str, then: str = "SELECT * FROM found") -> str:
    """The same over rows (g, block, v) of ``source``, as SQL over the base tables."""
    ends = {"m": ("lower", "upper"), "w": ("win_lower", "win_upper"), "f": ("pf_lower", "pf_upper")}
    quantiles = ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {name}" for c, names in ends.items() for q, name in zip((0.025, 0.975), names))
    stats = "(gain + loss)::DOUBLE / n AS m, wins::DOUBLE / n AS w, CASE WHEN loss < 0 THEN gain::DOUBLE / -loss::DOUBLE END AS f, (gain + loss)::DOUBLE AS t"
    return f"""WITH sums AS MATERIALIZED (
  SELECT g, block, row_number() OVER (PARTITION BY g ORDER BY block) - 1 AS k, count(*) AS n, count(*) FILTER (WHERE v > 0) AS wins,
         CAST(sum(greatest(v, 0)) AS BIGINT) AS gain, CAST(sum(least(v, 0)) AS BIGINT) AS loss FROM ({source}) WHERE v IS NOT NULL GROUP BY g, block),
sizes AS (SELECT g, count(*) AS m FROM sums GROUP BY g),
drawn AS (SELECT g, r, {_hashed_sql(f"'{SEED}'", 'g', 'CAST(r AS VARCHAR)', 'CAST(k AS VARCHAR)')} % m AS k FROM sums JOIN sizes USING (g), range({RESAMPLES}) x(r)),
replicas AS (
  SELECT g, r, {stats} FROM (SELECT g, r, sum(n) AS n, sum(wins) AS wins, CAST(sum(gain) AS BIGINT) AS gain, CAST(sum(loss) AS BIGINT) AS loss FROM drawn JOIN sums USING (g, k) GROUP BY g, r)),
point AS (SELECT g, n, n_blocks, gain + loss AS total, {stats} FROM (SELECT g, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_blocks, sum(wins) AS wins, CAST(sum(gain) AS BIGINT) AS gain, CAST(sum(loss) AS BIGINT) AS loss FROM sums GROUP BY g)),
spread AS (SELECT g, {quantiles}, round(quantile_cont(t, 0.025), 3) AS total_lower, round(quantile_cont(t, 0.975), 3) AS total_upper FROM replicas GROUP BY g),
tails AS (SELECT replicas.g, count(*) FILTER (WHERE round(abs(replicas.m), 6) >= round(abs(point.m), 6)) AS extreme FROM replicas JOIN point USING (g) GROUP BY replicas.g),
found AS (
SELECT g AS {name}, n, n_blocks, round(m, 6) AS mean, lower, upper, round(w, 6) AS win_rate, win_lower, win_upper, round(f, 6) AS profit_factor, pf_lower, pf_upper, total, total_lower, total_upper,
       CASE WHEN n >= 2 THEN round((extreme + 1)::DOUBLE / {RESAMPLES + 1}, 9) END AS p_value FROM point JOIN spread USING (g) JOIN tails USING (g))
{then}"""


def bootstrap_sql(kind: str, group: str = "run_id", name: str = "run_id", then: str = "SELECT * FROM found") -> str:
    return with_tables(bootstrap_body(f"SELECT {group} AS g, {BLOCKS[kind]} AS block, net_u AS v FROM {{ledger}}", name, then))


# -- matched control ----------------------------------------------------------

#: Span of a stratum, seeds of the control, and bars that returns look ahead.
SPAN_MS, SEEDS, HORIZONS = 30 * 86_400_000, (1, 2, 3), (1, 3, 6, 12)


def matched_sample(events: DataFrame, universe: DataFrame, key: str, strata: list[str], seed: int) -> DataFrame:
    """As many rows of ``universe`` in each stratum as it has different events, none of them an event's own.

    Without replacement: the rows of least hash of seed, stratum and key. So the
    same rows are drawn whatever the partitions, and a row keeps its place when
    others come. A stratum with too few rows gives all it has. ``universe`` has one
    row for each stratum and key. Events with nulls in either are no events.
    """
    own = events.select(*strata, key).dropna().distinct()
    wanted = own.groupBy(*strata).agg(F.count("*").alias("__wanted"))
    free = universe.join(own, [*strata, key], "left_anti").join(wanted, strata)
    ranked = prefix_sums(free.withColumn("__hash", hashed(seed, *strata, key)), ["__hash", key], {"__at": F.lit(1).cast("long")}, keys=strata, tag="matched")
    return ranked.where("__at < __wanted").drop("__hash", "__at", "__wanted")


_UNIVERSE = f"""SELECT symbol, CAST(floor(open_ms / {SPAN_MS}) AS BIGINT) AS span, i, c,
  {', '.join(f'lead(c, {h}) OVER (PARTITION BY symbol ORDER BY i) - c AS move_{h}' for h in HORIZONS)} FROM {{bars_1h}}"""


def _events_sql() -> str:
    from barloom.operators.events import SQL

    return f"SELECT d.symbol, u.span, d.i FROM ({SQL['displacement']}) d JOIN ({_UNIVERSE}) u ON u.symbol = d.symbol AND u.i = d.i"


def _drawn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    universe = cut(spark_query(_UNIVERSE)(spark, sf_dir), "universe")
    events = cut(spark_query(_events_sql())(spark, sf_dir), "events")
    drawn = [matched_sample(events, universe, "i", ["symbol", "span"], s).withColumn("seed", F.lit(s)) for s in SEEDS]
    out = drawn[0]
    for more in drawn[1:]:
        out = out.unionByName(more)
    return out, events.join(universe, ["symbol", "span", "i"])


def matched_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars drawn for the displacements of each symbol and 30 days, by seed."""
    return _drawn(spark, sf_dir)[0].select("seed", "symbol", "span", "i")


def control_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seed, horizon, n, mean_move): moves after the drawn bars of each seed, and after the events as seed 0."""
    drawn, events = _drawn(spark, sf_dir)
    rows = drawn.unionByName(events.withColumn("seed", F.lit(0)))
    moves = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"move_{h}").alias("move")) for h in HORIZONS])
    rows = rows.select("seed", F.explode(moves).alias("x")).select("seed", "x.*").where("move is not null")
    # Prices are whole cents, so their sums are exact.
    return rows.groupBy("seed", "horizon").agg(F.count("*").alias("n"), F.sum(F.round(F.col("move") * 100).cast("long")).alias("cents")).select("seed", "horizon", "n", F.round(F.col("cents") / F.col("n") / 100, 6).alias("mean_move"))


def _control_sql() -> str:
    seeds = ", ".join(f"({s})" for s in SEEDS)
    pick = _hashed_sql("CAST(seed AS VARCHAR)", "u.symbol", "CAST(u.span AS VARCHAR)", "CAST(u.i AS VARCHAR)")
    return f"""u AS MATERIALIZED ({_UNIVERSE}), e AS MATERIALIZED (SELECT DISTINCT symbol, span, i FROM ({_events_sql()})), wanted AS (SELECT symbol, span, count(*) AS n FROM e GROUP BY ALL),
free AS (SELECT u.*, seed, n, row_number() OVER (PARTITION BY seed, u.symbol, u.span ORDER BY {pick}, u.i) AS r FROM u JOIN wanted USING (symbol, span), (VALUES {seeds}) s(seed)
  WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.symbol = u.symbol AND e.span = u.span AND e.i = u.i)),
drawn AS (SELECT * FROM free WHERE r <= n)"""


_ADJUSTED = """SELECT cell, n, mean, p_value, round(least(1.0, min(p_value * m / k) OVER (ORDER BY k DESC)), 9) AS q
FROM (SELECT *, row_number() OVER (ORDER BY p_value, cell) AS k, count(*) OVER () AS m FROM found)"""
QUERIES = {f"block_bootstrap_{k}": _bootstrap_query(k) for k in BLOCKS} | {"benjamini_hochberg": benjamini_hochberg, "matched_control": matched_control, "control_comparison": control_comparison}
ORACLES = {f"block_bootstrap_{k}": bootstrap_sql(k) for k in BLOCKS} | {
    "benjamini_hochberg": bootstrap_sql("month", _CELL, "cell", _ADJUSTED),
    "matched_control": with_tables(f"WITH {_control_sql()} SELECT CAST(seed AS INTEGER) AS seed, symbol, span, i FROM drawn"),
    "control_comparison": with_tables(f"""WITH {_control_sql()},
moves AS (SELECT seed, unnest([{', '.join(map(str, HORIZONS))}]) AS horizon, unnest([{', '.join(f'move_{h}' for h in HORIZONS)}]) AS move FROM (
  SELECT seed, {', '.join(f'move_{h}' for h in HORIZONS)} FROM drawn UNION ALL SELECT 0, {', '.join(f'move_{h}' for h in HORIZONS)} FROM e JOIN u USING (symbol, span, i)))
SELECT CAST(seed AS INTEGER) AS seed, CAST(horizon AS INTEGER) AS horizon, count(*) AS n, round(sum(CAST(round(move * 100) AS BIGINT))::DOUBLE / count(*) / 100, 6) AS mean_move FROM moves WHERE move IS NOT NULL GROUP BY ALL"""),
}
