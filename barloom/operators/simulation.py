"""Bootstrap and Monte Carlo over a trade ledger.

Resamples are weights drawn from a hash of the trade and the resample's number, so
no task needs the whole sample, results do not depend on partitions, and the sums
that leave a task are one row for each run and resample.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.runtime import prefix_sums
from barloom.sources.frames import FRAMES

RESAMPLES, SEED = 2000, 20240101
#: Rows whose draws are held at once, few enough for a core's cache.
HELD = 32
#: Groups whose sums a task holds.
GROUPS = 64
#: Chances of 0, 1, 2 ... draws of one row in a resample of its own size.
_POISSON = np.cumsum(np.exp(-1) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880], float))
#: Draws by the 16 top bits of a hash, UNSURE where these do not tell.
UNSURE = 255
_EDGES = np.arange(1 << 16, dtype=np.uint64) << np.uint64(37)
_LEAST, _MOST = (np.searchsorted(_POISSON, (_EDGES + np.uint64(e)) / float(1 << 53), side="right") for e in (0, (1 << 37) - 1))
_DRAWS = np.where(_LEAST == _MOST, _LEAST, UNSURE).astype(float)


def draws(keys: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """(rows, resamples) Poisson(1) counts, as floats: splitmix64 of a counter, compared with the chances."""
    step = np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    x = keys.astype(np.uint64)[:, None] + step[None, :]
    y = x >> np.uint64(30)
    for shift, factor in ((27, 0xBF58476D1CE4E5B9), (48, 0x94D049BB133111EB)):
        x ^= y
        x *= np.uint64(factor)
        np.right_shift(x, np.uint64(shift), out=y)
    # The last step of the hash, x ^ (x >> 31), leaves the top bits as they are.
    w = _DRAWS.take(y.view(np.int64))
    at = np.nonzero(w == UNSURE)
    left = x[at]
    w[at] = np.searchsorted(_POISSON, ((left ^ (left >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53), side="right")
    return w


def resampled(parts, resamples: int, seed: int):
    """Frames (g, b, n, s): rows and sum of x that each resample b draws from the frames (g, x, n, k), once for a group where a task meets few."""
    held: dict = {}

    def frames():
        for g, (n, s) in held.items():
            yield pd.DataFrame({"g": g, "b": np.arange(resamples), "n": n.astype(np.int64), "s": s})
        held.clear()

    for p in parts:
        for g, rows in p.groupby("g"):
            if g not in held and len(held) == GROUPS:
                yield from frames()
            n, s = held.setdefault(g, (np.zeros(resamples), np.zeros(resamples)))
            keys, both = rows["k"].to_numpy(np.int64), rows[["n", "x"]].to_numpy(float).T
            for i in range(0, len(keys), HELD):
                more = both[:, i : i + HELD] @ draws(keys[i : i + HELD], resamples, seed)
                n += more[0]
                s += more[1]
    yield from frames()


def replicates(rows: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(g, b, m): the mean of each resample b of the rows (g, x, n, k); x is the sum of n values that are drawn together."""
    # The draws are dear and the rows small, so the rows are dealt by number of cores and not by size.
    dealt = rows.select("g", "x", "n", "k").repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "k")
    drawn = dealt.mapInPandas(lambda parts: resampled(parts, resamples, seed), "g string, b long, n long, s double")
    return drawn.groupBy("g", "b").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("m"))


def bootstrap_mean(values: DataFrame, group: str, value: str, key: str, resamples: int = RESAMPLES, seed: int = SEED, clustered: bool = False) -> DataFrame:
    """(group, n, mean, low, high, p_value): a 95 % percentile interval of the mean and its two-sided p-value.

    Rows with one key are drawn together; ``clustered`` says that many share theirs
    and sums them first. p is (extreme + 1) / (resamples + 1), as in :func:`paired_difference`.
    """
    rows = values.select(F.col(group).alias("g"), F.col(value).cast("double").alias("x"), F.col(key).cast("long").alias("k")).where("x is not null")
    point = rows.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
    alike = rows.groupBy("g", "k").agg(F.sum("x").alias("x"), F.count("*").alias("n")) if clustered else rows.withColumn("n", F.lit(1).cast("long"))
    spread = replicates(alike, resamples, seed).join(point.select("g", "mean"), "g").groupBy("g").agg(
        F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.count_if(F.abs("m") >= F.abs("mean")).alias("extreme")
    )
    p = F.when(F.col("n") >= 2, (F.col("extreme") + 1) / F.lit(resamples + 1))
    return point.join(spread, "g").select(F.col("g").alias(group), "n", "mean", "low", "high", p.alias("p_value"))


def paired_difference(events: DataFrame, baseline: DataFrame, group: str, value: str, order: list[str], resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(group, n, mean, low, high, p_value) of the events' mean less the baseline's, with both drawn by one index.

    The row at place j of the events goes with the baseline's at j modulo its
    length, places by ``order``. p is the share of resamples at least as far from 0
    as the difference itself, (extreme + 1) / (resamples + 1); they are not centred.
    Groups that one side lacks are left out; null values are not rows.
    """

    def placed(side: DataFrame, name: str) -> DataFrame:
        rows = side.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias(name), *[F.col(c).alias(f"o{j}") for j, c in enumerate(order)])
        by = [f"o{j}" for j in range(len(order))]
        return prefix_sums(rows, by, {"at": F.lit(1).cast("long")}, keys=["g"], tag=f"paired-{name}").drop(*by)

    e, b = placed(events, "ex"), placed(baseline, "bx")
    point = e.groupBy("g").agg(F.count("*").alias("n"), F.avg("ex").alias("em")).join(b.groupBy("g").agg(F.count("*").alias("nb"), F.avg("bx").alias("bm")), "g")
    rows = e.join(point.select("g", "nb"), "g").select("g", "ex", F.col("at").alias("k"), (F.col("at") % F.col("nb")).alias("at")).join(b, ["g", "at"])
    point = point.select("g", "n", (F.col("em") - F.col("bm")).alias("mean"))
    reps = replicates(rows.select("g", (F.col("ex") - F.col("bx")).alias("x"), F.lit(1).cast("long").alias("n"), "k"), resamples, seed).join(point, "g")
    spread = reps.groupBy("g", "n", "mean").agg(
        F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.count_if(F.abs("m") >= F.abs("mean")).alias("extreme")
    )
    p = F.when(F.col("n") >= 2, (F.col("extreme") + 1) / F.lit(resamples + 1))
    return spread.select(F.col("g").alias(group), "n", "mean", "low", "high", p.alias("p_value"))


def bootstrap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = FRAMES["ledger"][0](spark, sf_dir)
    key = F.xxhash64("trade_key", "line", "part_key", "supp_key", "net_u", "notional_u")
    return bootstrap_mean(trades.withColumn("key", key), "run_id", "net_r", "key")


def clustered_bootstrap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bootstrap_runs, with whole entry months drawn together."""
    trades = FRAMES["ledger"][0](spark, sf_dir)
    return bootstrap_mean(trades.withColumn("key", F.xxhash64("run_id", "entry_month")), "run_id", "net_r", "key", clustered=True)


def paired_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long trades against short ones of the same run, in the ledger's order."""
    trades = FRAMES["ledger"][0](spark, sf_dir)
    order = ["exit_day", "entry_day", "trade_key", "line", "part_key", "supp_key", "net_u", "notional_u", "cost_u"]
    return paired_difference(trades.where("side = 'long'"), trades.where("side = 'short'"), "run_id", "net_r", order)


def false_discovery(tests: DataFrame, p: str, order: list[str]) -> DataFrame:
    """``tests`` with q: the Benjamini-Hochberg adjusted p-values, ties by ``order``.

    A p-value that is null or outside (0, 1] is no test: it keeps its row, with a null
    q, and does not count. There is a row for each cell that was tested, whatever the
    trades, so one task ranks them.
    """
    valid = F.coalesce((F.col(p) > 0) & (F.col(p) <= 1), F.lit(False))
    alike = Window.partitionBy("__valid")
    ranked = tests.withColumn("__valid", valid).withColumns({"__rank": F.row_number().over(alike.orderBy(p, *order)), "__tests": F.count("*").over(alike)})
    later = alike.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("__tests") / F.col("__rank")).over(later))
    return ranked.withColumn("q", F.when(F.col("__valid"), q)).drop("__valid", "__rank", "__tests")


def monte_carlo_paths(spark: SparkSession, sf_dir: str, paths: int = 200, block: int = 10, fraction: float = 0.001) -> DataFrame:
    """Circular block bootstrap of each run's daily R, compounded: terminal wealth and drawdown by run.

    A group has one row for each day of the run, whatever the trades.
    """
    daily = FRAMES["ledger"][0](spark, sf_dir).groupBy("run_id", "exit_day").agg(F.sum("net_r").alias("r"))
    batches = daily.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(3))))

    def simulate(g: pd.DataFrame) -> pd.DataFrame:
        r = g.sort_values("exit_day")["r"].to_numpy()
        run, batch = g["run_id"].iloc[0], int(g["batch"].iloc[0])
        rng = np.random.default_rng([SEED, batch])
        n, k = len(r), paths // 4
        at = (rng.integers(0, n, (k, -(-n // block)))[:, :, None] + np.arange(block)).reshape(k, -1)[:, :n] % n
        wealth = np.cumprod(np.maximum(0, 1 + r[at] * fraction), axis=1)
        peak = np.maximum.accumulate(np.maximum(wealth, 1), axis=1)
        return pd.DataFrame({"run_id": run, "path": batch * k + np.arange(k), "terminal": wealth[:, -1], "drawdown": (1 - wealth / peak).max(axis=1)})

    sims = batches.groupBy("run_id", "batch").applyInPandas(simulate, "run_id string, path long, terminal double, drawdown double")
    return sims.groupBy("run_id").agg(
        F.count("*").alias("paths"), F.percentile("terminal", F.lit(0.5)).alias("median_terminal"), F.percentile("terminal", F.lit(0.05)).alias("low_terminal"),
        F.percentile("drawdown", F.lit(0.95)).alias("drawdown_95"), F.avg(F.when(F.col("terminal") < 1, 1.0).otherwise(0.0)).alias("loss_probability"),
    )


QUERIES = {"bootstrap_runs": bootstrap_runs, "clustered_bootstrap_runs": clustered_bootstrap_runs, "paired_sides": paired_sides, "monte_carlo_paths": monte_carlo_paths}
