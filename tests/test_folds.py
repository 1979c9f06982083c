"""Sequential operators against plain loops, and causality by prefixes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators.folds import clustered_levels, episodes, non_overlapping, wilder_and_ema
from barloom.operators.simulation import bootstrap_mean, draws
from barloom.plans.backtest import STRATEGIES, Costs, backtest, resolve_bar, strategy
from barloom.runtime import prefix_sums
from barloom.sources.frames import FRAMES


def series(spark, n=120, gap_at=60, seed=1):
    rng = random.Random(seed)
    rows, c, t = [], 100.0, 0
    for i in range(n):
        t += 3_600_000 * (3 if i == gap_at else 1)
        o, c = c, round(max(1, c + rng.uniform(-2, 2)), 2)
        h, low = round(max(o, c) + rng.random(), 2), round(min(o, c) - rng.random(), 2)
        rows.append(("X", i, n, t, t + 3_599_999, o, h, low, c, 10, 5))
    return spark.createDataFrame(rows, "symbol string, i long, n long, open_ms long, close_ms long, o double, h double, l double, c double, v long, tc long")


def test_wilder_restarts_at_a_gap(spark):
    out = {r["i"]: r for r in wilder_and_ema(series(spark), 3_600_000).collect()}
    assert out[12]["atr"] is None and out[13]["atr"] is not None
    assert out[60]["segment"] == out[59]["segment"] + 1
    assert all(out[i]["atr"] is None for i in range(60, 73)) and out[73]["atr"] is not None
    assert out[18]["ema"] is None and out[19]["ema"] is not None


def test_wilder_prefix_invariance(spark):
    bars = series(spark)
    full = {r["i"]: (r["atr"], r["ema"]) for r in wilder_and_ema(bars, 3_600_000).collect()}
    part = {r["i"]: (r["atr"], r["ema"]) for r in wilder_and_ema(bars.where("i < 40"), 3_600_000).collect()}
    assert all(full[i] == v for i, v in part.items())


def test_episodes_and_gaps(spark):
    events = spark.createDataFrame([("X", c) for c in (0, 5, 12, 13, 24, 26)], "symbol string, conf long")
    assert [r["episode"] for r in episodes(events).orderBy("conf").collect()] == [0, 0, 0, 1, 1, 2]
    assert [r["conf"] for r in non_overlapping(events).orderBy("conf").collect()] == [0, 12, 24]


def test_levels_join_the_earliest_bucket(spark):
    rows = [("X", "high", 0, 5, 100.0), ("X", "high", 3, 8, 100.1), ("X", "high", 9, 14, 100.2), ("X", "high", 12, 17, 100.19), ("X", "low", 4, 9, 100.0)]
    out = clustered_levels(spark.createDataFrame(rows, "symbol string, kind string, i long, conf long, price double")).orderBy("bucket").collect()
    assert [(r["price"], r["members"], r["created"]) for r in out] == [(100.0, 2, 8), (100.2, 2, 17)]


@pytest.mark.parametrize(
    "bar, want",
    [((90, 95, 85), ("stop_gap", 90)), ((120, 121, 119), ("target_gap", 120)), ((100, 120, 90), ("stop", 95)), ((100, 111, 99), ("target", 110)), ((100, 105, 99), None)],
)
def test_barrier_order(bar, want):
    assert resolve_bar(*bar, 95, 110) == want


def test_backtest_reconciles(spark):
    bars = series(spark, 200, seed=4)
    signals = STRATEGIES["sma_trend"](bars).withColumn("strategy", F.lit("s"))
    trades = backtest(signals, Costs()).collect()
    free = backtest(signals, Costs(0, 0, 0)).collect()
    assert trades and all(t["exit_i"] >= t["entry_i"] for t in trades)
    for t in [*trades, *free]:
        assert t["net"] == pytest.approx((t["exit"] - t["entry"]) * t["size"] - t["fees"])
    assert all(t["fees"] == 0 for t in free)
    with pytest.raises(ValueError):
        strategy("sma_trend")(lambda b: b)


def test_bootstrap_does_not_depend_on_partitions(spark):
    rows = spark.range(500).select(F.lit("g").alias("g"), (F.col("id") % 17 - 8).cast("double").alias("x"), F.col("id").alias("k"))
    a = bootstrap_mean(rows.repartition(3), "g", "x", "k").first()
    b = bootstrap_mean(rows.repartition(7), "g", "x", "k").first()
    assert a["low"] == pytest.approx(b["low"]) and a["low"] < a["mean"] < a["high"]
    import numpy as np

    w = draws(np.arange(2000), 50, 1)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05


def test_prefix_sums_with_and_without_keys(spark):
    rows = [(i % 3, i, i * 7 % 11) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, i long, x long").repartition(5)
    out = {r["i"]: (r["s"], r["n"]) for r in prefix_sums(df, ["i"], {"s": F.col("x"), "n": F.lit(1)}).collect()}
    assert all(out[i] == (sum(r[2] for r in rows[:i]), i) for _, i, _ in rows)
    keyed = {r["i"]: r["s"] for r in prefix_sums(df, ["i"], {"s": F.col("x")}, keys=["k"]).collect()}
    assert all(keyed[i] == sum(r[2] for r in rows[:i] if r[0] == k) for k, i, _ in rows)
    assert prefix_sums(df.limit(0), ["i"], {"s": F.col("x")}).count() == 0


def test_bars_cover_all_ticks(spark, sf_dir):
    ticks = FRAMES["ticks"][0](spark, sf_dir).count()
    assert FRAMES["bars_4h"][0](spark, sf_dir).agg(F.sum("tc")).first()[0] == ticks
