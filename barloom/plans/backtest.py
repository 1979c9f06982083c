"""Event-driven backtests: signals are window columns, positions a fold per symbol and strategy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.sources.frames import FRAMES


@dataclass(frozen=True)
class Costs:
    fee: float = 0.001
    spread: float = 0.0002
    slippage: float = 0.0001
    latency: int = 1

    def fill(self, price: float, buys: bool) -> float:
        rate = self.spread + self.slippage
        return round(price * (1 + rate if buys else 1 - rate), 6)


@dataclass(frozen=True)
class Risk:
    """Limits that stop new entries; a fraction of 1 or more means none."""

    per_trade: float = 0.01
    max_drawdown: float = 1.0
    cooldown: int = 0
    max_bars: int = 240


#: name -> function of bars that adds ``enter`` and ``leave`` (booleans), ``stop`` and ``target``.
STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def strategy(name: str):
    """Register a strategy; a name is taken once."""

    def add(f):
        if name in STRATEGIES:
            raise ValueError(f"{name} is registered already")
        STRATEGIES[name] = f
        return f

    return add


def _along():
    return Window.partitionBy("symbol").orderBy("i")


def _with_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    before = F.lag("c").over(_along())
    tr = F.coalesce(F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - before), F.abs(F.col("l") - before)), F.col("h") - F.col("l"))
    return bars.withColumn("tr", tr).withColumn("atr", F.when(F.col("i") >= n, F.avg("tr").over(_along().rowsBetween(1 - n, 0)))).drop("tr")


@strategy("buy_and_hold")
def buy_and_hold(bars: DataFrame) -> DataFrame:
    none = F.lit(None).cast("double")
    return bars.withColumns({"enter": F.col("i") == 0, "leave": F.lit(False), "stop": none, "target": none})


@strategy("sma_trend")
def sma_trend(bars: DataFrame, fast: int = 20, slow: int = 50) -> DataFrame:
    b = _with_atr(bars)
    f, s = (F.when(F.col("i") >= n - 1, F.avg("c").over(_along().rowsBetween(1 - n, 0))) for n in (fast, slow))
    b = b.withColumn("up", F.coalesce(f > s, F.lit(False)))
    was = F.coalesce(F.lag("up").over(_along()), F.lit(False))
    return b.withColumns({"enter": F.col("up") & ~was, "leave": ~F.col("up") & was, "stop": F.col("c") - 2 * F.col("atr"), "target": F.col("c") + 3 * F.col("atr")})


@strategy("donchian_breakout")
def donchian_breakout(bars: DataFrame, n: int = 20, out: int = 10) -> DataFrame:
    b = _with_atr(bars)
    hi, lo = F.max("h").over(_along().rowsBetween(-n, -1)), F.min("l").over(_along().rowsBetween(-out, -1))
    return b.withColumns({"enter": (F.col("i") >= n) & (F.col("c") > hi), "leave": (F.col("i") >= n) & (F.col("c") < lo), "stop": F.col("c") - 2 * F.col("atr"), "target": F.lit(None).cast("double")})


@strategy("random")
def random_entries(bars: DataFrame, every: int = 40, seed: int = 7) -> DataFrame:
    b = _with_atr(bars)
    draw = F.pmod(F.xxhash64("symbol", "i", F.lit(seed)), F.lit(every))
    return b.withColumns({"enter": draw == 0, "leave": draw == 1, "stop": F.col("c") - 1.5 * F.col("atr"), "target": F.col("c") + 1.5 * F.col("atr")})


def resolve_bar(o: float, h: float, low: float, stop: float | None, target: float | None) -> tuple[str, float] | None:
    """Exit of a long position within a bar: a gap through the stop, then one through the target, then the stop, then the target."""
    if stop is not None and o <= stop:
        return "stop_gap", o
    if target is not None and o >= target:
        return "target_gap", o
    if stop is not None and low <= stop:
        return "stop", stop
    if target is not None and h >= target:
        return "target", target
    return None


TRADES = "strategy string, symbol string, entry_i long, exit_i long, entry double, exit double, size double, fees double, net double, r double, mae double, mfe double, reason string"


def backtest(signals: DataFrame, costs: Costs = Costs(), risk: Risk = Risk(), capital: float = 10_000.0) -> DataFrame:
    """Trades of one long position at a time for each (strategy, symbol).

    A signal on a bar is filled at the open ``latency`` bars later; the position is
    marked, then its barriers and time limit are looked at, then a close signal's
    fill, then an entry's. What is open at the end closes at the last close.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("i")
        name, symbol = g["strategy"].iloc[0], g["symbol"].iloc[0]
        cash, peak, last_exit = capital, capital, None
        held, enter_at, leave_at, rows = None, None, None, []

        def close(i: int, raw: float, reason: str) -> None:
            nonlocal cash, held, leave_at, last_exit
            price = costs.fill(raw, False)
            fees = held["fee"] + price * held["size"] * costs.fee
            net = (price - held["entry"]) * held["size"] - fees
            at_risk = (held["entry"] - held["stop"]) * held["size"] if held["stop"] is not None else None
            rows.append((name, symbol, held["i"], i, held["entry"], price, held["size"], fees, net, net / at_risk if at_risk and at_risk > 0 else None, held["mae"], held["mfe"], reason))
            cash += net
            held, leave_at, last_exit = None, None, i

        for i, o, h, low, c, enter, leave, stop, target in g[["i", "o", "h", "l", "c", "enter", "leave", "stop", "target"]].itertuples(index=False):
            if held:
                held["mae"], held["mfe"] = min(held["mae"], low - held["entry"]), max(held["mfe"], h - held["entry"])
                if leave_at is not None and i >= leave_at:
                    close(i, o, "signal")
                elif hit := resolve_bar(o, h, low, held["stop"], held["target"]):
                    close(i, hit[1], hit[0])
                elif i - held["i"] >= risk.max_bars and held["stop"] is not None:
                    close(i, c, "time")
            if not held and enter_at is not None and i >= enter_at[0]:
                _, s, t = enter_at
                entry = costs.fill(o, True)
                s = s if s is not None and s == s and s < entry else None
                t = t if t is not None and t == t and t > entry else None
                size = cash / (entry * (1 + costs.fee))
                if s is not None:
                    size = min(size, cash * risk.per_trade / (entry - s))
                if size > 0 and cash > 0:
                    held = {"i": i, "entry": entry, "stop": s, "target": t, "size": size, "fee": entry * size * costs.fee, "mae": min(0.0, low - entry), "mfe": max(0.0, h - entry)}
                    if hit := resolve_bar(entry, h, low, s, t):
                        close(i, hit[1], hit[0])
                enter_at = None
            peak = max(peak, cash)
            if held and leave:
                leave_at = i + costs.latency
            calm = last_exit is None or i - last_exit >= risk.cooldown
            if not held and enter and calm and cash > peak * (1 - risk.max_drawdown):
                enter_at = (i + costs.latency, stop, target)
        if held:
            close(int(g["i"].iloc[-1]), float(g["c"].iloc[-1]), "end")
        return pd.DataFrame(rows, columns=[c.split()[0] for c in TRADES.split(", ")])

    cols = ["strategy", "symbol", "i", "o", "h", "l", "c", "enter", "leave", "stop", "target"]
    return signals.select(*cols).groupBy("strategy", "symbol").applyInPandas(run, TRADES)


def run_backtests(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = FRAMES["bars_1h"][0](spark, sf_dir)
    signals = None
    for name, add in STRATEGIES.items():
        one = add(bars).select(F.lit(name).alias("strategy"), "symbol", "i", "o", "h", "l", "c", "enter", "leave", "stop", "target")
        signals = one if signals is None else signals.union(one)
    return backtest(signals)


def backtest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = run_backtests(spark, sf_dir)
    wins = F.sum(F.when(F.col("net") > 0, F.col("net")))
    losses = F.sum(F.when(F.col("net") < 0, -F.col("net")))
    return trades.groupBy("strategy", "symbol").agg(
        F.count("*").alias("trades"), F.sum("net").alias("net"), F.avg("r").alias("mean_r"), F.sum("fees").alias("fees"),
        (F.count_if(F.col("net") > 0) / F.count("*")).alias("win_rate"), (wins / F.nullif(losses, F.lit(0.0))).alias("profit_factor"),
        F.avg(F.col("exit_i") - F.col("entry_i")).alias("bars_held"),
    )


QUERIES = {"backtest_trades": run_backtests, "backtest_metrics": backtest_metrics}
