"""Trades of confirmed setups, and a spot portfolio that may hold several of them at once."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.folds import segments
from barloom.operators.setups import expansion_retests, pullbacks, with_path
from barloom.plans.backtest import Costs
from barloom.sources.frames import FRAMES

HORIZON, TARGET_R = 12, 2.0
LOT, LEAST_NOTIONAL = 1e-5, 5.0


def setup_trades(setups: DataFrame, bars: DataFrame, step_ms: int, horizon: int = HORIZON, target_r: float = TARGET_R) -> DataFrame:
    """(symbol, detectors, entry_i, exit_i, entry, stop, target, exit, kind): one trade for each bar and stop entered at.

    Setups that enter on the same bar with the same stop are one trade. The entry's
    bar is the first of ``horizon`` bars; in each the stop is looked at before the
    target, and a bar that opens past either leaves at its open. A trade that
    neither ends is closed at the last bar's close, or has no exit (open) if its
    segment stops before.
    """
    rows = segments(bars, step_ms)
    entries = setups.where("outcome = 'confirmed'").groupBy("symbol", (F.col("end_i") + 1).alias("i"), F.col("low").alias("stop")).agg(
        F.array_join(F.array_sort(F.collect_set("detector")), ",").alias("detectors"), F.first("entry").alias("entry")
    )
    at = rows.select("symbol", "segment", "k", "i")
    # The path starts one bar early, so that it holds the entry's own bar.
    starts = with_path(entries.join(at, ["symbol", "i"]).withColumn("k", F.col("k") - 1).dropDuplicates(["symbol", "i", "stop"]), rows, horizon)
    starts = starts.withColumn("target", F.col("entry") + target_r * (F.col("entry") - F.col("stop")))
    stop, target, path = F.col("stop"), F.col("target"), F.col("path")
    out = starts.withColumn("hit", F.get(F.filter(path, lambda b: (b["l"] <= stop) | (b["h"] >= target)), F.lit(0)))
    hit, last = F.col("hit"), F.get(path, F.lit(horizon - 1))
    kind = (
        F.when(hit.isNull(), F.when(last.isNull(), "open").otherwise("time")).when(hit["o"] <= stop, "stop_gap").when(hit["o"] >= target, "target_gap")
        .when(hit["l"] <= stop, "stop").otherwise("target")
    )
    price = F.when(hit.isNull(), last["c"]).when((hit["o"] <= stop) | (hit["o"] >= target), hit["o"]).when(hit["l"] <= stop, stop).otherwise(target)
    return out.select("symbol", "detectors", F.col("i").alias("entry_i"), F.coalesce(hit["i"], last["i"]).alias("exit_i"), "entry", "stop", "target", price.alias("exit"), kind.alias("kind"))


POSITIONS = "symbol string, detectors string, entry_i long, exit_i long, size double, entry_fill double, exit_fill double, fees double, net double, cash double, skipped string"


def portfolio(trades: DataFrame, costs: Costs = Costs(), capital: float = 10_000.0, risk: float = 0.01) -> DataFrame:
    """The positions taken, and the trades skipped, of a spot account for each symbol.

    At a bar's open entries come before the exits of the bar. A trade risks ``risk``
    of the equity at that open, cash and holdings together; if the cash falls short,
    all entries of the bar shrink alike. Sizes are whole lots; under the least
    notional a trade is skipped (too_small). Trades without an exit are skipped too
    (no_exit). cash is what the account holds after the exit. All trades share the
    cash, so the account is one fold; it takes a symbol's trades, not its bars.
    """

    def lots(size: float) -> float:
        return math.floor(size / LOT + 1e-9) * LOT

    def run(g: pd.DataFrame) -> pd.DataFrame:
        symbol, cash, held, rows = g["symbol"].iloc[0], capital, [], []

        def leave(until: int) -> None:
            nonlocal cash, held
            for p in sorted((p for p in held if p["exit_i"] < until), key=lambda p: (p["exit_i"], p["entry_i"], p["stop"])):
                fill = costs.fill(p["exit"], False)
                fee = fill * p["size"] * costs.fee
                cash += fill * p["size"] - fee
                net = (fill - p["fill"]) * p["size"] - fee - p["fee"]
                rows.append((symbol, p["detectors"], p["entry_i"], p["exit_i"], p["size"], p["fill"], fill, fee + p["fee"], net, cash, None))
            held = [p for p in held if p["exit_i"] >= until]

        for bar, wanted in g.sort_values(["entry_i", "stop"]).groupby("entry_i"):
            leave(bar)
            asked = []
            equity = cash + sum(p["size"] for p in held) * float(wanted["entry"].iloc[0])
            for t in wanted.to_dict("records"):
                fill = costs.fill(t["entry"], True)
                lost = fill * (1 + costs.fee) - costs.fill(t["stop"], False) * (1 - costs.fee)
                size = 0.0 if pd.isna(t["exit_i"]) or lost <= 0 else lots(max(0.0, min(equity * risk / lost, cash / (fill * (1 + costs.fee)))))
                asked.append((t, fill, size))
            need = sum(size * fill * (1 + costs.fee) for _, fill, size in asked)
            share = min(1.0, cash / need) if need > 0 else 1.0
            for t, fill, size in asked:
                size = lots(size * share) if share < 1 else size
                if size * fill < LEAST_NOTIONAL:
                    rows.append((symbol, t["detectors"], t["entry_i"], None, 0.0, fill, None, 0.0, 0.0, cash, "no_exit" if pd.isna(t["exit_i"]) else "too_small"))
                    continue
                fee = size * fill * costs.fee
                cash -= size * fill + fee
                held.append(t | {"exit_i": int(t["exit_i"]), "fill": fill, "size": size, "fee": fee})
        leave(1 << 62)
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in POSITIONS.split(", ")])
        return out.astype({"exit_i": "Int64"})

    return trades.select("symbol", "detectors", "entry_i", "exit_i", "entry", "stop", "exit").groupBy("symbol").applyInPandas(run, POSITIONS)


def canonical_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = FRAMES["bars_1h"][0](spark, sf_dir)
    found = [f(bars, 3_600_000).withColumn("detector", F.lit(n)) for n, f in (("pullback", pullbacks), ("expansion", expansion_retests))]
    return setup_trades(found[0].union(found[1]), bars, 3_600_000)


def portfolio_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio(canonical_trades(spark, sf_dir))


QUERIES = {"canonical_trades": canonical_trades, "portfolio_positions": portfolio_positions}
