"""Operators that are sequential by nature, as grouped maps over one series or segment.

The groups are kept short: a contiguous segment of bars, or the swings or events of
a symbol, never its ticks.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators.structure import swings_sql
from barloom.plans.sql import spark_query
from barloom.sources.frames import FRAMES


def segments(bars: DataFrame, step_ms: int) -> DataFrame:
    """``bars`` with ``segment``, which grows wherever a bar is missing, and ``k``, the index in it."""
    w = Window.partitionBy("symbol").orderBy("i")
    starts = F.when(F.col("open_ms") - F.lag("open_ms").over(w) == step_ms, 0).otherwise(1)
    out = bars.withColumn("starts", starts).withColumn("segment", F.sum("starts").over(w).cast("long")).drop("starts")
    return out.withColumn("k", (F.row_number().over(Window.partitionBy("symbol", "segment").orderBy("i")) - 1).cast("long"))


def wilder_and_ema(bars: DataFrame, step_ms: int, n: int = 14, ema_n: int = 20) -> DataFrame:
    """(symbol, i, segment, atr, ema): Wilder's ATR and an EMA with a mean as its seed, restarted at each gap.

    Both are null until a segment has n (ema_n) bars. A segment's first true range
    is its bar's own range. Segments too short for either share one group of their
    symbol, so that bars with many gaps do not make a call for each.
    """
    short = -1

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("i")
        if g["part"].iloc[0] == short:
            none = pd.array([None] * len(g), "Float64")
            return pd.DataFrame({"symbol": g["symbol"].array, "i": g["i"].array, "segment": g["segment"].array, "atr": none, "ema": none})
        before = g["c"].shift()
        tr = pd.concat([g["h"] - g["l"], (g["h"] - before).abs(), (g["l"] - before).abs()], axis=1).max(axis=1).tolist()
        close = g["c"].tolist()
        atr, ema, a, e = [], [], None, None
        for k, (t, c) in enumerate(zip(tr, close)):
            if k == n - 1:
                a = sum(tr[:n]) / n
            elif k >= n:
                a = ((n - 1) * a + t) / n
            if k == ema_n - 1:
                e = sum(close[:ema_n]) / ema_n
            elif k >= ema_n:
                e += (c - e) * 2 / (ema_n + 1)
            atr.append(a)
            ema.append(e)
        return pd.DataFrame({"symbol": g["symbol"], "i": g["i"], "segment": g["segment"], "atr": pd.array(atr, "Float64").round(6), "ema": pd.array(ema, "Float64").round(6)})

    size = F.count("*").over(Window.partitionBy("symbol", "segment"))
    rows = segments(bars, step_ms).select("symbol", "i", "segment", "h", "l", "c", F.when(size < min(n, ema_n), short).otherwise(F.col("segment")).alias("part"))
    return rows.groupBy("symbol", "part").applyInPandas(fold, "symbol string, i long, segment long, atr double, ema double")


def episodes(events: DataFrame, horizon: int = 12) -> DataFrame:
    """(symbol, conf, episode): an event past the reach of an episode's first one begins the next."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("conf")
        out, reach, e = [], None, -1
        for c in g["conf"]:
            if reach is None or c > reach:
                e, reach = e + 1, c + horizon
            out.append(e)
        return g.assign(episode=out)

    return events.select("symbol", "conf").groupBy("symbol").applyInPandas(fold, "symbol string, conf long, episode long")


def non_overlapping(events: DataFrame, gap: int = 12) -> DataFrame:
    """(symbol, conf): events at least ``gap`` bars after the last one taken."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        taken, last = [], None
        for c in sorted(set(g["conf"])):
            if last is None or c - last >= gap:
                taken.append(c)
                last = c
        return pd.DataFrame({"symbol": g["symbol"].iloc[0], "conf": taken})

    return events.select("symbol", "conf").groupBy("symbol").applyInPandas(fold, "symbol string, conf long")


def bucketed(swings: DataFrame) -> DataFrame:
    """(symbol, kind, i, conf, price, bucket, anchor, rank): each swing in the earliest bucket of its kind within 0.1 %.

    Swings go in order of confirmation. A bucket's price is that of its first swing
    (rank 1). Prices are compared in whole cents; buckets are found by price, not
    one by one.
    """

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        by_price: list[tuple[int, int]] = []
        members: list[int] = []
        anchors: list[int] = []
        rows = []
        g = g.sort_values(["conf", "i"])
        for price in g["price"]:
            cents = round(price * 100)
            # |cents - a| * 1000 <= a, for a between cents * 1000 / 1001 and cents * 1000 / 999.
            low, high = -(-cents * 1000 // 1001), cents * 1000 // 999
            near = by_price[bisect_left(by_price, (low, -1)) : bisect_left(by_price, (high + 1, -1))]
            b = min((b for _, b in near), default=len(anchors))
            if b == len(anchors):
                anchors.append(cents)
                members.append(0)
                insort(by_price, (cents, b))
            members[b] += 1
            rows.append((b, anchors[b] / 100, members[b]))
        return g.assign(**dict(zip(("bucket", "anchor", "rank"), zip(*rows))))

    out = "symbol string, kind string, i long, conf long, price double, bucket long, anchor double, rank long"
    return swings.select("symbol", "kind", "i", "conf", "price").groupBy("symbol", "kind").applyInPandas(fold, out)


def clustered_levels(swings: DataFrame) -> DataFrame:
    """(symbol, kind, bucket, price, members, created): the buckets of two swings or more; a level from the second on."""
    found = bucketed(swings).groupBy("symbol", "kind", "bucket", F.col("anchor").alias("price")).agg(
        F.count("*").alias("members"), F.max(F.when(F.col("rank") == 2, F.col("conf"))).alias("created")
    )
    return found.where("members > 1")


def zone_lifecycle(zones: DataFrame, bars: DataFrame, max_age: int = 500, strict_reference: bool = False) -> DataFrame:
    """(symbol, i, zone_kind, state, touches, ended_i): what became of each zone after it was known.

    A zone is mitigated when a wick touches it, invalidated when a close goes over
    half through it, and expires after ``max_age`` bars; touches are counted when
    price has left the zone and at least three bars lie between. With
    ``strict_reference`` depth is measured from the far edge.
    """
    reach = bars.select(F.col("symbol").alias("s"), F.col("i").alias("b"), "h", "l", "c")
    near = zones.join(reach, (F.col("s") == F.col("symbol")) & (F.col("b") > F.col("conf")) & (F.col("b") <= F.col("conf") + max_age + 1))

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("b")
        z = g.iloc[0]
        top, bottom = z["zone_high"], z["zone_low"]
        state, touches, last_touch, cleared, ended = "fresh", 0, None, True, None
        for b, h, low, c in g[["b", "h", "l", "c"]].itertuples(index=False):
            if b - z["conf"] > max_age:
                state, ended = "expired", b
                break
            depth = (top - c) / (top - bottom) if z["zone_kind"] == "demand" else (c - bottom) / (top - bottom)
            inside = low <= top and h >= bottom
            if inside:
                if touches == 0:
                    state = "mitigated"
                if cleared and (last_touch is None or b - last_touch >= 3):
                    touches, last_touch = touches + 1, b
                cleared = False
                depth = min(1.0, 1 - depth) if strict_reference else depth
                if depth > 0.5:
                    state, ended = "invalidated", b
                    break
            else:
                cleared = True
                if not strict_reference and depth > 0.5:
                    state, ended = "invalidated", b
                    break
        return pd.DataFrame({"symbol": [z["symbol"]], "i": [z["i"]], "zone_kind": [z["zone_kind"]], "state": [state], "touches": [touches], "ended_i": pd.array([ended], "Int64")})

    return near.groupBy("symbol", "i", "zone_kind").applyInPandas(fold, "symbol string, i long, zone_kind string, state string, touches long, ended_i long")


# -- queries ------------------------------------------------------------------


def _bars(spark: SparkSession, sf_dir: str, tf: str = "1h") -> DataFrame:
    return FRAMES[f"bars_{tf}"][0](spark, sf_dir)


def _swings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_query(f"WITH {swings_sql('bars_1h', 3)} SELECT symbol, kind, i, conf, price FROM swings")(spark, sf_dir)


def wilder_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wilder_and_ema(_bars(spark, sf_dir), 3_600_000)


def event_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes(_swings(spark, sf_dir))


def greedy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return non_overlapping(_swings(spark, sf_dir))


def liquidity_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered_levels(_swings(spark, sf_dir))


def zones_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.operators.events import SQL

    return zone_lifecycle(spark_query(SQL["supply_demand_zones"])(spark, sf_dir), _bars(spark, sf_dir))


QUERIES = {"wilder_ema": wilder_ema, "event_episodes": event_episodes, "greedy_events": greedy_events, "liquidity_levels": liquidity_levels, "zones_lifecycle": zones_lifecycle}
