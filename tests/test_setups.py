"""Setups against plain loops over bars, and the paired bootstrap."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barloom.operators.setups import expansion_retests, pullbacks, with_averages
from barloom.operators.simulation import paired_difference

HOUR = 3_600_000
BARS = "symbol string, i long, n long, open_ms long, close_ms long, o double, h double, l double, c double, v long, tc long"


@pytest.fixture(scope="module")
def bars(spark):
    rng, rows = random.Random(5), []
    for symbol in ("A", "B"):
        c, t = 100.0, 0
        for i in range(900):
            t += HOUR * (5 if i in (130, 133, 410, 700) else 1)
            move = rng.uniform(4, 9) if rng.random() < 0.05 else rng.uniform(-1.5, 1.2)
            o, c = c, round(max(20, c + move), 2)
            spread = 0.1 if abs(move) > 2 else 0.8
            h, low = round(max(o, c) + rng.random() * spread, 2), round(min(o, c) - rng.random() * spread, 2)
            rows.append((symbol, i, 900, t, t + HOUR - 1, o, h, low, c, 10, 5))
    return spark.createDataFrame(rows, BARS)


def runs(bars):
    found: dict = {}
    for r in with_averages(bars, HOUR).orderBy("symbol", "i").collect():
        found.setdefault((r["symbol"], r["segment"]), []).append(r)
    return found


def test_pullbacks_against_a_loop(bars):
    want = set()
    for (symbol, _), b in runs(bars).items():
        k = 1
        while k < len(b):
            if b[k - 1]["ema"] is None or not (b[k - 1]["c"] >= b[k - 1]["ema"] and b[k]["c"] < b[k]["ema"]):
                k += 1
                continue
            level, why, j = b[k - 1]["h"], "segment_break", k
            for j in range(k + 1, len(b)):
                low = min(x["l"] for x in b[k : j + 1])
                why = "max_bars" if j - k + 1 > 30 else "max_depth" if level - low > 0.05 * level else "confirmed" if b[j]["c"] > level else None
                if why:
                    break
            why = why or "segment_break"
            low = min(x["l"] for x in b[k : j + 1])
            if why == "confirmed":
                why = "no_entry_bar" if j + 1 == len(b) else "confirmed" if b[j + 1]["o"] > low else "invalid_stop"
            want.add((symbol, b[k]["i"], b[j]["i"], level, low, why))
            k = j + 1
    got = {tuple(r)[:6] for r in pullbacks(bars, HOUR, max_bars=30, max_depth=0.05).collect()}
    assert got == want
    assert {"max_depth", "confirmed"} <= {w[5] for w in want}


def expands(b, k):
    if k < 14 or not b[k - 1]["atr"]:
        return False
    x, before = b[k], b[k - 1]
    size = x["h"] - x["l"]
    reach = max(size, abs(x["h"] - before["c"]), abs(x["l"] - before["c"]))
    return size > 0 and reach >= 2 * before["atr"] and x["c"] > x["o"] and x["c"] - x["o"] >= 0.55 * size and x["c"] - x["l"] >= 0.75 * size


def test_expansions_against_a_loop(bars):
    want = set()
    for (symbol, _), b in runs(bars).items():
        k = 0
        while k < len(b):
            if not expands(b, k):
                k += 1
                continue
            level, atr, touch, why, j = b[k]["c"], b[k]["atr"], None, None, k
            while why is None:
                if j + 1 == len(b):
                    why = "segment_break"
                    break
                j += 1
                if touch is None:
                    if b[j]["l"] <= level + 0.25 * atr:
                        touch = j
                        why = "retest_too_deep" if level - b[j]["l"] > 0.5 * atr else None
                    elif j == k + 6:
                        why = "retest_timeout"
                elif b[j]["c"] < level - 0.5 * atr:
                    why = "structure_broken"
                elif b[j]["c"] > level and b[j]["c"] > b[j]["o"]:
                    why = "confirmed"
                elif j == touch + 3:
                    why = "resumption_timeout"
            low = min(x["l"] for x in b[k : j + 1])
            if why == "confirmed":
                why = "no_entry_bar" if j + 1 == len(b) else "confirmed" if b[j + 1]["o"] > low else "invalid_stop"
            if why == "confirmed" and 0.0026 * b[j + 1]["o"] / (b[j + 1]["o"] - low) > 0.2:
                why = "cost_gate"
            want.add((symbol, b[k]["i"], b[j]["i"], level, low, why))
            k = j + 1
    got = {tuple(r)[:6] for r in expansion_retests(bars, HOUR).collect()}
    assert got == want
    assert len(Counter(w[5] for w in want)) >= 3


def test_setups_of_no_bars(bars):
    assert pullbacks(bars.limit(0), HOUR).count() == 0
    assert expansion_retests(bars.limit(0), HOUR).count() == 0


def test_paired_difference(spark):
    rows = spark.range(300).select(F.lit("g").alias("g"), (F.col("id") % 17 - 8).cast("double").alias("x"), F.col("id").alias("k"))
    same = paired_difference(rows, rows, "g", "x", ["k"]).first()
    assert (same["mean"], same["low"], same["high"], same["p_value"]) == (0.0, 0.0, 0.0, 1.0)
    up = paired_difference(rows.withColumn("x", F.col("x") + 20), rows.where("k < 7"), "g", "x", ["k"]).first()
    assert up["n"] == 300 and up["low"] > 0 and up["low"] < up["mean"] < up["high"]
    assert paired_difference(rows, rows.limit(0), "g", "x", ["k"]).count() == 0
