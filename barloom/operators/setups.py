"""Entry setups that unfold over several bars: pullbacks and expansion retests.

What becomes of a setup depends on a bounded number of bars after its first one, so
every possible first bar is joined to those and judged by itself in column
expressions. Only the choice of setups that do not overlap is sequential; it folds
over the few first bars of a segment.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators.folds import segments, wilder_and_ema
from barloom.sources.frames import FRAMES

#: Round-trip cost as a share of the entry price, and the most of it that a signal may pay, in R.
COST, COST_GATE = 0.0026, 0.20


def with_averages(bars: DataFrame, step_ms: int) -> DataFrame:
    """``bars`` with segment, k, atr and ema."""
    return segments(bars, step_ms).join(wilder_and_ema(bars, step_ms).select("symbol", "i", "atr", "ema"), ["symbol", "i"])


def with_path(starts: DataFrame, bars: DataFrame, n: int) -> DataFrame:
    """``starts`` with ``path``: up to ``n`` bars that follow in the segment, in order; empty if none does."""
    later = bars.select("symbol", "segment", F.col("k").alias("at"), F.struct("k", "i", "o", "h", "l", "c").alias("bar"))
    reach = starts.withColumn("at", F.explode(F.sequence(F.col("k") + 1, F.col("k") + n)))
    paths = reach.select("symbol", "segment", "k", "at").join(later, ["symbol", "segment", "at"]).groupBy("symbol", "segment", "k").agg(F.array_sort(F.collect_list("bar")).alias("path"))
    none = F.array().cast("array<struct<k:bigint,i:bigint,o:double,h:double,l:double,c:double>>")
    return starts.join(paths, ["symbol", "segment", "k"], "left").withColumn("path", F.coalesce("path", none))


def without_overlap(setups: DataFrame) -> DataFrame:
    """The setups (symbol, segment, k, end_k, ...) that begin after the one taken before has ended."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("k")
        taken, free = [], -1
        for k, end in g[["k", "end_k"]].itertuples(index=False):
            taken.append(k > free)
            if k > free:
                free = end
        return g[taken]

    kept = setups.select("symbol", "segment", "k", "end_k").groupBy("symbol", "segment").applyInPandas(fold, "symbol string, segment long, k long, end_k long")
    return setups.join(kept.select("symbol", "segment", "k"), ["symbol", "segment", "k"])


def _first(path: Column, test) -> Column:
    return F.get(F.filter(path, test), F.lit(0))


def _low_until(path: Column, k: Column) -> Column:
    return F.array_min(F.transform(F.filter(path, lambda b: b["k"] <= k), lambda b: b["l"]))


def _entry(setups: DataFrame, cost: float) -> DataFrame:
    """entry at the open after ``end_k``, its distance to ``low`` and the cost in R; null without such a bar."""
    at = _first(F.col("path"), lambda b: b["k"] == F.col("end_k") + 1)["o"]
    out = setups.withColumn("entry", F.when(F.col("outcome") == "confirmed", at)).withColumn("distance", F.col("entry") - F.col("low"))
    bad = (F.col("low") <= 0) | (F.col("distance") <= 0)
    out = out.withColumn("outcome", F.when(F.col("outcome") != "confirmed", F.col("outcome")).when(F.col("entry").isNull(), "no_entry_bar").when(bad, "invalid_stop").otherwise("confirmed"))
    return out.withColumn("cost_r", F.when(F.col("outcome") == "confirmed", cost * F.col("entry") / F.col("distance")))


SETUP = ["symbol", "i", "end_i", "level", "low", "outcome", "entry", "distance", "cost_r"]


def pullbacks(bars: DataFrame, step_ms: int, max_bars: int = 72, max_depth: float = 0.15, cost: float = COST) -> DataFrame:
    """(symbol, i, end_i, level, low, outcome, entry, distance, cost_r): a close under the EMA, and how it ended.

    The level is the high of the bar before. A pullback ends when it is longer than
    ``max_bars`` (max_bars), deeper than ``max_depth`` of the level (max_depth), or
    closes over the level (confirmed), looked at in this order; else with its
    segment (segment_break). Bars are counted from the first, which ends none.
    """
    rows = with_averages(bars, step_ms)
    w = Window.partitionBy("symbol", "segment").orderBy("k")
    before = {c: F.lag(c).over(w) for c in ("c", "ema", "h")}
    crossed = rows.withColumns({"crosses": (before["c"] >= before["ema"]) & (F.col("c") < F.col("ema")), "level": before["h"]}).where("crosses")
    starts = with_path(crossed.select("symbol", "segment", "k", "i", "l", "level"), rows, max_bars)

    too_long = lambda b: b["k"] - F.col("k") >= max_bars
    too_deep = lambda b: (F.col("level") <= 0) | (F.col("level") - F.least(b["l"], F.col("l")) > max_depth * F.col("level"))
    out = starts.withColumn("end", _first(F.col("path"), lambda b: too_long(b) | too_deep(b) | (b["c"] > F.col("level"))))
    end, last = F.col("end"), F.get(F.col("path"), F.size("path") - 1)
    why = F.when(end.isNull(), "segment_break").when(too_long(end), "max_bars").when(too_deep(end), "max_depth").otherwise("confirmed")
    out = out.withColumns({"outcome": why, "end_k": F.coalesce(end["k"], last["k"], F.col("k")), "end_i": F.coalesce(end["i"], last["i"], F.col("i"))})
    out = out.withColumn("low", F.least("l", _low_until(F.col("path"), F.col("end_k"))))
    return _entry(without_overlap(out), cost).select(*SETUP)


def is_expansion(rows: DataFrame) -> Column:
    """A rising bar of at least twice the ATR before it, mostly body, that closes in its upper quarter."""
    w = Window.partitionBy("symbol", "segment").orderBy("k")
    prior, atr = F.lag("c").over(w), F.lag("atr").over(w)
    size = F.col("h") - F.col("l")
    true_range = F.greatest(size, F.abs(F.col("h") - prior), F.abs(F.col("l") - prior))
    return (
        (F.col("k") >= 14) & (atr > 0) & (size > 0) & (true_range >= 2 * atr) & (F.col("c") > F.col("o"))
        & (F.col("c") - F.col("o") >= 0.55 * size) & (F.col("c") - F.col("l") >= 0.75 * size)
    )


def expansion_retests(bars: DataFrame, step_ms: int, touch_within: int = 6, resume_within: int = 3, cost: float = COST, gate: float = COST_GATE) -> DataFrame:
    """(symbol, i, end_i, level, low, outcome, entry, distance, cost_r): an expansion, its retest and resumption.

    The level is the expansion's close. Within ``touch_within`` bars a low must come
    within a quarter of the ATR of the level (else retest_timeout), not over half an
    ATR below it (retest_too_deep). Within ``resume_within`` bars after that a rising
    bar must close over the level (else resumption_timeout) before a close over half
    an ATR below it (structure_broken). A confirmed setup whose cost is over the gate
    is cost_gate. An expansion while a setup lasts begins none.
    """
    rows = with_averages(bars, step_ms)
    big = rows.withColumn("expands", is_expansion(rows)).where("expands").select("symbol", "segment", "k", "i", "l", "atr", F.col("c").alias("level"))
    starts = with_path(big, rows, touch_within + resume_within + 1)
    path, level, atr = F.col("path"), F.col("level"), F.col("atr")

    out = starts.withColumn("touch", _first(path, lambda b: (b["k"] <= F.col("k") + touch_within) & (b["l"] <= level + 0.25 * atr)))
    touch = F.col("touch")
    broken = lambda b: b["c"] < level - 0.5 * atr
    resumes = lambda b: (b["c"] > level) & (b["c"] > b["o"])
    out = out.withColumn("end", _first(path, lambda b: (b["k"] > touch["k"]) & (b["k"] <= touch["k"] + resume_within) & (broken(b) | resumes(b))))
    end, last = F.col("end"), F.get(path, F.size("path") - 1)
    last_k = F.coalesce(last["k"], F.col("k"))
    deep = level - touch["l"] > 0.5 * atr
    why = (
        F.when(touch.isNull(), F.when(last_k >= F.col("k") + touch_within, "retest_timeout").otherwise("segment_break"))
        .when(deep, "retest_too_deep")
        .when(end.isNull(), F.when(last_k >= touch["k"] + resume_within, "resumption_timeout").otherwise("segment_break"))
        .when(broken(end), "structure_broken").otherwise("confirmed")
    )
    end_k = (
        F.when(touch.isNull(), F.least(last_k, F.col("k") + touch_within)).when(deep, touch["k"])
        .when(end.isNull(), F.least(last_k, touch["k"] + resume_within)).otherwise(end["k"])
    )
    out = out.withColumns({"outcome": why, "end_k": end_k}).withColumn("end_i", F.col("i") + F.col("end_k") - F.col("k"))
    out = _entry(without_overlap(out.withColumn("low", F.least("l", _low_until(path, F.col("end_k"))))), cost)
    return out.withColumn("outcome", F.when((F.col("outcome") == "confirmed") & (F.col("cost_r") > gate), "cost_gate").otherwise(F.col("outcome"))).select(*SETUP)


def pullback_setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pullbacks(FRAMES["bars_1h"][0](spark, sf_dir), 3_600_000)


def expansion_setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expansion_retests(FRAMES["bars_1h"][0](spark, sf_dir), 3_600_000)


QUERIES = {"pullback_setups": pullback_setups, "expansion_setups": expansion_setups}
