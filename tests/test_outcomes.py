"""Permission, stop models, tie conventions and run metrics against plain loops."""

from __future__ import annotations

import math
import random
import statistics
from collections import defaultdict

import pytest

from barloom.catalogue import QUERIES
from barloom.operators import outcomes
from barloom.sources.frames import FRAMES


@pytest.fixture(scope="module")
def dense():
    return "/root/testdata/sf0.01"


def grouped(df, order="i"):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r["symbol"], []).append(r)
    return {s: sorted(rows, key=lambda r: r[order]) for s, rows in out.items()}


# -- permission ------------------------------------------------------------------


def series(seed, n, gaps=()):
    rng, rows, t, c = random.Random(seed), [], 0, 100.0
    for i in range(n):
        t += 14_400_000 * (5 if i in gaps else 1)
        c = round(max(5, c + rng.uniform(-2, 2.1) * (1 + 3 * (i // 40 % 2))), 2)
        h, low = round(c + rng.random() * (1 + i % 30 / 10), 2), round(c - rng.random(), 2)
        rows.append((f"S{seed}", i, t, h, low, c))
    return rows


def permitted(rows, ranked, sma, slope, atr):
    """A dictionary a bar, by the rules read one at a time."""
    out, part, runs, before = [], [], 0, -1
    for k, (_, i, t, h, low, c) in enumerate(rows):
        if k and t - rows[k - 1][2] != 14_400_000:
            part = []
        tr = max(h - low, abs(h - part[-1]["c"]), abs(low - part[-1]["c"])) if part else h - low
        bar = {"c": c, "tr": tr, "atr": None, "sma": None, "slope": None, "pct": None}
        part.append(bar)
        if len(part) >= atr:
            bar["atr"] = round(sum(b["tr"] for b in part[-atr:]) / atr, 9)
        if len(part) >= sma:
            bar["sma"] = round(sum(b["c"] for b in part[-sma:]) / sma, 9)
        if len(part) >= sma + slope:
            bar["slope"] = round(bar["sma"] - part[-1 - slope]["sma"], 9)
        if len(part) >= ranked + atr - 1:
            bar["pct"] = 100 * sum(b["atr"] < bar["atr"] for b in part[-ranked:]) / ranked
        known = None not in (bar["pct"], bar["slope"])
        permission = -1 if not known else int(c > bar["sma"] and bar["slope"] > 0 and 20 <= bar["pct"] <= 95)
        budget = -1 if not known else int(25 <= bar["pct"] <= 80)
        if permission == 1 and before != 1:
            runs += 1
        out.append((i, bar["pct"], permission, budget, runs - 1 if permission == 1 else -1))
        before = permission
    return out


def test_permission_with_short_windows(spark):
    """Windows short enough that every state and several runs occur, over gaps too."""
    windows = (20, 8, 3, 5)
    rows = [r for k, gaps in ((1, ()), (2, (70, 71, 150)), (3, (10,))) for r in series(k, 260, gaps)]
    df = spark.createDataFrame(rows, "symbol string, i long, open_ms long, h double, l double, c double").repartition(3)
    got = grouped(spark.sql(outcomes.regime_sql(*windows), bars_4h=df))
    states = set()
    for s in ("S1", "S2", "S3"):
        want = permitted([r for r in rows if r[0] == s], *windows)
        assert [(r["i"], r["permission"], r["budget"], r["run_id"]) for r in got[s]] == [(w[0], *w[2:]) for w in want]
        assert [r["pct"] for r in got[s]] == pytest.approx([w[1] for w in want])
        states |= {w[2:4] for w in want}
        assert max(w[4] for w in want) > 2
    assert states >= {(-1, -1), (0, 0), (0, 1), (1, 0), (1, 1)}


def test_permission_of_the_query_is_unknown_before_it_has_its_bars(spark, dense):
    rows = QUERIES["regime_4h"](spark, dense).collect()
    assert len(rows) == FRAMES["bars_4h"][0](spark, dense).count() and all(r["permission"] == -1 for r in rows if r["pct"] is None)
    assert {(r["symbol"], r["i"]): r["pct"] for r in rows} == {(r["symbol"], r["i"]): r["pct"] for r in QUERIES["atr_percent_rank"](spark, dense).collect()}


# -- outcomes ---------------------------------------------------------------------


def outcome(bars, conf, model, side, target_r):
    n, sign = len(bars), 1 if side == "long" else -1
    entry_i = min(conf + 1, n - 1)
    entry = bars[entry_i]["o"]
    if model == "swing":
        stop = bars[conf]["l" if side == "long" else "h"]
    elif model == "atr":
        if conf < 20:
            return None
        tr = [bars[0]["h"] - bars[0]["l"]] + [max(b["h"] - b["l"], abs(b["h"] - a["c"]), abs(b["l"] - a["c"])) for a, b in zip(bars, bars[1:])]
        stop = entry - sign * 1.5 * round(sum(tr[conf - 19 : conf + 1]) / 20, 9)
    else:
        stop = entry - sign * 0.005 * entry
    dist = sign * (entry - stop)
    if dist <= 1e-6:
        return None
    target = entry + sign * target_r * dist
    for k, b in enumerate(bars[entry_i : entry_i + 12]):
        against, toward = (b["l"], b["h"]) if side == "long" else (b["h"], b["l"])
        stopped, reached = sign * (against - stop) <= 0, sign * (toward - target) >= 0
        if sign * (b["o"] - stop) <= 0 or sign * (b["o"] - target) >= 0:
            return k, sign * (b["o"] - stop) > 0, False, b["o"], sign * (b["o"] - entry) / dist
        if stopped or reached:
            price = stop if stopped else target
            return k, not stopped, stopped and reached, price, sign * (price - entry) / dist
    return None, None, False, None, None


def test_every_stop_model_and_side(spark, dense):
    bars = grouped(FRAMES["bars_1h"][0](spark, dense))
    events = grouped(QUERIES["displacement"](spark, dense))
    got = {(r["symbol"], r["i"], r["model"], r["side"], r["target_r"]): r for r in QUERIES["event_outcomes"](spark, dense).collect()}
    seen, wanted = defaultdict(int), 0
    for s, rows in events.items():
        for e in rows:
            for model in ("swing", "atr", "fixed_percent"):
                for side in ("long", "short"):
                    for target in (0.5, 1.0, 1.5, 2.0):
                        want = outcome(bars[s], e["conf"], model, side, target)
                        r = got.get((s, e["i"], model, side, target))
                        assert (r is None) == (want is None)
                        if want is None:
                            seen["no stop"] += 1
                            continue
                        wanted += 1
                        assert (r["bars_to_resolve"], r["target_before_stop"], r["ambiguous_bar"]) == want[:3]
                        assert (r["exit_price"], r["r"]) == (None, None) if want[3] is None else (r["exit_price"], r["r"]) == pytest.approx(want[3:], abs=2e-6, rel=1e-6)
                        seen[model, want[1], want[2]] += 1
    assert len(got) == wanted
    assert all(seen[m, hit, False] for m in ("swing", "atr", "fixed_percent") for hit in (True, False)) and seen["atr", None, False] and seen["atr", False, True] and seen["no stop"]
    stats = {(r["model"], r["side"], r["target_r"]): r for r in QUERIES["stop_model_stats"](spark, dense).collect()}
    for key, r in stats.items():
        own = [x for k, x in got.items() if k[2:] == key]
        assert (r["events"], r["wins"], r["losses"], r["ambiguous"], r["unresolved"]) == (
            len(own), sum(x["target_before_stop"] is True for x in own), sum(x["target_before_stop"] is False for x in own), sum(x["ambiguous_bar"] for x in own), sum(x["target_before_stop"] is None for x in own)
        )


def test_tie_conventions_of_the_frozen_signal(spark, dense):
    trades = [r for r in QUERIES["event_outcomes"](spark, dense).collect() if (r["model"], r["side"], r["target_r"]) == ("swing", "long", 1.0)]
    done = [r for r in trades if r["r"] is not None]
    tied = sum(r["ambiguous_bar"] for r in done)
    assert tied
    got = {r["convention"]: r for r in QUERIES["frozen_signal"](spark, dense).collect()}
    for name, value in (("stop_first", -1), ("tie_win", 1), ("tie_split", 0), ("non_ambiguous", None)):
        values = [value if r["ambiguous_bar"] else r["r"] for r in done if not (r["ambiguous_bar"] and value is None)]
        r = got[name]
        assert (r["trades"], r["resolved"], r["censored"], r["ambiguous"], r["n"]) == (len(trades), len(done), len(trades) - len(done), tied, len(values))
        assert r["mean"] / 1e6 == pytest.approx(sum(values) / len(values), abs=1e-5)
        assert r["win_rate"] == pytest.approx(sum(v > 0 for v in values) / len(values), abs=1e-6) and r["lower"] <= r["mean"] <= r["upper"]
    assert got["stop_first"]["mean"] < got["tie_split"]["mean"] < got["tie_win"]["mean"]


# -- zones and deciles ------------------------------------------------------------


def test_zone_measures_by_a_loop(spark, dense):
    bars = grouped(FRAMES["bars_1h"][0](spark, dense))
    got = {(r["symbol"], r["i"], r["zone_kind"], r["at_i"]): r for r in QUERIES["zone_measures"](spark, dense).collect()}
    seen = defaultdict(int)
    for z in QUERIES["supply_demand_zones"](spark, dense).collect():
        high, low, supply = z["zone_high"], z["zone_low"], z["zone_kind"] == "supply"
        for b in bars[z["symbol"]][z["conf"] + 1 : z["conf"] + 25]:
            r = got.pop((z["symbol"], z["i"], z["zone_kind"], b["i"]))
            away = (b["h"] < low) if supply else (b["l"] > high)
            edge = min(b["h"], high) if supply else max(b["l"], low)
            wick = None if away else (high - edge if supply else edge - low) / (high - low)
            inside = low <= b["c"] <= high
            close = (high - b["c"] if supply else b["c"] - low) / (high - low) if inside else 0
            distance = max(0, b["c"] - high) + min(0, b["c"] - low)
            assert (r["age"], r["height"], r["distance"], r["close_depth"]) == pytest.approx((b["i"] - z["i"], high - low, distance, close), abs=1e-6)
            assert r["wick_depth"] is None if wick is None else r["wick_depth"] == pytest.approx(wick, abs=1e-6)
            seen[z["zone_kind"], wick is None, inside, distance > 0, distance < 0] += 1
    assert not got and len(seen) > 6


def test_deciles(spark, dense):
    values = [None, float("nan"), -0.1, 0.0, 9.99, 10.0, 55.5, 99.99, 100.0, 120.0]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, x double")
    got = [r["d"] for r in spark.sql(f"SELECT k, {outcomes.decile_sql('x')} AS d FROM {{t}} ORDER BY k", t=df).collect()]
    assert got == ["unknown", "unknown", "unknown", "0-10", "0-10", "10-20", "50-60", "90-100", "90-100", "90-100"]
    rows = QUERIES["range_deciles"](spark, dense).collect()
    assert {r["decile"] for r in rows} == {f"{k}-{k + 10}" for k in range(0, 100, 10)} and sum(r["bars"] for r in rows) == FRAMES["bars_1h"][0](spark, dense).count()


# -- metrics ----------------------------------------------------------------------


def test_run_metrics_by_a_loop(spark, sf_dir):
    runs: dict = {}
    for t in FRAMES["ledger"][0](spark, sf_dir).collect():
        runs.setdefault(t["run_id"], []).append(t)
    monthly = defaultdict(dict)
    for r in QUERIES["monthly_returns"](spark, sf_dir).collect():
        monthly[r["run_id"]][r["month_id"]] = r["ret"]
    capital = 10_000_000_000
    for r in QUERIES["run_metrics"](spark, sf_dir).collect():
        trades, days = runs[r["run_id"]], defaultdict(int)
        for t in trades:
            days[t["exit_day"]] += t["net_u"]
        eq, curve, months = capital, [], {}
        for d in sorted(days):
            eq += days[d]
            curve.append(eq)
            months[max(t["exit_month"] for t in trades if t["exit_day"] == d)] = eq
        rets = [b / a - 1 for a, b in zip(curve, curve[1:])]
        span, sd, mean = max(days) - min(days), statistics.stdev(rets), statistics.fmean(rets)
        down = math.sqrt(statistics.fmean([x * x for x in rets if x < 0]))
        peak, dd = capital, 0
        for x in curve:
            peak = max(peak, x)
            dd = min(dd, (x - peak) / peak)
        cagr = (eq / capital) ** (365.25 / span) - 1
        pnl = [t["net_u"] for t in trades]
        wins, losses = [p for p in pnl if p > 0], [p for p in pnl if p < 0]
        covered = set()
        for t in trades:
            covered |= set(range(t["entry_day"], t["exit_day"]))
        want = {
            "final_u": eq, "total_return": eq / capital - 1, "cagr": cagr, "volatility": sd * math.sqrt(365), "sharpe": mean / sd * math.sqrt(365), "sortino": mean / down * math.sqrt(365), "max_drawdown": dd,
            "calmar": cagr / -dd, "profit_factor": sum(wins) / -sum(losses), "win_rate": len(wins) / len(pnl), "trade_count": len(pnl), "average_win": sum(wins) / len(wins), "average_loss": sum(losses) / len(losses),
            "expectancy": sum(pnl) / len(pnl), "average_r": statistics.fmean(t["net_r"] for t in trades), "total_fees": sum(t["fee_u"] for t in trades),
            "total_turnover": sum(2 * t["notional_u"] + (1 if t["side"] == "long" else -1) * t["gross_u"] for t in trades), "average_days_held": statistics.fmean(t["exit_day"] - t["entry_day"] for t in trades),
            "exposure": len(covered) / (max(t["exit_day"] for t in trades) - min(t["entry_day"] for t in trades)), "best_trade": max(pnl), "worst_trade": min(pnl), "span_days": span,
        }
        for name, value in want.items():
            assert r[name] == pytest.approx(value, rel=1e-5, abs=2e-6), name
        assert r["insufficient_sample"] is False and r["initial_u"] == capital
        ends = [months[m] for m in sorted(months)]
        assert [monthly[r["run_id"]][m] for m in sorted(months)] == pytest.approx([b / a - 1 for a, b in zip([capital, *ends], ends)], abs=2e-9)
