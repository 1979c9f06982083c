"""Levels of ten types, sweeps of them and structure events against plain loops."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from barloom.catalogue import QUERIES
from barloom.operators.folds import bucketed
from barloom.sources.frames import FRAMES

DAY, SESSION = 86_400_000, 21_600_000


@pytest.fixture(scope="module")
def dense():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def bars(spark, dense):
    out: dict = {}
    for r in FRAMES["bars_1h"][0](spark, dense).collect():
        out.setdefault(r["symbol"], []).append(r)
    return {s: sorted(rows, key=lambda r: r["i"]) for s, rows in out.items()}


def swings_of(rows, k):
    found = []
    for i in range(k, len(rows) - k):
        around = rows[i - k : i] + rows[i + 1 : i + k + 1]
        if all(rows[i]["h"] > r["h"] for r in around):
            found.append((i + k, i, 0, "high", rows[i]["h"]))
        if all(rows[i]["l"] < r["l"] for r in around):
            found.append((i + k, i, 1, "low", rows[i]["l"]))
    return [(conf, i, kind, price) for conf, i, _, kind, price in sorted(found)]


def levels_of(rows):
    """(creation, price, type, side, specificity) by reading the definitions bar by bar."""
    out, n = [], len(rows)
    for side, pick, field in (("high", max, "h"), ("low", min, "l")):
        last = None
        for i in range(19, n - 1):
            end = pick(r[field] for r in rows[i - 19 : i + 1])
            if end != last:
                out.append((i, end, f"range_{side}", side, 1))
            last = end
        for name, ms in (("day", DAY), ("session", SESSION)):
            for i in range(1, n):
                p = rows[i - 1]["open_ms"] // ms
                if rows[i]["open_ms"] // ms != p:
                    out.append((i, pick(r[field] for r in rows[:i] if r["open_ms"] // ms == p), f"{name}_{side}", side, 1))
        buckets: list[list] = []
        for conf, i, kind, price in swings_of(rows, 3):
            if kind == side:
                cents = round(price * 100)
                home = next((b for b in buckets if abs(cents - b[0]) * 1000 <= b[0]), None)
                if home is None:
                    buckets.append(home := [cents, 0])
                home[1] += 1
                touched = sum((r["h"] >= price) if side == "high" else (r["l"] <= price) for r in rows[: conf + 1])
                if home[1] == 1 and touched >= 2:
                    out.append((conf, home[0] / 100, f"swing_{side}", side, 0))
                if home[1] == 2:
                    out.append((conf, home[0] / 100, f"equal_{side}s", side, 2))
    return out


def test_levels_of_ten_types(spark, dense, bars):
    got: dict = {}
    for r in QUERIES["all_levels"](spark, dense).collect():
        got.setdefault(r["symbol"], []).append((r["creation"], r["price"], r["level_type"], r["specificity"], r["seq"]))
    assert len({t for rows in got.values() for _, _, t, _, _ in rows}) == 10
    for s, rows in bars.items():
        want = sorted((c, p, t, x) for c, p, t, _, x in levels_of(rows))
        assert sorted(r[:4] for r in got[s]) == want
        assert [r[:3] for r in sorted(got[s], key=lambda r: r[4])] == [w[:3] for w in want]


def test_sweeps_of_all_levels(spark, dense, bars):
    symbol = min(bars)
    rows, want = bars[symbol], []
    levels = levels_of(rows)
    for i in range(1, len(rows) - 1):
        best: dict = {}
        for creation, price, kind, side, rank in levels:
            if creation >= i:
                continue
            cents = round(price * 100)
            was, now = (round(r["h" if side == "high" else "l"] * 100) for r in (rows[i - 1], rows[i]))
            beyond = (lambda x: cents * 1001 < x * 1000) if side == "high" else (lambda x: cents * 999 > x * 1000)
            if beyond(now) and not beyond(was):
                best[side, price] = max(best.get((side, price), ()), (rank, creation, kind))
        want += [(i, i + 1, side, price, kind, creation, rows[i + 1]["c"]) for (side, price), (_, creation, kind) in best.items()]
    got = [tuple(r)[1:] for r in QUERIES["all_sweeps"](spark, dense).where(F.col("symbol") == symbol).collect()]
    assert sorted(got) == sorted(want)
    assert {w[4] for w in want} >= {"swing_high", "swing_low", "range_high", "day_low", "session_high"}


def test_buckets_by_price_are_those_found_one_by_one(spark):
    """Dense prices, so that many buckets are in reach and the earliest must win."""
    rows = [("X", "high", k, k + 3, 100 + (k * 37 % 60) / 100) for k in range(300)] + [("X", "low", k, k + 3, 5000 + (k * 91 % 997) / 10) for k in range(300)]
    anchors: dict = {"high": [], "low": []}
    want = {}
    for s, kind, i, conf, price in rows:
        cents = round(price * 100)
        b = next((b for b, a in enumerate(anchors[kind]) if abs(cents - a) * 1000 <= a), None)
        if b is None:
            b = len(anchors[kind])
            anchors[kind].append(cents)
        want[kind, i] = (b, anchors[kind][b] / 100)
    got = bucketed(spark.createDataFrame(rows, "symbol string, kind string, i long, conf long, price double").repartition(5)).collect()
    assert {(r["kind"], r["i"]): (r["bucket"], r["anchor"]) for r in got} == want
    assert 5 < len(anchors["low"]) < 300


def test_structure_events_and_their_place_in_the_union(spark, dense, bars):
    events = QUERIES["structure_events"](spark, dense).collect()
    union = QUERIES["events_union"](spark, dense).where("kind like 'structure%'").collect()
    for symbol, rows in bars.items():
        swings, want, before = swings_of(rows, 5), [], None
        for k, (conf, i, kind, price) in enumerate(swings):
            if k and swings[k - 1][2] == kind:
                higher = price > swings[k - 1][3]
                label = ("HH" if higher else "LH") if kind == "high" else ("HL" if higher else "LL")
                want.append((label, i, conf, price, None, before, label, None))
                before = label
            if k >= 2:
                for _, _, other, level in swings[max(0, k - 5) : k]:
                    if other != kind and (price > level if kind == "high" else price < level):
                        want.append(("BOS", i, conf, price, level, None, None, "long" if kind == "high" else "short"))
                        break
            if k >= 3 and len({x[2] for x in swings[k - 3 : k]}) == 1:
                a, b, c = (x[3] for x in swings[k - 3 : k])
                was, now = ("up" if y > x else "down" for x, y in ((a, b), (b, c)))
                if was != now:
                    want.append(("structure_shift", swings[k - 1][1], swings[k - 1][0], c, None, was, now, None))
        fields = ("event_type", "i", "conf", "price", "broken_level", "previous_state", "new_state", "direction")
        own = [r for r in events if r["symbol"] == symbol]
        assert sorted((tuple(r[f] for f in fields) for r in own), key=repr) == sorted(want, key=repr)
        assert all(r["confirmation_close"] == rows[r["conf"]]["c"] and r["confirmation_ms"] == rows[r["conf"]]["close_ms"] for r in own)
        kinds = {"BOS": "structure_break", "structure_shift": "structure_shift"}
        side = lambda w: w[7] if w[0] == "BOS" else w[6]
        assert sorted((r["kind"], r["conf"], r["i"], r["side"], r["price"]) for r in union if r["symbol"] == symbol) == sorted((kinds.get(w[0], "structure_label"), w[2], w[1], side(w), w[3]) for w in want)
