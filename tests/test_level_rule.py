"""Levels of ranges, days and sessions by plain loops: none is left out, they are equally specific, and at one price the latest known names the sweep."""

from __future__ import annotations

import pytest
from test_levels import levels_of

from barloom.catalogue import QUERIES
from barloom.sources.frames import FRAMES

#: As in backend/app/services/research/events.py of the reference, line 303.
SPECIFICITY = {f"{kind}_{side}": 1 for kind in ("range", "day", "session") for side in ("high", "low")}


@pytest.fixture(scope="module")
def dense():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def bars(spark, dense):
    out: dict = {}
    for r in FRAMES["bars_1h"][0](spark, dense).collect():
        out.setdefault(r["symbol"], []).append(r)
    return {s: sorted(rows, key=lambda r: r["i"]) for s, rows in out.items()}


@pytest.fixture(scope="module")
def six(bars):
    return {s: [x for x in levels_of(rows) if x[2] in SPECIFICITY] for s, rows in bars.items()}


@pytest.fixture(scope="module")
def swept(bars, six):
    """(symbol, i, side, price) to the level that names it and to the number of levels at that price."""
    out = {}
    for s, rows in bars.items():
        for i in range(1, len(rows) - 1):
            at: dict = {}
            for creation, price, kind, side, _ in six[s]:
                if creation < i:
                    cents = round(price * 100)
                    was, now = (round(r["h" if side == "high" else "l"] * 100) for r in (rows[i - 1], rows[i]))
                    beyond = (lambda x: cents * 1001 < x * 1000) if side == "high" else (lambda x: cents * 999 > x * 1000)
                    if beyond(now) and not beyond(was):
                        at.setdefault((s, i, side, price), []).append((SPECIFICITY[kind], creation, kind))
            out |= {k: (max(v)[1:], len(v)) for k, v in at.items()}
    return out


def test_every_level_of_the_six_types(spark, dense, six):
    got = [tuple(r[c] for c in ("symbol", "creation", "price", "level_type", "specificity")) for r in QUERIES["levels_union"](spark, dense).collect()]
    assert sorted(got) == sorted((s, creation, price, kind, SPECIFICITY[kind]) for s, rows in six.items() for creation, price, kind, _, _ in rows)


def test_every_sweep_by_its_latest_level(spark, dense, bars, swept):
    got = {(r["symbol"], r["i"], r["side"], r["price"]): (r["creation"], r["level_type"], r["conf"], r["next_close"]) for r in QUERIES["liquidity_sweeps"](spark, dense).collect()}
    assert got == {k: (*level, k[1] + 1, bars[k[0]][k[1] + 1]["c"]) for k, (level, _) in swept.items()}
    assert sum(n > 1 for _, n in swept.values()) > 100


def test_every_sweep_is_measured(spark, dense, swept):
    rows = QUERIES["sweep_measures"](spark, dense).collect()
    assert len(rows) == len(swept)
    assert {(r["symbol"], r["i"], r["side"], r["price"]): r["level_type"] for r in rows} == {k: level[1] for k, (level, _) in swept.items()}
