"""Trades of setups and the account that holds them."""

from __future__ import annotations

import pytest

from barloom.plans.backtest import Costs
from barloom.plans.portfolio import portfolio, setup_trades

BARS = "symbol string, i long, n long, open_ms long, close_ms long, o double, h double, l double, c double, v long, tc long"
SETUPS = "symbol string, end_i long, low double, outcome string, entry double, detector string"
TRADES = "symbol string, detectors string, entry_i long, exit_i long, entry double, stop double, exit double"


def test_setup_trades(spark):
    flat = [(100.0, 101.0, 99.5, 100.0)] * 40
    flat[8] = (100.0, 111.0, 100.0, 110.0)  # reaches the target of the first
    flat[20] = (94.0, 95.0, 93.0, 94.0)  # opens under the stop of the second
    bars = spark.createDataFrame([("X", i, 40, i * 1000, i * 1000 + 999, *b, 1, 1) for i, b in enumerate(flat)], BARS)
    rows = [("X", 4, 95.0, "confirmed", 100.0, "a"), ("X", 4, 95.0, "confirmed", 100.0, "b"), ("X", 17, 95.0, "confirmed", 100.0, "a"),
            ("X", 22, 95.0, "confirmed", 100.0, "a"), ("X", 34, 95.0, "confirmed", 100.0, "a"), ("X", 30, 95.0, "cost_gate", 100.0, "a")]
    out = setup_trades(spark.createDataFrame(rows, SETUPS), bars, 1000).orderBy("entry_i").collect()
    assert [(r["detectors"], r["entry_i"], r["exit_i"], r["exit"], r["kind"]) for r in out] == [
        ("a,b", 5, 8, 110.0, "target"), ("a", 18, 20, 94.0, "stop_gap"), ("a", 23, 34, 100.0, "time"), ("a", 35, None, None, "open")]


def test_portfolio_shares_cash_and_reconciles(spark):
    rows = [("X", "a", 1, 5, 100.0, 99.9, 103.0), ("X", "b", 1, 3, 100.0, 99.8, 99.8), ("X", "a", 4, 9, 101.0, 99.0, 105.0), ("X", "a", 9, None, 101.0, 99.0, None), ("X", "a", 9, 9, 101.0, 99.0, 99.0)]
    out = portfolio(spark.createDataFrame(rows, TRADES), Costs(), risk=0.05).collect()
    taken = [r for r in out if r["skipped"] is None]
    assert [r["skipped"] for r in out if r["skipped"]] == ["no_exit"]
    assert len(taken) == 4
    assert 10_000 + sum(r["net"] for r in taken) == pytest.approx(taken[-1]["cash"])
    first = [r for r in taken if r["entry_i"] == 1]
    assert sum(r["size"] * r["entry_fill"] * 1.001 for r in first) <= 10_000
    assert all(r["cash"] >= 0 for r in out)
    free = portfolio(spark.createDataFrame(rows[:1], TRADES), Costs(0, 0, 0), risk=0.0001).first()
    assert free["fees"] == 0 and free["size"] == pytest.approx(10.0) and free["net"] == pytest.approx(30.0)
    assert portfolio(spark.createDataFrame([], TRADES)).count() == 0
