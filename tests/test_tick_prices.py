"""Prices of more than two decimals, which DuckDB's cast rounds by their double product with 100; times before 1970 and none."""

from __future__ import annotations

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from barloom.catalogue import ORACLES, QUERIES

DAY = datetime.datetime(2024, 1, 1)
#: Halves of a cent in text that are less as doubles times 100, or the reverse.
HALVES = [x for x in (round(20.005 + k * 0.01, 3) for k in range(9000)) if (x * 100) % 1 < 0.5][:500]
NAMES = [
    "candles_15m", "candles_1h", "candles_5m", "events_union", "forward_returns", "mfe_mae", "outcome_cells", "range_deciles", "realized_vol", "regime_counts",
    "streamed_candles_1h",
]


def _table(at: list, prices: list) -> pa.Table:
    n = len(prices)
    return pa.table({
        "event_id": pa.array(range(n), pa.int64()), "ts": pa.array(at, pa.timestamp("us")), "user_id": pa.array([1] * n, pa.int64()),
        "event_type": ["view"] * n, "value": pa.array(prices, pa.float64()), "props": ['{"k": 3}'] * n,
    })


def _equal(spark, path, name) -> None:
    with duckdb.connect() as con:
        con.execute(f"create view events as select * from read_parquet('{path}/events.parquet')")
        found = con.execute(ORACLES[name])
        columns = [c[0] for c in found.description]
        expected = sorted(found.fetchall(), key=str)
    got = sorted((tuple(r) for r in QUERIES[name](spark, str(path)).select(*columns).collect()), key=str)
    assert got == expected


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("halves")
    prices = [HALVES[k * 37 % len(HALVES)] + (60 if k % 90 == 45 else 0) for k in range(1440)]
    pq.write_table(_table([DAY + datetime.timedelta(minutes=15 * k) for k in range(len(prices))], prices), path / "events.parquet")
    return path


@pytest.fixture(scope="module")
def narrow(tmp_path_factory):
    path = tmp_path_factory.mktemp("narrow")
    prices = [HALVES[(k * 37 + k * k) % 7] if k % 2 else round(HALVES[0] + k * 37 % 7 * 0.01 + 0.005, 2) for k in range(720)]
    pq.write_table(_table([DAY + datetime.timedelta(hours=k) for k in range(len(prices))], prices), path / "events.parquet")
    return path


def test_halves_of_a_cent_in_a_narrow_market(spark, narrow):
    _equal(spark, narrow, "regime_counts")


@pytest.mark.parametrize("name", NAMES)
def test_halves_of_a_cent(spark, folder, name):
    _equal(spark, folder, name)


@pytest.mark.parametrize("name", ["candles_5m", "candles_15m", "candles_1h", "forward_returns"])
def test_before_1970_and_no_time(spark, tmp_path, name):
    prices = [-1.005, 0.125, -0.004, None, 1e12 + 0.125, 2.0**45] + [1 + k * 0.37 for k in range(60)]
    at = [datetime.datetime(1969, 12, 31, 20) + datetime.timedelta(minutes=7 * k) for k in range(64)] + [None, None]
    pq.write_table(_table(at, prices), tmp_path / "events.parquet")
    _equal(spark, tmp_path, name)
