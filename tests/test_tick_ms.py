"""Ticks within half a millisecond of a bar's end, which DuckDB's epoch_ms rounds into the next bar."""

from __future__ import annotations

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from barloom.catalogue import ORACLES, QUERIES
from barloom.sources.frames import epoch_ms

DAY = datetime.datetime(2024, 1, 1)
OFF = (-1500, -501, -500, -499, -1, 0, 1, 499, 500, 501)
NAMES = [
    "candles_5m", "candles_15m", "candles_1h", "candle_json_round_trip", "events_union", "forward_returns", "mfe_mae", "outcome_cells", "range_deciles",
    "realized_vol", "regime_counts", "regime_transitions", "candle_digest", "scalar_bar_functions", "streamed_candles_1h",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("edges")
    n = 720
    prices = [round(20 + (k * 37 % 101) * 0.37 + (60 if k % 90 == 45 else 0), 2) for k in range(n)]
    at = [DAY + datetime.timedelta(minutes=15 * k, microseconds=OFF[k * 7 % len(OFF)]) for k in range(n)]
    pq.write_table(pa.table({
        "event_id": pa.array(range(n), pa.int64()), "ts": pa.array(at, pa.timestamp("us")), "user_id": pa.array([1] * n, pa.int64()),
        "event_type": ["view"] * n, "value": pa.array(prices, pa.float64()), "props": ['{"k": 3}'] * n,
    }), path / "events.parquet")
    return path


@pytest.mark.parametrize("name", NAMES)
def test_ticks_at_the_edge_of_a_bar(spark, folder, name):
    with duckdb.connect() as con:
        con.execute(f"create view events as select * from read_parquet('{folder}/events.parquet')")
        found = con.execute(ORACLES[name])
        columns = [c[0] for c in found.description]
        expected = sorted(found.fetchall(), key=str)
    got = sorted((tuple(r) for r in QUERIES[name](spark, str(folder)).select(*columns).collect()), key=str)
    assert got == expected


def test_epoch_ms(spark):
    us = [-2500, -1501, -1500, -1499, -501, -500, -499, -1, 0, 1, 499, 500, 501, 1499, 1500, 1_704_070_799_999_500, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in us], "us long").selectExpr("timestamp_micros(us) AS ts").select(epoch_ms("ts")).collect()]
    with duckdb.connect() as con:
        assert got == [con.execute("select epoch_ms(make_timestamp(?::bigint))", [x]).fetchone()[0] for x in us]
