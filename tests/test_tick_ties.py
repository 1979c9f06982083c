"""Candles of ticks whose ids repeat or whose price is null, against DuckDB."""

from __future__ import annotations

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from barloom.catalogue import ORACLES, QUERIES

DAY = datetime.datetime(2024, 1, 1)


def _events(ids, prices) -> pa.Table:
    n = len(ids)
    return pa.table({
        "event_id": pa.array(ids, pa.int64()), "ts": pa.array([DAY + datetime.timedelta(minutes=7 * k) for k in range(n)], pa.timestamp("us")), "user_id": pa.array([1] * n, pa.int64()),
        "event_type": ["view"] * n, "value": pa.array(prices, pa.float64()), "props": ['{"k": 3}'] * n,
    })


@pytest.mark.parametrize("files", [1, 2])
@pytest.mark.parametrize("name", ["candles_5m", "candles_15m", "candles_1h", "candle_json_round_trip", "realized_vol"])
def test_equal_ids_and_null_prices(spark, tmp_path, name, files):
    ids = [5, 5, 6, 7, 9, 9, 9, 10, 10, 12, 12, 11, 12, -3, -3, 2**62, 2**62] * 20
    prices = [None if k % 11 == 3 else 1.0 + k * 0.37 for k in range(len(ids))]
    table = _events(ids, prices)
    path = tmp_path / "events.parquet"
    if files == 1:
        pq.write_table(table, path)
        source = str(path)
    else:
        path.mkdir()
        for k in range(files):  # the files cut an hour
            pq.write_table(table.slice(k * 203, 203), path / f"part-{k}.parquet")
        source = f"{path}/*.parquet"
    with duckdb.connect() as con:
        con.execute("set threads = 1")
        con.execute(f"create view events as select * from read_parquet('{source}')")
        found = con.execute(ORACLES[name])
        columns = [c[0] for c in found.description]
        expected = sorted(found.fetchall(), key=str)
    got = sorted((tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*columns).collect()), key=str)
    assert got == expected
