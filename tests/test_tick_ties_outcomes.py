"""Queries on candles of ticks whose ids repeat, against DuckDB on one thread."""

from __future__ import annotations

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from barloom.catalogue import ORACLES, QUERIES

DAY = datetime.datetime(2024, 1, 1)


@pytest.mark.parametrize("name", ["forward_returns", "mfe_mae", "outcome_cells", "range_deciles", "regime_counts", "regime_transitions", "events_union"])
def test_queries_on_candles_of_equal_ids(spark, tmp_path, name):
    n = 720
    prices = [round(20 + (k * 37 % 101) * 0.37 + (60 if k % 90 == 45 else 0), 2) for k in range(n)]
    table = pa.table({
        "event_id": pa.array([k // 4 for k in range(n)], pa.int64()), "ts": pa.array([DAY + datetime.timedelta(minutes=15 * k) for k in range(n)], pa.timestamp("us")),
        "user_id": pa.array([1] * n, pa.int64()), "event_type": ["view"] * n, "value": pa.array(prices, pa.float64()), "props": ['{"k": 3}'] * n,
    })
    pq.write_table(table, tmp_path / "events.parquet")
    with duckdb.connect() as con:
        con.execute("set threads = 1")
        con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
        found = con.execute(ORACLES[name])
        columns = [c[0] for c in found.description]
        expected = sorted(found.fetchall(), key=str)
    got = sorted((tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*columns).collect()), key=str)
    assert got == expected
