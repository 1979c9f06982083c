"""The event log with damaged lines, and streams of which one fails."""

from __future__ import annotations

import json
import threading

import pytest
from pyspark.sql import functions as F

from barloom.runtime import fresh_path
from barloom.sources import event_log as log
from barloom.sources.frames import FRAMES
from barloom.streaming.isolated import FRAMES_OF, Streams


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        ("A", 1, "sweep", 5, 4, "low", 10.1, "day_low", 0.25, 0.75, float("nan"), 7), ("A", 2, "zone", 9, 8, "demand", 3.5, None, None, None, None, None),
        ("A", 3, "regime", 9, 9, None, None, None, None, None, None, None), ("B", 1, "sweep", 2, 1, "high", 0.1 + 0.2, "odd \"quotes\"\n", None, float("inf"), 0.5, None),
        ("B", 1, "sweep", 2, 1, "high", 0.1 + 0.2, "odd \"quotes\"\n", None, float("inf"), 0.5, None),
    ]
    return spark.createDataFrame(rows, "symbol string, seq long, kind string, conf long, i long, side string, price double, level_type string, penetration double, recovery_ratio double, wick_ratio double, volume long")


def test_payloads_round_trip(spark, events, tmp_path):
    path = f"file://{tmp_path}/log"
    log.write_log(events, path)
    read, damaged = log.read_log(spark, path)
    assert damaged.count() == 0 and read.count() == 5
    got = sorted((tuple(r) for r in log.typed(read, "sweep").collect()), key=repr)
    assert got == sorted([("A", 1, "sweep", 5, 4, "low", 10.1, "day_low", 0.25, 0.75, None, 7)] + [("B", 1, "sweep", 2, 1, "high", 0.1 + 0.2, "odd \"quotes\"\n", None, None, 0.5, None)] * 2, key=repr)
    assert [tuple(r) for r in log.typed(read, "zone").collect()] == [("A", 2, "zone", 9, 8, "demand", 3.5, None, None)]
    assert log.reconcile(read, events).where("differing > 0 or logged <> fresh").count() == 0
    funnel = {r["symbol"]: tuple(r)[1:] for r in log.funnel(log.typed(read, "sweep")).collect()}
    assert funnel == {"A": (1, 1, 1, 0), "B": (2, 0, 0, 0)}


def test_damaged_lines_are_counted_and_reconciled(spark, events, tmp_path):
    good = [r["value"] for r in log.lines(events).collect()]
    whole = json.loads(good[0])
    bad = [
        good[0][:-9], "not json", json.dumps(whole | {"seq": "x"}), json.dumps({k: v for k, v in whole.items() if k != "kind"}),
        json.dumps(whole | {"payload": '{"price": "much"}'}), json.dumps(whole | {"payload": "{"}), json.dumps(whole | {"conf": None}), "[1]",
    ]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.txt").write_text("\n".join([good[1], bad[0], "", *bad[1:4], good[2], good[3], *bad[4:], "   "]))
    read, damaged = log.read_log(spark, f"file://{tmp_path}/log")
    assert sorted(r["value"] for r in damaged.collect()) == sorted(bad) and read.count() == 3
    rows = {(r["symbol"], r["kind"]): (r["logged"], r["fresh"], r["differing"]) for r in log.reconcile(read, events).collect()}
    # One sweep of A and one of two equal ones of B are missing.
    assert rows == {("A", "sweep"): (0, 1, 1), ("B", "sweep"): (1, 2, 1), ("A", "zone"): (1, 1, 0), ("A", "regime"): (1, 1, 0)}
    changed = read.withColumn("conf", F.when(F.col("kind") == "zone", F.col("conf") + 1).otherwise(F.col("conf")))
    assert log.reconcile(changed, events).where("kind = 'zone'").first()["differing"] == 2


def test_a_poisoned_timeframe_leaves_the_others_running(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    path = fresh_path(spark, "poison")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("part", F.ntile(3).over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("ts")))
    for k in (1, 2, 3):
        events.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{path}/in")
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    seen, lock = [], threading.Lock()
    poisoned = {"on": True}

    def before(name, batch, number):
        with lock:
            seen.append((name, number))
        if name == "1h" and number == 1 and poisoned["on"]:
            raise ValueError("poisoned bar")

    streams = Streams(spark, f"{path}/out", source, before, retries=1)
    assert streams.run(list(FRAMES_OF)) == {"5m": True, "1h": False, "4h": True}
    assert len(streams.failures["1h"]) == 2 and set(streams.failures) == {"1h"} and "poisoned bar" in streams.failures["1h"][0]
    want = lambda n: {tuple(r) for r in FRAMES[f"candles_{n}"][0](spark, sf_dir).select("symbol", "open_ms", "open", "high", "low", "close", "volume", "trade_count").collect()}
    got = lambda n: {tuple(r) for r in streams.candles(n).collect()}
    assert got("5m") == want("5m") and got("4h") == want("4h") and got("1h") != want("1h")
    # Mended, it goes on from its last batch and catches up; the others have nothing to do.
    poisoned["on"] = False
    before_n = len(seen)
    assert all(streams.run(list(FRAMES_OF)).values())
    assert got("1h") == want("1h") and {n for n, _ in seen[before_n:]} == {"1h"} and min(k for _, k in seen[before_n:]) == 1
