"""Keyed streaming state against the batch queries, for cuts after every bar and with restarts."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.catalogue import QUERIES
from barloom.runtime import fresh_path
from barloom.sources.frames import FRAMES
from barloom.streaming import carried


@pytest.fixture(scope="module")
def dense():
    return "/root/testdata/sf0.01"


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v


class Map(dict):
    def iterator(self):
        return iter(list(self.items()))

    def updateValue(self, k, v):
        self[tuple(k)] = v

    def removeKey(self, k):
        del self[tuple(k)]


class Store:
    """The state of one key, which outlives the processors that use it."""

    def __init__(self):
        self.of = {}

    def getValueState(self, name, schema):
        return self.of.setdefault(name, Value())

    def getMapState(self, name, *schemas):
        return self.of.setdefault(name, Map())


def cuts(n, mode):
    if mode == "every":
        return list(range(n + 1))
    if mode == "whole":
        return [0, n]
    rng = random.Random(mode)
    return [0, *sorted(rng.sample(range(1, n), 9)), n]


def fed(make, rows, mode, order="open_ms", watch=None):
    """Rows that fresh processors give over cut batches of each symbol, on one store a symbol."""
    out = []
    for symbol, part in rows.groupby("symbol"):
        if mode == "every" and symbol != rows["symbol"].min():
            continue
        store, part = Store(), part.sort_values(order)
        keys = sorted(part[order].unique())
        at = cuts(len(keys), mode)
        for a, b in zip(at, at[1:]):
            processor = make()
            processor.init(store)
            low, high = (part[order].searchsorted(k) for k in (keys[a], keys[b - 1] + 1))
            batch = part.iloc[low:high]
            batch = batch if len(batch) < 2 else batch.iloc[::-1]
            out += [r for f in processor.handleInputRows((symbol,), iter([batch]), None) for r in f.itertuples(index=False)]
            if watch:
                watch(store)
    return out


@pytest.fixture(scope="module")
def bars(spark, dense):
    return FRAMES["bars_1h"][0](spark, dense).select("symbol", *carried.BAR_COLUMNS).toPandas()


def batch_rows(spark, dense, query, columns, mode=None):
    rows = (tuple(r) for r in QUERIES[query](spark, dense).select(*columns).collect())
    return sorted((r for r in rows if mode != "every" or r[0] == "CLICK"), key=repr)


@pytest.mark.parametrize("mode", ["every", "whole", 1, 2])
def test_structure_by_any_cut(spark, dense, bars, mode):
    rows = fed(carried.Structure, bars, mode)
    pick = lambda event, columns: sorted((tuple(getattr(r, c) for c in columns) for r in rows if r.event == event), key=repr)
    for event, query, columns in (
        ("swing", "swings_1h", carried._SWING_COLUMNS), ("break", "break_of_structure", carried._BREAK_COLUMNS),
        ("label", "swing_labels", carried._LABEL_COLUMNS), ("shift", "structure_shift", carried._SHIFT_COLUMNS),
    ):
        want = batch_rows(spark, dense, query, columns, mode)
        assert want and pick(event, columns) == want, event


@pytest.mark.parametrize("mode", ["every", 3])
def test_levels_and_sweeps_by_any_cut(spark, dense, bars, mode):
    levels = sorted((tuple(r) for r in fed(carried.Levels, bars, mode)), key=repr)
    assert levels == batch_rows(spark, dense, "levels_union", ["symbol", "creation", "price", "level_type", "specificity"], mode)
    for kind in ("day", "session", "range"):
        assert sorted((r[:4] for r in levels if r[3].startswith(kind)), key=repr) == batch_rows(spark, dense, f"{kind}_levels", ["symbol", "creation", "price", "level_type"], mode)
    sweeps = sorted((tuple(r) for r in fed(carried.Sweeps, bars, mode)), key=repr)
    want = batch_rows(spark, dense, "liquidity_sweeps", ["symbol", "i", "conf", "side", "price", "level_type", "creation", "next_close"], mode)
    assert sweeps == want and len(want) > 5_000


def test_a_repeated_bar_fails(bars):
    one = bars[bars["symbol"] == bars["symbol"].iloc[0]].sort_values("open_ms")
    for make in (carried.Structure, carried.Levels, carried.Sweeps):
        store = Store()
        processor = make()
        processor.init(store)
        list(processor.handleInputRows(("X",), iter([one.head(30)]), None))
        with pytest.raises(ValueError):
            list(processor.handleInputRows(("X",), iter([one.iloc[29:40]]), None))


@pytest.mark.parametrize("mode", ["every", 5])
def test_zones_by_any_cut_and_their_state_is_bounded(spark, dense, mode):
    rows = carried.bars_and_zones(spark, dense).toPandas()
    open_zones = []
    out = fed(lambda: carried.Zones(500), rows, mode, "at", lambda store: open_zones.append(len(store.of["zones"])))
    last = {}
    for r in out:
        last[r.symbol, r.i, r.zone_kind] = (r.state, r.touches, None if pd.isna(r.ended_i) else r.ended_i)
    want = {(r["symbol"], r["i"], r["zone_kind"]): (r["state"], r["touches"], r["ended_i"]) for r in QUERIES["zones_lifecycle"](spark, dense).collect() if mode != "every" or r["symbol"] == "CLICK"}
    assert last == want and len(want) > 30
    assert max(open_zones) < rows["is_zone"].sum() / 10 and {s for s, _, _ in want.values()} >= {"invalidated"}


def bar(at, h, low, c):
    return ("X", at, False, h, low, c, None, None, None, None)


def test_every_end_of_a_zone():
    """A zone from 10 to 11: touched twice, left between, then over half through; one that expires; one still open."""
    zone = lambda at, i, top, bottom: ("X", at, True, None, None, None, i, "demand", top, bottom)
    rows = [zone(0, 0, 11.0, 10.0), zone(0, 1, 5.0, 4.0), zone(18, 17, 3.0, 2.0)]
    rows += [bar(1, 12, 11.5, 12), bar(2, 12, 10.9, 11.2), bar(3, 12, 10.9, 11.2), bar(4, 13, 12, 12.5), bar(5, 12, 10.8, 11), bar(6, 12, 10, 10.4)]
    rows += [bar(k, 13, 12, 12.5) for k in range(7, 21)]
    frame = pd.DataFrame(rows, columns=["symbol", "at", "is_zone", "h", "l", "c", "zone_i", "zone_kind", "top", "bottom"])
    for mode in ("every", "whole"):
        last = {r.i: (r.state, r.touches, None if pd.isna(r.ended_i) else r.ended_i) for r in fed(lambda: carried.Zones(15), frame, mode, "at")}
        assert last == {0: ("invalidated", 2, 6), 1: ("expired", 0, 16), 17: ("fresh", 0, None)}


def test_stream_goes_on_after_a_restart(spark, dense):
    """Six slices in two starts: at least six batches, with rows of the second start that need bars of the first."""
    rows = FRAMES["bars_1h"][0](spark, dense).select("symbol", *carried.BAR_COLUMNS)
    out = carried.stream_in_slices(rows, "open_ms", carried.Structure(), slices=6, starts=2)
    assert out.select(F.input_file_name().alias("f")).select(F.regexp_extract("f", r"batch=(\d+)", 1)).distinct().count() >= 6
    got = sorted((tuple(r) for r in out.where("event = 'swing'").select(*carried._SWING_COLUMNS).collect()), key=repr)
    assert got == batch_rows(spark, dense, "swings_1h", carried._SWING_COLUMNS)
    assert carried.stream_in_slices(rows.limit(0), "open_ms", carried.Structure()).count() == 0


def test_a_late_file_stops_the_stream(spark, dense):
    rows = FRAMES["bars_1h"][0](spark, dense).select("symbol", *carried.BAR_COLUMNS)
    path, session = fresh_path(spark, "late"), carried.stateful_session(spark)
    middle = rows.approxQuantile("open_ms", [0.5], 0)[0]
    stream = lambda: session.readStream.schema(rows.schema).parquet(f"{path}/in")
    rows.where(F.col("open_ms") >= middle).write.parquet(f"{path}/in")
    carried.run_stream(stream(), carried.Levels(), path)
    rows.where(F.col("open_ms") < middle).write.mode("append").parquet(f"{path}/in")
    with pytest.raises(Exception, match="after one at"):
        carried.run_stream(stream(), carried.Levels(), path)
