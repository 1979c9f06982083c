"""Structure, levels, sweeps and zones kept up to date from a stream of bars, in keyed state.

A symbol's bars arrive in order of time, in batches of any cut; what a detector
still needs of the bars behind it lies in the state store, so that a restart goes
on where the last batch ended and every cut gives the rows of the batch queries.
What only the next bar can tell is parked until it comes. A bar that is not later
than those seen fails the query, as it would count twice.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from barloom.operators.structure import K
from barloom.plans.sql import spark_query, with_tables
from barloom.runtime import cut, fresh_path
from barloom.sources.frames import FRAMES

BAR_COLUMNS = ["open_ms", "h", "l", "c"]
#: Bars of the range levels; the periods of day and session levels; the rank of all these among levels of one price.
RANGE, PERIODS, RANK = 20, (("day", 86_400_000), ("session", 21_600_000)), 1


class Bars(StatefulProcessor):
    """Steps through a symbol's bars in order of time; ``carry`` is what it keeps between batches."""

    schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("carry", "carry string")

    def start(self) -> dict:
        """The carry before the first bar."""
        return {}

    def load(self) -> None:
        """Further state, before a batch."""

    def step(self, carry: dict, i: int, bar) -> Iterator[tuple]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        carry = json.loads(self.kept.get()[0]) if self.kept.exists() else {"next": 0, "last_ms": None, **self.start()}
        self.load()
        out = []
        for bar in pd.concat(list(rows)).sort_values("open_ms").itertuples(index=False):
            if carry["last_ms"] is not None and bar.open_ms <= carry["last_ms"]:
                raise ValueError(f"{key[0]}: a bar at {bar.open_ms} after one at {carry['last_ms']}")
            out += [(key[0], *row) for row in self.step(carry, carry["next"], bar)]
            carry["last_ms"] = bar.open_ms
            carry["next"] += 1
        self.kept.update((json.dumps(carry, default=float),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in self.schema.split(", ")]).astype(object)

    def close(self) -> None:
        pass


class Structure(Bars):
    """Swings when the bar that confirms them comes, with the labels, breaks and shifts that they complete."""

    schema = (
        "symbol string, event string, i long, conf long, open_ms long, kind string, price double, seq long, label string, previous_label string, "
        "broken_seq long, broken_level double, penetration double, direction string, previous_state string, new_state string"
    )
    _FIELDS = [c.split()[0] for c in schema.split(", ")][1:]

    def start(self) -> dict:
        return {"window": [], "swings": [], "seq": 0, "label": None}

    def step(self, carry, i, bar):
        window = carry["window"]
        window.append([i, int(bar.open_ms), float(bar.h), float(bar.l)])
        del window[: -(2 * K + 1)]
        if len(window) > 2 * K:
            at, open_ms, h, low = window[K]
            others = window[:K] + window[K + 1 :]
            if h > max(x[2] for x in others):
                yield from self.swing(carry, {"i": at, "conf": i, "open_ms": open_ms, "kind": "high", "price": h})
            if low < min(x[3] for x in others):
                yield from self.swing(carry, {"i": at, "conf": i, "open_ms": open_ms, "kind": "low", "price": low})

    def swing(self, carry: dict, new: dict) -> Iterator[tuple]:
        before, new = carry["swings"], {**new, "seq": carry["seq"]}
        beyond = (lambda a, b: a > b) if new["kind"] == "high" else (lambda a, b: a < b)
        row = lambda event, **x: tuple({"event": event, **x}.get(f) for f in self._FIELDS)
        yield row("swing", **new)
        if before and before[-1]["kind"] == new["kind"]:
            higher = new["price"] > before[-1]["price"]
            label = ("HH" if higher else "LH") if new["kind"] == "high" else ("HL" if higher else "LL")
            yield row("label", **new, label=label, previous_label=carry["label"])
            carry["label"] = label
        broken = next((s for s in before if s["kind"] != new["kind"] and beyond(new["price"], s["price"])), None)
        if broken and new["seq"] >= 2:
            side = "long" if new["kind"] == "high" else "short"
            yield row("break", **new, broken_seq=broken["seq"], broken_level=broken["price"], penetration=round(abs(new["price"] - broken["price"]), 2), direction=side)
        if len(before) > 2 and len({s["kind"] for s in before[-3:]}) == 1:
            a, b, c = (s["price"] for s in before[-3:])
            was, now = ("up" if y > x else "down" for x, y in ((a, b), (b, c)))
            if was != now:
                yield row("shift", **before[-1], previous_state=was, new_state=now)
        before.append(new)
        del before[:-5]
        carry["seq"] += 1


def levels_at(carry: dict, i: int, bar) -> list[tuple[str, str, float, int]]:
    """(type, side, price, rank) of the levels that bar ``i`` creates: its range's new ends, and the ends of periods that it follows."""
    found = []
    for name, ms in PERIODS:
        period, now = carry.get(name), int(bar.open_ms) // ms
        if period and period[0] != now:
            found += [(f"{name}_high", "high", period[1], RANK), (f"{name}_low", "low", period[2], RANK)]
        carry[name] = [now, max(period[1], bar.h), min(period[2], bar.l)] if period and period[0] == now else [now, bar.h, bar.l]
    window = carry.setdefault("range", [])
    window.append([bar.h, bar.l])
    del window[:-RANGE]
    ends = [max(x[0] for x in window), min(x[1] for x in window)]
    for side, price, was in zip(("high", "low"), ends, carry.get("ends", ends)):
        if i == RANGE - 1 or (i >= RANGE and price != was):
            found.append((f"range_{side}", side, price, RANK))
    carry["ends"] = ends
    return found


class Levels(Bars):
    """Day and session levels at the first bar after the period; range levels one bar late, as the last bar makes none."""

    schema = "symbol string, creation long, price double, level_type string, specificity long"

    def start(self) -> dict:
        return {"parked": []}

    def step(self, carry, i, bar):
        yield from map(tuple, carry["parked"])
        rows = [(i, float(price), name, rank) for name, _, price, rank in levels_at(carry, i, bar)]
        yield from (r for r in rows if not r[2].startswith("range"))
        carry["parked"] = [r for r in rows if r[2].startswith("range")]


class Sweeps(Bars):
    """Bars that go beyond a level known before them; a sweep is parked until the next bar's close confirms it.

    Of the levels at one price the most specific, then newest, counts; one entry
    for each price is kept, so state grows with the prices that ever were levels.
    """

    schema = "symbol string, i long, conf long, side string, price double, level_type string, creation long, next_close double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.stored = handle.getMapState("levels", "side string, cents long", "specificity long, creation long, level_type string")

    def start(self) -> dict:
        return {"parked": [], "before": None}

    def load(self) -> None:
        self.levels = {tuple(k): tuple(v) for k, v in self.stored.iterator()}
        self.prices = {side: sorted(c for s, c in self.levels if s == side) for side in ("high", "low")}

    def step(self, carry, i, bar):
        yield from ((*row, float(bar.c)) for row in carry["parked"])
        now = {"high": round(bar.h * 100), "low": round(bar.l * 100)}
        carry["parked"] = [] if carry["before"] is None else [self.row(i, side, cents) for side in now for cents in self.crossed(side, carry["before"][side], now[side])]
        carry["before"] = now
        for name, side, price, rank in levels_at(carry, i, bar):
            key = (side, round(price * 100))
            if key not in self.levels:
                insort(self.prices[side], key[1])
            if (rank, i, name) > self.levels.get(key, ()):
                self.levels[key] = (rank, i, name)
                self.stored.updateValue(key, self.levels[key])

    def crossed(self, side: str, was: int, now: int) -> list[int]:
        """Prices that the bar is beyond by over a thousandth and the bar before was not."""
        prices = self.prices[side]
        if side == "high":
            return prices[bisect_left(prices, was * 1000, key=lambda p: p * 1001) : bisect_left(prices, now * 1000, key=lambda p: p * 1001)]
        return prices[bisect_left(prices, now * 1000 + 1, key=lambda p: p * 999) : bisect_left(prices, was * 1000 + 1, key=lambda p: p * 999)]

    def row(self, i: int, side: str, cents: int) -> tuple:
        _, creation, name = self.levels[side, cents]
        return (i, i + 1, side, cents / 100, name, creation)


class Zones(StatefulProcessor):
    """What becomes of zones: bars and zones of a symbol come in one stream, a zone no later than the bar after it is known.

    A zone leaves the state when it ends, at the latest ``max_age`` bars after it is
    known. A row comes out for each zone that a batch changes; the last one counts.
    """

    schema = "symbol string, i long, zone_kind string, state string, touches long, ended_i long, at_i long"

    def __init__(self, max_age: int = 500) -> None:
        self.max_age = max_age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "i long")
        self.open = handle.getMapState("zones", "i long, zone_kind string", "conf long, top double, bottom double, state string, touches long, last_touch long, cleared boolean")

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows)).sort_values(["at", "is_zone"], ascending=[True, True])
        last = self.last.get()[0] if self.last.exists() else -1
        zones = {tuple(k): list(v) for k, v in self.open.iterator()}
        stored = set(zones)
        met: dict[tuple, tuple] = {}
        for r in frame.itertuples(index=False):
            if r.is_zone:
                zones[int(r.zone_i), r.zone_kind] = [int(r.at), float(r.top), float(r.bottom), "fresh", 0, None, True]
                continue
            if r.at <= last:
                raise ValueError(f"{key[0]}: bar {r.at} after bar {last}")
            last = int(r.at)
            for z in [z for z, state in zones.items() if state[0] < last]:
                ended = self.advance(zones[z], z[1], r)
                met[z] = (key[0], *z, zones[z][3], zones[z][4], last if ended else None, last)
                if ended:
                    del zones[z]
        for z in stored - set(zones):
            self.open.removeKey(z)
        for z, state in zones.items():
            self.open.updateValue(z, tuple(state))
        self.last.update((last,))
        out = pd.DataFrame(list(met.values()), columns=["symbol", "i", "zone_kind", "state", "touches", "ended_i", "at_i"])
        yield out.astype({"ended_i": "Int64"})

    def advance(self, zone: list, kind: str, bar) -> bool:
        """True if the bar ends the zone."""
        conf, top, bottom, _, touches, last_touch, cleared = zone
        if bar.at - conf > self.max_age:
            zone[3] = "expired"
            return True
        depth = (top - bar.c) / (top - bottom) if kind == "demand" else (bar.c - bottom) / (top - bottom)
        if bar.l <= top and bar.h >= bottom:
            if touches == 0:
                zone[3] = "mitigated"
            if cleared and (last_touch is None or bar.at - last_touch >= 3):
                zone[4:6] = touches + 1, int(bar.at)
            zone[6] = False
        else:
            zone[6] = True
        if depth > 0.5:
            zone[3] = "invalidated"
            return True
        return False

    def close(self) -> None:
        pass


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same cluster whose streams keep their state in RocksDB, as keyed processors need."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return session


def run_stream(rows: DataFrame, processor: StatefulProcessor, path: str) -> None:
    """Run a stream of rows with ``symbol`` through a processor until it has taken all there is.

    Each batch is written under its number, so that a repeated batch replaces
    itself; the state and the offsets lie beside them.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batches/batch={number:09d}")

    out = rows.groupBy("symbol").transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.schema, outputMode="Append", timeMode="None")
    out.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def stream_in_slices(rows: DataFrame, order: str, processor: StatefulProcessor, slices: int = 6, starts: int = 2) -> DataFrame:
    """The processor's rows over a table that arrives in ``slices`` by range of ``order``.

    The stream is started ``starts`` times, each time with further slices in its
    folder, and goes on from its checkpoint; a slice's files hold whole symbols.
    """
    spark = stateful_session(rows.sparkSession)
    path = fresh_path(rows.sparkSession, "carried")
    rows = cut(rows, "slices")
    low, high = rows.agg(F.min(order), F.max(order)).first()
    if low is None:
        return rows.sparkSession.createDataFrame([], processor.schema)
    step = (high - low) // slices + 1
    for k in range(slices):
        part = rows.where((F.col(order) >= low + k * step) & (F.col(order) < low + (k + 1) * step))
        part.repartition("symbol").write.mode("append").parquet(f"{path}/in")
        if (k + 1) * starts // slices > k * starts // slices:
            run_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), processor, path)
    # A batch without rows has a file without rows, never none.
    return rows.sparkSession.read.schema(processor.schema).option("recursiveFileLookup", "true").parquet(f"{path}/batches")


# -- queries ------------------------------------------------------------------


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FRAMES["bars_1h"][0](spark, sf_dir).select("symbol", *BAR_COLUMNS)


def _structure(event: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: stream_in_slices(_bars(spark, sf_dir), "open_ms", Structure()).where(F.col("event") == event).select(*columns)


def streamed_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_in_slices(_bars(spark, sf_dir), "open_ms", Levels())


def streamed_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_in_slices(_bars(spark, sf_dir), "open_ms", Sweeps())


def bars_and_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each bar, at its index, and for each zone, at the bar at which it is known."""
    from barloom.operators.events import SQL

    none = {c: F.lit(None).cast(t) for c, t in (("zone_i", "long"), ("zone_kind", "string"), ("top", "double"), ("bottom", "double"))}
    bars = FRAMES["bars_1h"][0](spark, sf_dir).select("symbol", F.col("i").cast("long").alias("at"), F.lit(False).alias("is_zone"), "h", "l", "c").withColumns(none)
    zones = spark_query(SQL["supply_demand_zones"])(spark, sf_dir).select(
        "symbol", F.col("conf").cast("long").alias("at"), F.lit(True).alias("is_zone"), *[F.lit(None).cast("double").alias(c) for c in "hlc"],
        F.col("i").cast("long").alias("zone_i"), "zone_kind", F.col("zone_high").alias("top"), F.col("zone_low").alias("bottom"),
    )
    return bars.unionByName(zones)


def latest_zones(rows: DataFrame) -> DataFrame:
    """The last state of each zone."""
    last = rows.groupBy("symbol", "i", "zone_kind").agg(F.max_by(F.struct("state", "touches", "ended_i"), "at_i").alias("x"))
    return last.select("symbol", "i", "zone_kind", "x.*")


def streamed_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_zones(stream_in_slices(bars_and_zones(spark, sf_dir), "at", Zones()))


_SWING_COLUMNS = ["symbol", "i", "conf", "open_ms", "kind", "price", "seq"]
_BREAK_COLUMNS = ["symbol", "i", "conf", "kind", "price", "broken_seq", "broken_level", "penetration", "direction"]
_LABEL_COLUMNS = ["symbol", "i", "conf", "kind", "price", "label", "previous_label"]
_SHIFT_COLUMNS = ["symbol", "i", "conf", "price", "previous_state", "new_state"]
QUERIES = {
    "streamed_swings": _structure("swing", *_SWING_COLUMNS),
    "streamed_breaks": _structure("break", *_BREAK_COLUMNS),
    "streamed_levels": streamed_levels,
    "streamed_sweeps": streamed_sweeps,
    "streamed_zones": streamed_zones,
}


def _oracles() -> dict[str, str]:
    """A stream's rows are those of the batch query."""
    from barloom.operators.structure import SQL

    same = {"streamed_swings": "swings_1h", "streamed_breaks": "break_of_structure", "streamed_levels": "levels_union", "streamed_sweeps": "liquidity_sweeps"}
    return {name: with_tables(SQL[batch]) for name, batch in same.items()}


ORACLES = _oracles()
