"""A log of events as JSON lines: typed payloads out and in, damaged lines told apart, replay and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.audits import differences
from barloom.operators.events import SQL as EVENTS
from barloom.operators.structure import SQL as STRUCTURE
from barloom.plans.sql import spark_query, with_tables
from barloom.runtime import cut, fresh_path

ENVELOPE = "symbol string, seq long, kind string, conf long, i long, side string, payload string"
_FIELDS = [c.split()[0] for c in ENVELOPE.split(", ")]
_NEEDED = ["symbol", "seq", "kind", "conf", "i", "payload"]
#: Kind of event -> what its payload holds; any other kind has a price.
PAYLOADS = {
    "sweep": "price double, level_type string, penetration double, recovery_ratio double, wick_ratio double, volume long",
    "zone": "price double, zone_low double, pivot_i long",
}
_PLAIN = "price double"


def _payload_columns(kind: str) -> list[tuple[str, str]]:
    return [tuple(c.split()) for c in PAYLOADS.get(kind, _PLAIN).split(", ")]


def _sane(name: str, kind: str) -> Column:
    """The column in its payload's type; NaN and infinities, which JSON has not, become null."""
    value = F.col(name).cast(kind)
    if kind == "double":
        value = F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)
    return value.alias(name)


def lines(events: DataFrame) -> DataFrame:
    """(value): a JSON line for each event; its payload is a JSON text of its kind's fields, nulls included.

    A payload field that ``events`` lacks is null.
    """
    absent = {n: F.lit(None).cast(t) for k in [*PAYLOADS, ""] for n, t in _payload_columns(k) if n not in events.columns}
    events = events.withColumns(absent) if absent else events
    text = lambda kind: F.to_json(F.struct(*[_sane(n, t) for n, t in _payload_columns(kind)]), {"ignoreNullFields": "false"})
    payload = text("")
    for kind in PAYLOADS:
        payload = F.when(F.col("kind") == kind, text(kind)).otherwise(payload)
    return events.withColumn("payload", payload).select(F.to_json(F.struct(*_FIELDS), {"ignoreNullFields": "false"}).alias("value"))


def write_log(events: DataFrame, path: str) -> None:
    lines(events).write.text(path)


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, damaged): the lines that hold an event, and the text of those that do not.

    A line is damaged if it is no JSON object, if a field has another type, if one
    but the side is missing, or if its payload is not one of its kind. Every line is
    in one of the two; blank ones are in neither.
    """
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.select("value", F.from_json("value", ENVELOPE + ", corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("e"))
    whole = F.col("e").isNotNull() & F.col("e.corrupt").isNull()
    for name in _NEEDED:
        whole = whole & F.col(f"e.{name}").isNotNull()
    readable = F.lit(False)
    for kind in ["", *PAYLOADS]:
        own = F.from_json("e.payload", PAYLOADS.get(kind, _PLAIN) + ", corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
        good = own.isNotNull() & own["corrupt"].isNull()
        readable = F.when(F.col("e.kind") == kind, good).otherwise(readable) if kind else good
    held = cut(parsed.withColumn("whole", F.coalesce(whole & readable, F.lit(False))), "event-log")
    return held.where("whole").select("e.*").drop("corrupt"), held.where("not whole").select("value")


def typed(events: DataFrame, kind: str) -> DataFrame:
    """Logged events of a kind with their payload's fields as columns."""
    own = events.where(F.col("kind") == kind).withColumn("p", F.from_json("payload", PAYLOADS.get(kind, _PLAIN)))
    return own.select(*[c for c in _FIELDS if c != "payload"], "p.*")


def reconcile(logged: DataFrame, fresh: DataFrame) -> DataFrame:
    """(symbol, kind, logged, fresh, differing): events of each kind in the log and made anew, and those that do not stand equally often in both."""
    envelope = [c for c in _FIELDS if c != "payload"]
    fresh = fresh.select(*envelope)
    logged = logged.select(*envelope)
    gaps = differences(logged, fresh).groupBy("row.symbol", "row.kind").agg(F.sum(F.abs(F.col("a_times") - F.col("b_times"))).alias("differing"))
    counted = lambda df, name: df.groupBy("symbol", "kind").agg(F.count("*").alias(name))
    both = counted(logged, "logged").join(counted(fresh, "fresh"), ["symbol", "kind"], "full").join(gaps, ["symbol", "kind"], "left")
    return both.na.fill(0, ["logged", "fresh", "differing"])


#: Least share of the way back, and of the wick, that a sweep of a low needs.
RECOVERY, WICK = 0.5, 0.5
_STEPS = f"""count(*) AS sweeps, count(*) FILTER (WHERE side = 'low') AS lows, count(*) FILTER (WHERE side = 'low' AND recovery_ratio >= {RECOVERY}) AS recovered,
  count(*) FILTER (WHERE side = 'low' AND recovery_ratio >= {RECOVERY} AND wick_ratio >= {WICK}) AS accepted"""


def funnel(sweeps: DataFrame) -> DataFrame:
    """Counters of the low-sweep setup, from typed events."""
    return sweeps.sparkSession.sql(f"SELECT symbol, {_STEPS} FROM {{sweeps}} GROUP BY symbol", sweeps=sweeps)


# -- queries ------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event, with the measures of sweeps and the bands of zones."""
    events = spark_query(EVENTS["events_union"])(spark, sf_dir)
    measures = spark_query(STRUCTURE["sweep_measures"])(spark, sf_dir).withColumn("kind", F.lit("sweep"))
    zones = spark_query(EVENTS["supply_demand_zones"])(spark, sf_dir).select("symbol", F.lit("zone").alias("kind"), "i", F.col("zone_kind").alias("side"), "zone_low", "pivot_i")
    return cut(events.join(measures, ["symbol", "kind", "i", "side", "price"], "left").join(zones, ["symbol", "kind", "i", "side"], "left"), "events")


def _logged(spark: SparkSession, events: DataFrame) -> DataFrame:
    path = fresh_path(spark, "log")
    write_log(events, path)
    return read_log(spark, path)[0]


def event_log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return reconcile(_logged(spark, events), events)


def funnel_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The setup's counters from the log alone."""
    return funnel(typed(_logged(spark, _events(spark, sf_dir)), "sweep"))


def zones_from(events: DataFrame) -> DataFrame:
    """The zones that a log holds, without the bars they were found on."""
    return typed(events, "zone").select("symbol", "i", "conf", F.col("side").alias("zone_kind"), "pivot_i", F.col("price").alias("zone_high"), "zone_low")


def zones_from_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones_from(_logged(spark, _events(spark, sf_dir)))


QUERIES = {"event_log_replay": event_log_replay, "funnel_replay": funnel_replay, "zones_from_log": zones_from_log}
ORACLES = {
    "event_log_replay": f"SELECT symbol, kind, count(*) AS logged, count(*) AS fresh, 0::BIGINT AS differing FROM ({with_tables(EVENTS['events_union'])}) GROUP BY symbol, kind",
    "zones_from_log": with_tables(EVENTS["supply_demand_zones"]),
    "funnel_replay": f"SELECT symbol, {_STEPS} FROM ({with_tables(STRUCTURE['sweep_measures'])}) GROUP BY symbol",
}
