"""Audits must find what is planted: leaks, repetitions, changed cells, rows out of place."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barloom.catalogue import QUERIES
from barloom.operators import audits
from barloom.plans.sql import spark_query
from barloom.sources.frames import FRAMES


@pytest.fixture(scope="module")
def dense():
    return "/root/testdata/sf0.01"


# -- multisets -----------------------------------------------------------------

ROWS_A = [(1, "x", 0.5), (1, "x", 0.5), (2, None, float("nan")), (3, "y", -0.0), (None, None, None)]
ROWS_B = [(1, "x", 0.5), (2, None, float("nan")), (3, "y", 0.0), (None, None, None), (4, "z", 1.0)]


def test_a_repeated_row_is_found(spark):
    schema = "a_times long, row string, x double"
    a, b = spark.createDataFrame(ROWS_A, schema), spark.createDataFrame(ROWS_B, schema).select("x", "row", "a_times")
    got = {(r["row"]["a_times"], r["a_times"], r["b_times"]) for r in audits.differences(a, b).collect()}
    assert got == {(1, 2, 1), (4, 0, 1)}
    assert a.select("row").subtract(b.select("row")).count() == 0  # a difference of sets sees no repetition
    assert audits.differences(a, a.repartition(7)).count() == 0 and audits.differences(a.limit(0), b.limit(0)).count() == 0
    first = audits.first_differences(a.withColumnsRenamed({"a_times": "k"}), b.withColumnsRenamed({"a_times": "k"}), 1).collect()
    assert [(r["k"], r["a_times"], r["b_times"]) for r in first] == [(1, 2, 1)]
    with pytest.raises(ValueError):
        audits.differences(a, b.drop("x"))


def test_side_differences_by_a_loop(spark, sf_dir):
    rows = FRAMES["ledger"][0](spark, sf_dir).select("side", "run_id", "regime", "exit_reason", "entry_month").collect()
    longs, shorts = (Counter(tuple(r)[1:] for r in rows if r["side"] == s) for s in ("long", "short"))
    want = sorted((*k, longs[k], shorts[k]) for k in longs | shorts if longs[k] != shorts[k])
    assert sorted(tuple(r) for r in QUERIES["side_differences"](spark, sf_dir).collect()) == want


# -- prefixes ------------------------------------------------------------------


def audit(spark, sf_dir, sql, known):
    found = audits.audit_prefixes(spark, sf_dir, {"q": (spark_query(sql), known)}, shares=(0.5, 0.8)).collect()
    return {r["prefix"]: (r["compared"], r["changed"], r["future"]) for r in found}


def test_a_causal_query_is_clean(spark, dense):
    bars = spark_query("SELECT symbol, i, open_ms FROM {bars_1h}")(spark, dense)
    ends = audits._ends(spark, dense, (0.5, 0.8))
    want = {k: bars.where(F.col("open_ms") < e).count() for k, e in enumerate(ends)}
    assert audit(spark, dense, "SELECT symbol, i, max(h) OVER (PARTITION BY symbol ORDER BY i) AS top FROM {bars_1h}", "i") == {k: (n, 0, 0) for k, n in want.items()}


def test_planted_leaks_are_caught(spark, dense):
    next_close = "SELECT symbol, i, lead(c) OVER (PARTITION BY symbol ORDER BY i) AS c1 FROM {bars_1h}"
    mean = "SELECT symbol, i, round(c - avg(c) OVER (PARTITION BY symbol), 6) AS x FROM {bars_1h}"
    early = "SELECT symbol, i, max(h) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS x FROM {bars_1h}"
    symbols = FRAMES["bars_1h"][0](spark, dense).select("symbol").distinct().count()
    one = audit(spark, dense, next_close, "i")
    # The last bar of each prefix and symbol: null there, a price in the whole.
    assert all(changed == 2 * symbols and future == 0 for _, changed, future in one.values())
    # Marked as known a bar later it changes nothing, but the prefix should not have given its last bar at all.
    assert all(changed == 0 and future == symbols for _, changed, future in audit(spark, dense, next_close, "i + 1").values())
    assert all(changed > n for n, changed, _ in audit(spark, dense, mean, "i").values())
    assert all(changed > 0 for _, changed, _ in audit(spark, dense, early, "i").values())
    assert all(changed == 0 for _, changed, _ in audit(spark, dense, early, "i + 3").values())
    # A label of a bar that the prefix does not have.
    assert all(future == 2 * symbols for _, _, future in audit(spark, dense, "SELECT symbol, i FROM {bars_1h}", "i + 2").values())


# -- digests -------------------------------------------------------------------


def tree(rows):
    digest = lambda r: hashlib.sha256("|".join("-" if v is None else f"{len(str(v))}:{v}" for v in r).encode()).hexdigest()
    level = [digest(r) for r in rows]
    for _ in range(audits.LEVELS):
        level = [hashlib.sha256("".join(level[k : k + audits.FAN]).encode()).hexdigest() for k in range(0, len(level), audits.FAN)]
    return level[0]


def test_digests_do_not_depend_on_partitions_and_change_with_a_cell(spark, monkeypatch):
    monkeypatch.setattr(audits, "FAN", 16)
    rows = [(k, f"t{k % 7}" if k % 11 else None) for k in range(3000)]
    df = spark.createDataFrame(rows, "at long, h string")
    ordered = lambda d: tuple(audits.ordered_digest(d, ["at"], ["at", "h"]).first())
    free = lambda d: tuple(audits.unordered_digest(d, ["at", "h"]).first())
    assert ordered(df) == ordered(df.repartition(13)) == ordered(df.coalesce(1)) == (3000, tree(rows))
    assert free(df) == free(df.repartition(9).orderBy(F.desc("at")))
    cell = df.withColumn("h", F.when(F.col("at") == 1234, "other").otherwise(F.col("h")))
    blank = df.withColumn("h", F.coalesce("h", F.lit("")))
    twice = df.unionByName(df.where("at = 5"))
    assert len({ordered(d) for d in (df, cell, blank, twice)}) == len({free(d) for d in (df, cell, blank, twice)}) == 4
    # An order of its own: the same rows by another column.
    assert tuple(audits.ordered_digest(df, ["h", "at"], ["at", "h"]).first()) != ordered(df)
    audits.verify(df, {"rows": 3000, "digest": ordered(df)[1]}, ["at"], ["at", "h"])
    with pytest.raises(ValueError):
        audits.verify(cell, {"rows": 3000, "digest": ordered(df)[1]}, ["at"], ["at", "h"])
    assert ordered(df.limit(0)) == (0, hashlib.sha256().hexdigest()) and free(df.limit(0)) == (0, "0" * 64)


# -- positions -----------------------------------------------------------------


def test_a_row_out_of_place_aborts_the_job(spark, dense):
    bars = FRAMES["bars_1h"][0](spark, dense)
    ledger = bars.where("i % 9 = 3").select("symbol", F.col("i").alias("entry_i"), F.col("open_ms").alias("entry_ms"))
    assert audits.aligned(ledger, bars).count() == ledger.count() > 100
    shifted = ledger.withColumn("entry_ms", F.when((F.col("entry_i") == 12) & (F.col("symbol") == "CLICK"), F.col("entry_ms") + 3_600_000).otherwise(F.col("entry_ms")))
    beyond = ledger.withColumn("entry_i", F.when(F.col("entry_i") == 12, F.lit(10**6)).otherwise(F.col("entry_i")))
    for bad in (shifted, beyond, ledger.withColumn("entry_ms", F.lit(None).cast("long"))):
        with pytest.raises(Exception, match="row out of place"):
            audits.aligned(bad, bars).count()
    assert audits.aligned(ledger.limit(0), bars).count() == 0
