"""Block bootstraps, false discovery and matched controls against plain loops."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.catalogue import QUERIES
from barloom.operators import resampling as rs
from barloom.operators.simulation import bootstrap_mean, false_discovery


def number(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def looped(rows, resamples, seed):
    """Each statistic from index draws of whole blocks, one resample at a time."""
    out = {}
    for g in {r[0] for r in rows}:
        found = defaultdict(list)
        for _, b, v in (r for r in rows if r[0] == g and r[2] is not None):
            found[b].append(v)
        held = [found[b] for b in sorted(found)]
        stats = defaultdict(list)
        for r in range(resamples):
            values = [v for j in range(len(held)) for v in held[number(seed, g, r, j) % len(held)]]
            loss = -sum(v for v in values if v < 0)
            stats["m"].append(sum(values) / len(values))
            stats["w"].append(sum(v > 0 for v in values) / len(values))
            stats["t"].append(sum(values))
            if loss:
                stats["f"].append(sum(v for v in values if v > 0) / loss)
        values = [v for b in held for v in b]
        mean, loss = sum(values) / len(values), -sum(v for v in values if v < 0)
        ends = lambda k: tuple(np.percentile(stats[k], [2.5, 97.5])) if stats[k] else (None, None)
        p = (sum(round(abs(m), 6) >= round(abs(mean), 6) for m in stats["m"]) + 1) / (resamples + 1) if len(values) > 1 else None
        out[g] = (len(values), len(held), mean, *ends("m"), sum(v > 0 for v in values) / len(values), *ends("w"), sum(v for v in values if v > 0) / loss if loss else None, *ends("f"), sum(values), *ends("t"), p)
    return out


def trades():
    rng = random.Random(7)
    rows = [(g, rng.randint(0, 14), rng.randint(-500, 600)) for g in "ab" for _ in range(150)]
    return rows + [("one", 3, 10), ("win", 1, 5), ("win", 2, 7), ("a", None, 11), ("a", 2, None), ("zero", 1, 0), ("zero", 2, 0)]


def test_block_bootstrap_by_index_draws(spark):
    rows = [(g, -1 if b is None else b, v) for g, b, v in trades()]
    df = spark.createDataFrame(rows, "g_ string, b_ long, v_ long").withColumns({"n": F.lit(1), "at": F.lit("x"), "r": F.lit(2)}).repartition(5)
    got = {r["g_"]: tuple(r)[1:] for r in rs.block_bootstrap(df, "g_", "b_", "v_", resamples=200, seed=5).collect()}
    want = looped(rows, 200, 5)
    assert set(got) == set(want)
    for g, row in want.items():
        assert all(x is y is None or x == pytest.approx(y, abs=2e-3, rel=1e-6) for x, y in zip(got[g], row, strict=True)), g
    assert rs.block_bootstrap(df.limit(0), "g_", "b_", "v_", resamples=10).count() == 0


def test_block_bootstrap_widens_with_dependence(spark):
    """Trades of a block that are all alike count as one: the interval is as wide as that of the blocks."""
    rng = random.Random(2)
    alike = [("g", b, v) for b in range(60) for v in [rng.randint(-100, 110)] for _ in range(20)]
    spread = [("g", k, v) for k, (_, _, v) in enumerate(alike)]
    width = lambda rows: (lambda r: r["upper"] - r["lower"])(rs.block_bootstrap(spark.createDataFrame(rows, "g_ string, b long, v long"), "g_", "b", "v", resamples=300).first())
    assert width(alike) > 3 * width(spread)


def test_ledger_statistics_of_the_query(spark, sf_dir):
    rows = [tuple(r) for r in rs.spark_query("SELECT run_id, exit_month, net_u FROM {ledger}")(spark, sf_dir).collect()]
    got = {r["run_id"]: r for r in QUERIES["block_bootstrap_month"](spark, sf_dir).collect()}
    for run, (n, blocks, mean, *_rest) in looped(rows, 3, 1).items():
        assert (got[run]["n"], got[run]["n_blocks"]) == (n, blocks) and got[run]["mean"] == pytest.approx(mean, rel=1e-6)
        assert got[run]["lower"] <= got[run]["mean"] <= got[run]["upper"] and got[run]["pf_lower"] <= got[run]["profit_factor"] <= got[run]["pf_upper"]


def test_false_discovery_by_a_loop(spark):
    ps = {"a": 0.01, "b": 0.04, "c": 0.03, "d": 0.005, "e": 0.5, "f": 1.0, "tie1": 0.04, "none": None, "zero": 0.0, "over": 1.5}
    ranked = sorted((p, k) for k, p in ps.items() if p is not None and 0 < p <= 1)
    want, least = dict.fromkeys(ps), 1.0
    for rank in range(len(ranked), 0, -1):
        p, k = ranked[rank - 1]
        least = min(least, p * len(ranked) / rank)
        want[k] = least
    got = {r["k"]: r["q"] for r in false_discovery(spark.createDataFrame(list(ps.items()), "k string, p double"), "p", ["k"]).collect()}
    assert got == {k: None if q is None else pytest.approx(q) for k, q in want.items()}
    assert QUERIES["benjamini_hochberg"] is rs.benjamini_hochberg


def test_p_value_of_a_mean_is_not_centred(spark):
    rows = spark.createDataFrame([("g", float(v), k) for k, v in enumerate([1, -1, 2, -2, 3, 1, 1, 2])], "g string, x double, k long")
    r = bootstrap_mean(rows, "g", "x", "k", resamples=400).first()
    assert 0.3 < r["p_value"] < 0.8
    assert bootstrap_mean(rows.limit(1), "g", "x", "k", resamples=20).first()["p_value"] is None


# -- matched control -------------------------------------------------------------


def test_matched_sample(spark):
    universe = [(s, w, i) for s in "xy" for w in range(3) for i in range(100 * w, 100 * w + (5 if (s, w) == ("y", 2) else 60))]
    rng = random.Random(4)
    events = [u for u in universe if rng.random() < 0.2 and u[:2] != ("y", 2)] + [("y", 2, i) for i in range(200, 204)] + [("x", 0, None), ("q", 0, 1)]
    events += events[:3]
    u, e = spark.createDataFrame(universe, "symbol string, span long, i long"), spark.createDataFrame(events, "symbol string, span long, i long")
    pick = lambda a, b, seed: {tuple(r) for r in rs.matched_sample(a, b, "i", ["symbol", "span"], seed).collect()}
    got = pick(e, u, 9)
    assert got == pick(e.repartition(7), u.repartition(11), 9) != pick(e, u, 10)
    own = {x for x in events if x[2] is not None}
    want = set()
    for stratum, n in Counter(x[:2] for x in own).items():
        free = sorted((number(9, *x), x) for x in universe if x[:2] == stratum and x not in own)
        want |= {x for _, x in free[:n]}
    assert got == want and not got & own
    assert len([x for x in got if x[:2] == ("y", 2)]) == 1  # one of five bars is left
    # A bar that comes later displaces at most one that was drawn.
    assert len(got - pick(e, u.unionByName(spark.createDataFrame([("x", 0, 59_000)], u.schema)), 9)) <= 1
    assert pick(e.limit(0), u, 9) == set() == pick(e, u.limit(0), 9)


def test_control_has_as_many_rows_as_there_are_events(spark, sf_dir):
    drawn, events = rs._drawn(spark, sf_dir)
    want = {(r["symbol"], r["span"]): r["count"] for r in events.groupBy("symbol", "span").count().collect()}
    for seed in rs.SEEDS:
        assert {(r["symbol"], r["span"]): r["count"] for r in drawn.where(F.col("seed") == seed).groupBy("symbol", "span").count().collect()} == want
    assert drawn.join(events, ["symbol", "i"], "left_semi").count() == 0
