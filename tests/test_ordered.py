"""Quantiles, streaks and autocorrelations over many ranges and batches, against plain loops."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from barloom.catalogue import QUERIES
from barloom.operators.ordered import LAGS, _bucket, lag_sums, longest_streaks, quantiles


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("kind", ["normal", "few", "narrow"])
def test_quantiles(spark, kind):
    rng = np.random.default_rng(1)
    v = {"normal": rng.normal(size=3000), "few": rng.integers(-2, 3, 3000) * 0.5, "narrow": 1000 + rng.random(3000) / 100}[kind]
    rows = pd.DataFrame({"g": rng.choice(["a", "b", None], 3000, p=[0.9, 0.099, 0.001]), "h": "x", "v": v})
    rows.loc[7:40, "v"] = None
    shares = [0, 0.01, 0.25, 0.5, 0.501, 0.99, 1]
    df = spark.createDataFrame(rows.astype({"g": object}), "g string, h string, v double").withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = {r["g"]: r["q"] for r in quantiles(df, ["g", "h"], "v", shares).collect()}
    for g, part in rows.groupby("g", dropna=False):
        assert np.allclose(got[None if pd.isna(g) else g], np.quantile(part["v"].dropna(), shares), rtol=0, atol=1e-12)


def test_buckets_never_fall(spark):
    v = sorted([0.0, -0.0, 5e-324, -5e-324, 1.0, -1.0, 1e308, -1e308, *np.random.default_rng(2).normal(size=500).tolist()])
    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "v double").coalesce(1).select(_bucket("v")).collect()]
    assert got == sorted(got)


def _rows(spark, n: int, seed: int):
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({"g": rng.choice(["a", "b", "c"], n, p=[0.7, 0.29, 0.01]), "o": rng.permutation(n), "x": rng.normal(size=n), "s": np.repeat(rng.choice([-1, 0, 1], n), rng.integers(1, 9, n))[:n]})
    rows = pd.concat([rows, pd.DataFrame({"g": ["one"], "o": [n], "x": [1.5], "s": [0]})])
    return rows, spark.createDataFrame(rows).repartition(5)


def test_streaks_across_ranges(spark, small_ranges):
    for seed in range(3):
        rows, df = _rows(spark, 300, seed)
        rows["s"] = rows.sort_values(["g", "o"])["s"].values if seed else rows["s"]
        df = spark.createDataFrame(rows)
        got = {r["g"]: (r["wins"], r["losses"]) for r in longest_streaks(df, "g", ["o"], F.col("s")).collect()}
        for g, part in rows.groupby("g"):
            longest, was, n = {}, None, 0
            for s in part.sort_values("o")["s"]:
                n = n + 1 if s == was else 1
                was = s
                longest[s] = max(longest.get(s, 0), n)
            assert got[g] == (longest.get(1), longest.get(-1))


def test_lags_across_ranges(spark, small_ranges):
    rows, _ = _rows(spark, 300, 9)
    rows.loc[rows["o"] % 17 == 3, "x"] = None
    df = spark.createDataFrame(rows).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = {r["g"]: r for r in lag_sums(df, "g", ["o"], F.col("x")).collect()}
    for g, part in rows.groupby("g"):
        x = part.sort_values("o")["x"].to_numpy()
        assert got[g]["n"] == len(x) and np.isclose(got[g]["squares"], np.nansum(x * x))
        for j in range(1, LAGS + 1):
            p = x[j:] * x[:-j]
            p = p[~np.isnan(p)]
            assert (got[g]["sums"][j - 1] is None) if not len(p) else np.isclose(got[g]["sums"][j - 1], p.sum())


@pytest.mark.parametrize("name", ["streaks", "autocorrelation", "r_distribution", "bps_sensitivity", "stage_ladder"])
def test_no_group_whole_in_a_task(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan
    if name == "stage_ladder":
        assert plan.count("lineitem.parquet") == 1
    elif name in ("streaks", "autocorrelation"):
        assert "o_orderpriority" not in "".join(line for line in plan.splitlines() if "Window" in line)
