"""Draws by table and sums of a task, against the plain rule."""

from __future__ import annotations

import numpy as np
import pandas as pd

from barloom.operators import simulation as sim


def _plain(keys: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64)[:, None] + np.arange(1, resamples + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x = x ^ (x >> np.uint64(31))
    return np.searchsorted(sim._POISSON, (x >> np.uint64(11)) / float(1 << 53), side="right")


def test_draws_by_table():
    keys = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 3000)
    assert (sim._DRAWS == sim.UNSURE).sum() > 0
    assert (sim.draws(keys, 500, 7) == _plain(keys, 500, 7)).all()


def test_a_task_hands_on_one_sum_for_each_group():
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"g": rng.choice(list("abc"), 900), "x": rng.normal(size=900), "n": 1, "k": rng.integers(0, 2**40, 900)})
    out = list(sim.resampled([rows.iloc[i : i + 50] for i in range(0, 900, 50)], 40, 9))
    assert len(out) == 3
    for f in out:
        own = rows[rows["g"] == f["g"].iloc[0]]
        w = _plain(own["k"].to_numpy(), 40, 9)
        assert (f["n"] == w.sum(axis=0)).all() and np.allclose(f["s"], own["x"].to_numpy() @ w)


def test_clusters_are_drawn_whole(spark):
    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"g": rng.choice(["a", "b"], 400), "x": rng.normal(size=400), "k": rng.integers(0, 12, 400)})
    df = spark.createDataFrame(rows)
    whole, single = ({r["g"]: r for r in sim.bootstrap_mean(df, "g", "x", "k", 200, clustered=c).collect()} for c in (True, False))
    assert whole.keys() == single.keys()
    for g, r in whole.items():
        assert r["n"] == single[g]["n"] and r["p_value"] == single[g]["p_value"] and np.allclose([r["low"], r["high"]], [single[g]["low"], single[g]["high"]])
