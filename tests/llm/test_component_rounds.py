"""Components by one shuffle a star: the roots of a plain union-find, and no more jobs and tasks than that takes."""

from __future__ import annotations

import random

import pytest

from barloom.llm import graph
from barloom.llm.graph import Forest, connected_components
from barloom.runtime import cut_at


def by_union(edges):
    forest = Forest()
    for u, v in edges:
        forest.join(u, v)
    return {x: forest.find(x) for e in edges for x in e}


def graphs():
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(300)]
    yield "chain", [(a, b) if rng.random() < 0.5 else (b, a) for a, b in chain]
    yield "hub above", [(10_000, k) for k in range(2000)] + [(k, k + 3000) for k in range(500)]
    yield "hub below", [(-7, k) for k in range(2000)] + [(k, -k - 10) for k in range(500)]
    yield "loose", [(a, b) for a, b in ((rng.randrange(4000) - 2000, rng.randrange(4000) - 2000) for _ in range(1900)) if a != b]
    yield "ends of long", [(-(2**63), 2**63 - 1), (2**63 - 1, 0), (5, 2**62)]


@pytest.mark.parametrize(("name", "edges"), list(graphs()), ids=lambda x: x if isinstance(x, str) else "")
def test_roots_are_those_of_a_union_find(spark, name, edges):
    random.Random(len(edges)).shuffle(edges)
    found = connected_components(spark.createDataFrame([*edges, *edges[:9], (1, 1), (None, 3)], "u long, v long").repartition(7)).collect()
    assert len(found) == len({r["node"] for r in found})
    assert {r["node"]: r["root"] for r in found} == by_union(edges)


def test_shuffles_of_a_round(spark, monkeypatch):
    """A table is written after one shuffle, or after three in a round; it is looked at once."""
    at = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long").repartition(8).localCheckpoint()
    sc, seen = spark.sparkContext, []
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "50")
        sc.setJobGroup("component-rounds", "")
        monkeypatch.setattr(graph, "cut_at", lambda df, tag: seen.append(tag) or cut_at(df, tag))
        graph.connected_components(edges)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in at.items():
            spark.conf.set(k, v)
    tracker = sc.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup("component-rounds") for s in tracker.getJobInfo(job).stageIds}
    tasks = sorted(i.numTasks for i in map(tracker.getStageInfo, stages) if i)
    assert sum(n == 50 for n in tasks) <= 3 * len(seen) - 2, (tasks, seen)
