"""op7 over many shards: recall against all rows, and the size of each search group."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import embedding_dedup


def pairs_near(rng, n, width):
    """n random unit vectors, each with a copy at a cosine in [0.98, 0.99]."""
    x = rng.normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(n, width))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cos = rng.uniform(0.981, 0.99, size=(n, 1))
    return np.vstack([x, cos * x + np.sqrt(1 - cos**2) * y])


def test_recall_across_shards(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 20)
    x = pairs_near(np.random.default_rng(9), 1000, 64).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(4)
    found, true = embedding_dedup.audit_recall(frame, sample=2000)
    assert true == 2000 and found == true


def test_recall_across_two_levels_of_shards(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 20)
    monkeypatch.setattr(embedding_dedup, "SHARD_MOST", 30)
    monkeypatch.setattr(embedding_dedup, "CENTERS", 8)
    x = pairs_near(np.random.default_rng(11), 600, 32)
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    found, true = embedding_dedup.audit_recall(frame, sample=1200)
    assert true >= 1200 and found == true
    vectors = embedding_dedup._vectors(frame, "vec_id", "embedding", "label").select("label", F.col("id").alias("rep"), "key")
    members = embedding_dedup._members(vectors, embedding_dedup.DOUBLE)
    assert members.select("shard").distinct().count() > 8 * 4
    assert members.where("node").select("rep").distinct().count() == 1200


def test_the_audit_of_the_query_measures_pairs_and_can_fail(spark, monkeypatch):
    """2,000 pairs among 6,000 vectors in many shards: the default sample meets over 100, and the job fails if half are lost."""
    monkeypatch.setattr(embedding_dedup, "SHARD", 60)
    rng = np.random.default_rng(5)
    x = np.vstack([pairs_near(rng, 2000, 48), rng.normal(size=(2000, 48))])
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    found, true = embedding_dedup.audit_recall(frame)
    assert true >= 100 and found >= 0.9 * true
    real = embedding_dedup._components
    lost = lambda v, kind: real(v, kind).withColumn("component_id", F.when(F.col("vec_id") % 2 == 0, F.col("vec_id")).otherwise(F.col("component_id")))
    monkeypatch.setattr(embedding_dedup, "_components", lost)
    with pytest.raises(RuntimeError, match="pairs of the audit"):
        embedding_dedup.audited_components(frame)


def test_recall_without_pairs_is_unmeasured(spark):
    x = np.random.default_rng(3).normal(size=(300, 32))
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    with pytest.warns(UserWarning, match="unmeasured"):
        assert embedding_dedup.audited_components(frame).where("kept").count() == 300


def test_doubles_stay_doubles(spark):
    big = 1e300
    rows = [(1, [big, 0.0], 0), (2, [big, 1.0], 0), (3, [1e-300, 0.0], 0), (4, [0.0, 1.0], 0), (5, [float("inf"), 1.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.audited_components(frame).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}


def test_a_poor_graph_fails_the_audit(spark, monkeypatch):
    x = pairs_near(np.random.default_rng(12), 20, 16).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").coalesce(1)
    monkeypatch.setattr(embedding_dedup, "graph_links", lambda reps, kind: reps.select(reps.rep.alias("u"), reps.rep.alias("v")))
    with pytest.raises(RuntimeError):
        embedding_dedup.audited_components(frame)


def test_search_groups_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 500)
    monkeypatch.setattr(embedding_dedup, "SHARD_MOST", 50)
    monkeypatch.setattr(embedding_dedup, "ASK_MOST", 50)
    rng = np.random.default_rng(10)
    base = rng.normal(size=32)
    rows = [(i, (base + rng.normal(scale=0.02, size=32)).astype(np.float32).tobytes()) for i in range(400)]
    reps = spark.createDataFrame([("a", i, bytearray(k)) for i, k in rows], "label string, rep long, key binary").repartition(3)
    members = embedding_dedup._members(reps, embedding_dedup.FLOAT)
    asked = members.where("asks").groupBy("shard", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks").cast("long"))).count()
    assert members.where("node").select("rep").distinct().count() == 400
    assert asked.agg(F.max("count")).first()[0] < 100
    links = embedding_dedup.graph_links(reps)
    assert links.select("u").union(links.select("v")).distinct().count() == 400
