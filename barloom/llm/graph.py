"""Connected components of a distributed edge list."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from barloom.runtime import cut_at, remove


class Forest:
    """Union-find over the nodes that one task meets."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (parent := up.get(root, root)) != root:
            root = parent
        while (parent := up.get(x, x)) != root:
            up[x], x = root, parent
        return root

    def join(self, a: int, b: int) -> bool:
        """True if the edge is new, that is, it joined two trees."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True


def forest_of(edges: DataFrame) -> DataFrame:
    """Per partition, only edges that join two trees; the components stay."""

    def task(batches):
        seen = Forest()
        for b in batches:
            u, v = b.column("u").to_pylist(), b.column("v").to_pylist()
            kept = [(x, y) for x, y in zip(u, v) if seen.join(x, y)]
            if kept:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*kept)], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(task, "u long, v long")


def _state(edges: DataFrame) -> Row:
    """Equal for equal edges, and for others all but never."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node that the long edges (u, v) reach.

    Only nodes of some edge are returned. Alternating large-star and small-star
    rounds: each star is one shuffle by node, in whose order the minimum of a node
    and its edges lie together, and the round's edges are made distinct. Each round
    is written to the shared folder. Null ends, loops and repeated edges are left out.
    """
    spark = edges.sparkSession
    edges = edges.select("u", "v").where("u is not null and v is not null and u <> v")
    now, path = cut_at(
        forest_of(edges).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc"
    )
    least = F.min("v").over(Window.partitionBy("u"))
    state = _state(now)
    for _ in range(max_rounds):
        # Large star: each neighbour above a node, to the least of the node and its neighbours.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", least)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: each node's lower neighbours, and itself, to the least of them; the row of the least stands for the node.
        small = large.withColumn("m", least).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        then, then_path = cut_at(small, "cc")
        before, state = state, _state(then)
        remove(spark, path)
        now, path = then, then_path
        if state == before:
            break
    else:
        raise RuntimeError("the components have not settled")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def block_pairs(blocks: DataFrame, key: list[str], payload: list[str], with_itself: bool, facts: list[str] = [], unless=None) -> DataFrame:
    """(key, i, j, a, b): every two blocks of a key, i <> j (also i = j ``with_itself``), once, with the payload of each as a struct.

    ``blocks`` has one row for each (key, block), block from 0. The pairs are made
    as numbers and dealt over the cluster before they meet the payloads, in turn by
    one and by the other block, so a key of n blocks gives a task about n / 2 rows.
    ``unless(a, b)`` leaves out pairs by the columns ``facts`` of both, structs too.
    """
    least = F.col("block") + (0 if with_itself else 1)
    most = blocks.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.max("block").alias("__last"))
    same = [F.col(k) == F.col(f"__{k}") for k in key]

    def meet(ids: DataFrame, side: str, at: str, columns: list[str]) -> DataFrame:
        own = blocks.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("block").alias("__block"), F.struct(*columns).alias(side))
        return ids.join(own, [*same, F.col(at) == F.col("__block")]).drop("__block", *[f"__{k}" for k in key])

    ids = blocks.select(*key, "block").join(most, same).where(least <= F.col("__last"))
    ids = ids.select(*key, F.col("block").alias("i"), F.explode(F.sequence(least, F.col("__last"))).alias("j"))
    if unless is not None:
        ids = meet(meet(ids, "a", "i", facts), "b", "j", facts).where(~unless(F.col("a"), F.col("b")))
    turned = (F.col("i") + F.col("j")) % 2 == 1
    ids = ids.select(*key, F.when(turned, F.col("j")).otherwise(F.col("i")).alias("i"), F.when(turned, F.col("i")).otherwise(F.col("j")).alias("j"))
    return meet(meet(ids, "a", "i", payload), "b", "j", payload)
