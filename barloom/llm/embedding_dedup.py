"""Near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards."""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.graph import Forest, block_pairs, connected_components
from barloom.runtime import cut

THRESHOLD = 0.98
#: Distinct vectors that a shard should hold, and the most before it is split by a hash of the id.
SHARD, SHARD_MOST = 1000, 2000
#: Askers that a search group should hold, at most.
ASK_MOST = 1000
#: Shards that each vector joins.
OVERLAP = 2
#: Vectors that the centres of a level are fitted on, and centres of a level, at most.
SAMPLE, CENTERS = 20_000, 1000
DEGREE, CANDIDATES, ALPHA, BEAM = 24, 64, 1.2, 24
#: A search goes on from what is this near, if no nearer than the threshold.
RANGE = 0.94
BLOCK = 512
#: Queries of the audit, and the recall below which the operator fails.
AUDITED, LEAST_RECALL = 200, 0.9
FLOAT, DOUBLE = "<f4", "<f8"


def usable(v) -> bool:
    return v is not None and len(v) > 0 and bool(np.isfinite(v).all()) and bool(np.any(v))


def unit(keys: list[bytes], kind: str) -> np.ndarray:
    """Unit rows in double precision of vectors held as the bytes of their components, all of one length."""
    x = np.frombuffer(b"".join(keys), kind).reshape(len(keys), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def links(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which unit rows link; a pair at the threshold is settled by its exact sum, so in one way wherever it is met."""
    sim = a @ b.T
    close = sim >= THRESHOLD
    for i, j in zip(*np.nonzero(np.abs(sim - THRESHOLD) < 1e-12)):
        close[i, j] = math.fsum(a[i] * b[j]) >= THRESHOLD
    return close


# -- the graph of one shard ---------------------------------------------------


def robust_prune(x: np.ndarray, u: int, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours of u: the nearest candidate, then the next that no chosen one is alpha times nearer to."""
    d = np.sqrt(np.maximum(0, 2 - 2 * x[candidates] @ x[u]))
    order = np.argsort(d, kind="stable")
    candidates, d = candidates[order], d[order]
    between = np.sqrt(np.maximum(0, 2 - 2 * x[candidates] @ x[candidates].T))
    live = np.ones(len(candidates), bool)
    chosen = []
    for i in range(len(candidates)):
        if live[i]:
            chosen.append(candidates[i])
            if len(chosen) == degree:
                break
            live &= alpha * between[i] > d
            live[: i + 1] = False
    return np.array(chosen, np.int64)


def build_graph(x: np.ndarray) -> list[np.ndarray]:
    """Pruned neighbour lists of a shard's unit vectors, with the way back of each link."""
    n = len(x)
    out: list[list[int]] = [[] for _ in range(n)]
    for a in range(0, n, 512):
        sim = x[a : a + 512] @ x.T
        k = min(CANDIDATES + 1, n)
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        for i in range(len(sim)):
            c = near[i][near[i] != a + i]
            # Far candidates too, so that the graph hangs together.
            c = np.union1d(c, (np.arange(1, 9) * 2654435761 + (a + i) * 40503) % n)
            c = c[c != a + i]
            if len(c):
                out[a + i] = robust_prune(x, a + i, c).tolist()
    back: list[list[int]] = [[] for _ in range(n)]
    for u, vs in enumerate(out):
        for v in vs:
            if len(back[v]) < DEGREE:
                back[v].append(u)
    return [np.array(sorted(set(o) | set(b)), np.int64) for o, b in zip(out, back)]


def range_search(x: np.ndarray, links: list[np.ndarray], start: int, q: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Nodes at cosine >= threshold of q that a greedy search from start finds, widened while in range."""
    seen = np.zeros(len(x), bool)
    seen[start] = True
    pool_ids, pool_sim = np.array([start]), np.array([x[start] @ q])
    spent: set[int] = set()
    while True:
        fresh = [k for k, i in enumerate(pool_ids.tolist()) if i not in spent]
        if not fresh:
            break
        # The best few at once, and all that are in range; their neighbours are compared in one product.
        fresh = pool_ids[[k for n, k in enumerate(fresh) if n < 4 or pool_sim[k] >= RANGE]].tolist()
        spent.update(fresh)
        new = np.unique(np.concatenate([links[i] for i in fresh]))
        new = new[~seen[new]]
        if not len(new):
            continue
        seen[new] = True
        ids, sim = np.concatenate([pool_ids, new]), np.concatenate([pool_sim, x[new] @ q])
        order = np.argsort(-sim, kind="stable")
        # The beam, and beyond it all that is in range.
        keep = max(BEAM, int((sim >= RANGE).sum()))
        pool_ids, pool_sim = ids[order[:keep]], sim[order[:keep]]
    return pool_ids[pool_sim >= threshold - 1e-9]


# -- shards -------------------------------------------------------------------


def fit_centers(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit rows, from spread-out first centres; the same rows give the same centres."""
    centers = [sample[0]]
    best = sample @ centers[0]
    for _ in range(k - 1):
        centers.append(sample[int(best.argmin())])
        best = np.maximum(best, sample @ centers[-1])
    c = np.array(centers)
    for _ in range(rounds):
        own = (sample @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    return c


def _kind(rows: DataFrame, vector_col: str) -> str:
    """Floats stay floats; components of any other kind are doubles."""
    return FLOAT if rows.schema[vector_col].dataType.simpleString() == "array<float>" else DOUBLE


def _vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, key): key is the bytes of the vector's components, null if it links with nothing."""
    kind = _kind(rows, vector_col)
    zero = np.zeros(1, kind)

    def task(batches):
        for b in batches:
            keys = []
            for v, label, i in zip(b.column(2), b.column(1).to_pylist(), b.column(0).to_pylist()):
                x = v.values
                if x is None or label is None or i is None or x.null_count:
                    keys.append(None)
                    continue
                x = x.to_numpy(zero_copy_only=False).astype(kind) + zero
                keys.append(x.tobytes() if usable(x) else None)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(keys, pa.binary())], names=["id", "label", "key"])

    width = "float" if kind == FLOAT else "double"
    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(f"array<{width}>").alias("v"))
    return kept.mapInArrow(task, "id long, label string, key binary")


def _centers(reps: DataFrame, kind: str) -> dict[tuple[str, int], np.ndarray]:
    """First-level centres for each (label, length) with more distinct vectors than a shard holds.

    They are fitted on SAMPLE vectors at most, shared by these labels, and number
    CENTERS at most for each; larger cells are divided again by ``_divided``.
    """
    large = {(r["label"], r["bytes"]): r["count"] for r in reps.groupBy("label", F.octet_length("key").alias("bytes")).count().where(f"count > {SHARD}").collect()}
    if not large:
        return {}
    every = max(1, math.ceil(sum(large.values()) / SAMPLE))
    picked = reps.where(F.pmod(F.xxhash64("rep"), F.lit(every)) == 0).orderBy(F.xxhash64("rep")).limit(SAMPLE).select("label", "key").collect()
    found = {}
    for (label, size), n in large.items():
        own = [bytes(r["key"]) for r in picked if r["label"] == label and len(r["key"]) == size]
        if own:
            found[label, size] = fit_centers(unit(own, kind), min(len(own), math.ceil(n / SHARD), CENTERS))
    return found


def may_hold(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(near, held): each unit row's OVERLAP nearest centres, and a mask of the centres that may own a vector in range of it.

    A centre may if some point of the cap around the row lies on its side of the
    plane between it and the row's own centre.
    """
    sim = x @ c.T
    near = np.argsort(-sim, axis=1, kind="stable")[:, :OVERLAP]
    own = near[:, 0]
    gap = sim[np.arange(len(x)), own][:, None] - sim
    norms = (c * c).sum(axis=1)
    apart = norms[own][:, None] + norms[None, :] - 2 * (c[own] @ c.T)
    held = THRESHOLD * gap <= math.sqrt(1 - THRESHOLD * THRESHOLD) * np.sqrt(np.maximum(0, apart - gap * gap)) + 1e-9
    held[np.arange(len(x)), own] = True
    return near, held


def shards_asked(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(near, asked): as ``may_hold``, less the centres of a lower number than the row's own.

    Of any two rows in range, one still asks the other's shard.
    """
    near, asked = may_hold(x, c)
    return near, asked & (np.arange(len(c))[None, :] >= near[:, :1])


_DEALT = "shard string, rep long, key binary, node boolean, asks boolean, own boolean"
_SCHEMA = pa.schema([("shard", pa.string()), ("rep", pa.int64()), ("key", pa.binary()), ("node", pa.bool_()), ("asks", pa.bool_()), ("own", pa.bool_())])


def _rows_dealt(name: str, ids: list, keys: list, near: np.ndarray, asked: np.ndarray, node: np.ndarray, asks: np.ndarray, own: np.ndarray) -> list[tuple]:
    """Rows of _DEALT: a node joins the shards of its nearest centres, an asker goes to those it asks."""
    joined = np.zeros(asked.shape, bool)
    np.put_along_axis(joined, near, True, axis=1)
    joined &= node[:, None]
    asked = asked & asks[:, None]
    return [
        (f"{name}/{s}", ids[j], keys[j], bool(joined[j, s]), bool(asked[j, s]), bool(own[j] and near[j, 0] == s))
        for j, s in zip(*(r.tolist() for r in np.nonzero(joined | asked)))
    ]


def _dealt_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v, f.type) for v, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def _divided(dealt: DataFrame, kind: str) -> DataFrame:
    """``dealt`` with each shard of over SHARD_MOST nodes dealt over centres of its own.

    A task fits a shard's centres on a sample of SAMPLE of its nodes at most; blocks
    of its rows then meet them. Rows of the shard's own leave out centres of a lower
    number than theirs; rows of other shards ask all that may hold one in range.
    """
    sizes = dealt.where("node").groupBy(F.col("shard").alias("__shard")).agg(F.count("*").alias("__n")).where(F.col("__n") > SHARD_MOST)
    sizes = cut(sizes, "vectors-large")
    if sizes.isEmpty():
        return dealt
    marked = cut(dealt.join(sizes, F.col("shard") == F.col("__shard"), "left").drop("__shard"), "vectors-marked")
    large = marked.where("__n is not null")
    share = F.greatest(F.lit(1), F.ceil(F.col("__n") / SAMPLE))
    picked = large.where("node").where(F.pmod(F.xxhash64("rep", F.lit(2)), share) == 0)

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        n = table.column("__n")[0].as_py()
        keys = table.column("key").to_pylist()[:SAMPLE]
        c = fit_centers(unit(keys, kind), min(len(keys), math.ceil(n / SHARD), CENTERS))
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()]), "c": pa.array([c.tobytes()], pa.binary()), "n": pa.array([len(c)], pa.int64())})

    centers = cut(picked.select("shard", "rep", "key", "__n").groupBy("shard").applyInArrow(fit, "shard string, c binary, n long"), "vectors-centers")
    blocks = F.ceil(F.col("__n") / SHARD).cast("int")
    rows = large.withColumn("block", F.pmod(F.xxhash64("rep"), blocks.cast("long")).cast("int")).drop("__n")
    spread = sizes.join(centers, F.col("__shard") == F.col("shard")).select("shard", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "c", "n")

    def deal(rows: pa.Table, center: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and center.num_rows:
            c = np.frombuffer(center.column("c")[0].as_py()).reshape(center.column("n")[0].as_py(), -1)
            shard = rows.column("shard")[0].as_py()
            for i in range(0, rows.num_rows, 512):
                part = rows.slice(i, 512)
                ids, keys = part.column("rep").to_pylist(), part.column("key").to_pylist()
                node, asks, own = (part.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in ("node", "asks", "own"))
                near, held = may_hold(unit(keys, kind), c)
                asked = held & (~own[:, None] | (np.arange(len(c))[None, :] >= near[:, :1]))
                out += _rows_dealt(shard, ids, keys, near, asked, node, asks, own)
        return pa.Table.from_batches([_dealt_batch(out)] if out else [], _SCHEMA)

    again = rows.groupBy("shard", "block").cogroup(spread.groupBy("shard", "block")).applyInArrow(deal, _DEALT)
    return marked.where("__n is null").drop("__n").union(again)


def _members(reps: DataFrame, kind: str) -> DataFrame:
    """(shard, rep, key, node, asks, part, parts, blocks): each distinct vector in its OVERLAP nearest shards as a node, and in those it asks."""
    centers = reps.sparkSession.sparkContext.broadcast(_centers(reps, kind))  # CENTERS a label at most

    def task(batches):
        table = centers.value
        for b in batches:
            labels, ids, keys = (b.column(i).to_pylist() for i in range(3))
            groups: dict[tuple[str, int], list[int]] = {}
            for i, (label, key) in enumerate(zip(labels, keys)):
                groups.setdefault((label, len(key)), []).append(i)
            for (label, size), every in groups.items():
                c = table.get((label, size))
                for k in range(0, len(every), 512):
                    at = every[k : k + 512]
                    own_ids, own_keys, yes = [ids[i] for i in at], [keys[i] for i in at], np.ones(len(at), bool)
                    if c is None or len(c) < 2:
                        near, asked = np.zeros((len(at), 1), int), yes[:, None]
                    else:
                        near, asked = shards_asked(unit(own_keys, kind), c)
                    yield _dealt_batch(_rows_dealt(f"{label}/{size}", own_ids, own_keys, near, asked, yes, yes, yes))

    dealt = cut(reps.select("label", "rep", "key").mapInArrow(task, _DEALT), "vectors-dealt")
    dealt = cut(_divided(dealt, kind), "vectors-divided")
    sizes = dealt.groupBy(F.col("shard").alias("__shard")).agg(
        F.greatest(F.lit(1), F.ceil(F.count_if("node") / SHARD_MOST)).cast("int").alias("parts"),
        F.greatest(F.lit(1), F.ceil(F.count_if("asks") / ASK_MOST)).cast("int").alias("blocks"),
    )
    split = dealt.join(sizes, F.col("shard") == F.col("__shard")).drop("__shard", "own")
    return cut(split.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts").cast("long")).cast("int")), "vectors-members")


def graph_links(reps: DataFrame, kind: str = FLOAT) -> DataFrame:
    """Edges (u, v) between distinct vectors (label, rep, key) at cosine >= THRESHOLD, found through the graph.

    They connect what the searches found, without all pairs of a dense group.
    """
    members = _members(reps, kind)

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("rep").to_numpy()
        near = build_graph(unit(table.column("key").to_pylist(), kind))
        return pa.table({"rep": pa.array(ids), "near": pa.array([ids[v].tolist() for v in near], pa.list_(pa.int64()))})

    own = members.where("node").select("shard", "part", "rep", "key").groupBy("shard", "part").applyInArrow(build, "rep long, near array<long>")
    # The union of a vector's lists: one from each shard it joined.
    union = own.groupBy(F.col("rep").alias("__rep")).agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    # A part's nodes meet the askers of their shard in blocks; a group holds one part and one block.
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    nodes = members.where("node").join(union, F.col("rep") == F.col("__rep")).select("shard", "part", blocks, "rep", "key", "near", F.lit(True).alias("node"))
    none = F.array().cast("array<long>")
    block = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks").cast("long")).cast("int").alias("block")
    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    asking = members.where("asks").select("shard", parts, block, "rep", "key", none.alias("near"), F.lit(False).alias("node"))

    def search(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy(zero_copy_only=False)
        inside = table.filter(pa.array(node))
        found: list[tuple[int, int]] = []
        if inside.num_rows:
            ids = inside.column("rep").to_numpy()
            at = {int(r): i for i, r in enumerate(ids)}
            x = unit(inside.column("key").to_pylist(), kind)
            near = [np.array([at[v] for v in vs if v in at], np.int64) for vs in inside.column("near").to_pylist()]
            middle = x.mean(axis=0)
            start = int((x @ middle).argmax())
            asks = table.filter(pa.array(~node))
            seen = Forest()
            for r, q in zip(asks.column("rep").to_pylist(), unit(asks.column("key").to_pylist(), kind) if asks.num_rows else []):
                hits = range_search(x, near, start, q)
                for v in ids[hits[links(x[hits], q[None, :])[:, 0]]].tolist():
                    if v != r and seen.join(r, v):
                        found.append((r, v))
        return pa.table({"u": pa.array([e[0] for e in found], pa.int64()), "v": pa.array([e[1] for e in found], pa.int64())})

    return nodes.union(asking).groupBy("shard", "part", "block").applyInArrow(search, "u long, v long")


def exact_links(classes: DataFrame, kind: str = FLOAT) -> DataFrame:
    """(rep, n): how many other rows link with each distinct vector (root, rep, copies, key) of its component.

    Components are cut into blocks of about BLOCK vectors, and every two blocks of
    one component are compared in some task; sums leave it, not pairs.
    """
    sizes = classes.groupBy(F.col("root").alias("__root")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = classes.join(sizes, F.col("root") == F.col("__root")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")))
    lists = cut(
        dealt.groupBy("root", "block").agg(F.collect_list(F.struct("rep", "copies", "key")).alias("rows"))
        .select("root", "block", F.col("rows.rep").alias("reps"), F.col("rows.copies").alias("copies"), F.col("rows.key").alias("keys")),
        "vectors-blocks",
    )
    pairs = block_pairs(lists, ["root"], ["reps", "copies", "keys"], with_itself=True)
    pairs = pairs.select((F.col("i") == F.col("j")).alias("same"), *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("reps", "copies", "keys")])

    def task(batches):
        for t in batches:
            reps, sums = [], []
            for same, ra, ca, ka, rb, cb, kb in zip(*(c.to_pylist() for c in t.columns)):
                close = links(unit(ka, kind), unit(kb, kind))
                if same:
                    np.fill_diagonal(close, False)
                reps += ra
                sums += (close @ np.array(cb)).tolist()
                if not same:
                    reps += rb
                    sums += (np.array(ca) @ close).tolist()
            yield pa.record_batch([pa.array(reps, pa.int64()), pa.array(sums, pa.int64())], names=["rep", "n"])

    return pairs.mapInArrow(task, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))


def vector_components(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Rows of equal labels link at cosine >= THRESHOLD. A row links with nothing if
    its id, label or vector is null, or its vector is empty, zero, or holds null or
    non-finite components; vectors of different lengths do not link. Equal vectors
    are one node with its copies, so their pairs are never made. component_id is
    the smallest id reachable; kept is true where it is the row's own (false for a
    null id). Rows that repeat an id are vectors of their own.

    The graph's searches find components; n_links is then counted exactly within
    them.
    """
    vectors = cut(_vectors(rows, id_col, vector_col, label_col), "vectors")
    return _components(vectors, _kind(rows, vector_col))


def _components(vectors: DataFrame, kind: str) -> DataFrame:
    distinct = vectors.where("key is not null").groupBy("label", "key").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    # Nodes are numbered apart from the ids, which two vectors may share.
    reps = cut(distinct.withColumn("rep", F.monotonically_increasing_id()), "vectors-distinct")
    roots = cut(connected_components(graph_links(reps, kind)), "vectors-roots")
    classes = cut(reps.join(roots, F.col("rep") == F.col("node")).select("root", "rep", "least", "copies", "key"), "vectors-classes")
    counted = exact_links(classes.select("root", "rep", "copies", "key"), kind)
    lowest = classes.groupBy("root").agg(F.min("least").alias("lowest"))
    linked = classes.join(lowest, "root").select(F.col("rep").alias("__rep"), "lowest").join(counted.withColumnRenamed("rep", "__of"), F.col("__rep") == F.col("__of"), "left")
    facts = cut(
        reps.join(linked, F.col("rep") == F.col("__rep"), "left").select(
            F.col("label").alias("__label"), F.col("key").alias("__key"),
            (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("lowest", "least").alias("component_id"),
        ),
        "vectors-facts",
    )
    out = vectors.join(facts, (F.col("label") == F.col("__label")) & (F.col("key") == F.col("__key")), "left")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _audit(vectors: DataFrame, components: DataFrame, kind: str, sample: int) -> tuple[int, int]:
    usable = vectors.where("key is not null").select("id", "label", "key")
    linked = usable.join(components.where("n_links > 0").select(F.col("vec_id").alias("id")), "id")
    # At most twice the sample reaches the driver: rows of any kind, and rows that the graph linked, as most have no partner.
    picked = list({r["id"]: r for rows in (usable, linked) for r in rows.orderBy(F.xxhash64("id")).limit(sample).collect()}.values())
    if not picked:
        return 0, 0
    queries: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    for at in {(r["label"], len(r["key"])) for r in picked}:
        own = [r for r in picked if (r["label"], len(r["key"])) == at]
        queries[at] = np.array([r["id"] for r in own]), unit([bytes(r["key"]) for r in own], kind)
    held = vectors.sparkSession.sparkContext.broadcast(queries)

    def task(batches):
        for b in batches:
            ids, labels, keys = (b.column(i).to_pylist() for i in range(3))
            us, vs = [], []
            for at, (own, q) in held.value.items():
                mine = [i for i in range(len(ids)) if (labels[i], len(keys[i])) == at]
                if mine:
                    i, j = np.nonzero(links(unit([keys[k] for k in mine], kind), q))
                    pairs = [(ids[mine[x]], int(own[y])) for x, y in zip(i.tolist(), j.tolist()) if ids[mine[x]] != own[y]]
                    us += [p[0] for p in pairs]
                    vs += [p[1] for p in pairs]
            yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    true = vectors.where("key is not null").select("id", "label", "key").mapInArrow(task, "u long, v long")
    a, b = (components.select(F.col("vec_id").alias(f"__{x}"), F.col("component_id").alias(f"__root_{x}")) for x in "uv")
    # The side of the queries has a row for each of them.
    asked = b.join(F.broadcast(vectors.sparkSession.createDataFrame([(int(r["id"]),) for r in picked], "__q long").distinct()), F.col("__v") == F.col("__q")).drop("__q").distinct()
    both = true.join(F.broadcast(asked), F.col("v") == F.col("__v")).join(a, F.col("u") == F.col("__u"))
    found, total = both.agg(F.count_if(F.col("__root_u") == F.col("__root_v")), F.count("*")).first()
    return found, total


def audit_recall(rows: DataFrame, sample: int = AUDITED, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[int, int]:
    """(found, true): pairs at cosine >= THRESHOLD of sampled queries with all rows, and those that share a component.

    The queries are the ``sample`` usable rows whose ids hash lowest, and as many of
    those that the graph linked, whose other partners it may have missed; ids must be
    distinct. With no true pair among them, recall is not measured.
    """
    kind = _kind(rows, vector_col)
    vectors = cut(_vectors(rows, id_col, vector_col, label_col), "audit-vectors")
    return _audit(vectors, cut(_components(vectors, kind), "audit-components"), kind, sample)


def audited_components(rows: DataFrame, sample: int = AUDITED, least: float = LEAST_RECALL) -> DataFrame:
    """``vector_components`` of rows with distinct ids, checked: the job fails if the audit's recall is under ``least``.

    Where the audit's queries have no partner at all it warns that recall is unmeasured.
    """
    kind = _kind(rows, "embedding")
    vectors = cut(_vectors(rows, "vec_id", "embedding", "label"), "vectors")
    out = cut(_components(vectors, kind), "vectors-components")
    found, true = _audit(vectors, out, kind, sample)
    if not true:
        warnings.warn("recall is unmeasured: no query of the audit has a partner", stacklevel=2)
    elif found < least * true:
        raise RuntimeError(f"the graph found {found} of {true} pairs of the audit")
    return out


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
