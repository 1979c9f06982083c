"""Near-duplicates at an exact Jaccard similarity of five-word shingles.

op1's SimHash proposes the first pairs, which are checked exactly; a prefix-filtered
join then finds the similar pairs that its radius leaves out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.graph import block_pairs, connected_components
from barloom.llm.simhash import SEED, WORD, simhash_components
from barloom.llm.batches import small_batches
from barloom.llm.bit_filter import filter_of, may_hold
from barloom.runtime import cut, cut_at, free_prefix, remove

WIDTH, THRESHOLD = 5, 0.8
#: A shingle met more often than this comes last in every document's order; at most so many do, the most frequent.
HOT, HOT_MOST = 32, 1_000_000
#: Words whose hash a task remembers, pairs in a batch, and entries of a key that are compared at once.
WORDS, PAIRS, BLOCK = 200_000, 65_536, 2048
#: Bits of the filter that tells which sets the candidates need; beyond a few million sets it only lets more through.
FILTER_BITS = 1 << 25
#: Bits of a sketch: one for each shingle at most, within these bounds; entries of hot keys carry the first of them folded.
SKETCH, SKETCH_MOST = 1 << 10, 1 << 16
#: Hot keys of each set in which it asks for picks; similar sets mostly have these in common.
ASKS = 4
#: Candidates that each document outside a key's largest component tries in a round; after these rounds all pairs across components are compared.
PICKS = (4, 32)
#: Entries that are tried at once in search of a pick.
TRIED = 1024
ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3]


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


def shingle_set(text: str | None, width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text of fewer words is one shingle, one without words none."""
    words = WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    total = np.full(n, min(len(h), width), np.uint64)
    for k in range(min(len(h), width)):
        x = h[k : k + n] * np.uint64(ODD[k % len(ODD)] + 2 * (k // len(ODD)))
        total += x ^ (x >> np.uint64(29))
    total ^= total >> np.uint64(33)
    total *= np.uint64(0xFF51AFD7ED558CCD)
    return np.unique(total ^ (total >> np.uint64(33)))


def node_of(shingles: np.ndarray) -> int:
    """The name of a set: documents of equal sets are one node."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def needed(size, threshold: float = THRESHOLD):
    """The fewest elements that a set of ``size`` shares with one that is similar enough."""
    return np.ceil(threshold * np.asarray(size) - 1e-9).astype(np.int64)


def overlap(a, b, threshold: float = THRESHOLD):
    """The fewest common elements of two sets that are similar enough."""
    return np.ceil(threshold / (1 + threshold) * (np.asarray(a) + np.asarray(b)) - 1e-9).astype(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The parity of the number of elements in each of a power of two of parts, as bytes.

    Two sets differ in no fewer elements than their sketches differ in bits.
    """
    bits = min(max(SKETCH, 1 << max(0, len(shingles) - 1).bit_length()), SKETCH_MOST)
    at = (shingles & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1, bitorder="little")


def folded(sketches: np.ndarray, size: int) -> np.ndarray:
    """Rows of sketches, as those of ``size`` bytes."""
    while sketches.shape[-1] > size:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] ^ sketches[..., half:]
    return sketches


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits rows of sketches of 64-bit words differ."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def apart(a, b, threshold: float = THRESHOLD):
    """The most elements that only one of two sets has, if these are similar enough."""
    return np.asarray(a, np.int64) + b - 2 * overlap(a, b, threshold)


def is_hot(shingles: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(shingles), bool)
    return hot[np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)] == shingles


def prefix(shingles: np.ndarray, hot: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """The first elements in an order common to all sets; similar sets share one of them."""
    n = len(shingles)
    if len(hot):
        last = is_hot(shingles, hot)
        shingles = np.concatenate([shingles[~last], shingles[last]])
    return shingles[: n - int(needed(n, threshold)) + 1] if n else shingles


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, name): rows of equal texts have one name."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("name"))


def _sets(docs: DataFrame, width: int, id_col: str, text_col: str, emit, schema: str, wanted=None) -> DataFrame:
    """``emit(rows, nodes, sets, state)`` of each batch, as a table; only of rows whose name the filter ``wanted`` may hold."""

    def task(batches):
        known, state = WordHashes(), set()
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                if wanted is not None:
                    part = part.filter(pa.array(may_hold(wanted.value, part.column(2).to_numpy())))
                sets = [shingle_set(t.as_py(), width, known) for t in part.column(1)]
                out = emit(part, [node_of(s) for s in sets], sets, state)
                if out.num_rows:
                    yield out

    small_batches(docs.sparkSession)
    return _named(docs, id_col, text_col).mapInArrow(task, schema)


def _once(nodes: list[int], sets: list[np.ndarray], state: set[int]) -> list[tuple[int, np.ndarray]]:
    """The sets that the task has not met."""
    out = []
    for node, s in zip(nodes, sets):
        if len(s) and node not in state:
            state.add(node)
            out.append((node, s))
    return out


def _flat(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _prefixes(docs: DataFrame, width: int, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(id, name, node, n, keys, cold, brief, sketch): each row's set by node and size, with its prefix and sketch where the task meets the set first.

    Of the keys the first ``cold`` are not hot. ``brief`` is the sketch folded to
    SKETCH bits, null if no key is hot.

    Shingles in many sets come last in the order, whatever the set: those in many
    prefixes by hash, and beyond these, as they move up when others go last, those
    that are met more than once among 512 sets so often. Any order gives the same
    links; a good one gives few candidates.
    """

    def keys(part, nodes, sets, state):
        own = [s for _, s in _once(nodes, sets, state)]
        first = _flat([prefix(s, np.zeros(0, np.uint64), threshold) for s in own], np.uint64)
        rest, times = np.unique(_flat([s[len(prefix(s, np.zeros(0, np.uint64), threshold)) :] for s in own], np.uint64), return_counts=True)
        rest, times = rest[times > 1], times[times > 1]
        found = pa.array(np.concatenate([first, rest]).view(np.int64))
        return pa.record_batch([found, pa.array(np.concatenate([np.ones(len(first), np.int64), times]))], names=["key", "times"])

    counts = _sets(docs, width, id_col, text_col, keys, "key long, times long").groupBy("key").agg(F.sum("times").alias("count")).where(F.col("count") > HOT)
    common = counts.orderBy(F.desc("count"), "key").limit(HOT_MOST).select("key").toArrow().column("key").to_numpy()
    hot = docs.sparkSession.sparkContext.broadcast(np.sort(common.view(np.uint64)))

    def rows(part, nodes, sets, state):
        own = {node for node, _ in _once(nodes, sets, state)}
        found = []
        for node, s in zip(nodes, sets):
            if node not in own:
                found.append((None,) * 4)
                continue
            own.discard(node)
            first, drawn = prefix(s, hot.value, threshold), sketch(s)
            cold = len(first) - int(is_hot(first, hot.value).sum())
            found.append((first.view(np.int64), cold, folded(drawn, SKETCH // 8).tobytes() if cold < len(first) else None, drawn.tobytes()))
        own_columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary()))]
        columns = [part.column(0), part.column(2), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), *own_columns]
        return pa.record_batch(columns, names=["id", "name", "node", "n", "keys", "cold", "brief", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _sets(docs, width, id_col, text_col, rows, f"id {kind}, name long, node long, n int, keys array<long>, cold int, brief binary, sketch binary")


#: Columns of a block. All entries of a hot key have sketches, those of another key none.
_ENTRY = ["node", "n", "pos", "root", "sketch"]
_KINDS = [np.dtype(np.int64), np.dtype(np.int32), np.dtype(np.int32), np.dtype(np.int64)]


def _entries(rows: DataFrame) -> DataFrame:
    """(key, node, n, pos, early, sketch): the keys of each set; ``early`` says that it asks for picks there."""
    found = rows.where("keys is not null").select("node", "n", "cold", "brief", F.posexplode("keys").alias("pos", "key"))
    return found.select("key", "node", "n", "pos", (F.col("pos") < F.col("cold") + ASKS).alias("early"), F.when(F.col("pos") >= F.col("cold"), F.col("brief")).alias("sketch"))


def _shared(entries: DataFrame) -> DataFrame:
    """The entries whose key another set has too, once for each set, in the order of the key within a task."""

    def task(batches):
        last, told = None, False  # the entry before, and whether it has been handed on
        for b in batches:
            if last is not None:
                b = pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
            if not b.num_rows:
                continue
            key, node = b.column("key").to_numpy(), b.column("node").to_numpy()
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            b, key = b.filter(pa.array(fresh)), key[fresh]
            same = key[1:] == key[:-1]
            out = np.zeros(len(key), bool)
            out[1:] |= same
            out[:-1] |= same
            if told:
                out[0] = False
            told = bool(out[-1]) or (told and len(out) == 1)
            last = b.slice(len(out) - 1)
            if out.any():
                yield b.filter(pa.array(out))

    return entries.repartition("key").sortWithinPartitions("key", "node").mapInArrow(task, "key long, node long, n int, pos int, early boolean, sketch binary")


def _no_entries() -> list[np.ndarray]:
    return [*(np.zeros(0, k) for k in _KINDS), np.zeros((0, SKETCH // 8), np.uint8)]


def _columns(b: pa.RecordBatch):
    """The function that gives the entries a to z of a batch (key, *_ENTRY)."""
    own = [b.column(i + 1).to_numpy() for i in range(4)]
    drawn = b.column(5).cast(pa.binary())
    _, offsets, data = drawn.buffers()
    offsets = np.frombuffer(offsets, np.int32)[drawn.offset : drawn.offset + len(drawn) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return lambda a, z: [*(c[a:z] for c in own), data[offsets[a] : offsets[z]].reshape(-1, SKETCH // 8)]


def _blocks():
    """The task that makes (key, block, single, node, n, pos, root, sketch): the runs of entries of a key and unequal roots, as blocks of BLOCK at most.

    A block's columns are bytes; single is the root if all entries of the block have
    that one. A task holds a block at a time.
    """
    names = ["key", "block", "single", *_ENTRY]

    def task(batches):
        key, block, held = None, 0, _no_entries()
        out, size = [], 0

        def close(last: bool):
            nonlocal block, held, size
            root = held[3]
            single = int(root[0]) if len(root) and (root == root[0]).all() else None
            if block or not last or (len(root) > 1 and single is None):
                out.append((key, block, single, *(c.tobytes() for c in held)))
                size += len(root)
            block, held = (0 if last else block + 1), _no_entries()

        def batch():
            nonlocal out, size
            kinds = (pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5)
            done = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
            out, size = [], 0
            return done

        for b in batches:
            if not b.num_rows:
                continue
            keys, own = b.column(0).to_numpy(), _columns(b)
            cuts = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1, [len(keys)]])
            long = np.diff(cuts) > 1
            long[[0, -1]] = True  # a run may go on from the batch before or into the next
            for j in np.nonzero(long)[0].tolist():
                a, z = int(cuts[j]), int(cuts[j + 1])
                if keys[a] != key:
                    if key is not None:
                        close(True)
                    key = int(keys[a])
                while a < z:
                    if len(held[0]) == BLOCK:
                        close(False)
                    take = min(z - a, BLOCK - len(held[0]))
                    held = [np.concatenate([h, c]) if len(h) else c for h, c in zip(held, own(a, a + take))]
                    a += take
                if size >= PAIRS:
                    yield batch()
        if key is not None:
            close(True)
        if out:
            yield batch()

    return task


def _most_common(root: np.ndarray) -> np.ndarray:
    """Which entries have the root that most have; none if all differ."""
    _, which, count = np.unique(root, return_inverse=True, return_counts=True)
    return which == count.argmax() if count.max() > 1 else np.zeros(len(root), bool)


def _similar(n: int, rest: int, drawn: np.ndarray | None, others: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the others (n, rest, sketch) size, position and sketch do not rule out beside one entry."""
    ok = np.minimum(rest, others[1]) >= overlap(n, others[0], threshold)
    if drawn is not None and ok.any():
        ok[ok] = unlike(drawn, others[2][ok]) <= apart(n, others[0][ok], threshold)
    return ok


def _compared(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float):
    """(u, v) of entries of one key in blocks a and b (within a, if b is None) of unequal roots that size, position and sketch do not rule out.

    One of each such pair is outside the root that most entries have, so only those
    outside it are compared with all.
    """
    root = a[3] if b is None else np.concatenate([a[3], b[3]])
    if (root == root[0]).all():
        return
    common = _most_common(root)
    sides = []
    for block, most in [(a, common[: len(a[0])])] + ([] if b is None else [(b, common[len(a[0]) :])]):
        by = np.argsort(block[1], kind="stable")
        node, n, pos, root = (c[by] for c in block[:4])
        # A first common element leaves room for all that are needed.
        sides.append((node, n, n - pos, root, block[4][by] if len(block[4]) else None, most[by]))
    for turned, (own, other) in enumerate([(sides[0], sides[-1])] + ([] if b is None else [(sides[1], sides[0])])):
        node, n, rest, root, drawn, most = own
        begins = np.searchsorted(other[1], np.ceil(n * threshold - 1e-6), side="left")
        ends = np.searchsorted(other[1], n / threshold + 1e-6, side="right")
        for i in np.nonzero(~most)[0].tolist():
            s, z = int(begins[i]), int(ends[i])
            ok = (other[3][s:z] != root[i]) & (other[0][s:z] != node[i])
            if b is None:  # two entries outside the root meet once
                ok &= other[5][s:z] | (np.arange(s, z) > i)
            elif turned:
                ok &= other[5][s:z]
            at = s + np.nonzero(ok)[0]
            if len(at):
                at = at[_similar(n[i], rest[i], None if drawn is None else drawn[i], [other[1][at], other[2][at], None if drawn is None else other[4][at]], threshold)]
            if len(at):
                yield np.minimum(node[i], other[0][at]), np.maximum(node[i], other[0][at])


def _turn(nodes: np.ndarray, round_: int) -> np.ndarray:
    """The order in which nodes are tried, another one in each round."""
    x = (nodes.view(np.uint64) ^ np.uint64(ODD[round_ % len(ODD)])) * np.uint64(ODD[(round_ + 1) % len(ODD)])
    return x ^ (x >> np.uint64(32))


def _picked(block: list[np.ndarray], threshold: float, most: int, round_: int):
    """(asker, pick, turn): for each entry the first ``most`` of unequal roots in the round's order that size, position and sketch do not rule out.

    All askers try the same entries first, so that their links meet in one
    component. Entries of a root that most of the block have do not ask: the
    others ask them.
    """
    turn = _turn(block[0], round_)
    by = np.argsort(turn, kind="stable")
    turn, (node, n, pos, root) = turn[by].view(np.int64), (c[by] for c in block[:4])
    drawn = block[4][by] if len(block[4]) else None
    rest = n - pos
    for i in np.nonzero(~_most_common(root))[0].tolist():
        left = most
        for s in range(0, len(node), TRIED):
            at = s + np.nonzero(root[s : s + TRIED] != root[i])[0]
            if len(at):
                at = at[_similar(n[i], rest[i], None if drawn is None else drawn[i], [n[at], rest[at], None if drawn is None else drawn[at]], threshold)][:left]
            if len(at):
                yield np.full(len(at), node[i]), node[at], turn[at]
                left -= len(at)
            if not left:
                break


def _pairs(found):
    """Batches of distinct (u, v) of the arrays that ``found`` yields."""
    us, vs, size = [], [], 0

    def batch():
        both = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], axis=1), axis=0)
        return pa.record_batch([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["u", "v"])

    for u, v in found:
        us.append(u)
        vs.append(v)
        size += len(u)
        if size >= PAIRS:
            yield batch()
            us, vs, size = [], [], 0
    if us:
        yield batch()


def _arrays(values) -> list[np.ndarray]:
    """A block's columns; the sketches as rows of 64-bit words, none if the key is not hot."""
    *values, drawn = values
    return [*(np.frombuffer(v, k) for v, k in zip(values, _KINDS)), np.frombuffer(drawn, np.uint64).reshape(-1, SKETCH // 64)]


def _within(threshold: float):
    """The task that compares the entries of each block."""

    def task(batches):
        for b in batches:
            columns = [b.column(c).to_pylist() for c in _ENTRY]
            yield from _pairs(p for row in zip(*columns) for p in _compared(_arrays(row), None, threshold))

    return task


def _labelled(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """The entries with the root of their set, the set itself if it has no link."""
    found = entries.join(roots.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left")
    return found.withColumn("root", F.coalesce("root", "node")).select("key", *_ENTRY)


def _picks(entries: DataFrame, roots: DataFrame | None, most: int, round_: int, threshold: float) -> DataFrame:
    """(u, v): for each set the first ``most`` sets of a common key and unequal roots that it meets in the round's order.

    Sets meet within a block of their key only, of hot keys the first few of each
    set, and blocks are cut anew in each round; what never meets is left to
    ``_candidates``. In the first round the
    entries lie in the order of their key, so that runs are read as they are.
    """
    entries = entries.where("early")
    if roots is None:
        ordered = entries.withColumn("root", F.col("node")).select("key", *_ENTRY)
    else:
        ordered = _labelled(entries, roots).repartition("key").sortWithinPartitions("key", F.xxhash64("node", F.lit(round_)))
    blocks = _blocks()

    def task(batches):
        for b in blocks(batches):
            columns, held, size = [b.column(c).to_pylist() for c in _ENTRY], [], 0
            for row in zip(*columns):
                for pick in _picked(_arrays(row), threshold, most, round_):
                    held.append(pick)
                    size += len(pick[0])
                    if size >= PAIRS:
                        yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*held)], names=["u", "v", "turn"])
                        held, size = [], 0
            if held:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*held)], names=["u", "v", "turn"])

    found = ordered.mapInArrow(task, "u long, v long, turn long").groupBy("u").agg(F.collect_set(F.struct("turn", "v")).alias("all"))
    first = found.select("u", F.explode(F.slice(F.array_sort("all"), 1, most)).alias("pick")).select("u", F.col("pick.v").alias("v"))
    return first.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _candidates(entries: DataFrame, roots: DataFrame | None, threshold: float) -> DataFrame:
    """(u, v): all sets of a common key and unequal roots, not ruled out by size, position and, of hot keys, sketch."""
    labelled = entries.withColumn("root", F.col("node")) if roots is None else _labelled(entries, roots)
    ordered = labelled.select("key", *_ENTRY).repartition("key").sortWithinPartitions("key", "root", "n", "node")
    blocks, path = cut_at(ordered.mapInArrow(_blocks(), "key long, block int, single long, node binary, n binary, pos binary, root binary, sketch binary"), "near-blocks")

    def across(batches):
        for b in batches:
            columns = [b.column(f"{s}_{c}").to_pylist() for s in "ab" for c in _ENTRY]
            yield from _pairs(p for row in zip(*columns) for p in _compared(_arrays(row[:5]), _arrays(row[5:]), threshold))

    long = blocks.join(blocks.where("block > 0").select(F.col("key").alias("__key")).distinct(), F.col("key") == F.col("__key"), "left_semi")
    same = lambda a, b: F.coalesce(a["single"] == b["single"], F.lit(False))
    pairs = block_pairs(long, ["key"], _ENTRY, with_itself=False, facts=["single"], unless=same)
    pairs = pairs.select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in _ENTRY])
    found = cut(blocks.select(*_ENTRY).mapInArrow(_within(threshold), "u long, v long").union(pairs.mapInArrow(across, "u long, v long")).distinct(), "near-candidates")
    remove(blocks.sparkSession, path)
    return found


def _possible(found: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """The candidates (u, v) whose sketches leave room for what they must share; no similar pair is left out."""
    known = rows.where("sketch is not null")
    a = known.select(F.col("node").alias("__u"), F.col("n").alias("n_a"), F.col("sketch").alias("a"))
    b = known.select(F.col("node").alias("__v"), F.col("n").alias("n_b"), F.col("sketch").alias("b"))

    def task(batches):
        for t in batches:
            x, y = (t.column(c).to_pylist() for c in "ab")
            most = apart(t.column("n_a").to_numpy(), t.column("n_b").to_numpy(), threshold)
            sizes = np.array([(len(p), len(q)) for p, q in zip(x, y)], np.int64).reshape(-1, 2)
            room = np.zeros(len(x), bool)
            for size in np.unique(sizes, axis=0):
                at = np.nonzero((sizes == size).all(axis=1))[0]
                p, q = (folded(np.frombuffer(b"".join(c[i] for i in at), np.uint8).reshape(len(at), -1), int(size.min())) for c in (x, y))
                room[at] = unlike(*(np.ascontiguousarray(c).view(np.uint64) for c in (p, q))) <= most[at]
            yield t.filter(pa.array(room)).select(["u", "v"])

    joined = found.join(a, F.col("u") == F.col("__u")).join(b, F.col("v") == F.col("__v"))
    # A set that several tasks met first has its sketch as often.
    return joined.select("u", "v", "n_a", "n_b", "a", "b").mapInArrow(task, "u long, v long").distinct()


def _proposed(docs: DataFrame, rows: DataFrame, text_col: str) -> DataFrame:
    """(u, v): sets of one component of op1's fingerprints, each beside the first of its fingerprint and the first of its component, and these two."""
    found = simhash_components(docs.select(F.xxhash64(text_col).alias("name"), F.col(text_col).alias("text")), id_col="name")
    found = found.select(F.col("id").alias("__name"), "fp", "component_id").distinct()
    met = cut(rows.where("n > 0").select("name", "node").distinct().join(found, F.col("name") == F.col("__name")).select("node", "fp", "component_id").distinct(), "near-proposed")
    own = met.groupBy(F.col("fp").alias("__fp"), F.col("component_id").alias("__of")).agg(F.min("node").alias("own"))
    first = met.groupBy(F.col("component_id").alias("__component")).agg(F.min("node").alias("first"))
    stars = met.join(own, F.col("fp") == F.col("__fp")).join(first, F.col("component_id") == F.col("__component"))
    pairs = stars.select(F.explode(F.array(*[F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")) for x, y in (("node", "own"), ("node", "first"), ("own", "first"))])).alias("pair"))
    return pairs.select("pair.u", "pair.v").where("u <> v").distinct()


def _sets_of(docs: DataFrame, nodes: DataFrame, rows: DataFrame, width: int, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """(node, shingles) of the ``nodes`` (__node), each once, as a table, and its path.

    A text of each is found by its name among ``rows``, so that few others are taken apart.
    """
    texts = rows.join(nodes, F.col("node") == F.col("__node")).groupBy("node").agg(F.min("name").alias("name")).select("name")
    wanted = docs.sparkSession.sparkContext.broadcast(filter_of(texts, FILTER_BITS))

    def found(part, own, sets, state):
        met = _once(own, sets, state)
        return pa.record_batch([pa.array([x for x, _ in met], pa.int64()), pa.array([s.tobytes() for _, s in met], pa.binary())], names=["node", "shingles"])

    sets = _sets(docs, width, id_col, text_col, found, "node long, shingles binary", wanted)
    return cut_at(sets.join(nodes, F.col("node") == F.col("__node"), "left_semi").dropDuplicates(["node"]), "near-sets")


def _verified(found: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The candidate pairs (u, v) whose sets are similar enough."""
    a = sets.select(F.col("node").alias("__u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("node").alias("__v"), F.col("shingles").alias("b"))

    def task(batches):
        for t in batches:
            keep = []
            for x, y in zip(t.column("a"), t.column("b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield t.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    joined = found.join(a, F.col("u") == F.col("__u")).join(b, F.col("v") == F.col("__v"))
    return cut(joined.select("u", "v", "a", "b").mapInArrow(task, "u long, v long"), "near-links")


def near_components(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) for each row: components of documents at Jaccard similarity >= threshold.

    Words are those of op1; the sets hold distinct shingles of ``width`` words.
    Documents without words are equal. No similar pair is missed: two sets this
    similar share an element of their prefixes, whatever the common order, and
    every candidate is verified or already in one component. The first candidates
    are those of op1's fingerprints. A key's sets are
    compared in blocks, so no task holds a key whole. Rows that share an id are
    compared apart and may be in unequal components; component_id is the smallest
    id of the component, null if it has none.
    """
    rows = cut(_prefixes(docs, width, id_col, text_col, threshold), "near-prefixes")
    entries = cut(_shared(_entries(rows)), "near-entries")
    spark = docs.sparkSession
    links = roots = tried = sets = None
    paths, settled = [], False
    for k, most in enumerate([0, *PICKS, None]):
        if most and settled:
            continue
        if most is None:
            found = _candidates(entries, roots, threshold)
        else:
            found = _picks(entries, roots, most, k - 1, threshold) if k else _proposed(docs, rows, text_col)
        if tried is not None:
            found = found.join(tried, ["u", "v"], "left_anti")
        found = cut(found, "near-found")
        tried = found if tried is None else tried.union(found)
        found = cut(_possible(found, rows, threshold), "near-possible")
        # Sets are made once, mostly in the first round.
        nodes = found.select(F.col("u").alias("__node")).union(found.select("v")).distinct()
        if sets is not None:
            nodes = nodes.join(sets.select("node"), F.col("__node") == F.col("node"), "left_anti")
        nodes = cut(nodes, "near-nodes")
        if not nodes.isEmpty():
            more, path = _sets_of(docs, nodes, rows, width, id_col, text_col)
            sets, paths = (more if sets is None else sets.union(more)), [*paths, path]
        fresh = _verified(found, sets, threshold) if sets is not None else found
        none = fresh.isEmpty()
        settled = bool(k) and none  # that op1 finds none says nothing of the join
        if not none:
            links = fresh if links is None else links.union(fresh)
            roots = cut(connected_components(links), "near-roots")
    for path in paths:
        remove(spark, path)
    if roots is None:
        named = rows.select("id", F.col("node").alias("root"))
    else:
        named = rows.join(roots.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").select("id", F.coalesce("root", "node").alias("root"))
    lowest = named.groupBy(F.col("root").alias("__root")).agg(F.min("id").alias("component_id"))
    return named.join(lowest, F.col("root") == F.col("__root")).select("id", "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id.

    Rows that share that doc_id all stay, as they are one document; rows without
    a doc_id stay too. Null, empty and blank texts are one component.
    """
    found = near_components(docs, width, threshold)
    name = f"{free_prefix(docs.columns)}gone"
    gone = found.where("id is not null and id <> component_id").select(F.col("id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
