"""SimHash near-duplicates found through Golay-code keys."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.batches import small_batches
from barloom.llm.graph import Forest, block_pairs, connected_components
from barloom.runtime import cut, free_prefix

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
MAX_BITS = 3
BLOCK = 2048
#: Bits of the three segments, each padded with zeros to the 23 of the code.
SEGMENTS = (22, 21, 21)
#: The generator polynomial of the binary Golay code (23, 12, 7).
GENERATOR = 0b110001110101


# -- fingerprints -----------------------------------------------------------


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    words = WORD.findall(text)
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    ends = ends.tolist()
    starts = [0, *(e + 1 for e in ends[: -width])]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])), np.uint64, len(starts))


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits, each set if over half of the shingles' XXH64 have it; 0 without words."""
    if not text:
        return 0
    hashes = shingle_hashes(text.encode("utf-8", "surrogatepass").lower(), width)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long. Null and empty texts have 0."""
    small_batches(docs.sparkSession)

    def task(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(task, f"id {kind}, fp long")


# -- Golay keys -------------------------------------------------------------


def _syndrome(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64)
    for bit in range(22, 10, -1):
        v = np.where((v >> bit) & 1, v ^ (GENERATOR << (bit - 11)), v)
    return v


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Error patterns by syndrome: the one of at most 3 bits, and the five of 4 bits (else -1)."""
    near = np.zeros(2048, np.int64)
    far = np.full((2048, 5), -1, np.int64)
    filled = np.zeros(2048, int)
    for weight in range(5):
        errors = np.array([sum(1 << i for i in c) for c in combinations(range(23), weight)], np.int64)
        syndromes = _syndrome(errors)
        if weight < 4:
            near[syndromes] = errors
        else:
            for e, s in zip(errors.tolist(), syndromes.tolist()):
                far[s, filled[s]] = e
                filled[s] += 1
    return near, far


_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def codewords(v: np.ndarray) -> np.ndarray:
    """(n, 6) indices of codewords for n 23-bit values; -1 where there is none.

    Each value gives its nearest codeword, and one of odd weight gives all at
    four bits too. Two values at one bit's distance have unequal parity, and the
    even one's nearest codeword is within four bits of the odd one: they share an
    index. So do equal values.
    """
    if not _TABLES:
        _TABLES.append(golay_tables())
    near, far = _TABLES[0]
    s = _syndrome(v)
    out = np.full((len(v), 6), -1, np.int64)
    out[:, 0] = (v ^ near[s]) >> 11
    odd = np.bitwise_count(v.astype(np.uint64)) & 1 == 1
    more = (v[:, None] ^ far[s]) >> 11
    out[:, 1:] = np.where(odd[:, None] & (far[s] >= 0), more, -1)
    return out


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) arrays: fingerprints within 3 bits of each other share a key.

    If one segment has two errors or more, the other two have one at most: keys
    of one exact segment and a codeword of another, for the six ordered pairs.
    Else each segment has one at most: keys of codewords of the first two and an
    exact half of the third, for both halves. A key carries 33 bits or more.
    """
    fps = fps.astype(np.uint64)
    parts, shift = [], 64
    for bits in SEGMENTS:
        shift -= bits
        parts.append(((fps >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64))
    words = [codewords(p) for p in parts]
    rows, keys = [], []
    n = np.arange(len(fps))
    kind = 0
    for x in range(3):
        for y in range(3):
            if x != y:
                key = (np.int64(kind) << 56) | (parts[x][:, None] << 12) | words[y]
                ok = words[y] >= 0
                rows.append(np.broadcast_to(n[:, None], ok.shape)[ok])
                keys.append(key[ok])
                kind += 1
    pair = (words[0][:, :, None] << 12) | words[1][:, None, :]
    ok = (words[0][:, :, None] >= 0) & (words[1][:, None, :] >= 0)
    for half in (parts[2] >> 10, parts[2] & 1023):
        key = (np.int64(kind) << 56) | (half[:, None, None] << 24) | pair
        rows.append(np.broadcast_to(n[:, None, None], ok.shape)[ok])
        keys.append(key[ok])
        kind += 1
    return np.concatenate(rows), np.concatenate(keys)


# -- links ------------------------------------------------------------------


def _linked(fps: np.ndarray, seen: Forest) -> list[tuple[int, int]]:
    """Edges between values within MAX_BITS that connect all such values of ``fps``.

    Each value is reached once and then compared with those not yet reached, so a
    dense family of n values gives n - 1 edges, not its pairs.
    """
    out = []
    if len(fps) == 2:
        if 0 < (int(fps[0]) ^ int(fps[1])).bit_count() <= MAX_BITS:
            u, v = fps.view(np.int64).tolist()
            return [(u, v)] if seen.join(u, v) else []
        return []
    left = np.unique(fps)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= MAX_BITS
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found)
                u = int(x.view(np.int64))
                out += [(u, v) for v in found.view(np.int64).tolist() if seen.join(u, v)]
    return out


def _edges(rows: list[tuple[int, int]]) -> list[pa.Array]:
    u, v = zip(*rows) if rows else ((), ())
    return [pa.array(u, pa.int64()), pa.array(v, pa.int64())]


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all of the distinct fingerprints ``fp`` within 3 bits.

    Each edge is verified; pairs that are connected already within a task are
    left out. A key's fingerprints are compared in blocks of ``BLOCK``; those of a
    longer run are handed on as blocks, whose pairs are dealt over the cluster.
    """

    def emit(batches):
        for b in batches:
            fps = b.column("fp").to_numpy().view(np.uint64)
            for i in range(0, len(fps), 4096):
                part = fps[i : i + 4096]
                rows, keys = golay_keys(part)
                yield pa.record_batch([pa.array(keys), pa.array(part.view(np.int64)[rows])], names=["key", "fp"])

    def compare(batches):
        seen = Forest()
        key, run, blocks = None, np.zeros(0, np.uint64), 0

        def result(edges, block=None):
            n = len(edges)
            u, v = _edges(edges)
            if block is None:
                return pa.record_batch([u, v, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
            k, i, fps = block
            return pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([k], pa.int64()), pa.array([i], pa.int32()), pa.array([fps.tobytes()], pa.binary())], names=names)

        def close(last):
            """What the run that has ended, or a full block of it, gives."""
            nonlocal run, blocks
            out = []
            if len(run) > 1:
                if e := _linked(run, seen):
                    out.append(result(e))
            if not last or blocks:
                out.append(result([], (key, blocks, run)))
            blocks = 0 if last else blocks + 1
            run = np.zeros(0, np.uint64)
            return out

        names = ["u", "v", "key", "block", "fps"]
        for b in batches:
            keys = b.column("key").to_numpy()
            fps = b.column("fp").to_numpy().view(np.uint64)
            if not len(keys):
                continue
            cuts = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1, [len(keys)]])
            # Runs of one row inside the batch link nothing.
            long = np.nonzero(np.diff(cuts) > 1)[0]
            edge = {0, len(cuts) - 2}
            for j in sorted(edge | set(long.tolist())):
                a, z = int(cuts[j]), int(cuts[j + 1])
                if keys[a] != key:
                    if len(run) or blocks:
                        yield from close(True)
                    key = keys[a]
                while a < z:
                    take = min(z - a, BLOCK - len(run))
                    run = np.concatenate([run, fps[a : a + take]])
                    a += take
                    if len(run) == BLOCK:
                        yield from close(False)
        if len(run) or blocks:
            yield from close(True)

    def across(batches):
        seen = Forest()
        for b in batches:
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                e = _linked(np.frombuffer(x + y, np.uint64), seen)
                if e:
                    yield pa.record_batch(_edges(e), names=["u", "v"])

    keys = distinct.mapInArrow(emit, "key long, fp long")
    found = keys.repartition("key").sortWithinPartitions("key")
    found = cut(found.mapInArrow(compare, "u long, v long, key long, block int, fps binary"), "simhash-found")
    near = found.where("key is null").select("u", "v")
    blocks = found.where("key is not null").select("key", "block", "fps")
    if blocks.isEmpty():
        return near
    pairs = block_pairs(blocks, ["key"], ["fps"], with_itself=False).select(F.col("a.fps").alias("x"), F.col("b.fps").alias("y"))
    return near.union(pairs.mapInArrow(across, "u long, v long"))


def simhash_components(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for each row of ``docs``.

    Words are runs of anything but ASCII blanks, A-Z lower-cased; shingles of
    ``width`` words with repeats. A text of fewer words is one shingle; without
    words (empty, blank or null) the fingerprint is 0, linked like any other.
    component_id is the smallest id that links of 3 bits or fewer reach. Rows with
    equal fingerprints share a component whatever their ids; null ids are rows
    like others but never name a component (unless all of its ids are null).
    """
    prints = cut(fingerprints(docs, width, id_col, text_col), "simhash")
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = cut(connected_components(fingerprint_links(distinct.select("fp"))), "simhash-roots")
    members = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    members = cut(members, "simhash-members")
    lowest = members.groupBy("root").agg(F.min("least").alias("component_id"))
    named = members.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id.

    Rows that share that doc_id all stay, as they are one document; rows whose
    component has no doc_id stay too.
    """
    found = simhash_components(docs, width)
    name = f"{free_prefix(docs.columns)}gone"
    gone = found.where("id is not null and id <> component_id").select(F.col("id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_components(docs).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
