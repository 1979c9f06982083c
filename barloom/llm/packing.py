"""Packing token sequences into fixed windows by non-negative least squares.

Whole windows of a long document stand alone. What remains of each document is
rounded up to a bin; combinations of a few bins that fill a window are
enumerated, their repeat counts are solved against the histogram of bins by
non-negative least squares and rounded. What the counts leave is packed greedily:
window after window takes the largest bins left that fit, as often as they fit.
Both work on the histogram, whose size does not depend on the documents.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.batches import small_batches
from barloom.llm.tokens import encoder, public_vocabulary
from barloom.runtime import cut, prefix_sums

WINDOW = 4096
BIN = 16
DEPTH = 3
END_ID = 2


def combinations_filling(bins: int, depth: int) -> np.ndarray:
    """Combinations of bin sizes that add up to ``bins``, as counts by size (row 0 is size 1).

    All multisets of at most ``depth`` sizes, and every mix of any number of pieces
    of at most two sizes, which short documents need.
    """
    found: set[tuple[tuple[int, int], ...]] = {((bins, 1),)}
    for a in range(1, bins // 2 + 1):
        for j in range(1, bins // a + 1):
            left = bins - j * a
            if left == 0:
                found.add(((a, j),))
            else:
                found.update(((a, j), (b, left // b)) for b in range(a + 1, left + 1) if left % b == 0)

    def extend(left: int, least: int, taken: tuple[int, ...]) -> None:
        if left >= least:
            sizes = (*taken, left)
            found.add(tuple((s, sizes.count(s)) for s in sorted(set(sizes))))
        if len(taken) + 1 < depth:
            for size in range(least, left // 2 + 1):
                extend(left - size, size, (*taken, size))

    extend(bins, 1, ())
    out = np.zeros((bins, len(found)), np.float32)
    for j, sizes in enumerate(sorted(found)):
        for s, n in sizes:
            out[s - 1, j] = n
    return out


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-7) -> np.ndarray:
    """x >= 0 that minimizes |a x - b|, by active sets."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(6 * a.shape[0]):
        at = np.nonzero(free)[0]
        slope = a.T @ (b - a[:, at] @ x[at])
        slope[free] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= tolerance * scale:
            break
        free[j] = True
        while True:
            at = np.nonzero(free)[0]
            y = np.linalg.lstsq(a[:, at].astype(float), b, rcond=None)[0]
            if (y > 0).all():
                x[:] = 0
                x[at] = y
                break
            bad = y <= 0
            old = x[at]
            step = np.min(old[bad] / np.maximum(old[bad] - y[bad], 1e-300))
            x[at] = old + step * (y - old)
            gone = at[bad & (x[at] <= 1e-12 * scale)]
            gone = gone if len(gone) else at[bad]
            x[gone], free[gone] = 0, False
    return x


def greedy_patterns(left: np.ndarray):
    """(counts by size, repeats) of windows that take the largest sizes left that fit; uses up ``left``."""
    bins = len(left)
    while left.any():
        room, pattern = bins, np.zeros(bins, np.int64)
        for s in range(bins, 0, -1):
            if left[s - 1] and s <= room:
                pattern[s - 1] = min(int(left[s - 1]), room // s)
                room -= s * int(pattern[s - 1])
        at = pattern > 0
        repeat = int((left[at] // pattern[at]).min())
        left -= repeat * pattern
        yield pattern, repeat


def plan_slots(histogram: dict[int, int], window: int, bin_size: int, depth: int) -> tuple[list[tuple[int, int, int, int, int, int]], int, int]:
    """Rows (bin, lo, hi, first sequence, first slot, each), the sequences planned, and the documents that the least squares place.

    The documents of a bin with rank lo..hi-1 go to consecutive sequences from the
    first, ``each`` of them to one, at consecutive slots from the first slot. Solved
    counts are rounded, and no count takes more documents than a bin has left; the
    rest goes by greedy patterns, of which each uses up a bin or more.
    """
    bins = window // bin_size
    have = np.zeros(bins, np.int64)
    for b, n in histogram.items():
        have[b - 1] = n
    used = np.zeros(bins, np.int64)
    rows, sequences = [], 0

    def take(pattern: np.ndarray, repeat: int) -> None:
        nonlocal sequences
        slot = 0
        for s in np.nonzero(pattern)[0]:
            each = int(pattern[s])
            rows.append((int(s) + 1, int(used[s]), int(used[s]) + each * repeat, sequences, slot, each))
            used[s] += each * repeat
            slot += each
        sequences += repeat

    if have.any():
        combos = combinations_filling(bins, depth)
        # Combinations of sizes that no document has fill nothing.
        combos = combos[:, (combos[have == 0] == 0).all(axis=0)]
        solved = nnls(combos, have.astype(float)) if combos.shape[1] else np.zeros(0)
        for j in np.argsort(-solved, kind="stable"):
            pattern = combos[:, j].astype(np.int64)
            at = pattern > 0
            repeat = min(round(float(solved[j])), int(((have - used)[at] // pattern[at]).min()))
            if repeat > 0:
                take(pattern, repeat)
    solved_documents = int(used.sum())
    for pattern, repeat in greedy_patterns(have - used):
        take(pattern, repeat)
    return rows, sequences, solved_documents


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, n, ids): a row for each of ``docs``, ids as little-endian uint32 bytes, ``end_id`` last; row is unique."""
    small_batches(docs.sparkSession)

    def task(batches):
        encode = encoder("word", vocabulary).encode
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            held, size = [], 0
            for doc_id, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                ids = encode(text.as_py() or "") + end
                held.append((doc_id, row, len(ids) // 4, ids))
                size += len(ids)
                if size > 8 << 20:
                    yield batch(held)
                    held, size = [], 0
            if held:
                yield batch(held)

    def batch(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "row", "n", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(task, "doc_id long, row long, n long, ids binary")


def place(lengths: DataFrame, window: int = WINDOW, bin_size: int = BIN, depth: int = DEPTH) -> DataFrame:
    """(row, start, length, sequence_id, offset): where each piece of the rows (row, n) stands.

    Every id of every row is in one piece; offsets of a sequence have no gap from
    0. Rows of n = 0 have no piece. The histogram sent to the driver has
    window / bin_size bins at most, whatever the rows.
    """
    spark = lengths.sparkSession
    rest = F.col("n") % window
    lengths = lengths.select("row", "n", rest.alias("rest"), F.ceil(rest / bin_size).cast("int").alias("bin"), F.floor(F.col("n") / window).cast("long").alias("full"))
    remainders = lengths.where("rest > 0")
    histogram = {r["bin"]: r["count"] for r in remainders.groupBy("bin").count().collect()}
    slots, planned, _ = plan_slots(histogram, window, bin_size, depth)

    ranked = prefix_sums(remainders.select("row", "n", "rest", "bin"), ["row"], {"rank": F.lit(1).cast("long")}, keys=["bin"], tag="pack-rank")
    # A few rows for each combination or pattern that is used, of which there are about as many as bins.
    ranges = spark.createDataFrame(slots, "slot_bin int, lo long, hi long, first long, slot int, each int")
    at = F.col("rank") - F.col("lo")
    seated = cut(
        ranked.join(F.broadcast(ranges), (F.col("bin") == F.col("slot_bin")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .select("row", "n", "rest", (F.col("first") + F.floor(at / F.col("each"))).alias("sequence_id"), (F.col("slot") + at % F.col("each")).alias("slot")),
        "pack-slots",
    )
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    in_plan = seated.select(
        "row", (F.col("n") - F.col("rest")).alias("start"), F.col("rest").alias("length"), "sequence_id", F.coalesce(F.sum("rest").over(before), F.lit(0)).alias("offset")
    )
    full = prefix_sums(lengths.where("full > 0").select("row", "full"), ["row"], {"at": F.col("full")}, tag="pack-full")
    whole = full.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1))).select(
        "row", (F.col("k") * window).alias("start"), F.lit(window).cast("long").alias("length"),
        (F.col("at") + F.col("k") + planned).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return in_plan.union(whole)


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all documents.

    ids are the piece's own, as little-endian uint32 bytes. A sequence holds at
    most ``window`` ids and is padded to it by its reader. A null or empty text is
    the end id alone; rows that share a doc_id are separate documents; other
    columns are left out; an empty table gives an empty result.
    """
    encoded = cut(encode_documents(docs, vocabulary, end_id, id_col, text_col), "pack-ids")
    pieces = place(encoded.select("row", "n"), window)
    by_row = pieces.groupBy(F.col("row").alias("piece_row")).agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    joined = encoded.join(by_row, F.col("row") == F.col("piece_row")).select("doc_id", F.col("n").alias("doc_tokens"), "ids", F.explode("pieces").alias("p"))
    return joined.select(
        "doc_id", "p.start", "p.length",
        F.expr("substring(ids, cast(p.start * 4 + 1 as int), cast(p.length * 4 as int))").alias("ids"),
        "doc_tokens", "p.sequence_id", "p.offset",
    )


def packed_digest(docs: DataFrame) -> DataFrame:
    packed = pack_documents(docs, public_vocabulary("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
