"""Quality rules: exact counts, then a hashed n-gram logistic regression with calibrated probabilities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.batches import small_batches
from barloom.llm.textstats import TextStats, training_rows
from barloom.runtime import cut

#: Bits of a bucket's number.
BITS = 16
BUCKETS = 1 << BITS
#: Labelled ids of each class that the regression is fitted on, at most. A row has 6 bytes for each of its buckets.
PER_CLASS = 1000
KEEP_AT = 0.5
MIN_WORDS = 50
#: Steps of the fit, and rows that a step takes at once.
STEPS, CHUNK = 120, 128
#: Code points of a character gram, and a multiplier for each.
_GRAM = [np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def ngram_buckets(s: TextStats) -> list[np.ndarray]:
    """Buckets of the words, word pairs and 4-character grams (code points, case kept) of a text."""
    h = s.hashes.astype(np.uint64)
    mix = np.uint64(0x9E3779B97F4A7C15)
    words = (h * mix) >> np.uint64(64 - BITS)
    pairs = ((h[:-1] * np.uint64(31) + h[1:] + np.uint64(7)) * mix) >> np.uint64(64 - BITS)
    c = s.code_points()
    n = max(0, len(c) - len(_GRAM) + 1)
    grams = np.zeros(n, np.uint32)
    for k, m in enumerate(_GRAM):
        grams += c[k : k + n] * m
    grams = ((grams ^ (grams >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
    return [words, pairs, grams]


def _sparse(s: TextStats) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and the sum of their shares of each kind of gram."""
    total = np.zeros(BUCKETS)
    for g in ngram_buckets(s):
        if len(g):
            total += np.bincount(g.astype(np.int64), minlength=BUCKETS) / len(g)
    idx = np.nonzero(total)[0]
    return idx.astype(np.uint16), total[idx].astype(np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, steps: int = STEPS, decay: float = 1e-7) -> np.ndarray:
    """Weights by bucket and, last, a bias: full-batch gradients with a step size for each weight (Adam)."""
    chunks = []
    for a in range(0, len(rows), CHUNK):
        part = rows[a : a + CHUNK]
        chunks.append((a, len(part), np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part]), np.repeat(np.arange(len(part)), [len(r[0]) for r in part])))
    w, m, v = (np.zeros(BUCKETS + 1) for _ in range(3))
    rate = np.full(BUCKETS + 1, 1.0)
    rate[-1] = 0.1
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        g = decay * w
        for a, n, idx, val, row in chunks:
            z = np.bincount(row, w[idx] * val, n) + w[-1]
            miss = (_sigmoid(z) - y[a : a + n]) * weight[a : a + n]
            g += np.bincount(idx, miss[row] * val, BUCKETS + 1)
            g[-1] += miss.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def fit_platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) so that sigmoid(a z + b) is the probability of 1; a is not negative."""
    # Targets short of 0 and 1 keep the slope finite when the classes part cleanly.
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(np.std(z)), 1e-9)
    x, a, b = z / scale, 1.0, 0.0
    weight = weight / weight.sum()
    for _ in range(100):
        p = _sigmoid(a * x + b)
        d = weight * (p - t)
        s = weight * p * (1 - p)
        g = np.array([(d * x).sum() + 1e-6 * a, d.sum()])
        h = np.array([[(s * x * x).sum() + 1e-6, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 0.0) / scale, b


class QualityModel:
    """Regression weights and calibration; 1 is a kept text."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float) -> None:
        self.weights, self.bias, self.slope, self.shift = weights.astype(np.float32), bias, slope, shift

    def logit(self, s: TextStats) -> float:
        return self.bias + sum(float(self.weights[g].mean(dtype=np.float64)) for g in ngram_buckets(s) if len(g))

    def probability(self, s: TextStats) -> float:
        return float(_sigmoid(np.float64(self.slope * self.logit(s) + self.shift)))


def fit_quality_model(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    """Fit on at most ``per_class`` labelled ids of each class, none of them held out.

    The rows' grams are written once. Three tasks fit: two on the ids of one half
    each, which they then score the other half by, for the calibration, and one on
    all. What reaches the driver is their weights and 2 * per_class scores. The
    calibration is weighted to the classes' true sizes. Without rows of both classes
    the model gives every text the one class's probability (1 without labels).
    """
    small_batches(docs.sparkSession)

    def grams(batches):
        for b in batches:
            rows = [_sparse(TextStats(t.as_py())) for t in b.column(1)]
            yield pa.record_batch(
                [b.column(0), b.column(2), pa.array([r[0].tobytes() for r in rows], pa.binary()), pa.array([r[1].tobytes() for r in rows], pa.binary())],
                names=["doc_id", "quality", "idx", "val"],
            )

    rows, sizes = training_rows(docs, labels, per_class)
    rows = rows.select(F.col("doc_id").cast("long"), "text", F.col("quality").cast("int")).mapInArrow(grams, "doc_id long, quality int, idx binary, val binary")
    data = cut(rows, "quality-grams")
    count = {r["quality"]: r["count"] for r in data.groupBy("quality").count().collect()}
    if len(count) < 2:
        return QualityModel(np.zeros(BUCKETS), 0.0, 0.0, -30.0 if 0 in count else 30.0)

    def fit(table: pa.Table) -> pa.Table:
        k = table.column("k")[0].as_py()
        table = table.sort_by("doc_id")
        ids, y = table.column("doc_id").to_numpy(), table.column("quality").to_numpy().astype(float)
        x = [(np.frombuffer(i.as_buffer(), np.uint16), np.frombuffer(v.as_buffer(), np.float32)) for i, v in zip(table.column("idx"), table.column("val"))]
        weight = np.where(y == 1, 1 / count[1], 1 / count[0])
        own = np.nonzero(ids % 2 == k)[0] if k < 2 else np.arange(len(ids))
        other = np.nonzero(ids % 2 != k)[0] if k < 2 else own[:0]
        if k < 2 and len(set(y[own])) < 2:  # a half of one class: no scores of it
            own, other = own[:1], other[:0]
        w = fit_logistic([x[i] for i in own], y[own], weight[own])
        z = [float(w[-1] + (w[x[i][0]] * x[i][1]).sum()) for i in other]
        return pa.table({"k": pa.array([k], pa.int64()), "w": pa.array([w.tobytes()], pa.binary()), "z": pa.array([z], pa.list_(pa.float64())), "y": pa.array([y[other].tolist()], pa.list_(pa.float64()))})

    every = data.withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])))
    fits = {r["k"]: r for r in every.groupBy("k").applyInArrow(fit, "k long, w binary, z array<double>, y array<double>").collect()}
    w = np.frombuffer(fits[2]["w"])
    z, y = (np.array(fits[0][c] + fits[1][c]) for c in "zy")
    if len(set(y)) < 2:
        return QualityModel(w[:-1], float(w[-1]), 1.0, 0.0)
    true = np.where(y == 1, sizes[1] / (y == 1).sum(), sizes[0] / (y == 0).sum())
    return QualityModel(w[:-1], float(w[-1]), *fit_platt(z, y, true))


def judge(docs: DataFrame, model: QualityModel, keep_at: float = KEEP_AT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept), a row for each of ``docs``.

    base_failed: under 50 words, or over half of them in repeated three-word
    windows. kept: not base_failed and probability >= keep_at. Null and empty texts
    have no words and fail. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def task(batches):
        model = shared.value
        for b in batches:
            out = []
            for text in b.column(1):
                s = TextStats(text.as_py())
                failed = s.n_words < MIN_WORDS or 100 * s.n_repeat_words > 50 * s.n_words
                p = model.probability(s)
                out.append((s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, failed, p, not failed and p >= keep_at))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            columns = list(zip(*out)) if out else [()] * 8
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    schema = f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(task, schema)


def keep_good(docs: DataFrame, model: QualityModel, keep_at: float = KEEP_AT) -> DataFrame:
    """``docs`` without the rows that the rules reject; all columns stay."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def task(batches):
        model = shared.value
        for b in batches:
            kept = []
            for text in b.column(at):
                s = TextStats(text.as_py())
                failed = s.n_words < MIN_WORDS or 100 * s.n_repeat_words > 50 * s.n_words
                kept.append(not failed and model.probability(s) >= keep_at)
            yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(task, docs.schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, model).withColumnRenamed("id", "doc_id")
