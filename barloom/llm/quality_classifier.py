"""Quality scores: ridge regression on random Fourier features of document statistics, isotonically calibrated."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.batches import small_batches
from barloom.llm.textstats import TextStats, held_out, training_rows
from barloom.runtime import cut

FEATURES = 256
SEED = 8
#: Labelled ids of each class that the ridge is fitted on, at most, and tasks that sum its equations.
PER_CLASS, TASKS = 20_000, 16
RIDGE = 1e-3
PREDICT_AT = 0.7

_UPPER, _DIGIT = np.arange(65, 91), np.arange(48, 58)


def document_statistics(s: TextStats) -> np.ndarray:
    """Statistics of a text that do not depend on its language or topic."""
    c, n = s.counts, max(1, len(s.bytes))
    words, lines = max(1, s.n_words), max(1, s.lines)
    letters = c[65:91].sum() + c[97:123].sum()
    times = np.unique(s.numbers, return_counts=True)[1] if s.n_words else np.zeros(1)
    return np.array([
        np.log1p(s.n_words), np.log1p(s.lines), np.log1p(s.word_chars / words), np.log1p(s.n_words / lines),
        c[_UPPER].sum() / max(1, letters), c[_DIGIT].sum() / n, c[ord("!")] / words, c[ord("|")] / words,
        (s.n_symbols - c[ord("|")]) / words, (c[ord(".")] + c[ord(",")]) / words, c[0xC0:].sum() / n,
        s.n_dup_lines / lines, s.n_repeat_words / words, len(times) / words, times.max() / words, np.log1p(times.max()),
    ])


N_STATS = 16


def pava(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[tuple[float, float, float]]:
    """Isotonic steps by pooling adjacent violators: (lowest x, highest x, mean y) in order; equal x share a step."""
    blocks: list[list[float]] = []  # mean, weight, lowest x, highest x
    for i in np.argsort(x, kind="stable"):
        blocks.append([float(y[i]), float(w[i]), float(x[i]), float(x[i])])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            m, n, _, hi = blocks.pop()
            last = blocks[-1]
            last[0] = (last[0] * last[1] + m * n) / (last[1] + n)
            last[1] += n
            last[3] = hi
    return [(lo, hi, mean) for mean, _, lo, hi in blocks]


def ranked_steps(steps: list[tuple[float, float, float]], rows: int, slope: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """(knots, values), to be interpolated: the steps, each inclined a little so that no two scores in it tie.

    A step rises by at most ``slope`` to either side of its mean and stays clear of
    its neighbours. Means keep 1 / (2 rows + 2) from 0 and 1, which are reached as
    far outside the fitted scores as those are wide.
    """
    edge = 1 / (2 * rows + 2)
    means = np.clip([s[2] for s in steps], edge, 1 - edge)
    knots, values = [], []
    for k, (lo, hi, _) in enumerate(steps):
        m = float(means[k])
        room = min(slope, m / 2, (1 - m) / 2, *(abs(float(means[j]) - m) / 3 for j in (k - 1, k + 1) if 0 <= j < len(steps)))
        knots += [lo, hi] if hi > lo else [lo]
        values += [m - room, m + room] if hi > lo else [m]
    wide = max(knots[-1] - knots[0], 1e-6)
    return np.array([knots[0] - wide, *knots, knots[-1] + wide]), np.array([0.0, *values, 1.0])


class FourierRidge:
    """Standardizing, the random features, the ridge weights and the isotonic steps."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, spread
        self.directions = rng.standard_normal((len(mean), FEATURES)) / np.sqrt(len(mean))
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.knots, self.values = np.array([0.0]), np.array([1.0])

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -6, 6)
        out = np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases)
        return np.hstack([out, np.ones((len(out), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0, 1)


def _stats(column) -> np.ndarray:
    rows = [document_statistics(TextStats(t.as_py())) for t in column]
    return np.stack(rows) if rows else np.zeros((0, N_STATS))


def fit_classifier(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> FourierRidge:
    """Fit on at most ``per_class`` labelled ids of each class, none of them held out.

    The statistics of those rows are written once. Tasks sum the moments, then the
    normal equations, of their share; at most TASKS matrices come to the driver.
    The ridge is solved on even ids' equations for odd ids' scores and the reverse,
    the isotonic steps are fitted to those scores with the classes' true weights,
    and the weights are then solved on all. Without both classes every score is
    the one class's (1 without labels).
    """
    small_batches(docs.sparkSession)
    rows, sizes = training_rows(docs, labels, per_class)

    def measure(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(2), pa.array(list(_stats(b.column(1))), pa.list_(pa.float64()))], names=["doc_id", "quality", "stats"])

    data = rows.select(F.col("doc_id").cast("long"), "text", F.col("quality").cast("int")).mapInArrow(measure, "doc_id long, quality int, stats array<double>")
    data = cut(data, "quality-stats")
    columns = [F.element_at("stats", i + 1) for i in range(N_STATS)]
    moments = data.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not moments["n"]:
        return FourierRidge(np.zeros(N_STATS), np.ones(N_STATS))
    model = FourierRidge(np.array([moments[f"m{i}"] for i in range(N_STATS)]), np.maximum(1e-6, np.array([moments[f"s{i}"] for i in range(N_STATS)])))
    got = {r["quality"]: r["count"] for r in data.groupBy("quality").count().collect()}
    if len(got) < 2:
        model.values = np.array([float(next(iter(got)))])
        return model
    weight = {q: 1 / got[q] for q in got}

    def equations(batches):
        d = FEATURES + 1
        gram, rhs = np.zeros((2, d, d)), np.zeros((2, d))
        for b in batches:
            y = b.column(1).to_numpy().astype(float)
            a = model.features(np.array(b.column(2).to_pylist()).reshape(len(y), N_STATS))
            w = np.where(y == 1, weight[1], weight[0])
            for side in (0, 1):
                own = b.column(0).to_numpy() % 2 == side
                gram[side] += (a[own] * w[own, None]).T @ a[own]
                rhs[side] += (a[own] * w[own, None]).T @ y[own]
        yield pa.record_batch([pa.array([gram.tobytes()], pa.binary()), pa.array([rhs.tobytes()], pa.binary())], names=["gram", "rhs"])

    d = FEATURES + 1
    gram, rhs = np.zeros((2, d, d)), np.zeros((2, d))
    for r in data.coalesce(TASKS).mapInArrow(equations, "gram binary, rhs binary").toLocalIterator():
        gram += np.frombuffer(r["gram"]).reshape(2, d, d)
        rhs += np.frombuffer(r["rhs"]).reshape(2, d)
    solve = lambda g, r: np.linalg.solve(g + RIDGE * np.eye(d), r)
    halves = [solve(2 * gram[k], 2 * rhs[k]) for k in (0, 1)]

    def cross(batches):
        for b in batches:
            a = model.features(np.array(b.column(2).to_pylist()).reshape(b.num_rows, N_STATS))
            odd = b.column(0).to_numpy() % 2
            z = np.where(odd == 1, a @ halves[0], a @ halves[1])
            yield pa.record_batch([b.column(1), pa.array(z)], names=["quality", "z"])

    # 2 * per_class rows of two numbers at most.
    scored = data.mapInArrow(cross, "quality int, z double").toPandas()
    y = scored["quality"].to_numpy().astype(float)
    true = np.where(y == 1, sizes[1] / got[1], sizes[0] / got[0])
    model.weights = solve(gram.sum(0), rhs.sum(0))
    model.knots, model.values = ranked_steps(pava(scored["z"].to_numpy(), y, true), len(y))
    return model


def score_quality(docs: DataFrame, model: FourierRidge, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score) of each row of ``docs``; score is the probability of quality 1.

    Null and empty texts are scored like others, from statistics that are zero. A
    null id is not held out. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def task(batches):
        model = shared.value
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array(model.score(_stats(b.column(2))), pa.float64())], names=["id", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(task, f"id {kind}, held_out boolean, score double")


def keep_scored(docs: DataFrame, model: FourierRidge, keep_at: float = PREDICT_AT) -> DataFrame:
    """``docs`` without the rows of a lower score; all columns stay."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def task(batches):
        for b in batches:
            yield b.filter(pa.array(shared.value.score(_stats(b.column(at))) >= keep_at))

    return docs.mapInArrow(task, docs.schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).select(F.col("id").alias("doc_id"), "held_out", "score", F.when(F.col("score") >= PREDICT_AT, 1).otherwise(0).alias("predicted"))
