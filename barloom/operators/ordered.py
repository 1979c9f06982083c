"""Exact quantiles, streaks and autocorrelations of long groups: no task holds a group.

Rows are dealt by ranges or counted by buckets; what meets in one place is a few
rows for each group and range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.runtime import cut, prefix_sums

#: Buckets in which a value grows by a factor of e.
FINE = 1000
#: Places between two rows that an autocorrelation takes.
LAGS = 5


def _bucket(v: str) -> Column:
    """A number that never falls as ``v`` grows: about 1/FINE of it wide, and as wide below 1e-300."""
    near = F.least(F.greatest(F.abs(F.col(v)), F.lit(1e-300)), F.lit(1e308))
    depth = (F.floor(F.ln(near) * FINE) + 1000 * FINE).cast("long")
    return F.when(F.col(v) == 0, 0).when(F.col(v) > 0, depth).otherwise(-depth).cast("long")


def quantiles(values: DataFrame, groups: list[str], value: str, shares: list[float]) -> DataFrame:
    """(groups, q): the array of the interpolated quantiles at ``shares``; nulls are no values, and a group without one has no row.

    The table is read twice: counts by bucket tell which buckets hold the ranks
    asked, and only the values of these are counted and numbered.
    """
    rows = values.where(F.col(value).isNotNull()).select(F.struct(*groups).alias("g"), F.col(value).cast("double").alias("v")).withColumn("b", _bucket("v"))
    before = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("g", "b").agg(F.count("*").alias("c"))
    counts = counts.withColumns({"base": F.coalesce(F.sum("c").over(before), F.lit(0)), "n": F.sum("c").over(Window.partitionBy("g"))})
    asked = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), ((F.col("n") - 1) * F.lit(float(q))).alias("at")) for j, q in enumerate(shares)]))
    asked = counts.select("g", "b", "base", "c", asked.alias("a")).select("g", "b", "base", "c", "a.j", "a.at")
    ranks = asked.withColumn("rank", F.explode(F.array(F.floor("at"), F.ceil("at")))).where("rank >= base and rank < base + c").select("g", "b", "j", "at", (F.col("rank") - F.col("base")).alias("rank"), (F.col("rank") > F.col("at")).alias("upper")).distinct()
    ranks = cut(ranks, "quantile-ranks")
    wanted = ranks.select(F.col("g").alias("wg"), F.col("b").alias("wb")).distinct()
    held = rows.join(F.broadcast(wanted), (F.col("g") == F.col("wg")) & (F.col("b") == F.col("wb")), "left_semi").groupBy("g", "b", "v").agg(F.count("*").alias("c"))
    placed = prefix_sums(held, ["v"], {"first": F.col("c")}, keys=["g", "b"], tag="quantiles")
    met = placed.join(F.broadcast(ranks), ["g", "b"]).where("rank >= first and rank < first + c")
    low, high = F.max(F.when(~F.col("upper"), F.col("v"))), F.max(F.when(F.col("upper"), F.col("v")))
    found = met.groupBy("g", "j", "at").agg(low.alias("low"), high.alias("high"))
    share = F.col("at") - F.floor("at")
    found = found.withColumn("q", F.when(F.col("high").isNull(), F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * share))
    return found.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "q"))), lambda x: x["q"]).alias("q")).select(*[F.col("g")[c].alias(c) for c in groups], "q")


def _dealt(rows: DataFrame, group: str, order: list[str], value: Column) -> DataFrame:
    """(g, part, x): the rows by ranges of the order, numbered, and in order within each."""
    by = [F.col("g"), *[F.col(f"o{j}") for j in range(len(order))]]
    named = rows.select(F.col(group).alias("g"), *[F.col(c).alias(f"o{j}") for j, c in enumerate(order)], value.alias("x"))
    return named.repartitionByRange(*by).sortWithinPartitions(*by).select("g", F.spark_partition_id().alias("part"), "x")


def _runs(batches):
    """(g, part, rows of the group's values) of a task, batch by batch."""
    for b in batches:
        if not b.num_rows:
            continue
        coded = b.column("g").dictionary_encode()
        code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        x = b.column("x").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.nonzero(np.diff(code))[0] + 1).tolist(), len(code)]
        for a, z in zip(cuts, cuts[1:]):
            yield b.column("g")[a].as_py(), b.column("part")[a].as_py(), x[a:z]


def _streaks_of(batches):
    """(g, part, at, s, n): the first and last streak of each group in a task, and between them the longest of each sign, kept apart."""
    group, out = None, []
    first, open_, best = None, None, {}

    def close():
        if group is None:
            return
        inner = [(s, n) for s, n in best.items() if s]
        found = [first] if first else []
        for s, n in inner:
            found += [(0, 0), (s, n)]
        if first:
            found.append((0, 0))
        found.append(open_)
        out.extend((*group, at, s, n) for at, (s, n) in enumerate(found))

    for g, part, x in _runs(batches):
        if (g, part) != group:
            close()
            group, first, open_, best = (g, part), None, None, {}
        cuts = np.concatenate([[0], np.nonzero(np.diff(x))[0] + 1, [len(x)]])
        for s, n in zip(x[cuts[:-1]].tolist(), np.diff(cuts).tolist()):
            if open_ and open_[0] == s:
                open_ = (s, open_[1] + n)
                continue
            if open_ and first:
                best[open_[0]] = max(best.get(open_[0], 0), open_[1])
            elif open_:
                first = open_
            open_ = (s, n)
    close()
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["g", "part", "at", "s", "n"])


def longest_streaks(rows: DataFrame, group: str, order: list[str], sign: Column) -> DataFrame:
    """(group, wins, losses): the most rows in a row whose sign is 1, and -1, null if there are none."""
    found = _dealt(rows, group, order, sign.cast("int")).mapInArrow(_streaks_of, "g string, part int, at int, s int, n long")
    by = Window.partitionBy("g").orderBy("part", "at")
    fresh = F.when(F.col("s") == F.lag("s").over(by), 0).otherwise(1)
    joined = found.withColumn("fresh", fresh).withColumn("streak", F.sum("fresh").over(by)).groupBy("g", "streak", "s").agg(F.sum("n").alias("n"))
    longest = [F.max(F.when(F.col("s") == s, F.col("n"))).alias(name) for s, name in ((1, "wins"), (-1, "losses"))]
    return joined.groupBy("g").agg(*longest).withColumnRenamed("g", group)


def _products(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    p = a * b
    return float(np.nansum(p)), int((~np.isnan(p)).sum())


def _lagged(head: np.ndarray, x: np.ndarray):
    """Sums and numbers of products of rows 1 to LAGS apart, the later one in x, the earlier one in x or in ``head`` before it."""
    whole = np.concatenate([head, x])
    for j in range(1, LAGS + 1):
        later = whole[max(len(head), j) :]
        yield _products(whole[len(whole) - len(later) - j : len(whole) - j], later)


def _lags_of(batches):
    """A row for each group in a task: rows, squares, sums and numbers of products by lag, the first and last LAGS values."""
    group, out, held = None, [], None

    def close():
        if group is not None:
            n, (ss, ns), sums, numbers, first, last = held
            out.append((*group, n, ss, ns, sums.tolist(), numbers.tolist(), first.tolist(), last.tolist()))

    for g, part, x in _runs(batches):
        if (g, part) != group:
            close()
            group, held = (g, part), [0, (0.0, 0), np.zeros(LAGS), np.zeros(LAGS, np.int64), np.zeros(0), np.zeros(0)]
        n, (ss, ns), sums, numbers, first, last = held
        more, count = _products(x, x)
        found = list(_lagged(last, x))
        held = [n + len(x), (ss + more, ns + count), sums + [s for s, _ in found], numbers + [k for _, k in found], np.concatenate([first, x])[:LAGS], np.concatenate([last, x])[-LAGS:]]
    close()
    names = ["g", "part", "rows", "squares", "squared", "sums", "numbers", "first", "last"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
    yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)


def _joined_lags(parts: pd.DataFrame) -> pd.DataFrame:
    """A group's parts in one, with the products across their edges."""
    sums, numbers, last = np.zeros(LAGS), np.zeros(LAGS, np.int64), np.zeros(0)
    for r in parts.sort_values("part").itertuples():
        first = np.asarray(r.first, float)
        across, inside = list(_lagged(last, first)), list(_lagged(np.zeros(0), first))
        sums += np.asarray(r.sums, float) + [a[0] - b[0] for a, b in zip(across, inside)]
        numbers += np.asarray(r.numbers, np.int64) + [a[1] - b[1] for a, b in zip(across, inside)]
        last = np.concatenate([last, np.asarray(r.last, float)])[-LAGS:]
    squares = parts["squares"].sum() if parts["squared"].sum() else None
    return pd.DataFrame({"g": [parts["g"].iloc[0]], "n": [parts["rows"].sum()], "squares": [squares], "sums": [[float(s) if k else None for s, k in zip(sums, numbers)]]})


def lag_sums(rows: DataFrame, group: str, order: list[str], value: Column) -> DataFrame:
    """(group, n, squares, sums): rows, the sum of squares and the sums of products of values 1 to LAGS rows apart; null where there are none."""
    found = _dealt(rows, group, order, value.cast("double")).mapInArrow(_lags_of, "g string, part int, rows long, squares double, squared long, sums array<double>, numbers array<long>, first array<double>, last array<double>")
    return found.groupBy("g").applyInPandas(_joined_lags, "g string, n long, squares double, sums array<double>").withColumnRenamed("g", group)
