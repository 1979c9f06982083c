"""Checks of results against results: multisets, prefixes, digests and positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.structure import SQL as STRUCTURE
from barloom.plans.sql import spark_query, with_tables
from barloom.runtime import cut, fresh_path, prefix_sums
from barloom.sources.frames import FRAMES, epoch_ms

# -- multisets ----------------------------------------------------------------


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """The different rows that do not stand equally often in ``a`` and ``b``, with ``a_times`` and ``b_times``.

    Unlike a difference of sets this finds a row that one side repeats. Nulls equal
    nulls and NaN equals NaN. Both sides must have the same columns, in any order;
    equal rows are summed before the shuffle.
    """
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError(f"columns differ: {sorted(set(a.columns) ^ set(b.columns))}")
    names = a.columns
    side = lambda df, x, y: df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.lit(x).cast("long").alias("a_times"), F.lit(y).cast("long").alias("b_times"))
    both = side(a, 1, 0).unionByName(side(b, 0, 1)).groupBy("row").agg(F.sum("a_times").alias("a_times"), F.sum("b_times").alias("b_times"))
    return both.where("a_times <> b_times")


def first_differences(a: DataFrame, b: DataFrame, examples: int = 5) -> DataFrame:
    """The columns of ``a``, a_times, b_times: the first ``examples`` rows of :func:`differences`, in order of their columns."""
    return differences(a, b).orderBy("row").limit(examples).select("row.*", "a_times", "b_times")


_SIDE = "SELECT run_id, regime, exit_reason, entry_month FROM {ledger} WHERE side = '%s'"
_SIDES_SQL = f"""
WITH a AS ({_SIDE % 'long'}), b AS ({_SIDE % 'short'}),
u AS (SELECT *, 1 AS x, 0 AS y FROM a UNION ALL SELECT *, 0 AS x, 1 AS y FROM b)
SELECT run_id, regime, exit_reason, entry_month, CAST(sum(x) AS BIGINT) AS a_times, CAST(sum(y) AS BIGINT) AS b_times FROM u GROUP BY ALL HAVING sum(x) <> sum(y)"""


def side_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of trades that longs and shorts do not fill equally."""
    return differences(*[spark_query(_SIDE % s)(spark, sf_dir) for s in ("long", "short")]).select("row.*", "a_times", "b_times")


def side_difference_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_differences(*[spark_query(_SIDE % s)(spark, sf_dir) for s in ("long", "short")])


# -- prefixes -----------------------------------------------------------------

#: Query -> the bar after which each of its rows is known.
CAUSAL = {
    "true_range": "i", "atr_inclusive": "i", "zscore_prior": "i", "swings_1h": "conf", "swing_labels": "conf", "break_of_structure": "conf",
    "range_levels": "creation + 1", "session_levels": "creation", "liquidity_sweeps": "conf", "regime_transitions": "i",
}
SHARES, DAY_MS = (0.4, 0.7, 0.9), 86_400_000


def _ends(spark: SparkSession, sf_dir: str, shares: tuple[float, ...]) -> list[int]:
    """Whole days before which each prefix ends."""
    low, high = spark.read.parquet(f"{sf_dir}/events.parquet").select(epoch_ms("ts").alias("t")).agg(F.min("t"), F.max("t")).first()
    return [] if low is None else [int(low + s * (high - low)) // DAY_MS * DAY_MS for s in shares]


def tagged_prefixes(spark: SparkSession, sf_dir: str, shares: tuple[float, ...] = SHARES) -> str:
    """A folder with the events of each prefix and of the whole, as symbols of their own: SYMBOL|0, |1, ... and |ALL."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ms = epoch_ms("ts")
    tags = F.array(F.lit("ALL"), *[F.when(ms < end, F.lit(str(k))) for k, end in enumerate(_ends(spark, sf_dir, shares))])
    path = fresh_path(spark, "prefixes")
    tagged = events.withColumn("__tag", F.explode(F.filter(tags, lambda t: t.isNotNull())))
    tagged.withColumn("event_type", F.concat("event_type", F.lit("|"), F.col("__tag"))).drop("__tag").write.parquet(f"{path}/events.parquet")
    return path


def audit_prefixes(spark: SparkSession, sf_dir: str, queries: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]], shares: tuple[float, ...] = SHARES, bars: str = "bars_1h") -> DataFrame:
    """(query, prefix, compared, changed, future): whether later bars alter what a query said before.

    Each query runs once, over all prefixes and the whole series as symbols of
    their own, as every candle query keeps symbols apart. ``queries`` gives it with
    the bar after which a row is known. ``compared`` counts the rows of the whole
    that are known by the prefix's last bar. ``changed`` counts rows, with their
    multiplicity, that only the prefix or only the whole has of these; ``future``
    rows of the prefix that claim a bar after its last. A causal query has neither.
    """
    path = tagged_prefixes(spark, sf_dir, shares)
    ends = cut(FRAMES[bars][0](spark, path).groupBy("symbol").agg(F.max("i").alias("last")), "ends")
    prefixes = ends.select(F.split_part("symbol", F.lit("|"), F.lit(1)).alias("p_symbol"), F.split_part("symbol", F.lit("|"), F.lit(2)).alias("prefix"), "last").where("prefix <> 'ALL'")
    out = None
    for name, (query, known) in queries.items():
        rows = query(spark, path)
        columns = [c for c in rows.columns if c != "symbol"]
        rows = rows.select(F.struct(F.split_part("symbol", F.lit("|"), F.lit(1)).alias("symbol"), *columns).alias("row"), F.split_part("symbol", F.lit("|"), F.lit(2)).alias("tag"), F.expr(known).cast("long").alias("known"))
        rows = rows.join(prefixes, F.col("p_symbol") == F.col("row.symbol")).where("tag = 'ALL' or tag = prefix")
        whole = F.col("tag") == "ALL"
        told = F.col("known") <= F.col("last")
        summed = rows.groupBy("prefix", "row").agg(
            F.sum(F.when(told, F.when(whole, 1).otherwise(-1)).otherwise(0)).alias("gap"), F.count_if(whole & told).alias("compared"), F.count_if(~whole & ~told).alias("future")
        )
        found = summed.groupBy("prefix").agg(F.sum("compared").alias("compared"), F.sum(F.abs("gap")).alias("changed"), F.sum("future").alias("future"))
        found = found.select(F.lit(name).alias("query"), F.col("prefix").cast("int").alias("prefix"), "compared", "changed", "future")
        out = found if out is None else out.unionByName(found)
    return out


def _causal() -> dict[str, tuple[str, str]]:
    from barloom.operators import events, indicators

    texts = STRUCTURE | indicators.SQL | events.SQL
    return {name: (texts[name], known) for name, known in CAUSAL.items()}


def prefix_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_prefixes(spark, sf_dir, {name: (spark_query(sql), known) for name, (sql, known) in _causal().items()})


def prefix_audit_sql() -> str:
    """What a clean audit says: the rows of the whole that each prefix may know, none changed and none of the future."""
    parts = []
    for k, (name, (sql, known)) in enumerate(_causal().items()):
        parts.append(f"""SELECT '{name}' AS query, prefix, count(*) AS compared, 0::BIGINT AS changed, 0::BIGINT AS future
  FROM ({with_tables(sql)}) q JOIN lasts ON lasts.symbol = q.symbol AND {' + '.join(f'q.{x}' if x.isidentifier() else x for x in known.split(' + '))} <= last GROUP BY prefix""")
    shares = ", ".join(f"({k}, {s}::DOUBLE)" for k, s in enumerate(SHARES))
    return f"""
WITH span AS (SELECT min(epoch_ms(ts)) AS low, max(epoch_ms(ts)) AS high FROM events),
ends AS (SELECT p AS prefix, CAST(floor(low + s * (high - low)) AS BIGINT) // {DAY_MS} * {DAY_MS} AS until_ms FROM span, (VALUES {shares}) v(p, s)),
lasts AS (SELECT b.symbol, prefix, max(b.i) AS last FROM ({with_tables('SELECT symbol, i, open_ms FROM {bars_1h}')}) b JOIN ends ON b.open_ms < ends.until_ms GROUP BY b.symbol, prefix)
{' UNION ALL '.join(parts)}"""


# -- digests ------------------------------------------------------------------

#: Digests under one node of the tree, its least number of levels, and lanes of 32 bits of an order-free digest.
FAN, LEVELS, LANES = 1024, 3, 8


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of the values as text, each with its length before it, null apart from any text.

    Timestamps are printed in the session's time zone and decimals with all their
    places; the names and the order of columns do not count.
    """
    text = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("|", *text), 256)


def unordered_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, digest): one row, equal for any order of the rows, and changed by any cell or repetition.

    Sums of eight parts of the rows' digests modulo 2^32, made in the tasks.
    """
    h = row_digest(columns)
    lanes = df.select(*[F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)").alias(f"s{k}") for k in range(LANES)])
    sums = lanes.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(f"s{k}"), F.lit(0).cast("decimal(38,0)")).alias(f"s{k}") for k in range(LANES)])
    part = lambda k: F.lpad(F.lower(F.hex((F.col(f"s{k}") % F.lit(1 << 32).cast("decimal(20,0)")).cast("long"))), 8, "0")
    return sums.select("rows", F.concat(*[part(k) for k in range(LANES)]).alias("digest"))


def ordered_digest(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """(rows, digest): one row, of the rows in ``order``; ties go by the rows' own digests.

    A tree over global row numbers: each node is the SHA-256 of the FAN digests
    under it, so no task holds more than FAN at once and the partitions do not
    matter. It has at least LEVELS levels. No rows give the digest of nothing.
    """
    rows = df.select(*order, row_digest(columns).alias("h"))
    # Order columns get names of their own, as the running numbers must not clash with theirs.
    rows = rows.toDF(*[f"o{k}" for k in range(len(order))], "h")
    numbered = prefix_sums(rows, [f"o{k}" for k in range(len(order))] + ["h"], {"at": F.lit(1).cast("long")}, tag="digest")
    nodes, n, level = cut(numbered.select("at", "h"), "leaves"), None, 0
    n = left = nodes.count()
    while level < LEVELS or left > 1:
        nodes = nodes.groupBy(F.floor(F.col("at") / FAN).alias("at")).agg(F.sort_array(F.collect_list(F.struct("at", "h"))).alias("x"))
        nodes = nodes.select("at", F.sha2(F.concat_ws("", F.transform("x", lambda e: e["h"])), 256).alias("h"))
        left, level = -(-left // FAN), level + 1
    return nodes.agg(F.lit(n).alias("rows"), F.coalesce(F.max("h"), F.sha2(F.lit(""), 256)).alias("digest"))


def verify(df: DataFrame, frozen: dict, order: list[str], columns: list[str]) -> None:
    """Raise unless the table has the rows and the ordered digest that ``frozen`` names."""
    now = ordered_digest(df, order, columns).first().asDict()
    if now != {k: frozen[k] for k in ("rows", "digest")}:
        raise ValueError(f"the table has changed: {now} is not {frozen}")


_DIGESTED = ["symbol", "open_ms", "open", "high", "low", "close", "volume", "quote_volume", "trade_count"]


def candle_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both digests of the 1-hour candles."""
    df = cut(FRAMES["candles_1h"][0](spark, sf_dir), "digested")
    kinds = [unordered_digest(df, _DIGESTED).select(F.lit("unordered").alias("kind"), "rows", "digest"), ordered_digest(df, ["symbol", "open_ms"], _DIGESTED).select(F.lit("ordered").alias("kind"), F.col("rows").cast("long").alias("rows"), "digest")]
    return kinds[0].unionByName(kinds[1])


def _candle_digest_sql() -> str:
    cell = " || '|' || ".join(f"coalesce(concat(length(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR)), '-')" for c in _DIGESTED)
    lanes = ", ".join(f"printf('%08x', CAST(sum(CAST(concat('0x', substr(h, {1 + 8 * k}, 8)) AS BIGINT)) % {1 << 32} AS BIGINT))" for k in range(LANES))
    levels = "".join(f", l{k + 1} AS (SELECT pos // {FAN} AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM l{k} GROUP BY pos // {FAN})" for k in range(LEVELS))
    return f"""
WITH r AS (SELECT symbol, open_ms, sha256({cell}) AS h FROM ({with_tables('SELECT * FROM {candles_1h}')})),
l0 AS (SELECT row_number() OVER (ORDER BY symbol, open_ms, h) - 1 AS pos, h FROM r){levels}
SELECT 'unordered' AS kind, count(*) AS rows, concat({lanes}) AS digest FROM r
UNION ALL SELECT 'ordered', (SELECT count(*) FROM r), max(h) FROM l{LEVELS}"""


# -- positions ----------------------------------------------------------------


def asserted(df: DataFrame, holds: Column, message: Column) -> DataFrame:
    """``df``; a row for which ``holds`` is not true fails the job when the row is read."""
    return df.where(F.when(F.coalesce(holds, F.lit(False)), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def aligned(ledger: DataFrame, bars: DataFrame, index: str = "entry_i", time: str = "entry_ms") -> DataFrame:
    """The ledger's rows with the bar (o, h, l, c) at their index, all of whose times must be the bar's opening time.

    A row whose bar is absent or opens at another time fails the job.
    """
    at = bars.select(F.col("symbol").alias("b_symbol"), F.col("i").alias("b_i"), F.col("open_ms").alias("b_ms"), "o", "h", "l", "c")
    joined = ledger.join(at, (F.col("symbol") == F.col("b_symbol")) & (F.col(index) == F.col("b_i")), "left")
    told = F.concat(F.lit("row out of place: "), F.col("symbol"), F.lit(" "), F.coalesce(F.col(index).cast("string"), F.lit("no index")), F.lit(" at "), F.coalesce(F.col(time).cast("string"), F.lit("no time")))
    return asserted(joined, F.col(time) == F.col("b_ms"), told).drop("b_symbol", "b_i", "b_ms")


#: Sweeps entered at the open of the bar that confirms them, timed by the bar itself.
_ENTRIES = f"""{STRUCTURE['liquidity_sweeps'].replace('SELECT symbol, i, i + 1 AS conf, side, price, level_type, creation, next_close FROM sweeps', '''
, timed AS (SELECT symbol, i, lead(open_ms) OVER (PARTITION BY symbol ORDER BY i) AS entry_ms FROM {bars_1h})
SELECT s.symbol, s.i + 1 AS entry_i, s.side, s.price, t.entry_ms FROM sweeps s JOIN timed t ON t.symbol = s.symbol AND t.i = s.i''')}"""


def aligned_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(spark_query(_ENTRIES)(spark, sf_dir), FRAMES["bars_1h"][0](spark, sf_dir)).select("symbol", "entry_i", "side", "price", "entry_ms", F.col("o").alias("entry_open"))


QUERIES = {
    "side_differences": side_differences, "side_difference_examples": side_difference_examples, "prefix_audit": prefix_audit, "candle_digest": candle_digest, "aligned_entries": aligned_entries,
}
ORACLES = {
    "side_differences": with_tables(_SIDES_SQL),
    "side_difference_examples": with_tables(f"SELECT * FROM ({_SIDES_SQL}) ORDER BY run_id, regime, exit_reason, entry_month LIMIT 5"),
    "prefix_audit": prefix_audit_sql(),
    "candle_digest": _candle_digest_sql(),
    "aligned_entries": with_tables(f"SELECT e.*, b.o AS entry_open FROM ({_ENTRIES}) e JOIN {{bars_1h}} b ON b.symbol = e.symbol AND b.i = e.entry_i"),
}
