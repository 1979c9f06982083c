"""Files of candles and trades: strict JSON, partitioned Parquet, exports, upserts and small dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.runtime import fresh_path
from barloom.sources.frames import FRAMES, LEDGER_SQL, TICKS_SQL, candles_sql

#: A record as it lies in a JSON array: numbers as text, the flag as text.
RECORD = "symbol string, open_time long, close_time long, open string, high string, low string, close string, volume string, is_closed string"
#: Quote currencies that end a symbol.
QUOTES = ["USDT", "USDC", "BTC", "ETH", "USD"]


# -- JSON -----------------------------------------------------------------------


def read_candle_json(spark: SparkSession, path: str, start_ms: int | None = None, end_ms: int | None = None, arrays: bool = False) -> DataFrame:
    """Candles of JSON files with a record a line, or ``arrays``: one array a file. A malformed file fails the job.

    With ``arrays`` a file that is not one whole array fails too, as Spark would
    read the first record of it alone. Numbers must be decimals and the flag True or
    False, or the cast raises. Rows outside [start_ms, end_ms) are left out; of rows
    with one symbol and open time one stays. ``ohlc_valid`` marks bars whose high and
    low bound the others.
    """
    raw = spark.read.schema(RECORD).option("multiLine", arrays).option("mode", "FAILFAST").json(path)
    if arrays:
        whole = F.col("value").rlike(r"(?s)^\s*\[.*\]\s*$")
        broken = spark.read.option("wholetext", True).text(path).where(~whole).select(F.raise_error(F.lit("a file is not one JSON array")).cast("string").alias("symbol"))
        raw = raw.unionByName(broken, allowMissingColumns=True)
    if start_ms is not None:
        raw = raw.where(F.col("open_time") >= start_ms)
    if end_ms is not None:
        raw = raw.where(F.col("open_time") < end_ms)
    rows = raw.select(
        "symbol", F.col("open_time").alias("open_ms"), F.col("close_time").alias("close_ms"),
        *[F.col(c).cast("decimal(18,2)").alias(c) for c in ("open", "high", "low", "close")],
        F.col("volume").cast("long").alias("volume"), F.lower("is_closed").cast("boolean").alias("is_closed"),
    )
    first = Window.partitionBy("symbol", "open_ms").orderBy("close_ms", "open", "high", "low", "close", "volume", "is_closed")
    rows = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return rows.withColumn("ohlc_valid", (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close")))


def write_candle_json(candles: DataFrame, path: str) -> None:
    """JSON lines of ``RECORD``; each line is a record of its own, so files split."""
    candles.select(
        "symbol", F.col("open_ms").alias("open_time"), F.col("close_ms").alias("close_time"),
        *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close", "volume")], F.lit("True").alias("is_closed"),
    ).write.json(path)


# -- Parquet --------------------------------------------------------------------


def write_candles(candles: DataFrame, path: str, timeframe: str) -> None:
    """Append to Parquet by symbol, timeframe, year and month, so that a scan of a range reads its months only."""
    at = F.timestamp_millis("open_ms")
    parts = candles.withColumns({"timeframe": F.lit(timeframe), "year": F.year(at), "month": F.month(at)})
    parts.write.mode("append").option("compression", "zstd").partitionBy("symbol", "timeframe", "year", "month").parquet(path)


def read_candles(spark: SparkSession, path: str, symbol: str | None = None, timeframe: str | None = None, start_ms: int | None = None, end_ms: int | None = None, newest: int | None = None) -> DataFrame:
    """A range of stored candles in ascending order, or the ``newest`` of it."""
    rows = spark.read.parquet(path)
    for c, v in (("symbol", symbol), ("timeframe", timeframe)):
        if v is not None:
            rows = rows.where(F.col(c) == v)
    month = lambda ms: F.lit(ms).cast("long")
    at = F.col("year") * 12 + F.col("month")
    if start_ms is not None:
        t = F.timestamp_millis(month(start_ms))
        rows = rows.where((F.col("open_ms") >= start_ms) & (at >= F.year(t) * 12 + F.month(t)))
    if end_ms is not None:
        t = F.timestamp_millis(month(end_ms))
        rows = rows.where((F.col("open_ms") < end_ms) & (at <= F.year(t) * 12 + F.month(t)))
    if newest is not None:
        rows = rows.orderBy(F.desc("open_ms")).limit(newest)
    return rows.orderBy("open_ms")


def upsert(stored: DataFrame, arrived: DataFrame, keys: list[str], version: str) -> DataFrame:
    """``stored`` with the rows of ``arrived``; of one key's rows that of the largest version stays."""
    both = stored.unionByName(arrived)
    last = Window.partitionBy(*keys).orderBy(F.desc(version))
    return both.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def get_or_create(dimension: DataFrame, names: DataFrame, name: str, number: str) -> DataFrame:
    """``dimension`` (number, name) with a row for each new name, numbered on from its largest number.

    A dimension is a small table; the new names alone are numbered.
    """
    new = names.select(name).where(F.col(name).isNotNull()).distinct().join(dimension.select(name), name, "left_anti")
    top = dimension.agg(F.coalesce(F.max(number), F.lit(0))).first()[0]
    numbered = new.withColumn(number, (F.row_number().over(Window.orderBy(name)) + top).cast("long"))
    return dimension.select(number, name).unionByName(numbered.select(number, name))


# -- exports ----------------------------------------------------------------------


def export_trades(trades: DataFrame, path: str, kind: str = "csv") -> int:
    """Write trades with a net R as CSV or JSON lines, with the legacy alias column; returns how many had none."""
    rows = trades.withColumn("net_r_legacy", F.col("net_r"))
    kept = rows.where("net_r is not null")
    kept.write.option("header", True).csv(path) if kind == "csv" else kept.write.json(path)
    return rows.where("net_r is null").count()


def split_symbol(symbol: str) -> tuple[Column, Column]:
    """(base, quote) of a symbol that ends with one of QUOTES; else the whole symbol and null."""
    pattern = f"^(.+)({'|'.join(QUOTES)})$"
    base, quote = (F.regexp_extract(symbol, pattern, k) for k in (1, 2))
    return F.when(quote != "", base).otherwise(F.col(symbol)), F.when(quote != "", quote)


# -- queries ------------------------------------------------------------------------


def candle_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "candle-json")
    write_candle_json(FRAMES["candles_1h"][0](spark, sf_dir), path)
    return read_candle_json(spark, path).select("symbol", "open_ms", "close", "volume")


def candle_store_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "candle-store")
    for tf in ("1h", "4h"):
        write_candles(FRAMES[f"candles_{tf}"][0](spark, sf_dir), path, tf)
    rows = read_candles(spark, path, timeframe="4h", start_ms=1704412800000, end_ms=1706140800000)
    return rows.select("symbol", "open_ms", "open", "high", "low", "close", "volume", F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"))


def trade_export_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "trades")
    trades = FRAMES["ledger"][0](spark, sf_dir).select("run_id", "trade_key", "line", "part_key", "supp_key", "net_u", "net_r")
    export_trades(trades, path)
    return spark.read.option("header", True).schema("run_id string, trade_key long, line long, part_key long, supp_key long, net_u long, net_r double, net_r_legacy double").csv(path)


def instrument_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = FRAMES["ticks"][0](spark, sf_dir)
    known = spark.createDataFrame([(1, "CLICK"), (2, "VIEW")], "number long, symbol string")
    base, quote = split_symbol("pair")
    return get_or_create(known, ticks, "symbol", "number").withColumn("pair", F.concat("symbol", F.lit("USDT"))).select("number", "symbol", base.alias("base"), quote.alias("quote"))


QUERIES = {
    "candle_json_round_trip": candle_json_round_trip, "candle_store_range": candle_store_range,
    "trade_export_round_trip": trade_export_round_trip, "instrument_dimension": instrument_dimension,
}
ORACLES = {
    "candle_json_round_trip": f"WITH ticks AS ({TICKS_SQL}), c AS ({candles_sql(3_600_000)}) SELECT symbol, open_ms, close, volume FROM c",
    "candle_store_range": f"""WITH ticks AS ({TICKS_SQL}), c AS ({candles_sql(14_400_000)})
SELECT symbol, open_ms, open, high, low, close, volume, CAST(year(make_timestamp(open_ms * 1000)) AS BIGINT) AS year, CAST(month(make_timestamp(open_ms * 1000)) AS BIGINT) AS month
FROM c WHERE open_ms >= 1704412800000 AND open_ms < 1706140800000""",
    "trade_export_round_trip": f"WITH ledger AS ({LEDGER_SQL}) SELECT run_id, trade_key, line, part_key, supp_key, net_u, net_r, net_r AS net_r_legacy FROM ledger WHERE net_r IS NOT NULL",
    "instrument_dimension": f"""WITH ticks AS ({TICKS_SQL}), known(number, symbol) AS (VALUES (1::BIGINT, 'CLICK'), (2::BIGINT, 'VIEW')),
new AS (SELECT DISTINCT symbol FROM ticks WHERE symbol NOT IN ('CLICK', 'VIEW')),
dim AS (SELECT * FROM known UNION ALL SELECT row_number() OVER (ORDER BY symbol) + 2 AS number, symbol FROM new)
SELECT number, symbol, symbol AS base, 'USDT' AS quote FROM dim""",
}
