"""Candles kept up to date from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.runtime import fresh_path
from barloom.sources.frames import TICKS_SQL, candles_sql, epoch_ms, price

STATE = "open_tick long, open decimal(18,2), high decimal(18,2), low decimal(18,2), close_tick long, close decimal(18,2), volume long, trade_count long"


def partial_candles(events: DataFrame, timeframe: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Windowed candles of a stream of events; a window closes when the watermark has passed it."""
    ticks = events.select(
        F.upper("event_type").alias("symbol"), F.timestamp_millis(epoch_ms("ts")).alias("ts"), F.col("event_id").alias("tick_id"),
        price("value").alias("price"), F.get_json_object("props", "$.k").cast("long").alias("qty"),
    )
    return (
        ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", timeframe).alias("w"))
        .agg(
            F.min("tick_id").alias("open_tick"), F.min_by("price", "tick_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max("tick_id").alias("close_tick"), F.max_by("price", "tick_id").alias("close"), F.sum("qty").alias("volume"), F.count("*").alias("trade_count"),
        )
        .select("symbol", F.unix_millis("w.start").alias("open_ms"), "open_tick", "open", "high", "low", "close_tick", "close", "volume", "trade_count")
    )


def stream_to_table(events: DataFrame, path: str, timeframe: str = "1 hour") -> None:
    """Run over all there is; each batch's changed candles are appended under its number, so a repeated batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batches/batch={number:09d}")

    query = partial_candles(events, timeframe).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last version of each candle."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/batches")
    last = rows.groupBy("symbol", "open_ms").agg(F.max_by(F.struct("open", "high", "low", "close", "volume", "trade_count"), "batch").alias("x"))
    return last.select("symbol", "open_ms", "x.*")


def streamed_candles_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "candle-stream")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream_to_table(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parque[t]"), path)
    return latest(spark, path)


QUERIES = {"streamed_candles_1h": streamed_candles_1h}
ORACLES = {
    "streamed_candles_1h": f"""WITH ticks AS ({TICKS_SQL}), c AS ({candles_sql(3_600_000)})
SELECT symbol, open_ms, open, high, low, close, volume, trade_count FROM c"""
}
