"""Candle streams of several timeframes side by side: one that fails is started again, the others run on."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barloom.plans.sql import with_tables
from barloom.runtime import fresh_path
from barloom.streaming.candles import latest, partial_candles

#: Timeframe -> Spark's interval, shortest first.
FRAMES_OF = {"5m": "5 minutes", "1h": "1 hour", "4h": "4 hours"}


@dataclass
class Streams:
    """A query for each timeframe, each with offsets, state and output of its own under ``path``.

    ``before`` is called with timeframe, batch and number before a batch is
    written; what it raises fails that timeframe's query alone.
    """

    spark: SparkSession
    path: str
    source: object
    before: object = None
    retries: int = 3
    failures: dict[str, list[str]] = field(default_factory=dict)

    def start(self, name: str) -> StreamingQuery:
        def put(batch: DataFrame, number: int) -> None:
            if self.before:
                self.before(name, batch, number)
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{self.path}/{name}/batches/batch={number:09d}")

        writer = partial_candles(self.source(), FRAMES_OF[name]).writeStream.outputMode("update").foreachBatch(put)
        return writer.queryName(f"candles_{name}").option("checkpointLocation", f"{self.path}/{name}/checkpoint").trigger(availableNow=True).start()

    def run(self, names: list[str]) -> dict[str, bool]:
        """Start all, then wait for each; a failed one starts again from its last batch up to ``retries`` times. True for those that took all there is."""
        running = {n: self.start(n) for n in names}
        done = {}
        for name, query in running.items():
            for tries in range(self.retries + 1):
                try:
                    query.awaitTermination()
                    done[name] = True
                    break
                except StreamingQueryException as failed:
                    self.failures.setdefault(name, []).append(str(failed))
                    done[name] = False
                    if tries < self.retries:
                        query = self.start(name)
        return done

    def candles(self, name: str) -> DataFrame:
        return latest(self.spark, f"{self.path}/{name}")


def streamed_candles_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles of every timeframe from one run of isolated streams."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parque[t]")
    streams = Streams(spark, fresh_path(spark, "timeframes"), source)
    done = streams.run(list(FRAMES_OF))
    if not all(done.values()):
        raise RuntimeError(f"streams failed: {streams.failures}")
    out = None
    for name in FRAMES_OF:
        rows = streams.candles(name).select(F.lit(name).alias("timeframe"), "symbol", "open_ms", "open", "high", "low", "close", "volume", "trade_count")
        out = rows if out is None else out.unionByName(rows)
    return out


QUERIES = {"streamed_candles_all": streamed_candles_all}
ORACLES = {
    "streamed_candles_all": with_tables(" UNION ALL ".join(f"SELECT '{n}' AS timeframe, symbol, open_ms, open, high, low, close, volume, trade_count FROM {{candles_{n}}}" for n in FRAMES_OF))
}
