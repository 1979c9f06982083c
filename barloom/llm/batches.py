"""The size of the batches in which whole texts reach Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Spark's own default, and bytes of a batch of texts.
DEFAULT, BYTES = "67108864b", "4194304b"
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's own default, and rows that a Parquet scan holds at once: texts and sets of shingles take 10 KB and more each.
ROWS_DEFAULT, ROWS = "4096", "512"
_SCAN = "spark.sql.parquet.columnarReaderBatchSize"


def small_batches(spark: SparkSession) -> None:
    """At Spark's default a batch of texts and its copies take hundreds of MB of a worker. A setting of the user's stays."""
    if spark.conf.get(_SETTING, DEFAULT) == DEFAULT:
        spark.conf.set(_SETTING, BYTES)
    if spark.conf.get(_SCAN, ROWS_DEFAULT) == ROWS_DEFAULT:
        spark.conf.set(_SCAN, ROWS)
