"""Contiguous shards of near-equal bytes (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.runtime import cut, free_prefix, prefix_sums

SHARDS = 8


def text_size(text: str = "text"):
    """UTF-8 bytes of a text plus 1; a null text has no bytes."""
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0)) + F.lit(1)


def shard_by_bytes(rows: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", size_col: str = "size") -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` added; all other columns are kept.

    The rows, in order of id, lie end to end on a line of ``sum(size)`` bytes;
    per-partition totals give the global prefix sums. The line is cut at
    ``shards`` equal targets, and a row goes to the shard that holds its middle
    byte, so a shard is one contiguous run of ids that misses its target by less
    than one row at either end. ``slot`` counts the rows of a shard from 0.

    Null ids come first; equal ids are taken in any one order. Null sizes count
    as 0. Very long rows may leave a shard without rows. An empty table gives an
    empty result. Input columns named shard or slot are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    rows = rows.drop("shard", "slot")
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0))
    own = free_prefix(rows.columns)
    before, row = f"{own}before", f"{own}row"
    placed = prefix_sums(rows, [id_col], {before: size, row: F.lit(1).cast("long")}, tag="shard")
    placed = cut(placed, "shard-prefix")
    total = max(1, placed.agg(F.sum(size)).first()[0] or 0)
    middle = (F.col(before) * 2 + size).cast("decimal(28,0)") * shards
    placed = placed.withColumn("shard", F.least(F.floor(middle / F.lit(2 * total).cast("decimal(20,0)")).cast("int"), F.lit(shards - 1)))
    first = placed.groupBy(F.col("shard").alias(f"{own}shard")).agg(F.min(row).alias(f"{own}first"))
    # A row for each shard at most.
    return placed.join(F.broadcast(first), F.col("shard") == F.col(f"{own}shard")).select(
        *rows.columns, "shard", (F.col(row) - F.col(f"{own}first")).alias("slot")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        text_size().alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    return shard_by_bytes(rows).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
