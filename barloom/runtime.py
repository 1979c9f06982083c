"""Session helpers: the shared folder, tables that cut lineage, numbering that scales."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: list[str] = []

#: Bytes of a row group of a cut table: a task holds one whole, whether it writes or reads it.
ROW_GROUP = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a local master may go without the setting; it then gets a temporary
    folder which goes when Python ends.
    """
    if path := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="barloom-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    What follows reads the files, so a lost executor never repeats the work
    above, and values such as partition numbers stay as they were written.
    """
    return cut_at(df, tag)[0]


def cut_at(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def free_prefix(columns: list[str]) -> str:
    """Underscores with which no column begins, so that names made with it clash with none."""
    prefix = "__"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def prefix_sums(
    df: DataFrame,
    order: list[str],
    totals: dict[str, Column],
    keys: list[str] | None = None,
    tag: str = "prefix",
) -> DataFrame:
    """Exclusive running sums over a global order, without a global window.

    Rows are dealt by range of ``keys + order``; each partition's totals are
    summed over the few partition rows, and each row adds what precedes it in
    its own partition. ``totals`` maps new column names to the summed columns.
    With ``keys`` the sums restart at each key; a key that fills many partitions
    is still spread over them. Ties in the order share a partition and are taken
    in an arbitrary order that the written table then fixes. All columns are kept,
    whatever their names.
    """
    keys = keys or []
    own = free_prefix([*df.columns, *totals])
    pid, tie = f"{own}pid", f"{own}tie"
    dealt = (
        df.withColumns({f"{own}sum_{n}": c for n, c in totals.items()})
        .repartitionByRange(*[F.col(c) for c in keys + order])
        .withColumn(pid, F.spark_partition_id())
        .withColumn(tie, F.monotonically_increasing_id())
    )
    dealt = cut(dealt, tag)
    parts = dealt.groupBy(*keys, pid).agg(*[F.sum(f"{own}sum_{n}").alias(f"{own}part_{n}") for n in totals])
    before = Window.partitionBy(*keys).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *[F.col(k).alias(f"{own}k{i}") for i, k in enumerate(keys)],
        F.col(pid).alias(f"{own}p"),
        *[F.coalesce(F.sum(f"{own}part_{n}").over(before), F.lit(0)).alias(f"{own}base_{n}") for n in totals],
    )
    within = Window.partitionBy(pid, *keys).orderBy(*order, tie).rowsBetween(Window.unboundedPreceding, -1)
    on = F.col(pid) == F.col(f"{own}p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"{own}k{i}"))
    local = dealt.withColumns({f"{own}own_{n}": F.coalesce(F.sum(f"{own}sum_{n}").over(within), F.lit(0)) for n in totals})
    return local.join(parts, on).select(
        *df.columns, *[(F.col(f"{own}own_{n}") + F.col(f"{own}base_{n}")).alias(n) for n in totals]
    )
