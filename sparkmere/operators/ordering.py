"""Orders that results depend on: null placement, physical order, and the emission order of joins."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a scan delivers at a time; the emission order of joins is defined by it.
BATCH = 64


def key(column: Column, descending: bool) -> Column:
    """Nulls last when ascending, first when descending."""
    return column.desc_nulls_first() if descending else column.asc_nulls_last()


def ordered(df: DataFrame, keys: Sequence[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Sorted and cut. With a limit Spark keeps limit+offset rows a task and merges them, without a full sort."""
    out = df.orderBy(*keys) if keys else df
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def emission_order(left_row: Column, right_row: Column) -> list[Column]:
    """Keys that give joined rows the order of a nested loop over batches: left batch, matched before unmatched, right
    batch, left row, right row."""
    part = lambda c: F.floor(c / BATCH)
    return [part(left_row).asc(), right_row.isNull().cast("int").asc(), part(right_row).asc_nulls_last(), left_row.asc(), right_row.asc_nulls_last()]


#: Bytes, as the optimizer estimates them, that one task of a numbering sorts.
RANGE_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it. On one machine one of our own will do."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="sparkmere-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def dense_rows(df: DataFrame, order: str, name: str, start: int = 0) -> DataFrame:
    """df with numbers start, start+1, .. in the order of a column, replacing `name`; ties in the order of a hash of the row.

    A range exchange and a count for each partition; no window over one partition, and the driver sees one row a partition.
    Partitions grow in number with the input.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = size // RANGE_BYTES + 1 if size < 1 << 60 else int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [order, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
    placed = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__part__", F.spark_partition_id()).withColumn("__at__", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = placed.checkpoint(eager=True)
    base, total = [], start
    for p, n in sorted(tuple(r) for r in placed.groupBy("__part__").count().collect()):
        base.append((p, total))
        total += n
    offsets = spark.createDataFrame(base, "__part__ int, __base__ long")
    return placed.join(F.broadcast(offsets), "__part__").withColumn(name, F.col("__base__") + F.col("__at__")).drop("__part__", "__at__", "__base__")
