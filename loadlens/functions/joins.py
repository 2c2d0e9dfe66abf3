"""Join helpers: a side is broadcast only after its size has been checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_LIMIT = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's own size estimate (file sizes carried through the plan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_side(df: DataFrame, measure: DataFrame | None = None,
               limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast when the estimate is below ``limit``; else leave the side to
    a shuffled join, which adaptive execution can split on hot keys.

    ``measure`` is the table that bounds the rows of ``df``: the estimate of a join
    multiplies both sides, so a dimension is measured before its lookups are joined.
    """
    size = estimated_bytes(df if measure is None else measure)
    return F.broadcast(df) if size <= limit else df


SPLIT_BYTES = 128 * 1024 * 1024
MIN_SPREAD_BYTES = 2 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Give every core rows of a small input.

    A file of one row group is read by one task however many cores there are.
    Inputs that fill the cores by themselves are left as they are: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = estimated_bytes(df)
    return df.repartition(cores) if MIN_SPREAD_BYTES <= size < cores * SPLIT_BYTES / 8 else df


def many_tasks(spark: SparkSession) -> int:
    """Tasks for a step whose rows multiply after the shuffle: small shares for every core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")),
               16 * spark.sparkContext.defaultParallelism)
