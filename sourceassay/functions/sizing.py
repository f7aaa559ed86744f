"""Bounded work on hot groups."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourceassay.session import ensure_checkpoint_dir

def spread(df: DataFrame) -> DataFrame:
    """Fill the cluster when the input has fewer splits than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Cuts the lineage like a checkpoint, which computes its rows twice: once to count them, once to write them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nth_smallest(df: DataFrame, group: str, order: str, n: int, salts: int = 32) -> DataFrame:
    """Per group the row at rank ``n`` by a unique ``order`` column; none if there are fewer.

    Ranks are taken inside salted sub-groups first, so a group that holds a third
    of all rows is cut to ``salts * n`` rows before it meets in one task.
    """
    salt = F.pmod(F.xxhash64(order), F.lit(salts))
    part = W.partitionBy(group, "salt").orderBy(order)
    whole = W.partitionBy(group).orderBy(order)
    return (
        df.select(group, order)
        .withColumn("salt", salt)
        .withColumn("rank", F.row_number().over(part))
        .where(F.col("rank") <= n)
        .withColumn("rank", F.row_number().over(whole))
        .where(F.col("rank") == n)
        .select(group, order)
    )


def number_rows(df: DataFrame, group: str, order: list[str | Column], name: str) -> DataFrame:
    """``row_number() OVER (PARTITION BY group ORDER BY order)`` without one task per group.

    The rows are range-partitioned and sorted by (group, order) and written to the
    checkpoint folder, which fixes both their place and their order.  A row's
    number is then its offset in its partition plus what earlier partitions hold
    of the same group; only one small row per (group, partition) is aggregated.
    """
    ensure_checkpoint_dir(df.sparkSession)
    keys = [F.col(group), *[F.col(o) if isinstance(o, str) else o for o in order]]
    # The bounds of the ranges are sampled in a pass of their own, over rows that are there already.
    placed = written(df, "numbered").repartitionByRange(*keys).sortWithinPartitions(*keys).checkpoint()
    placed = placed.withColumn("__at", F.monotonically_increasing_id()).withColumn(
        "__part", F.shiftright("__at", 33)
    )
    before = W.partitionBy(group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(group, "__part")
        .agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
        .withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
        .drop("__rows")
    )
    return (
        placed.join(offsets, [group, "__part"])
        .withColumn(name, F.col("__at") - F.col("__first") + F.col("__before") + 1)
        .drop("__at", "__part", "__first", "__before")
    )
