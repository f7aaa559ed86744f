"""Written tables in the shared folder, and small helpers of the operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from sourceassay.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors see; a local session may get its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        ensure_checkpoint_dir(spark)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, survives lost executors, fixes values such as
    ``monotonically_increasing_id()`` and lets later passes read single columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sourceassay-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tidy(run: Callable) -> Callable:
    """``run`` over Arrow batches, after which the task's freed memory goes back to the system.

    Python workers are used again by later tasks and would keep it beside the executor's heap.
    """
    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # not this C library
            pass
    return tidied


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in consecutive parts that hold at most ``most`` bytes of text, or list elements, in ``column`` (plus one row)."""
    values = batch.column(column)
    length = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    before = np.cumsum(np.r_[0, length.fill_null(0).to_numpy(zero_copy_only=False)])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(before, before[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end
