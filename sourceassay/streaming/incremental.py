"""Change detection over files that keep arriving.

The batch functions of the index are stateless per file, so they run on a
streaming table as they are.  Each micro-batch is compared with the stored
hashes of its own files and then added to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sourceassay.operators import corpus

_STORED = "project string, path string, hash string, batch bigint"


def hashes(files: DataFrame) -> DataFrame:
    """Path and content hash of every readable candidate file."""
    ok, _ = corpus.decode_files(corpus.candidates(files))
    return corpus.index_columns(ok).select("project", F.col("path_relative").alias("path"), "hash")


def latest(spark: SparkSession, store: str, before: int) -> DataFrame:
    """Newest stored hash per file from the batches before ``before``."""
    rows = spark.read.schema(_STORED).parquet(store).where(F.col("batch") < before)
    return rows.groupBy("project", "path").agg(F.max_by("hash", "batch").alias("old_hash"))


def detect_changes(files: DataFrame, store: str, changes: str, checkpoint: str) -> StreamingQuery:
    """Write ``added`` / ``modified`` / ``unchanged`` per arriving file to ``changes``.

    A batch that is repeated after a failure overwrites its own partition in both
    tables, so the result does not depend on retries.
    """
    spark = files.sparkSession
    spark.createDataFrame([], _STORED).write.mode("append").partitionBy("batch").parquet(store)

    def run(batch: DataFrame, number: int) -> None:
        # the last copy of a file in the batch does not matter: equal paths, one hash kept
        current = batch.groupBy("project", "path").agg(F.max("hash").alias("hash"))
        status = (
            F.when(F.col("old_hash").isNull(), "added")
            .when(F.col("old_hash") != F.col("hash"), "modified")
            .otherwise("unchanged")
        )
        compared = current.join(latest(spark, store, number), ["project", "path"], "left").select(
            "project", "path", "hash", status.alias("status"), F.lit(number).alias("batch"))
        for rows, place in ((compared, changes),
                            (compared.where("status <> 'unchanged'").drop("status"), store)):
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                "batch").parquet(place)

    return (
        hashes(files).writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
