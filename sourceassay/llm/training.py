"""The labelled rows that a classifier learns from, shared by operators 2 and 3."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str | Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % by


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, may_learn, most_rows: int) -> DataFrame:
    """``text, label`` of at most ``most_rows`` labelled rows (those of the lowest id hash), in one partition in a fixed order.

    Only ids that ``may_learn`` accepts take part; null labels don't.  An id labelled several times counts once, with its
    highest label.  The ids are chosen before any text is read, so texts of the sample alone are moved.
    """
    spread = F.xxhash64("doc_id", F.lit(label))
    chosen = (labels.where(may_learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
              .withColumn("spread", spread).orderBy("spread", "doc_id").limit(most_rows))
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            .join(F.broadcast(chosen), "doc_id")  # at most `most_rows` ids
            .repartition(1).sortWithinPartitions("spread", "doc_id", F.xxhash64("text")).select("text", "label"))
