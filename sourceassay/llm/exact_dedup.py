"""Operator 7, exact dedup: a heavy-hitter split.

Misra-Gries summaries of each partition find the digests that may be frequent; their counts are
verified exactly, the verified winners (a bounded table) are broadcast and settle their rows map-side.
All other digests use an ordinary shuffle, in which no group can be hot any more.

Texts are equal when they are identical after deleting every ASCII space character.  The row with
the most code points stays, then the smallest doc_id, then the first row as stored.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceassay.llm.store import settle, slices, tidy

#: Bytes of text that a task holds as Python objects at once (plus one text).
SLICE_BYTES = 4 << 20
_SPACES = b" \t\n\x0b\x0c\r"


def _digests(at: int):
    """Replace the binary column ``at`` by the SHA-256 of its bytes without spaces."""
    def run(batches):
        for batch in (part for b in batches for part in slices(b, at, SLICE_BYTES)):
            found = [hashlib.sha256(b.translate(None, _SPACES)).digest() for b in batch.column(at).to_pylist()]
            columns = batch.columns
            columns[at] = pa.array(found, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
    return tidy(run)


def merge_counts(counts: Counter, k: int) -> Counter:
    """A Misra-Gries summary of at most ``k`` counters out of a larger one."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return Counter({x: c - cut for x, c in counts.items() if c > cut})


def _summaries(k: int):
    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            counts.update(batch.column(0).to_pylist())
            counts = merge_counts(counts, k)
        if counts:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["digest", "low"])
    return run


def _digested(docs: DataFrame, carry: bool) -> DataFrame:
    """``doc_id, size, digest, row`` of each row, with the row itself in ``doc`` if asked; written, so ``row`` is fixed."""
    text = F.coalesce("text", F.lit(""))
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if carry else []
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("size"),
                       text.cast("binary").alias("digest"), *whole)
    return settle(base.mapInArrow(_digests(2), base.schema).withColumn("row", F.monotonically_increasing_id()), "digests")


def _groups(base: DataFrame, counters: int) -> DataFrame:
    best = F.min(F.struct((-F.col("size")).alias("size"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    low = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("low", T.LongType())])
    frequent = (base.select("digest").mapInArrow(_summaries(counters), low)
                .groupBy("digest").agg(F.sum("low").alias("low")).orderBy(F.desc("low"), "digest").limit(counters))
    rows = base.count()
    winners = (base.join(F.broadcast(frequent.select("digest")), "digest")  # at most `counters` rows
               .groupBy("digest").agg(F.count("*").alias("group_size"), best.alias("best"))
               .where(F.col("group_size") * counters > 2 * rows))
    winners = F.broadcast(settle(winners, "frequent"))  # at most `counters` / 2 rows

    group = W.partitionBy("digest")
    hot = base.join(winners, "digest")
    rest = (base.join(winners, "digest", "left_anti")
            .withColumn("group_size", F.count("*").over(group)).withColumn("best", best.over(group)))
    out = ["doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
           (F.col("best.row") == F.col("row")).alias("kept"), "digest", "row"]
    return hot.select(*out).unionByName(rest.select(*out))


def exact_groups(docs: DataFrame, counters: int = 512) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, digest`` and ``row`` (unique).

    Null texts count as empty; all empty texts form one group.  A null doc_id loses ties.
    Rows repeated as a whole are one group too, and exactly one of them is kept.  An empty
    table gives no rows.  Only ``doc_id`` and ``text`` are read.

    ``counters`` is the size of a summary.  A digest with more than 2 * rows / counters rows is
    always found, so no group of the shuffled rest is larger than that.
    """
    return _groups(_digested(docs, carry=False), counters)


def drop_exact_duplicates(docs: DataFrame, counters: int = 512) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; defined as in ``exact_groups``."""
    base = _digested(docs, carry=True)
    dropped = settle(_groups(base.drop("doc"), counters).where(~F.col("kept")).select("row"), "dropped")
    return base.join(dropped, "row", "left_anti").select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def op7(spark, sf_dir: str) -> DataFrame:
    found = exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP7_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(x) DESC, doc_id) AS keep_id,
      count(*) OVER (PARTITION BY n) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM k
"""
