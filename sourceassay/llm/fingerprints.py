"""Operator 13, document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch holds the ``K`` smallest 64-bit hashes of a text's distinct word shingles (five words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower
case; of fewer words, but not none, the whole sequence).  The smallest ``K`` of two sketches together are the sketch of both texts
together, so sketches merge across the parts of a corpus in any order.  They estimate resemblance, containment and the number of distinct shingles;
a sketch of fewer than ``K`` hashes is the whole set and its answers are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourceassay.llm.store import free_name, settle

#: Hashes of a sketch: a resemblance of 1/3 is estimated with a standard error of 0.04.
K = 128
#: Words of a shingle.
WIDTH = 5
#: Sub-groups in which the hashes of one group are ranked first when sketches are merged.
SALTS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWEST = -(1 << 63)


def sketch(df: DataFrame, text: str, out: str, width: int = WIDTH, k: int = K) -> DataFrame:
    """``df`` with the sketch of the column ``text`` as ``out``, an ascending array of longs; empty for null texts and those without words."""
    words = F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    df = df.withColumn(out, F.transform(words, lambda w: F.xxhash64(w)))
    # The hash of an array goes through its elements, so runs of one length compare by their words in order.  The column
    # is named several times here, so the hashes of the words are made once and not for each shingle.
    h, n = F.col(out), F.size(out)
    shingles = F.when(n >= width, F.transform(F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, width))))
    shingles = shingles.when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(shingles)), 1, k))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two texts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of two texts, 0 to 1; two texts without shingles are alike."""
    both = merged(a, b, k)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    share = (F.element_at(a, -1).cast("double") - F.lit(float(_LOWEST))) / F.lit(float(1 << 64))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too, 0 to 1; a text without shingles is contained in any."""
    common = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as a string: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def merge_sketches(df: DataFrame, group: str, column: str, k: int = K) -> DataFrame:
    """One row per ``group`` with the sketch of all its texts together.

    Hashes are made distinct inside each task first and ranked in salted sub-groups, so a group that holds a third of all rows
    meets in one task only as ``SALTS * k`` hashes.  A group without shingles has an empty sketch; null is a group too.
    """
    # Only hashes of their own row's sketch can be among the smallest of the group.
    hashes = df.select(group, F.explode(column).alias("hash")).groupBy(group, "hash").agg(F.lit(0).alias("_"))
    salt = F.pmod(F.xxhash64("hash"), F.lit(SALTS))
    ranked = hashes.withColumn("salt", salt).withColumn("rank", F.row_number().over(W.partitionBy(group, "salt").orderBy("hash"))).where(F.col("rank") <= k)
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy("hash"))).where(F.col("rank") <= k)
    found = ranked.groupBy(group).agg(F.sort_array(F.collect_list("hash")).alias("sketch"))  # at most k each
    return (df.select(group).distinct().alias("l").join(found.alias("r"), F.col(f"l.{group}").eqNullSafe(F.col(f"r.{group}")), "left")
            .select(f"l.{group}", F.coalesce("sketch", F.array().cast("array<bigint>")).alias("sketch")))


_KEY = ["no_id", "id", "n", "h"]


def _neighbours(slim: DataFrame) -> DataFrame:
    """Who needs whose beginning: ``no_id, id, n, h`` of a text, those of one in front of it as ``to_*``, and how many rows that stands for.

    Texts are ranked by a range sort (ids from the largest down, null ids last) that is written once; a row's
    rank is its place in its partition plus what earlier partitions hold.  Of rows that repeat as a whole each is followed
    by the next of them, the last one by the next text; the last text is followed by the first.
    """
    order = [F.col("no_id"), F.col("id").desc(), F.col("n"), F.col("h")]
    placed = settle(slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("at", 33)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    parts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    ranked = (placed.withColumn("part", part).join(F.broadcast(parts), "part")
              .select(*_KEY, "copies", (F.col("at") - F.shiftleft("part", 33) + F.col("before")).alias("rank")))
    rows = placed.count()
    front = ranked.select(F.pmod(F.col("rank") + 1, F.lit(max(rows, 1))).alias("rank"), F.struct(*_KEY, F.lit(1).cast("long").alias("times")).alias("front"))
    itself = F.struct(*_KEY, (F.col("copies") - 1).alias("times"))
    return (ranked.join(front, "rank")
            .select(*_KEY, F.explode(F.filter(F.array("front", itself), lambda x: x["times"] > 0)).alias("to"))
            .select(*_KEY, *[F.col("to")[c].alias(f"to_{c}") for c in _KEY], F.col("to.times").alias("times")))


def edited(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """``doc_id, text, n_chars, edited, sketch, edited_sketch, next_sketch``: one row per row of ``docs``.

    ``edited`` is the text whose last floor(n_chars / 2) code points are replaced by the first as many, or all, of the next document, by descending doc_id;
    the first follows the last.  Rows with equal doc_ids follow each other in the order of their texts' lengths and hashes; null ids come last.
    A null text is empty.  Repeated rows count as rows of their own.  A single row is followed by itself; an empty table gives no rows.
    Only ``doc_id`` and ``text`` are read.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("id"),
                       F.length(text).cast("long").alias("n"), F.xxhash64(text).alias("h"), text.alias("text"))
    next_of = _neighbours(base.groupBy(*_KEY).agg(F.count("*").alias("copies")))
    # Rows that repeat as a whole meet as one before they move, so no key is hot.
    whole = base.groupBy(*_KEY).agg(F.first("text").alias("text"))
    given = sketch(whole, "text", "next_sketch", width, k).join(next_of, _KEY)
    given = given.select(*[F.col(f"to_{c}").alias(c) for c in _KEY], F.substring("text", F.lit(1), F.floor(F.col("to_n") / 2).cast("int")).alias("beginning"),
                         "next_sketch", "times")
    kept = F.substring("text", F.lit(1), (F.col("n") - F.floor(F.col("n") / 2)).cast("int"))
    pairs = whole.join(given, _KEY).withColumn("edited", F.concat(kept, F.col("beginning")))
    pairs = sketch(sketch(pairs, "text", "sketch", width, k), "edited", "edited_sketch", width, k)
    return pairs.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "text", F.col("n").alias("n_chars"), "edited", "sketch", "edited_sketch", "next_sketch",
                        F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy")).drop("copy")


def fingerprints(docs: DataFrame, width: int = WIDTH, k: int = K) -> tuple[DataFrame, str]:
    """All columns of ``docs`` and a sketch of ``text`` (``fingerprint``, or the next free name); returned with that name.

    Null and empty texts, and texts of white space, have an empty sketch; equal texts have equal sketches.  Rows stay where they are: nothing is shuffled.
    """
    name = free_name(docs, "fingerprint")
    return sketch(docs, "text", name, width, k), name


def op13(spark, sf_dir: str) -> DataFrame:
    found = edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
                        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
                        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
