"""Operator 11, filter interaction audit: truth-table survival words.

A document becomes a 32-bit word: bit ``S`` is set if the document survives the subset ``S`` of the five filters.
Positional popcounts of these words, by carry-save adders over whole arrays, give the survivors of all 32 subsets at once, per part
and label.  Everything the audit reports (what each filter removes in each order, overlaps, Shapley sums) follows from
those 32 numbers, so the documents are read once and never per order.

Filters: A: under 200 words.  B: 100 * distinct words < 50 * words.  C: 100 * ``[A-Z]`` > 3 * code points.  D: holds any of ``#$%&*|``.
E: a smaller doc_id anywhere in the table has the same text.
"""

from __future__ import annotations

import hashlib
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceassay.llm.store import settle, slices, tidy

FILTERS = "ABCDE"
_ALL = (1 << len(FILTERS)) - 1
#: Bytes of text that a task holds as Python objects at once (plus one text), of a text whose words are cut at once, and words
#: waiting for their popcount.
TEXT_BYTES, PIECE_BYTES, PENDING = 4 << 20, 1 << 20, 1 << 20
#: A text that more than one of so many rows hold is settled by a broadcast table, which has fewer rows than this.
HEAVY = 512

#: The word of each of the 32 sets of failed filters: bit S is set if S holds none of them.
SURVIVES = np.array([sum(1 << s for s in range(32) if not s & failed) for failed in range(32)], np.uint32)

_CAPITALS, _SIGNS = bytes(range(0x41, 0x5B)), b"#$%&*|"


def _words(data: bytes):
    """The words of a text, a piece after the other; pieces end at white space."""
    at = 0
    while at < len(data):
        end = at + PIECE_BYTES
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end].split()
        at = end


def failed_by_text(text: str) -> int:
    """The set of filters A to D that a text fails, as bits."""
    data = text.encode("utf-8", "surrogatepass")
    n, distinct = 0, set()
    for words in _words(data):
        n += len(words)
        distinct.update(words)
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    sign = len(data) != len(data.translate(None, _SIGNS))
    return (n < 200) | (100 * len(distinct) < 50 * n) << 1 | (100 * capitals > 3 * len(text)) << 2 | sign << 3


def _facts(batches):
    """``doc_id, part, text`` -> ``doc_id, part, digest, failed``."""
    for batch in (part for b in batches for part in slices(b, 2, TEXT_BYTES)):
        texts = batch.column(2).to_pylist()
        digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array([failed_by_text(t) for t in texts], pa.int32())],
            names=["doc_id", "part", "digest", "failed"])


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit ``words`` have each of the 32 bits set.

    A carry-save adder takes three words of one weight to a sum word of that weight and a carry word of twice the
    weight, for all bits and all triples at once.  Levels hold two words at most in the end; these are counted bit by bit.
    """
    counts, weight, level = np.zeros(32, np.int64), 1, words.astype(np.uint32)
    while len(level):
        carries = []
        while len(level) > 2:
            third = len(level) // 3
            a, b, c = level[:third], level[third:2 * third], level[2 * third:3 * third]
            either = a ^ b
            carries.append((a & b) | (either & c))
            level = np.concatenate([either ^ c, level[3 * third:]])
        counts += weight * ((level[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)).sum(axis=0, dtype=np.int64)
        level = np.concatenate(carries) if carries else level[:0]
        weight *= 2
    return counts


_SURVIVORS = "part string, label string, survivors array<long>"


def _survivors(batches):
    """Survivors of each subset per part and label, of the words seen so far whenever ``PENDING`` of them wait."""
    waiting: dict[tuple[str, str], list[np.ndarray]] = {}
    held = 0

    def counted():
        keys = sorted(waiting)
        counts = [positional_popcount(np.concatenate(waiting[k])).tolist() for k in keys]
        waiting.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in keys], pa.string()), pa.array([x for _, x in keys], pa.string()), pa.array(counts, pa.list_(pa.int64()))],
            names=["part", "label", "survivors"])

    for batch in batches:
        parts = batch.column(0).dictionary_encode()
        words = SURVIVES[batch.column(1).to_numpy()]
        place, order = parts.indices.to_numpy(), np.argsort(parts.indices.to_numpy(), kind="stable")
        cuts = np.searchsorted(place[order], np.arange(len(parts.dictionary) + 1))
        chosen = {"all": None, "good": batch.column(2).to_numpy(zero_copy_only=False), "toxic": batch.column(3).to_numpy(zero_copy_only=False)}
        for k, part in enumerate(parts.dictionary.to_pylist()):
            rows = order[cuts[k]:cuts[k + 1]]
            for label, mask in chosen.items():
                found = words[rows] if mask is None else words[rows[mask[rows]]]
                if len(found):
                    waiting.setdefault((part, label), []).append(found)
                    held += len(found)
        if held >= PENDING:
            yield counted()
            held = 0
    if waiting:
        yield counted()


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, part, failed, good, toxic``: one row per document, with the set of filters it fails as bits (A is 1, E is 16).

    A null text is empty, a null language the part ''.  A null doc_id is neither smaller nor larger than another, so such a row never fails E,
    has no label and makes nobody fail.  Rows with equal doc_ids don't fail because of each other.  Repeated rows all count.  An id that is
    labelled several times is good, or toxic, if one of its rows says so.  Only ``doc_id, text, lang`` and ``doc_id, quality, toxic`` are read.
    """
    base = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"),
                              F.coalesce("text", F.lit("")).alias("text"))
                  .mapInArrow(tidy(_facts), "doc_id long, part string, digest binary, failed int"), "facts")
    # Counted inside each task before the shuffle; only texts with several ids matter for E.
    first = (base.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("rows"))
             .where("first < last").select("digest", "first", "rows"))
    first = settle(first, "first-ids")
    heavy = F.broadcast(first.where(F.col("rows") * HEAVY > base.count()).drop("rows"))  # fewer than HEAVY rows
    light = first.join(heavy.select("digest"), "digest", "left_anti").drop("rows")
    hot = base.join(heavy, "digest")
    rest = base.join(heavy.select("digest"), "digest", "left_anti").join(light, "digest", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    masks = hot.unionByName(rest).select("doc_id", "part", (F.col("failed") + 16 * copy).alias("failed"))
    label = (labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")))
    # Rows without an id have no label and don't take part in the join, where they would be one key.
    with_id = masks.where("doc_id IS NOT NULL").join(label, "doc_id", "left")
    out = ["doc_id", "part", "failed", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")]
    without = masks.where("doc_id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    return with_id.select(*out).unionByName(without.select(*out))


def survivors(documents: DataFrame) -> DataFrame:
    """``part, total, good, toxic``: per part the survivors of all 32 subsets of filters, as arrays, of the rows of ``audited``."""
    counts = documents.select("part", "failed", "good", "toxic").mapInArrow(tidy(_survivors), _SURVIVORS)
    summed = (counts.select("part", "label", F.posexplode("survivors").alias("subset", "n"))
              .groupBy("part", "label", "subset").agg(F.sum("n").alias("n"))
              .groupBy("part", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("subset", "n"))), lambda x: x["n"]).alias("n")))  # 32 each
    none = F.array_repeat(F.lit(0).cast("long"), 32)
    def of(label):
        return F.coalesce(F.max(F.when(F.col("label") == label, F.col("n"))), none)
    return summed.groupBy("part").agg(of("all").alias("total"), of("good").alias("good"), of("toxic").alias("toxic"))


_AUDIT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def _audit(batches):
    """All orders and steps of each part, from its survivors."""
    orders = list(permutations(range(len(FILTERS))))
    before = np.array([[sum(1 << x for x in o[:k]) for k in range(len(o))] for o in orders]).ravel()
    own = np.array(orders).ravel()
    after = before | (1 << own)
    names = ["".join(FILTERS[x] for x in o) for o in orders for _ in o]
    steps = np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(orders))
    arrangements = np.array([factorial(k) * factorial(len(FILTERS) - 1 - k) for k in range(len(FILTERS))])
    for batch in batches:
        for part, total, good, toxic in zip(*(c.to_pylist() for c in batch.columns)):
            total, good, toxic = np.array(total), np.array(good), np.array(toxic)
            removed = total[before] - total[after]
            failing = total[0] - total[1 << own]
            shapley = np.array([sum(arrangements[s.bit_count()] * (total[s] - total[s | 1 << x]) for s in range(32) if not s >> x & 1)
                                for x in range(len(FILTERS))])
            columns = [total[after], removed, failing - removed, total[_ALL ^ (1 << own)] - total[_ALL],
                       good[before] - good[after], toxic[before] - toxic[after], shapley[own]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(names)), pa.array(names), pa.array(steps), *[pa.array(c, pa.int64()) for c in columns]],
                names=[f.split()[0] for f in _AUDIT.split(", ")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step; an empty table has no parts and gives no rows.  Odd rows: see ``audited``."""
    return survivors(audited(docs, labels)).select("part", "total", "good", "toxic").mapInArrow(_audit, _AUDIT)


def op11(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM t),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.part, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic,
      len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
      100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x) AS c, regexp_matches(x, '[#$%&*|]') AS d,
      coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY x), false) AS e
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
m AS (SELECT part, good, toxic, [a, b, c, d, e] AS fails, count(*) AS n FROM f GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) v(c, i)),
orders AS (SELECT p.c || q.c || r.c || s.c || u.c AS filter_order, [p.i, q.i, r.i, s.i, u.i] AS places
           FROM letters p, letters q, letters r, letters s, letters u
           WHERE len(list_distinct([p.i, q.i, r.i, s.i, u.i])) = 5),
steps AS (SELECT filter_order, step::INTEGER AS step, places[step] AS own, places[1:step - 1] AS earlier FROM orders, range(1, 6) k(step)),
g AS (SELECT m.*, filter_order, step, own, fails[own] AS fails_own, len(list_filter(earlier, lambda k: fails[k])) > 0 AS gone,
      len(list_filter(fails, lambda k: k)) AS failed FROM m, steps),
r AS (SELECT part, filter_order, step, own,
      sum(CASE WHEN NOT gone AND NOT fails_own THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails_own THEN n ELSE 0 END) AS removed,
      sum(CASE WHEN gone AND fails_own THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails_own AND failed = 1 THEN n ELSE 0 END) AS unique_fails,
      sum(CASE WHEN NOT gone AND fails_own AND good THEN n ELSE 0 END) AS good_lost,
      sum(CASE WHEN NOT gone AND fails_own AND toxic THEN n ELSE 0 END) AS toxic_lost
      FROM g GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
