"""Operator 10, sharding: a histogram sort, in DataFrame functions only.

Rows are ordered by the key (hash of the text, doc_id, hash of the other columns), so equal texts lie
side by side.  Candidate key boundaries are probed: one aggregation counts the exact bytes and rows
below each of them over all partitions; probes are then refined around the wanted splitters only,
a byte of the key at a time, until every splitter meets the tolerance.  The rows are
exchanged once, straight to their place.

Law ``bytes``: shards are consecutive key ranges of nearly equal size; a row's size is the UTF-8 length of its text plus 16.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourceassay.llm.store import free_name, settle

#: Bytes of text that one task orders at most (plus one row); shards are cut into such ranges.
RANGE_BYTES = 8 << 30
_KEYS = ("k0", "k1", "k2")
_WIDTH = 64 * len(_KEYS)
_LOWEST = -(1 << 63)


def _prefix(depth: int) -> Column:
    """The first ``depth`` bits of the key (64 are one column) as an array of longs."""
    full, part = divmod(depth, 64)
    parts = [F.col(k) for k in _KEYS[:full]]
    if part:
        parts.append(F.shiftright(F.col(_KEYS[full]), 64 - part))
    return F.array(*parts)


def _as_key(prefix: tuple[int, ...], depth: int) -> tuple[int, ...]:
    """The lowest key that starts with ``prefix``."""
    full, part = divmod(depth, 64)
    key = list(prefix[:full])
    if part:
        key.append(prefix[full] << (64 - part))
    return tuple(key + [_LOWEST] * (len(_KEYS) - len(key)))


def splitters(slim: DataFrame, parts: int, tolerance: float) -> tuple[list[tuple[int, ...]], int]:
    """Keys that cut ``slim`` (k0, k1, k2, size) into ``parts`` ranges of nearly equal bytes, and all bytes.

    Each round refines the ranges that hold a splitter by 8 bits.  A range is done when its bytes are
    within ``tolerance`` of a part, when it is one row, or when the key has no more bits;
    the nearer of its ends is then the splitter.  The driver holds at most 256 counts for each splitter.
    """
    total = slim.agg(F.sum("size")).first()[0] or 0
    if not total:
        return [], 0
    goal = total / parts
    #: open ranges: prefix -> (bytes before it, wanted positions inside it)
    active = {(): (0, [i * goal for i in range(1, parts)])}
    found: list[tuple[float, tuple[int, ...]]] = []
    depth = 0
    while active and depth < _WIDTH:
        step = min(8, _WIDTH - depth)
        rows = slim
        if depth:
            wanted = F.array(*[F.array(*[F.lit(x).cast("long") for x in p]) for p in active])
            rows = slim.where(F.array_contains(wanted, _prefix(depth)))
        counts = (rows.groupBy(_prefix(depth + step).alias("at"))
                  .agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect())
        inside: dict[tuple[int, ...], list] = {p: [] for p in active}
        for at, size, n in counts:
            inside[_parent(tuple(at), depth, step)].append((tuple(at), size, n))
        depth += step
        following = {}
        for prefix, (before, wanted_at) in active.items():
            todo = list(wanted_at)
            for at, size, n in sorted(inside[prefix]):
                here = [x for x in todo if x < before + size]
                todo = todo[len(here):]
                if here and (n == 1 or size <= tolerance * goal or depth >= _WIDTH):
                    for x in here:  # the nearer end; the upper one is the lowest key behind this range
                        upper = x - before > size / 2
                        found.append((x, _after(at, depth) if upper else _as_key(at, depth)))
                elif here:
                    following[at] = (before, here)
                before += size
        active = following
    return [k for _, k in sorted(found)], total


def _parent(at: tuple[int, ...], depth: int, step: int) -> tuple[int, ...]:
    full, part = divmod(depth, 64)
    if part:
        return (*at[:full], at[full] >> step)
    return at[:full]


def _after(prefix: tuple[int, ...], depth: int) -> tuple[int, ...]:
    """The lowest key above all that start with ``prefix``."""
    full, part = divmod(depth, 64)
    key = list(prefix)
    at = len(key) - 1
    high = (1 << (part if part else 64) - 1) - 1
    while key[at] == (high if at == len(prefix) - 1 else (1 << 63) - 1):
        key.pop()
        at -= 1
        if at < 0:  # nothing is above: beyond the highest key
            return tuple([(1 << 63) - 1] * len(_KEYS))
    key[at] += 1
    return _as_key(tuple(key), depth if at == len(prefix) - 1 else 64 * (at + 1))


def shard(docs: DataFrame, shards: int = 40, tolerance: float = 0.001, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All columns of ``docs`` and a struct (``placed``, or the next free name) of shard, slot, size and text_crc32.

    ``slot`` counts the rows of a shard from 0 without gaps, in key order.  A null text has
    size 16 and the checksum of no bytes; null ids are a key like any other (the lowest).
    Rows that repeat in every column can't be told apart and stay in one shard; equal texts with different ids
    are only parted where a splitter has to fall between them.  An empty table gives no rows.
    A shard's bytes differ from the mean by at most the tolerance and one row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    others = [F.col(f"`{c}`").cast("string") for c in docs.columns if c not in ("text", "doc_id")]
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("k0"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("k1"),
        F.xxhash64(*others).alias("k2") if others else F.lit(0).cast("long").alias("k2"))
    slim = settle(keyed.select(*_KEYS, "size"), "keys")
    ranges = shards * max(1, -(-(slim.agg(F.sum("size")).first()[0] or 0) // (shards * range_bytes)))
    keys, _ = splitters(slim, ranges, tolerance)
    per_shard = ranges // shards

    key = F.struct(*_KEYS)
    def literal(k):
        return F.struct(*[F.lit(x).cast("long").alias(c) for x, c in zip(k, _KEYS)])
    def place(low: int, high: int) -> Column:
        """Number of splitters at or below the key, by halving."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < literal(keys[mid]), place(low, mid)).otherwise(place(mid + 1, high))
    placed = keyed.withColumn("range", place(0, len(keys)).cast("int"))
    shard_of = F.floor(F.col("range") / per_shard).cast("int")

    # Rows before each range of the same shard: one small row for each range.
    in_range = (slim.withColumn("range", place(0, len(keys)).cast("int")).groupBy("range")
                .agg(F.count("*").alias("rows")).withColumn("shard", shard_of))
    before = W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = in_range.select("range", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    offsets = settle(offsets, "offsets")  # at most `ranges` rows
    order = W.partitionBy("range").orderBy(*_KEYS)
    name = free_name(docs, "placed")
    return (placed.withColumn("at", F.row_number().over(order) - 1)
            .join(F.broadcast(offsets), "range")
            .select(*[F.col("doc")[c].alias(c) for c in docs.columns],
                    F.struct("shard", (F.col("at") + F.col("offset")).alias("slot"), "size", "text_crc32").alias(name)))


def op10(spark, sf_dir: str) -> DataFrame:
    found = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "placed.size", "placed.text_crc32", F.lit("bytes").alias("law"),
                        "placed.shard", "placed.slot", F.lit(None).cast("int").alias("grown_shard"))
