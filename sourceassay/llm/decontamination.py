"""Operator 1, benchmark decontamination: an FM-index per training shard.

A task reads its documents in shards of some megabytes.  The words of a shard become symbols of the
vocabulary of the searched phrases; a word outside it can't be part of an occurrence, so it only
separates.  Over the runs long enough to hold a phrase an FM-index is built; all phrases are searched backward
through wavelet ranks, occurrences are located by sampled suffix positions, and the spans of a document are merged.

Nothing is shuffled.  Phrases go out in blocks of bounded size; each block is one more pass over the rows inside the same stage.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceassay.llm.fm_index import FMIndex
from sourceassay.llm.store import free_name, slices, tidy
from sourceassay.llm.words import ALNUM, word_list

#: Bytes of phrases in one block (on the driver and in each task), and of text in one shard (plus one document).
BLOCK_BYTES, SHARD_BYTES = 4 << 20, 2 << 20
#: Words as in ``word_list``, as code points.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LEAK = "struct<n_words:long,items:array<string>,spans:array<struct<start:long,end:long>>>"


class Phrases:
    """Windows of ``width`` words of the items; an item of fewer words is one window."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            words = [ids.setdefault(w, len(ids) + 1) for w in word_list(text, ALNUM)]
            for k in range(max(1, len(words) - width + 1) if words else 0):
                owners[tuple(words[k : k + width])].add(item)
        self.vocabulary = ids
        self.by_length: list[tuple[np.ndarray, list[list[str]]]] = []
        for n in sorted({len(w) for w in owners}):
            windows = [w for w in owners if len(w) == n]
            self.by_length.append((np.array(windows, np.int64), [sorted(owners[w]) for w in windows]))
        self.shortest = min((w.shape[1] for w, _ in self.by_length), default=0)


class _Ids(dict):
    def __missing__(self, word):
        return 0


def _runs(symbols: np.ndarray, starts: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of at least ``shortest`` symbols without a 0 or a start of a document in between, each followed by a 0; and their places."""
    inside = symbols > 0
    edge = np.zeros(len(symbols) + 1, bool)
    edge[starts] = True
    begins = np.flatnonzero(inside & (edge[:-1] | ~np.r_[False, inside[:-1]]))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.r_[inside[1:], False])) + 1
    keep = ends - begins >= shortest
    begins, ends = begins[keep], ends[keep]
    size = ends - begins + 1
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begins, size)
    out = symbols[np.minimum(at, max(0, len(symbols) - 1))] if len(at) else np.zeros(0, symbols.dtype)
    out[np.cumsum(size) - 1] = 0
    return out, at


def search(texts: list[str | None], phrases: Phrases) -> list[tuple[int, set[str], list[tuple[int, int]]]]:
    """For each text its number of words, the items found and the merged spans of words."""
    ids = _Ids(phrases.vocabulary)
    counts, parts = [], []
    for text in texts:
        words = word_list(text, ALNUM)
        counts.append(len(words))
        parts.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
    symbols = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    ends = np.cumsum(counts)
    found: list = [(n, set(), []) for n in counts]
    if not phrases.by_length or not len(symbols):
        return found
    indexed, at = _runs(symbols, ends[:-1], phrases.shortest)
    if not len(indexed):
        return found
    index = FMIndex(indexed, len(phrases.vocabulary))
    spans = []
    for windows, owners in phrases.by_length:
        which, position = index.locate(*index.ranges(windows))
        begin = at[position]
        doc = np.searchsorted(ends, begin, side="right")
        spans.append(np.stack((begin, begin + windows.shape[1]), axis=1))
        for d, w in set(zip(doc.tolist(), which.tolist())):
            found[d][1].update(owners[w])
    spans = np.concatenate(spans)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    if len(spans):
        # Two occurrences of one document merge when they overlap or touch; documents never share a run.
        reach = np.maximum.accumulate(spans[:, 1])
        doc = np.searchsorted(ends, spans[:, 0], side="right")
        fresh = np.r_[True, (spans[1:, 0] > reach[:-1]) | (doc[1:] != doc[:-1])]
        last = np.r_[np.flatnonzero(fresh)[1:] - 1, len(spans) - 1]
        offset = np.r_[0, ends]
        for d, b, e in zip(doc[fresh].tolist(), spans[fresh, 0].tolist(), reach[last].tolist()):
            found[d][2].append((b - int(offset[d]), e - int(offset[d])))
    return found


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlaps or touching ends."""
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((b, e))
    return out


def _searcher(phrases, text_at: int, leak_at: int):
    kind = pa.struct([("n_words", pa.int64()), ("items", pa.list_(pa.string())),
                      ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches):
        for batch in (shard for b in batches for shard in slices(b, text_at, SHARD_BYTES)):
            leaks = search(batch.column(text_at).to_pylist(), phrases.value)
            rows = []
            for (n, items, spans), old in zip(leaks, batch.column(leak_at).to_pylist()):
                if old is not None:
                    items = items | set(old["items"])
                    spans = merge_spans(spans + [(s["start"], s["end"]) for s in old["spans"]])
                rows.append({"n_words": n, "items": sorted(items), "spans": [{"start": b, "end": e} for b, e in spans]})
            columns = batch.columns
            columns[leak_at] = pa.array(rows, kind)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
    return tidy(run)


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """``docs`` with all its columns and a struct of the words, the leaked items (sorted) and the merged word spans; and that struct's name.

    The struct is named ``leak`` or the next free name.  A null or empty text has no words, items or spans; null or
    wordless items are never found; a null item_id is the empty string.  Repeated rows give repeated results.
    Memory follows one block of phrases, one shard and the longest single text.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    name = free_name(docs, "leak")
    out = docs.withColumn(name, F.lit(None).cast(LEAK))
    for block in range(blocks):
        chosen = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        phrases = spark.sparkContext.broadcast(Phrases([tuple(r) for r in chosen.collect()], width))  # one bounded block
        out = out.mapInArrow(_searcher(phrases, docs.columns.index("text"), len(docs.columns)), out.schema)
    return out, name


def drop_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs."""
    found, leak = find_leaks(docs, benchmark, width)
    return found.where(F.size(F.col(leak)["spans"]) == 0).drop(leak)


def cut_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the words of ``spans`` and what stands between them."""
    if not text or not spans:
        return text
    words = [m.span() for m in WORD.finditer(text.translate({c: c + 32 for c in range(0x41, 0x5B)}))]
    out, at = [], 0
    for b, e in spans:
        out.append(text[at : words[b][0]])
        at = words[e - 1][1]
    return "".join([*out, text[at:]])


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found, leak = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leak = F.col(leak)
    hit = F.aggregate(leak["spans"], F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", leak["n_words"].alias("n_words"), hit.alias("n_hit"),
                        F.size(leak["items"]).cast("long").alias("n_items"),
                        F.sha2(F.array_join(leak["items"], ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (SELECT DISTINCT item_id, w[k:k + least(10, len(w)) - 1] AS g
            FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT len(g) AS n FROM windows),
grams AS (SELECT doc_id, k, w[k:k + n - 1] AS g, n
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, k, n, item_id FROM grams JOIN windows USING (g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
