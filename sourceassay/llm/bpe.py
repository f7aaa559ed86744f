"""Operator 5, byte-level BPE: overlapping chunk encoding and decoding.

Texts are cut into chunks that overlap; the chunks are pre-tokenised in parallel.  The pattern looks at nothing before
a match, so two pre-tokenisations that share one boundary agree from there on: each chunk is stitched to
the one before it at the first boundary both have inside the overlap.  The pieces between such boundaries are
encoded on their own and a text's ids are the pieces' ids in order.  Chunks that do not resynchronise within the
overlap are joined and encoded as one piece, so the ids are always those of the whole text.

A text of at most one chunk is a piece already and stays in its task; only longer ones are spread over the cluster.
Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceassay.llm.store import free_name, settle, slices, tidy

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Code points of a chunk without and of its overlap with the next.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Bytes of text and ids that a task holds as Python objects at once (plus one text).
TEXT_BYTES, IDS = 2 << 20, 1 << 18


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def boundaries(text: str, pattern: str) -> np.ndarray:
    """Ends of the pre-tokens of ``text``."""
    return np.fromiter((m.end() for m in regex.finditer(pattern, text)), np.int64)


def _edges(pattern: str, chunk: int, overlap: int):
    """Boundaries of a chunk inside its first and its last ``overlap`` code points, counted from the text's start."""
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            texts, numbers = batch.column(at("text")).to_pylist(), batch.column(at("k")).to_pylist()
            heads, tails = [], []
            for text, k in zip(texts, numbers):
                # A match that touches the chunk's end may be longer in the whole text.
                ends = boundaries(text, pattern)
                ends = ends[ends < len(text)] + k * chunk
                heads.append(ends[ends <= k * chunk + overlap])
                tails.append(ends[ends > (k + 1) * chunk])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))],
                names=[*batch.schema.names, "head", "tail"])
    return tidy(run)


def _bytes(bpe: tiktoken.Encoding, ids: pa.ListArray) -> pa.Array:
    """The tokens' raw bytes, concatenated."""
    return pa.array([bpe.decode_bytes(x) if x else b"" for x in ids.to_pylist()], pa.binary())


def _encode(path: str, pattern: str, column: int, decoded: bool = False):
    """Replace the texts by their ids; ``decoded`` adds the bytes that the ids stand for."""
    def run(batches):
        bpe = encoding(path, pattern)
        for batch in batches:
            for part in slices(batch, column, TEXT_BYTES):
                ids = [np.array(bpe.encode_ordinary(text) if text else [], np.int32) for text in part.column(column).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)])
                columns = part.columns
                columns[column] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                names = part.schema.names
                if decoded:
                    columns, names = [*columns, _bytes(bpe, columns[column])], [*names, "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
    return tidy(run)


def _pieces(long_texts: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """``row, piece, text``: the texts cut where neighbouring chunks agree."""
    count = F.ceil(F.length("text") / chunk).cast("int")
    chunks = (long_texts.select("row", "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("k"))
              .select("row", "k", F.substring("text", F.col("k") * chunk + 1, F.lit(chunk + overlap)).alias("text"))
              .repartition("row", "k"))
    edges = chunks.mapInArrow(_edges(pattern, chunk, overlap), "row long, k int, text string, head array<long>, tail array<long>")
    order = W.partitionBy("row").orderBy("k")
    # A text's first chunk starts at a boundary; another one starts where it agrees with the chunk before it, if it does.
    shared = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    cut = edges.withColumn("sync", F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(shared)).drop("head", "tail")
    cut = (cut.withColumn("begin", F.coalesce("sync", F.col("k") * chunk))
           .withColumn("end", F.coalesce(F.lead("begin").over(order), F.lit((1 << 31) - 1)))
           .withColumn("piece", F.count("sync").over(order)))
    part = F.substring(F.col("text"), (F.col("begin") - F.col("k") * chunk + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int"))
    return (cut.groupBy("row", "piece").agg(F.array_sort(F.collect_list(F.struct("k", part.alias("part")))).alias("parts"))
            .select("row", "piece", F.array_join(F.col("parts.part"), "").alias("text")))


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN,
           chunk: int = CHUNK, overlap: int = OVERLAP, decoded: str | None = None) -> tuple[DataFrame, str]:
    """``docs`` with all columns but ``text`` and an array of ids, and that array's name (``ids`` or the next free one).

    Ids are those of the whole text, each match of the pattern by itself, without special tokens.
    Null and empty texts have no ids.  Repeated rows give repeated results; an empty table gives no rows.
    ``path`` must be readable on every executor.  ``decoded`` names a further column for the bytes decoded from the ids
    in the same pass.
    """
    if overlap >= chunk:
        raise ValueError("the overlap must be shorter than a chunk")
    name = free_name(docs, "ids")
    size = F.coalesce(F.length("text"), F.lit(0))
    keep = [f"`{c}`" for c in docs.columns if c != "text"]
    at = len(keep)
    short = docs.where(size <= chunk).select(*keep, F.col("text").alias(name))
    schema = short.schema
    schema.fields[at].dataType = T.ArrayType(T.IntegerType())
    if decoded:
        schema = T.StructType([*schema.fields, T.StructField(decoded, T.BinaryType())])
    short = short.mapInArrow(_encode(path, pattern, at, bool(decoded)), schema)

    row = free_name(docs, "row")
    long_ = settle(docs.where(size > chunk).withColumn(row, F.monotonically_increasing_id()), "long-texts")
    pieces = _pieces(long_.select(F.col(row).alias("row"), "text"), pattern, chunk, overlap)
    schema = pieces.schema
    schema.fields[2].dataType = T.ArrayType(T.IntegerType())
    coded = pieces.repartition("row", "piece").mapInArrow(_encode(path, pattern, 2), schema)
    whole = (coded.groupBy(F.col("row").alias(row)).agg(F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("pieces"))
             .select(row, F.flatten(F.col("pieces.text")).alias(name)))
    long_ = long_.join(whole, row).select(*keep, name, *([F.col(name).alias(decoded)] if decoded else []))
    return short.unionByName(decode(long_, decoded, path, pattern) if decoded else long_), name


def _decode(path: str, pattern: str, column: int):
    def run(batches):
        bpe = encoding(path, pattern)
        for batch in batches:
            for part in slices(batch, column, IDS):
                columns = part.columns
                columns[column] = _bytes(bpe, part.column(column))
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)
    return tidy(run)


def decode(coded: DataFrame, ids: str = "ids", path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``coded`` with the column of ids replaced by the bytes they stand for (none for null)."""
    at = coded.columns.index(ids)
    schema = coded.select("*").schema
    schema.fields[at].dataType = T.BinaryType()
    return coded.mapInArrow(_decode(path, pattern, at), schema)


def round_trip(docs: DataFrame) -> DataFrame:
    """Token counts and digests of the ids and of the bytes decoded from them, for each row of ``doc_id, text``."""
    coded, ids = encode(docs.select("doc_id", "text"), decoded="decoded")
    return coded.select("doc_id", F.size(ids).cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op5(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
