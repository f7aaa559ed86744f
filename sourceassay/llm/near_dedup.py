"""Operator 6, MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

A text's set of word shingles is hashed once; each of 255 bins keeps its smallest hash, and an empty bin borrows from
a bin that its own sequence of hashes leads to.  51 bands of 5 bins make the buckets: at a similarity of 0.8 a
pair shares none with probability 2e-9.  Texts with equal sets are one node from the start.

In each bucket every node is compared with the bucket's smallest one only, so candidates grow with the rows of the buckets, not with their squares.
Candidates are confirmed on the full sets.  What stars alone would miss is settled afterwards: only buckets whose other nodes
still belong to different components are looked at again, block by block inside the tasks, and only confirmed links leave them.
So no link between different components is lost and nothing is capped.

Components come from alternating large and small stars over written tables; nothing is collected.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceassay.llm.store import free_name, settle, slices, tidy
from sourceassay.llm.words import NON_SPACE, mix, shingle_set, word_hashes

BINS, ROWS = 255, 5
BANDS = BINS // ROWS
#: Words of a shingle; least similarity as a share of 100.
WIDTH, LEAST = 2, 80
#: Nodes of a block when a bucket is looked at again.
BLOCK = 512
#: Bytes of texts, signatures or sets that a task holds as Python objects at once (plus one row).
SLICE_BYTES = 4 << 20
#: Bytes up to which a written table is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 16 << 20

_BIN = np.arange(BINS, dtype=np.uint64)


def _donors(attempt: int) -> np.ndarray:
    """The bin from which each empty bin borrows at an attempt."""
    return (mix(_BIN * np.uint64(1000003) + np.uint64(7919 * attempt + 1)) % np.uint64(BINS)).astype(np.int64)


_DONORS = [_donors(a) for a in range(64)]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Densified one-permutation MinHash of a sorted, non-empty set of hashes."""
    bins = (((shingles >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    low = np.zeros(BINS, np.uint64)
    full = np.zeros(BINS, bool)
    low[bins[first]] = shingles[first]
    full[bins[first]] = True
    out, empty, attempt = low.copy(), np.flatnonzero(~full), 0
    while len(empty):
        if attempt == len(_DONORS):
            _DONORS.append(_donors(attempt))
        donor = _DONORS[attempt][empty]
        out[empty[full[donor]]] = low[donor[full[donor]]]
        empty, attempt = empty[~full[donor]], attempt + 1
    return mix(out)


def bands(sig: np.ndarray) -> np.ndarray:
    """One bucket key for each band."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in sig.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def likely(agree: np.ndarray, size: np.ndarray | int, least: int) -> np.ndarray:
    """Whether a share of agreeing bins is within six standard deviations of the least similarity (``size``: the smaller set)."""
    p = least / 100
    return agree >= p - 6 * np.sqrt(p * (1 - p) / np.minimum(size, BINS))


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signed(width: int, at: int):
    def run(batches):
        for batch in (part for b in batches for part in slices(b, at, SLICE_BYTES)):
            size, digest, keys = [], [], []
            for text in batch.column(at).to_pylist():
                s = shingle_set(word_hashes(text, NON_SPACE), width)
                size.append(len(s))
                digest.append(_digest(s))
                keys.append(bands(signature(s)) if len(s) else None)
            columns = [c for k, c in enumerate(batch.columns) if k != at]
            names = [n for k, n in enumerate(batch.schema.names) if k != at]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=[*names, "size", "digest", "keys"])
    return tidy(run)


def _sets(width: int):
    """From ``doc_id, text``: digest, size, signature (16 bits a bin) and set."""
    def run(batches):
        for batch in (part for b in batches for part in slices(b, 1, SLICE_BYTES)):
            found = [shingle_set(word_hashes(t, NON_SPACE), width) for t in batch.column(1).to_pylist()]
            sigs = [signature(s).astype(np.uint16).tobytes() if len(s) else b"" for s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([_digest(s) for s in found], pa.binary()), pa.array([len(s) for s in found], pa.int64()),
                 pa.array(sigs, pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())],
                names=["doc_id", "digest", "size", "sig", "members"])
    return tidy(run)


def _likely_pairs(least: int):
    """Keep the pairs (a, b, size_a, sig_a, size_b, sig_b) that the signatures and sizes allow."""
    def run(batches):
        for batch in (part for b in batches for part in slices(b, 3, SLICE_BYTES)):
            a, b, na, sa, nb, sb = (c.to_pylist() for c in batch.columns)
            keep = []
            for k in range(len(a)):
                small, large = min(na[k], nb[k]), max(na[k], nb[k])
                agree = np.mean(np.frombuffer(sa[k], np.uint16) == np.frombuffer(sb[k], np.uint16))
                if 100 * small >= least * large and likely(agree, small, least):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
    return tidy(run)


def _linked(x: int, y: int, common, least: int):
    return 100 * common >= least * (x + y - common)


def _confirmed(least: int):
    """Keep the pairs (a, b, set_a, set_b) whose full sets are similar enough."""
    def run(batches):
        for batch in (part for b in batches for part in slices(b, 2, SLICE_BYTES)):
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if _linked(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), least):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
    return tidy(run)


def _sides(table: pa.Table):
    """The two blocks of a group, ``rest`` against ``other`` (the same block twice if there is one side only)."""
    rest = [k for k, s in enumerate(table.column("side").to_pylist()) if s == 0]
    other = [k for k, s in enumerate(table.column("side").to_pylist()) if s == 1]
    return np.array(rest, np.int64), np.array(other or rest, np.int64)


class _Joined:
    """Disjoint sets of whatever is looked up."""

    def __init__(self):
        self.above: dict = {}

    def top(self, x):
        while self.above.setdefault(x, x) != x:
            self.above[x] = x = self.above[self.above[x]]
        return x

    def join(self, x, y) -> bool:
        """Whether ``x`` and ``y`` were apart."""
        x, y = self.top(x), self.top(y)
        self.above[x] = y
        return x != y


def _edges(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _block_likely(least: int):
    """Edges that hold together what the signatures of two blocks (node, component, size, sig) make likely between components."""
    def of(table: pa.Table) -> pa.Table:
        sigs = np.stack([np.frombuffer(s, np.uint16) for s in table.column("payload").to_pylist()])
        size, comp = np.array(table.column("size").to_pylist()), np.array(table.column("component").to_pylist())
        node = table.column("node").to_pylist()
        left, right = _sides(table)
        joined, found = _Joined(), []
        for x in left:
            y = right[comp[right] != comp[x]]
            small, large = np.minimum(size[y], size[x]), np.maximum(size[y], size[x])
            y, small = y[100 * small >= least * large], small[100 * small >= least * large]
            if len(y):
                ok = likely((sigs[y] == sigs[x]).mean(axis=1), small, least)
                found += [(node[x], node[k]) for k in y[ok] if joined.join(node[x], node[k])]
        return _edges(found)
    return of


def _block_links(least: int):
    """Links between different components of two blocks (node, component, size, set); a spanning set of them is enough."""
    def of(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(s, np.uint64) for s in table.column("payload").to_pylist()]
        node, size = table.column("node").to_pylist(), np.array(table.column("size").to_pylist())
        left, right = _sides(table)
        comp = table.column("component").to_pylist()
        joined, links = _Joined(), []
        owner = np.repeat(np.arange(len(right)), size[right])
        values = np.concatenate([sets[k] for k in right])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        for x in left:
            low, high = np.searchsorted(values, sets[x], "left"), np.searchsorted(values, sets[x], "right")
            count = high - low
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            common = np.bincount(owner[at], minlength=len(right))
            links += [(node[x], node[y]) for y in right[_linked(size[x], size[right], common, least)] if joined.join(comp[x], comp[y])]
        return _edges(links)
    return of


def _small(df: DataFrame, bytes_a_row: int) -> DataFrame:
    """Marked for broadcast if the written table ``df`` is known to be small."""
    return F.broadcast(df) if df.count() * bytes_a_row <= BROADCAST_BYTES else df


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of all nodes in ``links`` (a, b); by alternating large and small stars."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = settle(edges, "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        small = (small.select("a", F.col("low").alias("b")).unionByName(small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))).distinct())
        edges = settle(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now


def _blocks(members: DataFrame, payload: str) -> DataFrame:
    """Rows of buckets (key, node, component, size, payload) dealt to pairs of blocks.

    The largest component of a bucket needs no comparison with itself: its blocks meet the blocks of the
    rest only, and the rest's blocks meet each other.
    """
    by = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    tops = by.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.max("n").alias("n_top"))
    tops = (tops.where("n > n_top")  # more than one component
            .select("key", "top", F.ceil(F.col("n_top") / BLOCK).cast("int").alias("b_top"), F.ceil((F.col("n") - F.col("n_top")) / BLOCK).cast("int").alias("b_rest")))
    rows = members.join(tops, "key").withColumn("is_top", F.col("component") == F.col("top"))
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("is_top"), F.col("b_top")).otherwise(F.col("b_rest"))).cast("int")
    rows = rows.withColumn("mine", mine)
    rest = F.sequence(F.lit(0), F.col("b_rest") - 1)

    def place(x, y, side):
        return F.struct(x.alias("x"), y.alias("y"), F.lit(side).alias("side"))
    # y >= 0: a block of the rest; y < 0: block -1 - y of the largest component.
    as_top = F.transform(rest, lambda r: place(r, -1 - F.col("mine"), 1))
    as_left = F.concat(F.transform(F.filter(rest, lambda r: r >= F.col("mine")), lambda r: place(F.col("mine"), r, 0)),
                       F.transform(F.sequence(F.lit(0), F.col("b_top") - 1), lambda t: place(F.col("mine"), -1 - t, 0)))
    as_right = F.transform(F.filter(rest, lambda r: r < F.col("mine")), lambda r: place(r, F.col("mine"), 1))
    places = F.when(F.col("is_top"), as_top).otherwise(F.concat(as_left, as_right))
    return rows.select("key", "node", "component", "size", F.col(payload).alias("payload"), F.explode(places).alias("p")).select(
        "key", "p.x", "p.y", "p.side", "node", "component", "size", "payload")


def _links(docs: DataFrame, base: DataFrame, nodes: DataFrame, width: int, least: int) -> DataFrame:
    """``node, component`` of all linked nodes."""
    repeats = settle(nodes.where("row <> node").select("row"), "repeats")
    keyed = (base.where("size > 0").select("row", "keys").join(repeats, "row", "left_anti")
             .select(F.explode("keys").alias("key"), F.col("row").alias("node")))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("n")).where("n > 1")
    buckets = settle(buckets, "buckets")
    members = settle(keyed.join(_small(buckets, 32), "key"), "members").where("node <> center")
    stars = settle(members.select(F.col("center").alias("a"), F.col("node").alias("b")).distinct(), "stars")

    # The texts in question are read again, so that sets are only written for them.
    asked = stars.select(F.col("a").alias("row")).unionByName(stars.select(F.col("b").alias("row"))).distinct()
    asked = settle(base.select("row", "doc_id", "digest").join(asked, "row").select(F.col("row").alias("node"), "doc_id", F.col("digest").alias("its")), "asked")
    same = F.col("d.doc_id").eqNullSafe(F.col("i.doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.alias("d").join(_small(asked.select("doc_id").distinct(), 32).alias("i"), same, "left_semi")
    sets = texts.mapInArrow(_sets(width), "doc_id long, digest binary, size long, sig binary, members binary")
    same = (F.col("d.digest") == F.col("i.its")) & F.col("d.doc_id").eqNullSafe(F.col("i.doc_id"))
    sets = settle(sets.alias("d").join(_small(asked, 64).alias("i"), same).select("node", "size", "sig", "members"), "sets")
    if sets.count() > asked.count():  # repeated rows
        sets = settle(sets.dropDuplicates(["node"]), "sets")

    def side(name, *columns):
        return sets.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    pairs = stars.join(side("a", "size", "sig"), "a").join(side("b", "size", "sig"), "b").select("a", "b", "size_a", "sig_a", "size_b", "sig_b")
    pairs = settle(pairs.mapInArrow(_likely_pairs(least), "a long, b long"), "pairs")
    left = _small(pairs.select("a").distinct(), 16)
    right = _small(pairs.select("b").distinct(), 16)
    checked = (pairs.join(side("a", "members").join(left, "a", "left_semi"), "a")
               .join(side("b", "members").join(right, "b", "left_semi"), "b").select("a", "b", "members_a", "members_b"))
    links = settle(checked.mapInArrow(_confirmed(least), "a long, b long"), "links")
    found = settle(components(links), "components")

    # Buckets whose nodes besides the center are still apart.
    def apart(rows: DataFrame) -> DataFrame:
        labelled = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = labelled.groupBy("key").agg(F.min("component").alias("l"), F.max("component").alias("h")).where("l <> h").select("key")
        return labelled.join(_small(settle(mixed, "mixed"), 16), "key", "left_semi")

    open_ = settle(apart(members.select("key", "node")), "open")
    if open_.isEmpty():
        return found
    blocks = _blocks(open_.join(sets.select("node", "size", "sig"), "node"), "sig")
    likely_ = blocks.groupBy("key", "x", "y").applyInArrow(_block_likely(least), "a long, b long").distinct()
    likely_ = settle(likely_, "likely")
    if likely_.isEmpty():
        return found
    # A node may be likely in many buckets; its set is moved for its family alone.
    family = components(likely_).withColumnRenamed("component", "key")
    rows = family.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    blocks = _blocks(rows.join(sets.select("node", "size", "members"), "node"), "members")
    more = blocks.groupBy("key", "x", "y").applyInArrow(_block_links(least), "a long, b long").distinct()
    return components(links.unionByName(more))


def near_groups(docs: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``, ``mark`` (md5 of the text) and ``row`` (unique).

    Texts are linked when ``100 * intersection >= least * union`` of their shingle sets.  Null, empty and wordless texts have no
    shingles and are linked with nothing; a text of fewer words than a shingle is one shingle.  ``component_id`` is the
    smallest doc_id of the component (null if all are null); exactly one row of a component is kept: that of the smallest
    doc_id, of repeated ones the first as stored.  An empty table gives no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("mark"), "text")
    base = base.mapInArrow(_signed(width, 2), "doc_id long, mark string, size long, digest binary, keys array<long>")
    base = settle(base.withColumn("row", F.monotonically_increasing_id()), "signed")
    some = base.where("size > 0").select("row", "digest")
    nodes = settle(some.join(some.groupBy("digest").agg(F.min("row").alias("node")), "digest").select("row", "node"), "nodes")
    found = _links(docs, base, nodes, width, least)
    label = nodes.join(found, "node", "left").select("row", F.coalesce("component", "node").alias("component"))
    rows = (base.select("row", "doc_id", "mark", "size").join(label, "row", "left")
            .withColumn("component", F.coalesce("component", "row")))
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best"))
    return rows.join(best, "component").select("doc_id", F.col("size").alias("n_shingles"), F.col("best.doc_id").alias("component_id"),
                                               (F.col("best.row") == F.col("row")).alias("kept"), "mark", "row")


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; defined as in ``near_groups``.

    Texts without shingles all stay, repeated or not.  Of rows that repeat id and text, if they have shingles, one stays.
    """
    found = settle(near_groups(docs, width, least).select("doc_id", "mark", "kept"), "near-groups")
    kept, gone = (found.where(test).select("doc_id", "mark").distinct() for test in ("kept", "not kept"))
    def same(left: str, right: str, mark: Column) -> Column:
        return F.col(f"{left}.doc_id").cast("long").eqNullSafe(F.col(f"{right}.doc_id")) & (mark == F.col(f"{right}.mark"))
    def rows(keys: DataFrame, how: str) -> DataFrame:
        return docs.alias("d").join(_small(keys, 64).alias("g"), same("d", "g", F.md5(F.coalesce("d.text", F.lit("")))), how)
    staying = rows(settle(gone, "gone"), "left_anti")
    # Rows with equal id and text, one kept and others gone, can't be told apart: one of them stays.  No other row is touched.
    repeats = settle(gone.alias("g").join(kept.alias("k"), same("g", "k", F.col("g.mark")), "left_semi"), "repeats")
    if repeats.isEmpty():
        return staying
    mark = free_name(docs, "mark")
    one = rows(repeats, "left_semi").withColumn(mark, F.md5("text")).dropDuplicates(["doc_id", mark]).drop(mark)
    return staying.unionByName(one)


def op6(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")


OP6_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
      ELSE list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) END) AS g FROM t),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
both_ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON r = x)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, t.doc_id = m.c AS kept
FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) m USING (doc_id)
"""
