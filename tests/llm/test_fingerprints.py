"""Operator 13 against sketches, neighbours and edits computed in Python."""

import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from sourceassay.llm import fingerprints


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashes(text, width=5):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    out = set()
    for k in range(len(h) - width + 1 if len(h) >= width else min(len(h), 1)):
        seed = 42
        for x in h[k:k + width]:
            seed = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed)
        out.add(signed(seed))
    return out


def like(a, b, k=fingerprints.K):
    both = sorted(set(a) | set(b))[:k]
    return sum(x in a and x in b for x in both) / len(both) if both else 1.0


def brute(rows, k=fingerprints.K):
    """Rows of one id are ordered by length and hash of their text."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), len(r[1] or ""), signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42))))
    for at, (i, text) in enumerate(order):
        text, following = text or "", order[(at + 1) % len(order)][1] or ""
        changed = text[:len(text) - len(text) // 2] + following[:len(text) // 2]
        a, b, c = (sorted(hashes(t))[:k] for t in (text, changed, following))
        yield (str(i), len(text), hashlib.sha256(changed.encode()).hexdigest(), "".join(f"{x & (1 << 64) - 1:016x}" for x in a),
               "".join(f"{x & (1 << 64) - 1:016x}" for x in b), round(like(a, b), 9), round(like(a, c), 9))


def rows_of(draw):
    words = [f"w{k}" for k in range(50)] + ["É", "漢字", "A", "😀", "B\tc", "\n"]
    rows = [(draw.randrange(10**9), " ".join(draw.choices(words, k=draw.choice([0, 1, 4, 5, 6, 40, 300])))) for _ in range(60)]
    return rows + [(5, None), (6, ""), (7, " \n"), (8, "one"), (None, "no id"), (None, None), (9, "same row here now and then"), (9, "same row here now and then"),
                   (9, "same row here now and then"), (9, "same id"), (10, "x" * 100_000), (11, "long words " * 20_000), (-(1 << 63), "lowest")]


def test_op13_matches_brute_force(spark, tmp_path):
    rows = rows_of(random.Random(4))
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sketch string, n int").write.parquet(f"{tmp_path}/documents.parquet")
    found = fingerprints.op13(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = sorted((str(r[0]), *r[1:5], round(r[5], 9), round(r[6], 9)) for r in found.collect())
    assert got == sorted(brute(rows))


def test_one_row_and_none(spark):
    one = fingerprints.edited(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert [r.edited for r in one] == ["abab"]
    three = fingerprints.edited(spark.createDataFrame([(1, "abcd")] * 3, "doc_id long, text string")).collect()
    assert [r.edited for r in three] == ["abab"] * 3
    assert fingerprints.edited(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plan_is_native(spark):
    plan = fingerprints.op13(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_estimates_and_merging(spark):
    draw = random.Random(2)
    words = [f"w{k}" for k in range(5000)]
    a = " ".join(draw.choices(words, k=3000))
    b = a[:len(a) // 2] + " " + " ".join(draw.choices(words, k=1500))
    docs = spark.createDataFrame([(1, a, "p", "x"), (2, b, "p", "y"), (3, None, "q", "z"), (4, a, None, "x")], "doc_id long, text string, part string, fingerprint string")
    marked, name = fingerprints.fingerprints(docs)
    assert name == "fingerprint_" and marked.columns == [*docs.columns, name]
    by_id = {r.doc_id: r[name] for r in marked.collect()}
    assert by_id[1] == by_id[4] == sorted(hashes(a))[:fingerprints.K] and by_id[3] == []
    pair = marked.where("doc_id = 1").select(F.col(name).alias("a")).join(marked.where("doc_id = 2").select(F.col(name).alias("b")))
    r = pair.select(fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"),
                    fingerprints.distinct_shingles(F.col("a")).alias("n")).first()
    x, y = hashes(a), hashes(b)
    assert abs(r.r - len(x & y) / len(x | y)) < 0.13 and abs(r.c - len(x & y) / len(x)) < 0.2 and abs(r.n / len(x) - 1) < 0.3
    parts = {r.part: r.sketch for r in fingerprints.merge_sketches(marked, "part", name).collect()}
    assert parts == {"p": sorted(x | y)[:fingerprints.K], "q": [], None: by_id[1]}
