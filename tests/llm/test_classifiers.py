"""Toxicity and quality: held-out accuracy, odd rows, exact gradients; and the pipeline against a brute-force version."""

import hashlib
import zlib

import numpy as np
import pytest

import corpus_pipeline
from sourceassay.llm import bpe, decontamination, quality, queries, toxicity, training
from tests.conftest import SMALL
from tests.llm.test_dedup import brute_components

LARGER = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "é " * 100_000), (5, "twice"), (5, "twice"), (None, "no id")]


@pytest.mark.parametrize("name, label, by, rest, least", [("op2_toxicity", "toxic", 5, 0, 0.93), ("op3_quality", "quality", 4, 2, 0.95)])
def test_held_out_accuracy(spark, name, label, by, rest, least):
    found = queries.QUERIES[name](spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % by == rest) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert np.mean([r.predicted == r[label] for r in held]) >= least


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id AS string)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    may = training.remainder("doc_id", 5) != 0
    assert toxicity.train(docs, labels, may) == toxicity.train(docs, turned, may)


@pytest.mark.parametrize("module, none", [(toxicity, 0.0), (quality, 1.0)])
def test_odd_rows(spark, docs, module, none):
    label = "toxic" if module is toxicity else "quality"
    labels = spark.createDataFrame([(2, 1), (4, 0), (5, None), (None, 1), (4, 1)], f"doc_id long, {label} int")
    name = "toxicity" if module is toxicity else "quality"
    table = docs(ODD).withColumnRenamed("lang", name.upper())
    model = module.train(table, labels)
    found, score = module.score(table, model)
    rows = found.collect()
    assert score == f"{name}_" and len(rows) == len(ODD) and all(0 <= r[score] <= 1 for r in rows)
    empty = {r[score] for r in rows if r.doc_id in (1, 2)}
    assert len(empty) == 1
    untaught, score = module.score(table, module.train(table, labels.where("false")))
    assert {r[score] for r in untaught.collect()} == {none}
    assert module.score(docs([]), model)[0].count() == 0


def test_gradients():
    texts = [b"abc abc abc abc", b"", "some other text é".encode() * 40]
    labels = np.array([1, 0, 1], np.float32)
    net = quality.Network.fresh()
    net.w["out"] += np.linspace(-1, 1, len(net.w["out"]), dtype=np.float32)
    grad = quality.gradients(net, texts, labels)

    def loss():
        p = np.clip(quality.probabilities(net, texts).astype(np.float64), 1e-9, 1 - 1e-9)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))
    draw = np.random.default_rng(0)
    for name, w in net.w.items():
        flat, g = w.reshape(-1), grad[name].reshape(-1)
        for k in set(draw.integers(0, len(flat), 6).tolist()) | {int(np.abs(g).argmax())}:
            old, step = flat[k], 1e-3
            flat[k] = old + step
            up = loss()
            flat[k] = old - step
            down = loss()
            flat[k] = old
            assert abs((up - down) / (2 * step) - g[k]) < 0.03 * max(1, abs(g[k])), (name, k)


def test_score_covers_the_whole_text():
    net = quality.Network.fresh()
    net.w["out"][:] = 1
    same = b"plain text " * 20_000
    assert quality.probabilities(net, [same])[0] != quality.probabilities(net, [same[:-400] + b"#%&! " * 80])[0]
    # Texts scored together or alone have the same score.
    texts = [b"a", b"", same[:5000], b"zz top"]
    alone = [quality.probabilities(net, [t])[0] for t in texts]
    assert np.allclose(quality.probabilities(net, texts), alone, atol=1e-6)


def test_ftrl_is_sparse():
    model, draw = toxicity.Ftrl(), np.random.default_rng(4)
    for _ in range(400):
        label = int(draw.integers(0, 2))
        model.learn(np.unique(np.append(draw.integers(100, 5000, 30), [toxicity.BIAS, 7] if label else [toxicity.BIAS])), label)
    w = model.weights(slice(None))
    assert w[7] > 0.5 and np.count_nonzero(w[100:5000]) < 500


def test_pipeline_matches_brute_force(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    found, name = quality.score(table, quality.train(table, labels, quality.may_learn()))
    rows = sorted((r.doc_id, r.text or "") for r in found.collect() if r[name] >= 0.7)
    seen = {}
    for i, t in rows:
        n = t.encode().translate(None, b" \t\n\x0b\x0c\r")
        seen[n] = min(seen.get(n, (1, 0)), (-len(t), i))
    rows = [(i, t) for i, t in rows if seen[t.encode().translate(None, b" \t\n\x0b\x0c\r")][1] == i]
    near = brute_components(rows, 5)
    rows = [(i, t) for i, t in rows if near[i][1] == i]
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    windows = set()
    for r in items:
        w = decontamination.WORD.findall((r.text or "").lower())
        windows |= {tuple(w[k:k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}

    def leaks(t):
        w = decontamination.WORD.findall(t.translate({c: c + 32 for c in range(65, 91)}))
        return any(tuple(w[k:k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    encoder = bpe.encoding(bpe.VOCABULARY, bpe.public_tokenizers.PATTERN)
    want = {i: hashlib.sha256(",".join(map(str, encoder.encode_ordinary(t))).encode()).hexdigest() for i, t in rows if not leaks(t)}
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SMALL).collect()} == want
    assert len(want) < table.count()


def test_pipeline_stages_keep_odd_rows(spark, tmp_path, docs):
    rows = [(10, "A clean text of a few words stays here."), (11, None), (12, ""), (13, "word " * 50_000), (13, "word " * 50_000), (None, "Another text without an id.")]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["10", "11", "13", "None"]
