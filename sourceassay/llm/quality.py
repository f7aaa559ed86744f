"""Operator 3, quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded; beside the learned embedding each byte carries whether the bytes before it
repeat what stood a word or a line earlier.  Learned filters slide over the bytes in steps; their responses are
max-pooled and averaged inside overlapping chunks that cover the whole text, and the chunks' mean is combined into one probability.

Learning is back-propagation with Adam over a bounded sample; the network (some 10,000 numbers) is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceassay.llm.store import free_name, slices, tidy
from sourceassay.llm.training import labelled_sample, remainder

#: Bytes a filter moves at once, steps it covers, learned channels of a byte, filters, steps of a chunk and between two chunks' starts.
STEP, TAPS, DEPTH, FILTERS, CHUNK, HOP = 4, 3, 6, 24, 128, 96
#: Distances in bytes at which a repetition is looked for, and how many bytes have to agree.
LAGS, AGREE = range(3, 40), 3
CHANNELS = DEPTH + 1
#: Most labelled rows to learn from, least passes and steps, rows of a step, rate; bytes scored at once (plus one text).
TRAIN_ROWS, EPOCHS, STEPS, BATCH, RATE = 3_000, 3, 600, 16, 0.01
BLOCK_BYTES = 1 << 18


class Network:
    """Weights by name, all float32."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        draw = np.random.default_rng(seed)
        width = STEP * CHANNELS
        return cls({
            "embed": draw.normal(0, 0.5, (256, DEPTH)).astype(np.float32),
            "filter": draw.normal(0, 1 / np.sqrt(width * TAPS), (width, TAPS * FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": np.zeros(2 * FILTERS, np.float32),
            "prior": np.zeros(1, np.float32),
        })


class Block:
    """Texts laid out one after the other: bytes, repetition channel, and where the steps, chunks and texts lie."""

    def __init__(self, texts: list[bytes]):
        # A text starts at a step and is followed by zeros, so that neither a filter nor a repetition sees two texts.
        real = np.array([max(1, -(-len(t) // STEP)) for t in texts], np.int64)
        steps = real + max(TAPS - 1, -(-(LAGS[-1] + AGREE) // STEP))
        self.begin = np.cumsum(steps) - steps
        self.size = int(steps.sum())
        data = bytearray(self.size * STEP)
        for at, t in zip((self.begin * STEP).tolist(), texts):
            data[at : at + len(t)] = t
        self.data = np.frombuffer(bytes(data), np.uint8)
        again = np.zeros(len(self.data), bool)
        for lag in LAGS:
            same = (self.data[lag:] == self.data[:-lag]) & (self.data[lag:] != 0x20) & (self.data[lag:] != 0)
            run = same[: len(same) - AGREE + 1].copy() if len(same) >= AGREE else np.zeros(0, bool)
            for k in range(1, AGREE):
                run &= same[k : len(same) - AGREE + 1 + k]
            again[lag + AGREE - 1 : lag + AGREE - 1 + len(run)] |= run
        self.again = again
        # Chunks of a text: every HOP steps, at least one; a filter starts at each step of the text.
        chunks = np.maximum(1, -(-np.maximum(real - CHUNK, 0) // HOP) + 1)
        self.owner = np.repeat(np.arange(len(texts)), chunks)
        number = np.arange(len(self.owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        self.first = self.begin[self.owner] + number * HOP
        self.last = np.minimum(self.first + CHUNK, self.begin[self.owner] + real[self.owner])
        self.chunks = chunks.astype(np.float32)


def _responses(net: Network, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Input of the steps and response of each filter at each step (rectified)."""
    x = np.empty((len(block.data), CHANNELS), np.float32)
    x[:, :DEPTH] = net.w["embed"][block.data]
    x[:, DEPTH] = block.again
    x = x.reshape(block.size, STEP * CHANNELS)
    taps = (x @ net.w["filter"]).reshape(block.size, TAPS, FILTERS)
    out = taps[:, 0] + net.w["bias"]
    for k in range(1, TAPS):
        out[: block.size - k] += taps[k:, k]
    return x, np.maximum(out, 0, out=out)


def _pool(block: Block, response: np.ndarray) -> np.ndarray:
    """Mean over a text's chunks of the filters' greatest and mean response in a chunk."""
    edges = np.stack((block.first, block.last), axis=1).ravel()
    padded = np.concatenate((response, np.zeros((1, response.shape[1]), np.float32)))
    high = np.maximum.reduceat(padded, edges, axis=0)[::2]
    mean = np.add.reduceat(padded, edges, axis=0)[::2] / (block.last - block.first)[:, None]
    return np.concatenate((high, mean), axis=1)


def _by_text(block: Block, pooled: np.ndarray) -> np.ndarray:
    starts = np.r_[0, np.cumsum(block.chunks[:-1])].astype(np.int64)
    return np.add.reduceat(pooled, starts, axis=0) / block.chunks[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    block = Block(texts)
    _, response = _responses(net, block)
    return _sigmoid(_by_text(block, _pool(block, response)) @ net.w["out"] + net.w["prior"][0])


def gradients(net: Network, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss."""
    block = Block(texts)
    x, response = _responses(net, block)
    pooled = _pool(block, response)
    by_text = _by_text(block, pooled)
    error = ((_sigmoid(by_text @ net.w["out"] + net.w["prior"][0]) - labels) / len(texts)).astype(np.float32)
    grad = {"out": by_text.T @ error, "prior": np.array([error.sum()], np.float32)}
    # Down to the chunks, the steps at which a filter was greatest, and all steps for the mean.
    down = (error / block.chunks)[block.owner][:, None] * net.w["out"]
    back = np.zeros_like(response)
    each = np.arange(FILTERS)
    for c, (a, b) in enumerate(zip(block.first.tolist(), block.last.tolist())):
        part = response[a:b]
        back[a:b] += down[c, FILTERS:] / (b - a)
        back[a + part.argmax(axis=0), each] += down[c, :FILTERS]
    back *= response > 0
    taps = np.zeros((block.size, TAPS, FILTERS), np.float32)
    for k in range(TAPS):
        taps[k:, k] = back[: block.size - k]
    taps = taps.reshape(block.size, TAPS * FILTERS)
    grad["bias"] = back.sum(axis=0)
    grad["filter"] = x.T @ taps
    deep = (taps @ net.w["filter"].T).reshape(len(block.data), CHANNELS)[:, :DEPTH]
    grad["embed"] = np.stack([np.bincount(block.data, deep[:, d], 256) for d in range(DEPTH)], axis=1).astype(np.float32)
    return grad


def learn(rows: list[tuple[bytes, int]], seed: int = 7) -> Network:
    """Adam over the rows in a fixed random order."""
    net, draw = Network.fresh(seed), np.random.default_rng(seed)
    labels = np.array([y for _, y in rows], np.float32)
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    net.w["prior"][0] = np.log(share / (1 - share))
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    per_epoch = -(-len(rows) // BATCH)
    epochs = max(EPOCHS, -(-STEPS // per_epoch))
    step, steps = 0, epochs * per_epoch
    for _ in range(epochs):
        order = draw.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            chosen = order[at : at + BATCH]
            grad = gradients(net, [rows[k][0] for k in chosen], labels[chosen])
            step += 1
            rate = RATE * (1 - (step - 1) / steps)
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    return net


def _train(batches):
    rows = []
    for batch in batches:
        rows += [(t.encode("utf-8", "surrogatepass"), y) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
    weights = learn(rows).w if rows else {}
    yield pa.RecordBatch.from_arrays([pa.array(list(weights)), pa.array([w.ravel().tolist() for w in weights.values()], pa.list_(pa.float32()))],
                                     names=["name", "numbers"])


def train(docs: DataFrame, labels: DataFrame, may_learn=None, most_rows: int = TRAIN_ROWS) -> Network | None:
    """The network learned from ``labels.quality`` of the ids that ``may_learn`` accepts (all by default).

    Learns on a bounded sample, at most ``most_rows`` rows, in one task.  None without any labelled row.
    """
    sample = labelled_sample(docs, labels, "quality", F.lit(True) if may_learn is None else may_learn, most_rows)
    found = {r.name: np.array(r.numbers, np.float32) for r in sample.mapInArrow(_train, "name string, numbers array<float>").collect()}
    return Network({k: found[k].reshape(v.shape) for k, v in Network.fresh().w.items()}) if found else None


def _scorer(model, at: int, name: str):
    def run(batches):
        net = model.value
        for batch in (part for b in batches for part in slices(b, at, BLOCK_BYTES)):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(at).to_pylist()]
            scores = probabilities(net, texts) if net else np.ones(len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])
    return tidy(run)


def score(docs: DataFrame, net: Network | None) -> tuple[DataFrame, str]:
    """``docs`` with all columns and the probability of good quality; and that column's name (``quality`` or the next free one).

    Null and empty texts have the score of a text without bytes.  Without a network all scores are 1, so that nothing is rejected.
    """
    name = free_name(docs, "quality")
    model = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of weights
    schema = docs.withColumn(name, F.lit(0.0)).schema
    schema[name].nullable = True
    return docs.mapInArrow(_scorer(model, docs.columns.index("text"), name), schema), name


def may_learn():
    return remainder("doc_id", 4) != 2


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, as the query predicts them."""
    found, name = score(docs, train(docs, labels, may_learn()))
    return found.where(F.col(name) >= least).drop(name)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found, name = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), may_learn()))
    return found.select("doc_id", (~may_learn()).alias("held_out"), F.col(name).alias("score"),
                        (F.col(name) >= 0.7).cast("int").alias("predicted"))
