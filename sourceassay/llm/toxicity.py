"""Operator 2, toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The features of a text are the distinct hashes of its words, of its pairs of neighbours and of its pairs with one word
skipped; every word of the text counts.  Rates are per coordinate; the L1 term leaves most
weights at zero, so the model is a short list of (feature, weight) that is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceassay.llm.store import free_name, tidy
from sourceassay.llm.training import labelled_sample, remainder
from sourceassay.llm.words import ALNUM, WordHashes, mix, word_list

#: Bits of a feature's number, and the most labelled rows to learn from.
BITS, TRAIN_ROWS = 20, 12_000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 5.0, 1.0, 6.0, 0.1
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: The feature that every text has.
BIAS = 0


def features(hashes: np.ndarray) -> np.ndarray:
    """Feature numbers of a text's word hashes, in no order and with repeats."""
    parts = [mix(hashes), mix(hashes[:-1] * _PAIR + hashes[1:]), mix(hashes[:-2] * _SKIP + hashes[2:])]
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


class Ftrl:
    """State of the learner: per coordinate the adjusted gradient sum and the sum of squared gradients."""

    def __init__(self):
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = _sigmoid(w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _train(batches):
    """One bounded sample, several passes in a fixed order; yields the weights that are not zero."""
    hashes, rows = WordHashes(), []
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            at = np.unique(np.append(features(hashes.of(word_list(text, ALNUM))), BIAS)).astype(np.int32)
            rows.append((at, label))
    model = Ftrl()
    for _ in range(EPOCHS):
        for at, label in rows:
            model.learn(at, label)
    w = model.weights(slice(None))
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at], pa.float64())], names=["feature", "weight"])


def train(docs: DataFrame, labels: DataFrame, may_learn=None, most_rows: int = TRAIN_ROWS) -> dict[int, float]:
    """Weights learned from ``labels.toxic`` of the ids that ``may_learn`` accepts (all by default).

    Learns on a bounded sample, at most ``most_rows`` rows, in one task.  At most 2**BITS weights come back.
    Without any labelled row there are none.
    """
    sample = labelled_sample(docs, labels, "toxic", F.lit(True) if may_learn is None else may_learn, most_rows)
    return {r.feature: r.weight for r in sample.mapInArrow(_train, "feature long, weight double").collect()}


def _scorer(model, at: int, name: str):
    def run(batches):
        hashes, weights = WordHashes(), np.zeros(1 << BITS)
        for k, w in model.value.items():
            weights[k] = w
        for batch in batches:
            scores = []
            for text in batch.column(at).to_pylist():
                found = features(hashes.of(word_list(text, ALNUM)))
                found = np.unique(np.append(found[weights[found] != 0], BIAS))
                scores.append(_sigmoid(weights[found].sum()) if model.value else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])
    return tidy(run)


def score(docs: DataFrame, weights: dict[int, float]) -> tuple[DataFrame, str]:
    """``docs`` with all columns and the probability of being toxic; and that column's name (``toxicity`` or the next free one).

    Null and empty texts have the score of a text without words.  Without weights all scores are 0.
    """
    name = free_name(docs, "toxicity")
    model = docs.sparkSession.sparkContext.broadcast(weights)  # at most 2**BITS numbers
    schema = docs.withColumn(name, F.lit(0.0)).schema
    schema[name].nullable = True
    return docs.mapInArrow(_scorer(model, docs.columns.index("text"), name), schema), name


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder("doc_id", 5) != 0)
    found, name = score(docs, weights)
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), F.col(name).alias("score"),
                        (F.col(name) >= 0.5).cast("int").alias("predicted"))
