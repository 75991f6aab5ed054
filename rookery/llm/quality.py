"""Quality classifier: logistic regression on hashed word n-grams.

Learned with follow-the-regularised-leader updates on a bounded sample of
labelled rows in one task; scored over all documents as sparse dot products, one
batch at a time.  The model has a fixed size, ``2 ** BITS`` weights, whatever the
input, and is what executors receive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import slices, utf8
from rookery.llm.labelled import SAMPLE_ROWS, WordHashes, held_out, labelled_sample

#: Weights: 2 to this power.
BITS = 18
#: Follow-the-regularised-leader: learning rate, its offset, L1 and L2.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
#: Times the sample is gone over.
EPOCHS = 3
#: Score from which label 1 is predicted.
THRESHOLD = 0.3

#: A word, or a run of other signs: junk shows in its punctuation too.
TOKENS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")


def features(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Places of a text's word unigrams and bigrams among the weights, one for each occurrence."""
    h = hashes.of(TOKENS.findall(text))
    one = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    two = ((h[:-1] * np.uint32(0x85EBCA6B)) ^ (h[1:] * np.uint32(0xC2B2AE35))) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
    return np.concatenate([one, two])


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss; the last coordinate is the bias."""

    def __init__(self, size: int) -> None:
        self.z = np.zeros(size + 1)
        self.n = np.zeros(size + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (sigmoid(w @ x) - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def vector(text: bytes, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """A text as sparse vector: counts over the root of their number, and the bias."""
    at, count = np.unique(features(text, hashes), return_counts=True)
    return np.append(at, 1 << BITS), np.append(count / np.sqrt(max(count.sum(), 1)), 1.0)


def train(rows: list[tuple[bytes, int]]) -> np.ndarray:
    """Weights (float32, bias last) from (text, label) rows, in the given order; zeros without rows."""
    model, hashes = Ftrl(1 << BITS), WordHashes()
    vectors = [vector(text, hashes) for text, _ in rows]
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            model.learn(*vectors[k], rows[k][1])
    return model.weights(slice(None)).astype(np.float32)


def score(texts: list[bytes], weights: np.ndarray, hashes: WordHashes) -> np.ndarray:
    found = [features(t, hashes) for t in texts]
    sizes = np.array([len(f) for f in found])
    flat = weights[np.concatenate(found)].astype(np.float64) if found else np.zeros(0)
    sums = np.add.reduceat(np.append(flat, 0.0), np.minimum(np.cumsum(sizes) - sizes, len(flat))) if len(sizes) else np.zeros(0)
    sums[sizes == 0] = 0.0
    return sigmoid(sums / np.sqrt(np.maximum(sizes, 1)) + weights[-1])


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(i, t, y) for b in batches for i, t, y in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(3).to_pylist(), strict=True)]
    weights = train([(t, y) for _, t, y in sorted(rows, key=lambda r: (str(r[0]), r[1]))])
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], names=["model"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", *, modulus: int = 5, remainder: int = 0, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Learn from at most ``rows`` labelled rows whose crc32 remainder is not ``remainder``."""
    sample = labelled_sample(docs, labels, label_col, modulus=modulus, remainder=remainder, id_col=id_col, text_col=text_col, rows=rows)
    model = sample.repartition(1).mapInArrow(_train_task, "model binary").head()
    return np.frombuffer(model[0], np.float32) if model else np.zeros((1 << BITS) + 1, np.float32)


def score_documents(docs: DataFrame, weights: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) for every row, repeated rows too.

    A null text counts as empty; an empty text gets the score of the bias alone.
    """
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            scores = score(utf8(batch.column(1)), held.value, hashes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of every document, learned from ``labels.quality`` outside the held-out fifth.

    Null and empty texts get the score of the bias alone; a row with a null id is
    not held out; repeated rows have a row each; texts may be of any length; an
    empty table gives no rows; without labels every score is one half.
    """
    scored = score_documents(docs, fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
