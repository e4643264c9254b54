"""Toxicity by a chain of linear classifiers.

The categories stand in an order. Each has a logistic model over the document's distinct words
(with their beginnings, hashed, without case and outer punctuation) and over the probabilities of all categories before
it. In training, the earlier probabilities are out of fold: each labelled document's come from
models that have not seen it, so that later models meet in training what they will meet in use.
The models are fitted by follow-the-regularized-leader steps with an L1 penalty, which leaves most
words without a weight. A category's models, the final one and those of its folds, are fitted side by
side as tasks.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import map_slices, with_bytes
from .labelled import SAMPLE_BYTES, in_fold, sample

BUCKETS = 1 << 20
EPOCHS, ALPHA, BETA, L1 = 6, 2.0, 1.0, 6.0
OUTER = """!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""
#: Lengths of the beginnings of a word that are features beside the whole word.
STEMS = range(3, 9)
INNER_FOLDS, FOLDS = 3, 5
REMEMBERED = 400_000
SAMPLE_ROWS = 8000
#: Category names and how each follows from the labels quality and toxic, in chain order.
CATEGORIES = (("junk", lambda quality, toxic: 1 - quality), ("toxic", lambda quality, toxic: toxic))


def word_buckets(word: bytes) -> list[int]:
    s = word.decode("utf-8", "replace").lower().strip(OUTER)
    return [zlib.crc32(f.encode()) & (BUCKETS - 1) for f in (s, *("<" + s[:n] for n in STEMS if len(s) > n))]


def document_features(text: bytes) -> np.ndarray:
    return np.unique(np.array([b for w in set(text.split()) for b in word_buckets(w)], dtype=np.int64))


@dataclass
class Linear:
    weights: np.ndarray
    bias: float
    chain: np.ndarray

    def margin(self, features: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
        base = np.array([self.weights[x].sum() for x in features])
        return base + self.bias + earlier @ self.chain


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(features: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Linear:
    """One logistic model; the bias and the chain's weights have no L1 penalty.

    Without both labels there is nothing to learn but the prior.
    """
    k = earlier.shape[1]
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if not 0 < y.sum() < len(y):
        return Linear(np.zeros(BUCKETS, dtype=np.float32), prior, np.zeros(k))
    z, n = np.zeros(BUCKETS + k + 1), np.zeros(BUCKETS + k + 1)
    l1 = np.full(BUCKETS + k + 1, L1)
    l1[BUCKETS:] = 0
    tail = np.arange(BUCKETS, BUCKETS + k + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1[i], 0.0, (np.sign(zi) * l1[i] - zi) / ((BETA + np.sqrt(n[i])) / ALPHA))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(y)):
            i = np.concatenate([features[r], tail])
            x = np.ones(len(i))
            x[-k - 1 : -1] = earlier[r]
            w = weights(i)
            g = (sigmoid(w @ x) - y[r]) * x
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - step * w
            n[i] += g * g
    w = weights(np.arange(len(z)))
    return Linear(w[:BUCKETS].astype(np.float32), float(w[-1]), w[BUCKETS:-1].copy())


def train(texts: list[bytes], labels: np.ndarray, run=None) -> list[Linear]:
    """The chain for label columns (documents, categories) in order.

    Folds go by a hash of the text, so that copies of a text share a fold. ``run`` takes the features
    and a list of (rows, earlier, y) and fits a model for each; by default one after another.
    """
    run = run or (lambda features, jobs: [fit_linear([features[i] for i in rows], earlier, y) for rows, earlier, y in jobs])
    features = [document_features(t) for t in texts]
    fold = np.array([zlib.crc32(t) % INNER_FOLDS for t in texts], dtype=np.int64)
    every = np.arange(len(texts))
    earlier = np.zeros((len(texts), 0))
    chain = []
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        outside = [np.flatnonzero(fold != f) for f in range(INNER_FOLDS)] if c + 1 < labels.shape[1] else []
        model, *inner = run(features, [(rows, earlier[rows], y[rows]) for rows in (every, *outside)])
        chain.append(model)
        if inner:
            out = np.zeros(len(texts))
            for f, m in enumerate(inner):
                inside = np.flatnonzero(fold == f)
                out[inside] = sigmoid(m.margin([features[i] for i in inside], earlier[inside]))
            earlier = np.column_stack([earlier, out])
    return chain


def in_tasks(spark: SparkSession):
    """Fit each model in a task of its own; the sample's features, bounded as the sample is, are sent once."""
    sent = {}

    def run(features: list[np.ndarray], jobs: list[tuple]) -> list[Linear]:
        if not sent:
            ends = np.cumsum([len(x) for x in features])
            flat = np.concatenate(features).astype(np.int32) if features else np.zeros(0, dtype=np.int32)
            sent["features"] = spark.sparkContext.broadcast((flat, ends))
        shared, given = sent["features"], spark.sparkContext.broadcast(jobs)

        def fit(batches):
            for batch in batches:
                for at in batch.column("id").to_pylist():
                    flat, ends = shared.value
                    rows, earlier, y = given.value[at]
                    m = fit_linear([flat[(ends[i - 1] if i else 0) : ends[i]].astype(np.int64) for i in rows], earlier, y)
                    used = np.flatnonzero(m.weights)
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([used.tolist()], pa.list_(pa.int64())), pa.array([m.weights[used].tolist()], pa.list_(pa.float32())), pa.array([m.bias]), pa.array([m.chain.tolist()], pa.list_(pa.float64()))], names=["id", "used", "weights", "bias", "chain"])

        found = spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(fit, "id long, used array<long>, weights array<float>, bias double, chain array<double>")
        out = []
        for r in sorted(found.collect(), key=lambda r: r.id):  # a few models of at most BUCKETS weights
            weights = np.zeros(BUCKETS, dtype=np.float32)
            weights[np.array(r.used, dtype=np.int64)] = r.weights
            out.append(Linear(weights, r.bias, np.array(r.chain, dtype=np.float64)))
        return out

    return run


class Words(dict):
    """word -> the rows of the table of weights that it calls on; most words call on none."""

    def __init__(self, rows: dict[int, int]):
        self.rows = rows

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        self[word] = out = tuple(self.rows[b] for b in word_buckets(word) if b in self.rows)
        return out


def weight_table(chain: list[Linear]) -> tuple[dict[int, int], np.ndarray]:
    """The buckets that have a weight in some category, and those weights (at most BUCKETS rows)."""
    used = np.flatnonzero(np.any([m.weights != 0 for m in chain], axis=0))
    return {int(b): k for k, b in enumerate(used)}, np.column_stack([m.weights[used] for m in chain]).astype(np.float64)


def score_texts(texts: list[bytes], words: Words, table: np.ndarray, chain: list[Linear]) -> np.ndarray:
    """The probability of each category (columns) for each whole text."""
    get = words.__getitem__
    base = np.zeros((len(texts), len(chain)))
    for i, text in enumerate(texts):
        if len(words) > REMEMBERED:
            words.clear()
        if hit := set().union(*filter(None, map(get, set(text.split())))):
            base[i] = table[sorted(hit)].sum(axis=0)
    out = np.zeros_like(base)
    for c, m in enumerate(chain):
        out[:, c] = sigmoid(base[:, c] + m.bias + out[:, :c] @ m.chain)
    return out


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, rows: int = SAMPLE_ROWS, limit: int = SAMPLE_BYTES) -> list[Linear]:
    """Train the chain of ``CATEGORIES`` on at most ``rows`` labelled documents, of ``limit`` bytes in all,
    outside the fold."""
    got = sample(docs, labels, ["quality", "toxic"], folds, rows, limit)
    y = np.array([[f(q, t) for _, f in CATEGORIES] for _, q, t in got]).reshape(len(got), len(CATEGORIES))
    return train([t for t, *_ in got], y, in_tasks(docs.sparkSession))


def classify(docs: DataFrame, chain: list[Linear], names: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """doc_id, p_<category> for each category, and is_<category> (probability >= threshold).

    Null and empty texts have no words and get each model's bias. Texts of any length are read whole,
    a slice of them at a time. Equal texts get equal probabilities, and one equal to ``threshold`` is
    marked. Repeated rows and null ids give rows of their own; an empty table gives an empty result.
    Columns other than doc_id and text are ignored.
    """
    names = names or [n for n, _ in CATEGORIES]
    rows, table = weight_table(chain)
    shared = docs.sparkSession.sparkContext.broadcast((rows, table, [Linear(np.zeros(0), m.bias, m.chain) for m in chain]))

    def make():
        rows, table, models = shared.value
        words = Words(rows)

        def one(batch: pa.RecordBatch) -> dict:
            p = score_texts(batch.column("utf8").to_pylist(), words, table, models)
            return {"doc_id": batch.column("doc_id")} | {f"p_{n}": p[:, c] for c, n in enumerate(names)} | {f"is_{n}": p[:, c] >= threshold for c, n in enumerate(names)}

        return one

    return map_slices(with_bytes(docs, "doc_id"), make, "doc_id long, " + ", ".join(f"p_{n} double" for n in names) + ", " + ", ".join(f"is_{n} boolean" for n in names))


def held_out(doc_id):
    return in_fold(F.col(doc_id), FOLDS)
