"""A quality classifier on supervised subword embeddings.

Every word contributes itself, the 3- to 5-grams of its characters between "<" and ">", and the pair
that it makes with the next word, each hashed to one of ``BUCKETS`` learned vectors; all words' pairs
with themselves are one pair. A document is the mean of two averages, of its words' and characters'
vectors and of its pairs', and a softmax layer over it gives the classes. Both layers are trained
together by stochastic gradient descent in numpy, a document at a time.

The average and the output layer are linear, so at scoring each bucket's vector is taken through
the output layer once, and a document's logit is the average of its buckets' logits.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import byte_slices, in_slices, map_slices, with_bytes
from .labelled import SAMPLE_BYTES, SAMPLE_ROWS, sampled

BUCKETS, DIMS, EPOCHS, RATE = 1 << 18, 8, 8, 0.3
SHORTEST, LONGEST = 3, 5
#: Distinct words that a worker remembers.
REMEMBERED = 300_000
FOLDS, KEEP = 5, 0.3


def bucket(feature: bytes) -> int:
    return zlib.crc32(feature) & (BUCKETS - 1)


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of many words and the index of the word that each belongs to.

    A word has its own bucket and one for each of its character n-grams.
    """
    marked = [f"<{w.decode('utf-8', 'replace')}>" for w in words]
    lengths = np.array([len(s) for s in marked], dtype=np.int64)
    points = np.frombuffer("".join(marked).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))  # characters to the word's end
    buckets, owners = [np.array([bucket(w) for w in words], dtype=np.int64)], [np.arange(len(words))]
    for n in range(SHORTEST, LONGEST + 1):
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, dtype=np.uint64)
        for i in range(n):
            h = (h ^ points[at + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        buckets.append((h >> np.uint64(64 - 18)).astype(np.int64) & (BUCKETS - 1))
        owners.append(owner[at])
    return np.concatenate(buckets), np.concatenate(owners)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) | (zlib.adler32(w) << 32) for w in words), dtype=np.uint64, count=len(words))


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """The bucket of each word's pair with the next one, from the words' hashes in order."""
    h = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return np.where(hashes[:-1] == hashes[1:], bucket(b"\0itself"), (h >> np.uint64(64 - 18)).astype(np.int64) & (BUCKETS - 1))


def document_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A document's distinct buckets and their shares, which sum to 1 (empty text: none)."""
    words = text.split()
    counts = Counter(words)
    if not counts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)
    buckets, owner = word_features(list(counts))
    weight = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))[owner]
    pairs = pair_buckets(word_hashes(words))
    ids, inverse = np.unique(np.append(buckets, pairs), return_inverse=True)
    parts = [weight / weight.sum(), np.full(len(pairs), 1 / max(1, len(pairs)))]
    share = np.bincount(inverse, weights=np.concatenate(parts))
    return ids, (share / share.sum()).astype(np.float32)


@dataclass
class Model:
    """Each bucket's logit of class 1 against class 0, and the prior's."""

    logits: np.ndarray
    bias: float


def train(rows: list[tuple[bytes, int]], epochs: int = EPOCHS, rate: float = RATE, dims: int = DIMS, seed: int = 7) -> Model:
    """Fit on (text, label 0 or 1) rows. Without both labels the prior alone is learned."""
    n1 = sum(1 for _, y in rows if y)
    bias = float(np.log((n1 + 1) / (len(rows) - n1 + 1)))
    if not 0 < n1 < len(rows):
        return Model(np.zeros(BUCKETS, dtype=np.float32), bias)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dims, 1 / dims, (BUCKETS, dims)).astype(np.float32)
    output = np.zeros((2, dims), dtype=np.float32)
    offset = np.array([0.0, bias], dtype=np.float32)
    data = [(*document_features(t), int(bool(y))) for t, y in rows]
    data = [d for d in data if len(d[0])]
    step, steps = 0, epochs * len(data)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            ids, share, y = data[k]
            lr = rate * (1 - step / steps)
            step += 1
            hidden = share @ vectors[ids]
            z = output @ hidden + offset
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = lr * (p @ output)
            output -= lr * np.outer(p, hidden)
            vectors[ids] -= back  # the whole step for each feature present
    direction = output[1] - output[0]
    return Model((vectors @ direction).astype(np.float32), float(offset[1] - offset[0]))


class Words:
    """Sums of feature logits and feature counts of the words met so far, by word."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.sums, self.counts, self.hashes = np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)

    def learn(self, split: list[list[bytes]]) -> None:
        new = list(set().union(*split).difference(self.index))
        if len(self.index) + len(new) > REMEMBERED:
            self.forget()
            new = list(set().union(*split))
        if new:
            buckets, owner = word_features(new)
            first = len(self.index)
            self.index.update(zip(new, range(first, first + len(new)), strict=True))
            self.sums = np.append(self.sums, np.bincount(owner, weights=self.model.logits[buckets], minlength=len(new)))
            self.counts = np.append(self.counts, np.bincount(owner, minlength=len(new)))
            self.hashes = np.append(self.hashes, word_hashes(new))


def score_texts(texts: list[bytes], words: Words, model: Model) -> np.ndarray:
    """The probability of class 1 for each whole text."""
    out = np.empty(len(texts))
    for a, b in in_slices(texts, 1 << 20):
        split = [t.split() for t in texts[a:b]]
        words.learn(split)
        get = words.index.__getitem__
        ids = np.fromiter((k for ws in split for k in map(get, ws)), dtype=np.int64)
        ends = np.cumsum([len(ws) for ws in split])
        starts = ends - [len(ws) for ws in split]
        paired = np.ones(len(ids), dtype=bool)
        paired[ends[ends > starts] - 1] = False  # a document's last word makes no pair
        pair = np.zeros(len(ids))
        if len(ids) > 1:
            pair[:-1] = model.logits[pair_buckets(words.hashes[ids])]
        # running sums, differenced at the documents' ends
        between = lambda x: (t := np.concatenate([[0], np.cumsum(x)]))[ends] - t[starts]
        alone = between(words.sums[ids]) / np.maximum(between(words.counts[ids]), 1)
        pairs = between(paired.astype(np.int64))
        out[a:b] = np.where(pairs > 0, (alone + between(pair * paired) / np.maximum(pairs, 1)) / 2, alone)
    return 1 / (1 + np.exp(-np.clip(out + model.bias, -40, 40)))


def score(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """doc_id, score and predicted (1 if score >= keep) for every row; null text counts as empty.

    An empty text scores the prior of class 1. Texts are read whole, one slice of them at a time, and
    one of any length is scored in one piece. Equal texts score equally, and a score equal to ``keep``
    is predicted 1. Repeated rows and null ids give rows of their own; an empty table gives an empty
    result. Columns other than doc_id and text are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats, whatever the input

    def make():
        m = shared.value
        words = Words(m)

        def one(batch: pa.RecordBatch) -> dict:
            p = score_texts(batch.column("utf8").to_pylist(), words, m)
            return {"doc_id": batch.column("doc_id"), "score": p, "predicted": (p >= keep).astype(np.int32)}

        return one

    return map_slices(with_bytes(docs, "doc_id"), make, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, model: Model, least: float = KEEP) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``least``; all else as in score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        words = Words(m)
        for batch in batches:
            raw = batch.set_column(batch.schema.get_field_index("text"), "text", batch.column("text").cast(pa.binary()))
            at = 0
            for part in byte_slices(raw, "text"):
                p = score_texts([t or b"" for t in part.column("text").to_pylist()], words, m)
                yield batch.slice(at, part.num_rows).filter(pa.array(p >= least))
                at += part.num_rows

    return docs.mapInArrow(run, docs.schema)


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, rows: int = SAMPLE_ROWS, limit: int = SAMPLE_BYTES) -> Model:
    """Train on at most ``rows`` labelled documents, of ``limit`` bytes in all, outside the held-out fold.

    One task holds the sample and trains; only the model comes back.
    """
    found = sampled(docs, labels, ["quality"], folds, rows, limit)
    if found is None:
        return train([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = [(t, y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        model = train(data)
        yield pa.RecordBatch.from_arrays([pa.array([model.logits.tobytes()], pa.binary()), pa.array([model.bias])], names=["logits", "bias"])

    # the limit's rows meet in one partition; coalesce says so where there are none left
    r = found.coalesce(1).mapInArrow(run, "logits binary, bias double").first()
    return Model(np.frombuffer(bytes(r.logits), dtype=np.float32), r.bias)
