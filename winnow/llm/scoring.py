"""Language-model scores of documents: context-tree weighting, beside a word-frequency base.

Three passes:

1. Every task counts its documents' byte grams and words; the counts meet by key, so a frequent
   key costs one row a task. Grams of held-out documents come along with count 0, so that the model
   has a value for every gram there is.
2. The model's values are computed from the table of grams (see ``ctw``).
3. Every document is scored. The most frequent grams and words, at most ``COMMON`` of each, are sent
   to all executors; what a document has beyond those it looks up by a join on the key.

Counts are of 64-bit hashes of words; grams are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import ctw
from .base import durable, in_slices, map_batches, record, scratch
from .labelled import in_fold

#: Grams and words, each, that every executor holds.
COMMON = 500_000
FOLDS, PRIOR = 10, 0.1
GRAM, WORD = 0, 1
GROUP_ROWS = 20_000
END = b"\n"
REMEMBERED = 200_000


def word_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    every = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
    if not len(every):
        return every, every
    out, inverse = np.unique(every, return_inverse=True)
    return out, np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)


class Counter:
    """Distinct keys with counts, brought together whenever ``limit`` rows have gathered."""

    def __init__(self, limit: int = 1_000_000):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held, self.limit = 0, limit

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)

    def full(self) -> bool:
        if self.held > self.limit:
            k, c = merged(self.keys, self.counts)
            self.keys, self.counts, self.held = [k], [c], len(k)
        return self.held > self.limit // 2

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = merged(self.keys, self.counts)
        self.keys, self.counts, self.held = [], [], 0
        return out


def prepared(docs: DataFrame, folds: int) -> DataFrame:
    return docs.select("doc_id", in_fold(F.col("doc_id"), folds).alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("utf8"))


def count(docs: DataFrame, folds: int) -> DataFrame:
    """kind, key, n over the training documents; grams of other documents have n = 0."""
    schema = StructType.fromDDL("kind int, key long, n long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words = Counter(), Counter()

        def flush(kind: int, c: Counter) -> Iterator[pa.RecordBatch]:
            k, n = c.take()
            for a in range(0, len(k), 200_000):
                m = len(k[a : a + 200_000])
                yield record({"kind": np.full(m, kind, dtype=np.int32), "key": k[a : a + m], "n": n[a : a + m]}, arrow)

        for batch in batches:
            texts = batch.column("utf8").to_pylist()
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            for a, b in in_slices(texts):
                split = [ctw.normal(t) for t in texts[a:b]]
                for learn in (True, False):
                    own = [w for w, h in zip(split, held[a:b], strict=True) if h != learn]
                    if not own:
                        continue
                    g, n = np.unique(ctw.grams([ctw.sequence(w) for w in own]), return_counts=True)
                    grams.add(g, n if learn else np.zeros_like(n))
                    if learn:
                        tally: dict[bytes, int] = {END: len(own)}
                        for ws in own:
                            for w in ws:
                                tally[w] = tally.get(w, 0) + 1
                        words.add(np.fromiter(map(word_key, tally), dtype=np.int64, count=len(tally)), np.fromiter(tally.values(), dtype=np.int64, count=len(tally)))
                if grams.full():
                    yield from flush(GRAM, grams)
                if words.full():
                    yield from flush(WORD, words)
        yield from flush(GRAM, grams)
        yield from flush(WORD, words)

    parts = prepared(docs, folds).mapInArrow(run, schema)
    return parts.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def gram_values(counts: DataFrame) -> DataFrame:
    """gram, n, value (log10 of the last byte's probability) for every gram counted."""
    grams = counts.where(F.col("kind") == GRAM).select(F.col("key").alias("gram"), "n")
    # Whole contexts are dealt to groups of about GROUP_ROWS grams.
    groups = max(32, grams.count() // GROUP_ROWS)
    context = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << (8 * ctw.GROUP)) - 1))
    grams = grams.withColumn("dealt", F.pmod(F.xxhash64(context), F.lit(groups)))

    def ends(table: pa.Table) -> pa.Table:
        k, a, b, w = ctw.group_roots(table["gram"].to_numpy(), table["n"].to_numpy().astype(np.float64))
        return pa.table({"dealt": pa.array(np.full(len(k), table["dealt"][0].as_py())), "key": k & ctw.ABOVE, "zeros": a, "ones": b, "split": w})

    ended = grams.groupBy("dealt").applyInArrow(ends, "dealt long, key long, zeros double, ones double, split double")
    ended = durable(ended.groupBy("dealt", "key").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "split"))), "scoring-ends")
    sums = lambda df, key: df.groupBy(key.alias("key")).agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "split")))
    by_two = durable(sums(ended, F.col("key")), "scoring-levels", few_files=True)
    columns = lambda x: [x.column(c).to_numpy(zero_copy_only=False) for c in ("key", "zeros", "ones", "split")]

    def weighted(batch: pa.RecordBatch) -> dict:
        k, a, b, w = columns(batch)
        level = ctw.level_of(k, a, b, w, ctw.GROUP - 1)
        return {"key": level.keys, "zeros": level.zeros, "ones": level.ones, "split": level.log_pw}

    above = map_batches(by_two, lambda: weighted, "key long, zeros double, ones double, split double")
    last = sums(above, F.col("key").bitwiseAND(F.lit(0xFFFF))).toArrow()  # at most 256 bytes of 255 nodes
    shared = counts.sparkSession.sparkContext.broadcast(ctw.roots(*(last[c].to_numpy() for c in ("key", "zeros", "ones", "split"))))

    def down(batch: pa.RecordBatch) -> dict:
        level = ctw.level_of(*columns(batch), ctw.GROUP - 1)
        one, reach = ctw.go_down(shared.value, level, 1)
        return {"key": level.keys, "one": one, "reach": reach}

    tops = ended.select("dealt", "key").join(map_batches(by_two, lambda: down, "key long, one double, reach double"), "key")

    def values(left: pa.Table, right: pa.Table) -> pa.Table:
        gram, n = left["gram"].to_numpy(), left["n"].to_numpy()
        keys, one, reach = (right[c].to_numpy() for c in ("key", "one", "reach"))
        order = np.argsort(keys)
        return pa.table({"gram": gram, "n": n, "value": ctw.group_scores(gram, n.astype(np.float64), ctw.Top(keys[order], one[order], reach[order]))})

    return grams.groupBy("dealt").cogroup(tops.groupBy("dealt")).applyInArrow(values, "gram long, n long, value double")


def common(table: DataFrame, key: str, limit: int) -> DataFrame:
    """The rows of the most frequent keys, at most ``limit``, without sorting: n at or above the
    least power of 2**(1/4) that few enough keys reach."""
    step = F.floor(F.log2(F.greatest("n", F.lit(1))) * 4).cast("int")
    rungs = sorted(table.groupBy(step.alias("step")).count().collect(), reverse=True)  # a few hundred at most
    least, kept = None, 0
    for r in rungs:
        if kept + r["count"] > limit:
            break
        least, kept = r.step, kept + r["count"]
    return table.where(step >= least) if least is not None else table.limit(0)


class Words:
    """What is known of the words met so far: ln-free base value, known or not, key if uncommon."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.common, self.common_values = keys, values
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.keys, self.values, self.rare = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=bool)

    def learn(self, split: list[list[bytes]]) -> None:
        new = list(set().union(*split).difference(self.index))
        if len(self.index) + len(new) > REMEMBERED:
            self.forget()
            new = list(set().union(*split))
        if new:
            first = len(self.index)
            keys = np.fromiter(map(word_key, new), dtype=np.int64, count=len(new))
            at = np.minimum(np.searchsorted(self.common, keys), max(0, len(self.common) - 1))
            hit = self.common[at] == keys if len(self.common) else np.zeros(len(keys), dtype=bool)
            self.index.update(zip(new, range(first, first + len(new)), strict=True))
            self.keys = np.append(self.keys, keys)
            self.rare = np.append(self.rare, ~hit)
            self.values = np.append(self.values, np.where(hit, self.common_values[at] if len(self.common) else 0.0, 0.0))


def by_document(doc: np.ndarray, key: np.ndarray, documents: int) -> tuple[pa.ListArray, pa.ListArray]:
    """Lists of each document's distinct keys and of their counts."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    first = np.ones(len(doc), dtype=bool)
    first[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(first)
    n = np.diff(np.append(at, len(doc)))
    offsets = np.searchsorted(doc[at], np.arange(documents + 1)).astype(np.int32)
    return tuple(pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (key[at], n.astype(np.int64)))


LOCAL = "uid long, doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, base double, score double, grams array<long>, gram_counts array<long>, words array<long>, word_counts array<long>"


def score(docs: DataFrame, folds: int = FOLDS, common_limit: int = COMMON) -> DataFrame:
    """Score every whole text, learning from the documents outside the held-out fold.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.
    base_score is the sum of log10((c + 0.1) / (N + 0.1 (V + 1))) over the tokens, the words and one
    end; score is the context-tree model's log10 probability of the words joined by spaces and
    ended by a line feed, and bits_per_byte its code length over that sequence's bytes.

    Null and empty texts are one end token. Texts are scored whole, in slices of many texts or one text of
    any length at a time; equal texts score equally. Words are known by 64-bit hashes: among V distinct
    words two are taken for one with probability V * V / 2**65. Rows with a null id are training documents. Repeated
    rows count and are scored each. With no training documents all counts are 0 and the model
    predicts every bit with 1/2. An empty table gives an empty result. Columns other than doc_id
    and text are ignored.
    """
    spark = docs.sparkSession
    counts = durable(count(docs, folds), "scoring-counts")
    words = counts.where((F.col("kind") == WORD) & (F.col("n") > 0))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    with scratch(spark) as keep:
        model = keep(durable(gram_values(counts), "scoring-model"))
    g = common(model, "gram", common_limit).select("gram", "value").toArrow()
    w = common(words, "key", common_limit).select("key", "n").orderBy("key").toArrow()
    shared = spark.sparkContext.broadcast((g["gram"].to_numpy(), g["value"].to_numpy(), w["key"].to_numpy(), np.log10(w["n"].to_numpy() + PRIOR)))
    schema = StructType.fromDDL(LOCAL)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, value, keys, values = shared.value
        lookup, known = ctw.Lookup(gram, value), Words(keys, values)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column("utf8").to_pylist()
            for a, b in in_slices(texts):
                yield one(batch.slice(a, b - a), texts[a:b], lookup, known, uid)
                uid += b - a

    def one(batch: pa.RecordBatch, texts: list[bytes], lookup: ctw.Lookup, known: Words, uid: int) -> pa.RecordBatch:
        m = len(texts)
        split = [ctw.normal(t) for t in texts]
        sequences = [ctw.sequence(ws) for ws in split]
        for ws in split:
            ws.append(END)
        lengths = np.array([len(s) for s in sequences])
        g = ctw.grams(sequences)
        p, missing = lookup(g)
        score = np.add.reduceat(p, np.cumsum(lengths) - lengths)
        doc = np.repeat(np.arange(m), lengths)[missing]
        gram_keys, gram_counts = by_document(doc, g[missing], m)
        known.learn(split)
        get = known.index.__getitem__
        ids = np.fromiter((k for ws in split for k in map(get, ws)), dtype=np.int64)
        n = np.array([len(ws) for ws in split])
        starts = np.cumsum(n) - n
        rare = known.rare[ids]
        word_keys, word_counts = by_document(np.repeat(np.arange(m), n)[rare], known.keys[ids[rare]], m)
        return record({"uid": np.arange(uid, uid + m), "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "n_bytes": lengths, "n_tokens": n, "n_known": np.add.reduceat((~rare).astype(np.int64), starts), "base": np.add.reduceat(known.values[ids], starts), "score": score, "grams": gram_keys, "gram_counts": gram_counts, "words": word_keys, "word_counts": word_counts}, arrow)

    local = durable(prepared(docs, folds).mapInArrow(run, schema), "scoring-local")
    pairs = lambda kind, k, n: local.select("uid", F.lit(kind).alias("kind"), F.explode(F.arrays_zip(F.col(k).alias("k"), F.col(n).alias("n"))).alias("p")).select("uid", "kind", F.col("p.k").alias("key"), F.col("p.n").alias("times"))
    asked = pairs(GRAM, "grams", "gram_counts").unionByName(pairs(WORD, "words", "word_counts"))
    told = model.select(F.lit(GRAM).alias("kind"), F.col("gram").alias("key"), "value").unionByName(words.select(F.lit(WORD).alias("kind"), "key", F.log10(F.col("n") + PRIOR).alias("value")))
    is_word = F.col("kind") == WORD
    value = F.coalesce(F.col("value"), F.log10(F.lit(PRIOR))) * F.col("times")  # only words can be unknown
    rest = asked.join(told, ["kind", "key"], "left").groupBy("uid").agg(
        F.sum(F.when(is_word, value)).alias("more_base"),
        F.sum(F.when(~is_word, value)).alias("more_score"),
        F.sum(F.when(is_word & F.col("value").isNotNull(), F.col("times"))).alias("more_known"),
    )
    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    each = float(np.log10(total + PRIOR * (distinct + 1)))
    whole = add("score", "more_score")
    return local.drop("grams", "gram_counts", "words", "word_counts").join(rest, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", add("n_known", "more_known").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (add("base", "more_base") - F.col("n_tokens") * F.lit(each)).alias("base_score"), whole.alias("score"), (-whole / float(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
