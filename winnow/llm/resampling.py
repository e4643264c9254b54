"""Target-distribution importance resampling by inverted postings, partitioned by bucket.

A document's features are its words, hashed to buckets. Postings (bucket, document, count) are shuffled
by ranges of buckets; there each bucket's gain is computed from what both corpora have in it, and
what a document's postings in the range come to is emitted. Documents are reduced over the ranges, and
the draw keeps the highest sums of weight and Gumbel noise, which is a sample without replacement by
the exponentials of the weights.

The postings that a slice of texts has in a range are one row. A range's rows are dealt out over as
many groups as its postings need, so a bucket that every document has (or a third of all rows) is never
one group; the two corpora's sums of its buckets, made in each task before they are shuffled, meet
each of the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .base import durable, map_slices, scratch, settings, with_bytes
from .words import word_counts

BUCKETS = 10_000
#: Ranges of buckets, and about how many postings make a group.
RANGES, GROUP = 8, 1 << 18
#: Words whose buckets a task remembers.
KNOWN = 1 << 20
POSTINGS = "range int, postings long, docs array<long>, sizes array<int>, buckets array<int>, counts array<int>"


def postings(docs: DataFrame, buckets: int, columns: str, *names: str) -> DataFrame:
    """Of each row (kind 0): ``names`` (typed as in ``columns``), its number ``row`` and n_features; of each slice of texts
    and range of buckets (kind 1) the postings: rows, how many each has, and their buckets and counts."""
    width = -(-buckets // RANGES)
    numbered = with_bytes(docs.select(*names, "text", F.monotonically_increasing_id().alias("row")), *names, "row")

    def make():
        known: dict[bytes, int] = {}

        def one(batch: pa.RecordBatch) -> dict:
            texts, m = batch.column("utf8").to_pylist(), batch.num_rows
            total, docs_of, at, count = np.zeros(m, dtype=np.int64), [], [], []
            for i, t in enumerate(texts):
                words = word_counts(t)
                found = np.empty(len(words), dtype=np.int64)
                for j, w in enumerate(words):
                    if (b := known.get(w)) is None:
                        if len(known) >= KNOWN:
                            known.clear()
                        b = known[w] = crc32(w) % buckets
                    found[j] = b
                if len(words):
                    own, place = np.unique(found, return_inverse=True)
                    n = np.bincount(place, weights=np.fromiter(words.values(), dtype=np.int64, count=len(words))).astype(np.int64)
                    total[i] = n.sum()
                    docs_of.append(np.full(len(own), i))
                    at.append(own)
                    count.append(n)
            out = {c: [] for c in ("range", "postings", "docs", "sizes", "buckets", "counts")}
            if at:
                doc, bucket, count = np.concatenate(docs_of), np.concatenate(at), np.concatenate(count)
                rows = batch.column("row").to_numpy()
                for r in np.unique(bucket // width).tolist():
                    mine = bucket // width == r
                    held, sizes = np.unique(doc[mine], return_counts=True)
                    for c, v in (("range", r), ("postings", int(mine.sum())), ("docs", rows[held]), ("sizes", sizes), ("buckets", bucket[mine]), ("counts", count[mine])):
                        out[c].append(v)
            k = len(out["range"])
            none = [None] * m
            return {"kind": [0] * m + [1] * k, "row": [*batch.column("row").to_pylist(), *[None] * k], "n_features": [*total.tolist(), *[None] * k]} | {c: [*batch.column(c).to_pylist(), *[None] * k] for c in names} | {c: none + v for c, v in out.items()}

        return one

    return map_slices(numbered, make, f"kind int, row long, n_features long, {columns}{POSTINGS}")


def bucket_sums(table: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: the occurrences in all rows of kind 1, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for x in range(b.num_rows):
                at, n = (b.column(c)[x].values.to_numpy(zero_copy_only=False) for c in ("buckets", "counts"))
                total += np.bincount(at, weights=n, minlength=buckets).astype(np.int64)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(held, pa.int32()), "n": pa.array(total[held], pa.int64())})

    return table.where("kind = 1").select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(s: np.ndarray, t: np.ndarray, s_all: int, t_all: int, buckets: int) -> np.ndarray:
    """Of buckets with s of the corpus's and t of the target's features."""
    return np.floor(1000 * np.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)))).astype(np.int64)


def contributions(source: DataFrame, target: DataFrame, s_all: int, t_all: int, groups: int, buckets: int) -> DataFrame:
    """row, gain: what each document's postings come to in each range that it has any in."""
    width = -(-buckets // RANGES)
    left = source.where("kind = 1").select("range", F.pmod(F.xxhash64("range", F.element_at("docs", 1)), F.lit(groups)).alias("part"), "docs", "sizes", "buckets", "counts")
    sums = bucket_sums(source, buckets).withColumnRenamed("n", "s").join(bucket_sums(target, buckets).withColumnRenamed("n", "t"), "bucket", "left").select("bucket", "s", F.coalesce("t", F.lit(0)).alias("t"))
    sums = sums.groupBy(F.floor(F.col("bucket") / width).cast("int").alias("range")).agg(F.collect_list("bucket").alias("bucket"), F.collect_list("s").alias("s"), F.collect_list("t").alias("t"))  # a range's buckets
    right = durable(sums, "resampling-sums", few_files=True).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def meet(own: pa.Table, both: pa.Table) -> pa.Table:
        flat = lambda t, c: np.concatenate([x.values.to_numpy(zero_copy_only=False) for x in t[c]] or [np.zeros(0, dtype=np.int64)])
        if not own.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "gain": pa.array([], pa.int64())})
        gain = np.zeros(buckets, dtype=np.int64)
        gain[flat(both, "bucket")] = gains(flat(both, "s"), flat(both, "t"), s_all, t_all, buckets)
        sizes, worth = flat(own, "sizes"), gain[flat(own, "buckets")] * flat(own, "counts")
        return pa.table({"row": flat(own, "docs"), "gain": np.add.reduceat(worth, np.cumsum(sizes) - sizes)})

    keys = ("range", "part")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "row long, gain long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, fixed by the id; a null id counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank for every row of ``docs``.

    Of the N rows with at least ``least_words`` words, floor(percent N / 100) are drawn: those of the
    highest scores, equal scores by smaller doc_id, null ids last. rank is 1, 2, 3... in that order,
    null if not drawn. Null and empty texts have no features and weight 0, in either table. Rows of one
    id (or none) have the same noise and stay apart; rows equal in id and score follow one another in
    the order of their rows. Texts of any length are read whole, a few MB of words at a time. An empty
    table gives an empty result; an empty target has no occurrences. Columns other than doc_id and text
    are ignored.
    """
    spark = docs.sparkSession
    with settings(spark, spark__sql__execution__arrow__maxBytesPerBatch="4m", spark__sql__execution__arrow__maxRecordsPerBatch="4096"), scratch(spark) as keep:
        source = durable(postings(docs, buckets, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ", "doc_id"), "resampling-source")
        aim = durable(postings(target, buckets, ""), "resampling-target", few_files=True)
        s_all, held, eligible = source.agg(F.coalesce(F.sum("n_features"), F.lit(0)), F.coalesce(F.sum("postings"), F.lit(0)), F.count(F.when(F.col("n_features") >= least_words, 1))).first()
        t_all = aim.agg(F.coalesce(F.sum("n_features"), F.lit(0))).first()[0]
        emitted = contributions(source, aim, s_all, t_all, max(1, -(-held // (RANGES * GROUP))), buckets)
        weights = emitted.groupBy("row").agg(F.sum("gain").alias("weight"))
        rows = source.where("kind = 0").select("row", "doc_id", "n_features").join(weights, "row", "left")
        weight = F.coalesce("weight", F.lit(0)).cast("long")
        scored = durable(rows.select("row", "doc_id", "n_features", weight.alias("weight"), (weight + noise(F.col("doc_id"), seed)).alias("score")), "resampling-scored")
        order = [(F.col("n_features") < least_words).asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
        # numbers run on within a sorted partition; what the partitions before it hold comes on top
        sorted_rows = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
        ranked = keep(durable(sorted_rows.select("doc_id", "n_features", "weight", "score", "at"), "resampling-ranked"))
        part = F.shiftright("at", 33)
        counts = ranked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").toArrow()  # a row for each partition
    before = F.broadcast(spark.createDataFrame(list(zip(counts["part"].to_pylist(), [0, *np.cumsum(counts["n"]).tolist()], strict=False)), "part long, before long"))
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = ranked.withColumn("part", part).join(before, "part")
    return out.select("doc_id", "n_features", "weight", "score", F.when(rank <= percent * eligible // 100, rank).alias("rank"))
