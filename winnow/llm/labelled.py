"""A bounded, reproducible sample of labelled documents, and the fold rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents, and so many bytes of their texts, fit a model; both are parameters.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 64 << 20


def in_fold(doc_id: Column, folds: int) -> Column:
    """Whether crc32 of the id as text is divisible by ``folds``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, columns: list[str], folds: int, rows: int = SAMPLE_ROWS, limit: int = SAMPLE_BYTES) -> list[tuple]:
    """The rows of ``sampled``, on the driver: (text bytes, *labels)."""
    found = sampled(docs, labels, columns, folds, rows, limit)
    return [(bytes(r[0]), *r[1:]) for r in found.collect()] if found is not None else []


def sampled(docs: DataFrame, labels: DataFrame, columns: list[str], folds: int, rows: int = SAMPLE_ROWS, limit: int = SAMPLE_BYTES) -> DataFrame | None:
    """utf8, label_0, ... of labelled documents outside the held-out fold, in one partition; None if there are none.

    Ids are taken in the order of the MD5 of their text form, so the choice depends on nothing
    else; the sample ends at ``rows`` documents or at ``limit`` bytes of whole texts (one at least). Rows with a
    null id or label are passed over; ids that the documents lack count toward ``rows``.
    """
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    picked = labels.where(F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), folds) & known)
    picked = picked.select("doc_id", *[F.col(c).cast("int").alias(f"label_{i}") for i, c in enumerate(columns)]).withColumn("order", order)
    picked = picked.orderBy("order", "doc_id", *[f"label_{i}" for i in range(len(columns))]).limit(rows)
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("utf8"))
    # The picked ids are bounded by ``rows``, so they may be sent to every executor.
    names = [f"label_{i}" for i in range(len(columns))]
    found = texts.join(F.broadcast(picked), "doc_id").withColumn("size", F.octet_length("utf8").cast("long"))
    order = ["order", "doc_id", "size", *names]
    # first the sizes alone, so that no more than ``limit`` bytes of texts are ever brought together
    kept, held, last = 0, 0, None
    for r in found.select(*order).orderBy(*order).limit(rows).collect():
        held += r["size"]
        if held > limit and kept:
            break
        kept, last = kept + 1, r
    if not kept:
        return None
    upto = found.where(F.struct("order", "doc_id", "size") <= F.struct(F.lit(last["order"]), F.lit(last["doc_id"]).cast(docs.schema["doc_id"].dataType), F.lit(last["size"]).cast("long")))
    return upto.orderBy(*order, "utf8").limit(kept).select("utf8", *names)
