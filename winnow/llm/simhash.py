"""SimHash near-duplicates by multi-index hashing over two segments of the fingerprint.

Fingerprints at most two bits apart differ in at most one bit of the high segment, or not at all in
the low one. So the table holds every fingerprint by either segment, and each fingerprint fetches
those that stand at a value of the small ball around its own segment: the high one itself and with one
of its set bits cleared (of two segments one bit apart, one has that bit set), the low one itself.
What is fetched is verified by the complete distance.

A table cell of more than ``FULL`` fingerprints is not fetched whole. Its fingerprints agree in one
segment, so those within two bits in the other one share a point at most one bit from both: they meet
there, in 33 rows each however many they are. One that comes to such a cell by a cleared bit asks for
the 33 whole fingerprints that it may link with.

Only different fingerprints take part; equal ones are one row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from .base import durable, map_slices, scratch, settings, with_bytes
from .graph import connected

SEED = 42
#: Fingerprints of a cell up to which they are fetched and verified one by one.
FULL = 32
#: Shingles whose hashes are held at once.
HELD = 1 << 16
LOW = (1 << 32) - 1


def fingerprint(utf8: bytes, words: int = 3) -> int:
    """64 bits, each set where it is set in over half the hashes of the text's shingles, repeats
    included; as a signed integer. Fewer words: one shingle of them all; none: 0."""
    line = b" ".join(utf8.lower().split())  # bytes split at the six ASCII spaces and lower A-Z alone
    if not line:
        return 0
    gaps = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 0x20)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(line))
    span = min(words, len(starts))
    starts, ends = starts[: len(starts) - span + 1], ends[span - 1 :]
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(starts), HELD):
        hashes = b"".join([xxh64_digest(line[i:j], SEED) for i, j in zip(starts[a : a + HELD].tolist(), ends[a : a + HELD].tolist(), strict=True)])
        ones += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, print: the fingerprint of every row's whole text."""

    def one(batch):
        return {"doc_id": batch.column("doc_id"), "print": [fingerprint(t, words) for t in batch.column("utf8").to_pylist()]}

    return map_slices(with_bytes(docs, "doc_id"), lambda: one, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, print long")


def segments(prints: DataFrame) -> DataFrame:
    """segment, value, print: the table, a row for each segment of a fingerprint."""
    high, low = F.shiftrightunsigned("print", 32), F.col("print").bitwiseAND(F.lit(LOW))
    cells = F.array(F.struct(F.lit(0).alias("segment"), high.alias("value")), F.struct(F.lit(1).alias("segment"), low.alias("value")))
    return prints.select("print", F.explode(cells).alias("cell")).select("cell.segment", "cell.value", "print")


def probes(prints: DataFrame) -> DataFrame:
    """segment, value, print, cleared: where a fingerprint looks, and whether a bit was cleared for it."""
    high = F.shiftrightunsigned("print", 32)
    bits = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("getbit", high, i) == 1)
    near = F.transform(bits, lambda i: high - F.call_function("shiftleft", F.lit(1).cast("long"), i))
    return segments(prints).withColumn("cleared", F.lit(False)).unionByName(prints.select(F.lit(0).alias("segment"), F.explode(near).alias("value"), "print", F.lit(True).alias("cleared")))


def around(point: Column, segment: Column) -> Column:
    """The whole fingerprints at most one bit from ``point`` that agree with it in ``segment``."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), (i + F.when(segment == 0, 0).otherwise(32)).cast("int"))
    return F.concat(F.array(point), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: point.bitwiseXOR(bit(i))))


def links(prints: DataFrame) -> DataFrame:
    """x, y: edges whose components are those of the fingerprints at most two bits apart.

    Ends are fingerprints, or points that several of them lie at most one bit from.
    """
    table, asked, cell = segments(prints), probes(prints), ["segment", "value"]
    full = durable(table.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FULL).select(*cell), "simhash-full", few_files=True)
    none = full.isEmpty()
    few = table if none else table.join(full, cell, "left_anti")
    found = asked.withColumnRenamed("print", "x").join(few.withColumnRenamed("print", "y"), cell)
    near = found.where((F.col("cleared") | (F.col("x") < F.col("y"))) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= 2)).select("x", "y")
    if none:
        return near
    crowd = durable(asked.join(full, cell), "simhash-crowd")
    met = crowd.where("NOT cleared").select("print", F.explode(around(F.col("print"), F.col("segment"))).alias("point"))
    shared = met.groupBy("point").agg(F.min("print").alias("a"), F.max("print").alias("b")).where("a <> b").select("point")
    meet = met.join(shared, "point").where("print <> point").select(F.col("print").alias("x"), F.col("point").alias("y"))
    moved = F.shiftleft("value", 32).bitwiseOR(F.col("print").bitwiseAND(F.lit(LOW)))
    wanted = crowd.where("cleared").select(F.col("print").alias("x"), F.explode(around(moved, F.col("segment"))).alias("y"))
    return near.union(meet).union(wanted.join(prints.select(F.col("print").alias("y")), "y").select("x", "y"))


def components(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id for every row.

    Rows link where their fingerprints differ in at most two bits; component_id is the smallest doc_id
    reachable, nulls left out; a component of null ids alone has a null component_id. Null texts and
    texts without words have fingerprint zero and link like others. Repeated rows stay apart as rows and
    share a component. Whole texts are read, the hashes of ``HELD`` shingles at a time. A fingerprint
    that a third of all rows have is one row until the last join, whose skewed side can be split. An
    empty table gives an empty result. Columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    with settings(spark, spark__sql__execution__arrow__maxBytesPerBatch="4m", spark__sql__execution__arrow__maxRecordsPerBatch="4096"), scratch(spark) as keep:
        rows = keep(durable(fingerprints(docs, words), "simhash-rows"))
        classes = durable(rows.groupBy("print").agg(F.min("doc_id").alias("least_id")), "simhash-classes", few_files=True)
        roots = connected(links(classes.select("print")))
        named = classes.join(roots.select(F.col("node").alias("print"), "root"), "print", "left").withColumn("root", F.coalesce("root", "print"))
        least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
        ids = keep(durable(named.select("print", "root").join(least, "root").select("print", "component_id"), "simhash-components", few_files=True))
        return rows.join(ids, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
