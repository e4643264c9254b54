"""Joining documents whose n-gram sets have a Jaccard similarity of at least num/den.

Think of the incidence matrix of documents by n-grams; its product with its own transpose holds all
overlaps. What is computed of it:

1. Documents with equal sets are one row of the matrix, a class.
2. Columns stand in one order for all rows, rare ones first as far as a sketch of the columns' sums
   can tell. If two rows overlap by the bound, they share a column among each one's first
   n - ceil(num n / den) + 1. Only rows that meet in such a column can link. Where columns turn out
   to hold more than ``HOT`` rows, the prefixes are taken again with those columns last. Rows of a column
   that is hot still meet by it and a second column: rows that link share two at least, the second
   within one more place of each one's order.
   A column of several rows is divided into parts by size, in which rows too unequal to link do not meet.
3. Two rows are possible links if their sizes and the parity maps of their sets leave the bound
   possible. In each column the rows possible with its leader are tied to it; rows that are not tied
   to the leader's cluster are compared with the column's other rows, in blocks. Ties make clusters:
   both ends of every link are in one.
4. Within a cluster overlaps are accumulated by sparse products, a row of a block's incidence matrix
   at a time with the rows not yet linked, and pairs below the bound are discarded. A cluster of one
   block is done then. In larger ones a row of each component of each block meets those of the
   others, and last every row outside the cluster's largest component meets all rows of the cluster.
   Pairs left out by that are within one component already.

So a group of any number of near copies is read a few times and not once for every member, only links
that join components are put out, and no link between different sets is lost. Shingles are 64-bit
hashes: two of one text's n shingles agree by chance with probability n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from . import shingles
from .base import byte_slices, discard, durable, map_slices, record, scratch, settings, with_bytes
from .graph import connected

#: Cells of the sketch of column sums, and into how many pieces it is cut.
CELL_BITS, PIECES = 20, 64
MAP_WORDS = 8
MAPS = [f"m{i}" for i in range(MAP_WORDS)]
#: Rows to a block of a column or of a cluster, and shingles of their sets to a block.
BLOCK, ELEMENTS = 512, 1 << 21
#: Columns and clusters of at most so many rows are worked on together with others.
SMALL = 64
#: Columns of more rows come last in a second order of columns; at most so many are sent to executors,
#: the fullest.
HOT, HOT_MOST = 20_000, 1 << 18
CELL = "struct<kind:int,a:bigint,b:bigint>"
#: Bits of the filter that says which classes' sets are wanted: 16 for each class, within these powers
#: of two. Beyond them more sets than wanted are shuffled and fall out in the join.
FILTER_BITS = (16, 28)
COLUMN_BITS = 48


def first_pass(docs: DataFrame, words: int, seed: int, num: int, den: int) -> DataFrame:
    """A row for each document (kind 0) and, for each task, the pieces of its sketch (kind 1)."""
    long = lambda *names: [StructField(n, LongType()) for n in names]
    schema = StructType([StructField("kind", IntegerType()), StructField("doc_id", docs.schema["doc_id"].dataType), *long("key", "check", "n", *MAPS), StructField("map", BinaryType()), StructField("piece", IntegerType()), *long("part"), StructField("cells", BinaryType())])
    arrow = to_arrow_schema(schema)
    blank = {f.name: None for f in arrow}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, dtype=np.int64)
        for batch in batches:
            for part in byte_slices(batch, "utf8", shingles.SLICE_BYTES):
                m = part.num_rows
                s = shingles.shingle_sets(part.column("utf8").to_pylist(), words, seed)
                np.add(cells, np.bincount((s.hash >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(cells)), out=cells)
                key, check = shingles.set_keys(s)
                maps = shingles.parity_maps(s, MAP_WORDS)
                yield record(_nulls(blank, m, arrow) | {"kind": np.zeros(m, dtype=np.int32), "doc_id": part.column("doc_id"), "key": key, "check": check, "n": s.size, "map": shingles.long_maps(s, num, den, MAP_WORDS)} | {c: maps[:, i] for i, c in enumerate(MAPS)}, arrow)
        pieces = cells.astype("<i8").reshape(PIECES, -1)
        yield record(_nulls(blank, PIECES, arrow) | {"kind": np.ones(PIECES, dtype=np.int32), "piece": np.arange(PIECES, dtype=np.int32), "part": np.full(PIECES, TaskContext.get().partitionId()), "cells": [p.tobytes() for p in pieces]}, arrow)

    return with_bytes(docs, "doc_id").mapInArrow(run, schema)


def _nulls(blank: dict, m: int, arrow: pa.Schema) -> dict:
    return {k: pa.nulls(m, arrow.field(k).type) for k in blank}


def column_classes(pieces: DataFrame) -> np.ndarray:
    """From the tasks' sketches, a class 0..15 of each cell, higher for fuller cells.

    Sketches are added 64 at a time, so no task holds many.
    """

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), dtype="<i8") for x in table["cells"])
        return pa.table({"piece": table["piece"][:1], "part": pa.array([table["part"][0].as_py() // 64]), "cells": [total.tobytes()]})

    most = pieces.agg(F.max("part")).first()[0]
    while most is not None and most > 0:
        pieces = pieces.groupBy("piece", F.floor(F.col("part") / 64).alias("group")).applyInArrow(add, "piece int, part long, cells binary")
        most //= 64
    rows = pieces.select("piece", "cells").collect()  # 2 ** CELL_BITS numbers in all
    cells = np.zeros((PIECES, (1 << CELL_BITS) // PIECES), dtype=np.int64)
    for r in rows:
        cells[r.piece] = np.frombuffer(r.cells, dtype="<i8")
    cells = cells.reshape(-1)
    mean = max(cells.mean(), 1.0)
    return np.clip(np.floor(2 * np.log2(np.maximum(cells, 1) / mean)) + 2, 0, 15).astype(np.uint8)


def size_step(num: int, den: int) -> float:
    """Rows that link are in the same or in neighbouring classes of size, of this width in logarithms."""
    return max(float(np.log(den / num)), 1e-3) + 1e-6  # a little wide, so that rounding parts no two neighbours


def prefixes(docs: DataFrame, classes: np.ndarray, hot: np.ndarray, words: int, seed: int, num: int, den: int) -> DataFrame:
    """column, key: the columns of each class's prefix, once for each task that meets the class.

    ``column`` holds the row's size class above ``COLUMN_BITS`` bits of the column's hash. The columns
    in ``hot``, sorted, come after all others. The column after the prefix is given too, marked by the
    sign bit.
    """
    step = size_step(num, den)
    shared = docs.sparkSession.sparkContext.broadcast((classes, hot))  # 2 ** CELL_BITS bytes, HOT_MOST numbers

    def make():
        level, last = shared.value
        seen: set[int] = set()

        def one(batch: pa.RecordBatch) -> dict | None:
            s = shingles.shingle_sets(batch.column("utf8").to_pylist(), words, seed)
            key, _ = shingles.set_keys(s)
            new = np.zeros(batch.num_rows, dtype=bool)
            for i, k in enumerate(key.tolist()):
                if k not in seen:
                    seen.add(k)
                    new[i] = True
            keep = new[s.doc]
            doc, h = s.doc[keep], s.hash[keep]
            rank = level[(h >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64)
            if len(last):
                rank[np.isin(column_hash(h), last)] = 15
            order = (rank << np.uint64(60)) | (h >> np.uint64(4))  # all there is of a column from here on
            size = np.where(new, s.size, 0)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
            shingles.sort_each(order, size)
            length = size - -(-num * size // den) + 1
            taken = place <= length[doc]
            doc, place = doc[taken], place[taken]
            band = np.floor(np.log(np.maximum(size, 1)) / step).astype(np.int64)[doc]
            column = (band << COLUMN_BITS) | column_hash(order[taken] << np.uint64(4))
            return {"column": np.where(place == length[doc], column | np.iinfo(np.int64).min, column), "key": key[doc]}

        return one

    return map_slices(with_bytes(docs, "doc_id"), make, "column long, key long", limit=shingles.SLICE_BYTES)


def column_hash(h: np.ndarray) -> np.ndarray:
    """A column's number from its shingle's hash but for the last 4 bits; equal numbers only meet more rows."""
    return (shingles.mix((h >> np.uint64(4)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - COLUMN_BITS)).astype(np.int64)


def shared_columns(table: DataFrame) -> DataFrame:
    """bare, rows: the columns in which different classes meet. Most are one class's alone."""
    bare = F.col("column").bitwiseAND(F.lit((1 << COLUMN_BITS) - 1))
    per = table.groupBy(bare.alias("bare")).agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count(F.lit(1)).alias("rows"))
    return durable(per.where("a <> b").select("bare", "rows"), "jaccard-several", few_files=True)


def pair_columns(table: DataFrame, hot: DataFrame) -> DataFrame:
    """column, key: rows of hot columns (bare) by each pair of such a column and another of the row's."""
    bare = F.col("column").bitwiseAND(F.lit((1 << COLUMN_BITS) - 1))
    own = table.where("column >= 0").withColumn("bare", bare).join(hot.select("bare"), "bare").select("bare", "column", "key").distinct()
    other = table.select(bare.alias("other"), "key").distinct()
    pair = F.xxhash64(F.least("bare", "other"), F.greatest("bare", "other")).bitwiseAND(F.lit((1 << COLUMN_BITS) - 1))
    band = F.col("column").bitwiseAND(F.lit(~((1 << COLUMN_BITS) - 1)))
    return own.join(other, "key").where("bare <> other").select(band.bitwiseOR(pair).alias("column"), "key").distinct()


def hot_columns(several: DataFrame) -> np.ndarray:
    """The columns of more than HOT rows, sorted; the fullest HOT_MOST if there are more."""
    found = several.where(F.col("rows") > HOT).orderBy(F.col("rows").desc(), "bare").limit(HOT_MOST).select("bare").toArrow()
    return np.sort(found["bare"].to_numpy())


def meetings(table: DataFrame, several: DataFrame) -> DataFrame:
    """column, key, lead: the rows of the parts of columns in which different classes meet.

    A row stands in its column's part of its own size class and of the next one.
    """
    bare, band = F.col("column").bitwiseAND(F.lit((1 << COLUMN_BITS) - 1)), F.shiftright("column", COLUMN_BITS)
    rows = durable(table.withColumn("bare", bare).join(several.select("bare"), "bare").select("column", "key").distinct(), "jaccard-rows", few_files=True)
    rows = rows.select(bare.alias("bare"), F.explode(F.array(band, band + 1)).alias("band"), "key").select(F.xxhash64("bare", "band").alias("column"), "key")
    leads = rows.groupBy("column").agg(F.min("key").alias("lead"), F.max("key").alias("last")).where("lead <> last").drop("last")
    out = durable(rows.join(leads, "column"), "jaccard-members", few_files=True)
    discard(rows)
    return out


def wanted_sets(docs: DataFrame, keys: DataFrame, words: int, seed: int) -> DataFrame:
    """key, set: the sets of at least the given classes, one row a class."""
    number = keys.count()
    size = min(FILTER_BITS[1], max(FILTER_BITS[0], (16 * number).bit_length()))
    mixed = F.shiftrightunsigned(F.xxhash64("key"), 64 - size)
    bits = keys.select(F.shiftright(mixed, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(key), {64 - size}) & 63 as int))").alias("bit"))
    bits = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # a word for four classes, 2 ** 22 at most
    table = np.zeros(1 << (size - 6), dtype=np.int64)
    table[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def make():
        own = shared.value
        seen: set[int] = set()

        def one(batch: pa.RecordBatch) -> dict | None:
            s = shingles.shingle_sets(batch.column("utf8").to_pylist(), words, seed)
            key, _ = shingles.set_keys(s)
            at = spark_hash(key) >> np.uint64(64 - size)
            hit = (own[(at >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (at & np.uint64(63))) & np.uint64(1) == 1
            ends = s.ends()
            keys, sets = [], []
            for i in np.flatnonzero(hit).tolist():
                k = int(key[i])
                if k not in seen:
                    seen.add(k)
                    keys.append(k)
                    sets.append(s.hash[ends[i] - s.size[i] : ends[i]].astype("<u8").tobytes())
            return {"key": keys, "set": sets} if keys else None

        return one

    # several tasks may meet a class; its sets are equal
    return map_slices(with_bytes(docs, "doc_id"), make, "key long, set binary", limit=shingles.SLICE_BYTES).dropDuplicates(["key"])


def spark_hash(x: np.ndarray) -> np.ndarray:
    """xxhash64 of longs with Spark's seed 42, as unsigned integers."""
    p1, p2, p3, p4, p5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rotate = lambda v, r: (v << np.uint64(r)) | (v >> np.uint64(64 - r))
    h = np.full(len(x), 42, dtype=np.uint64) + p5 + np.uint64(8)
    h ^= rotate(x.view(np.uint64) * p2, 31) * p1
    h = rotate(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def possible(x: str, y: str, num: int, den: int):
    """Whether sizes and parity maps of the pair's two sides leave the bound possible."""
    a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = sum(F.bit_count(F.col(f"{x}.{m}").bitwiseXOR(F.col(f"{y}.{m}"))) for m in MAPS)
    # overlap >= num (a + b) / (num + den), so at most (den - num) (a + b) / (num + den) are not shared
    return (den * F.least(a, b) >= num * F.greatest(a, b)) & ((num + den) * apart <= (den - num) * (a + b))


def ties(members: DataFrame, meta: DataFrame, num: int, den: int) -> DataFrame:
    """x, y: possible links between members and leaders of their columns."""
    x, y = meta.alias("cx"), meta.alias("cy")
    least = shingles.long_set(num, den, MAP_WORDS)
    pairs = members.where("key <> lead").select(F.col("key").alias("x"), F.col("lead").alias("y")).distinct()
    near = pairs.join(x, F.col("x") == F.col("cx.key")).join(y, F.col("y") == F.col("cy.key"))
    near = durable(near.where(possible("cx", "cy", num, den)).select("x", "y", F.least("cx.n", "cy.n").alias("n")), "jaccard-near", few_files=True)
    # the short maps say little of long sets, which have longer ones
    long = near.where(F.col("n") > least)
    maps = meta.where(F.col("n") > least)
    side = lambda c: maps.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("map").alias(f"m{c}"))

    def one(batch: pa.RecordBatch) -> dict:
        a, b = (batch.column(c).to_numpy() for c in ("nx", "ny"))
        apart = np.array([shingles.bits_apart(p.as_py(), q.as_py()) for p, q in zip(batch.column("mx"), batch.column("my"), strict=True)])
        keep = pa.array((num + den) * apart <= (den - num) * (a + b))
        return {"x": batch.column("x").filter(keep), "y": batch.column("y").filter(keep)}

    both = long.select("x", "y").join(side("x"), "x").join(side("y"), "y").select("x", "y", "nx", "ny", "mx", "my")
    out = near.where(F.col("n") <= least).select("x", "y").union(durable(map_slices(both, lambda: one, "x long, y long", "mx"), "jaccard-long-ties"))
    return out


def forest(linked: np.ndarray, keys: np.ndarray, root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph with the given symmetric adjacency.

    Rows of one ``root`` are joined beforehand and cost no edge.
    """
    return spanning(lambda i, left: linked[i] & left, keys, root)


def spanning(links, keys: np.ndarray, root: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """As forest; ``links(i, left)`` says which of the rows marked in ``left`` link with row i."""
    n = len(keys)
    left = np.ones(n, dtype=bool)
    xs, ys = [], []
    order = np.argsort(root, kind="stable") if root is not None else None
    sorted_root = root[order] if root is not None else None

    def mates(j: int) -> list[int]:
        if root is None:
            return []
        a, b = np.searchsorted(sorted_root, root[j], side="left"), np.searchsorted(sorted_root, root[j], side="right")
        own = order[a:b]
        own = own[left[own]]
        left[own] = False
        return own.tolist()

    for seed in range(n):
        if not left[seed]:
            continue
        left[seed] = False
        front = [seed, *mates(seed)]
        while front:
            i = front.pop()
            for j in np.flatnonzero(links(i, left)).tolist():
                if left[j]:
                    xs.append(keys[j])
                    ys.append(keys[i])
                    left[j] = False
                    front += [j, *mates(j)]
    return np.array(xs, dtype=np.int64), np.array(ys, dtype=np.int64)


def open_ties(members: DataFrame, roots: DataFrame, meta: DataFrame, num: int, den: int) -> DataFrame:
    """Possible links in columns whose rows are not all tied to the leader's cluster."""
    least = shingles.long_set(num, den, MAP_WORDS)
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    rows = members.join(root("key"), "key", "left").join(root("lead"), "lead", "left")
    rows = rows.select("column", "key", "lead", F.coalesce("key_root", "key").alias("root"), F.coalesce("lead_root", "lead").alias("lead_root"))
    rows = rows.where(F.col("key") != F.col("lead"))
    out = (F.col("root") != F.col("lead_root")).cast("long")
    rows = durable(rows.withColumn("out", out).select("column", "key", "root", "out"), "jaccard-open", few_files=True)
    stats = rows.groupBy("column").agg(F.sum("out").alias("outs"), F.sum(1 - F.col("out")).alias("ins"))
    stats = stats.where((F.col("outs") >= 1) & (F.col("outs") + F.col("ins") >= 2))
    stats = durable(stats.select("column", "outs", "ins", *[F.ceil(F.col(c) / BLOCK).cast("long").alias(b) for c, b in (("outs", "ob"), ("ins", "ib"))]), "jaccard-columns", few_files=True)
    # Outer rows are dealt to outer blocks, inner ones to inner blocks; an inner block meets every
    # outer one, two outer blocks meet once.
    full = rows.join(stats, "column").join(meta, "key")
    few = F.col("outs") + F.col("ins") <= SMALL
    slots = max(1, stats.where(few).agg(F.sum(F.col("outs") + F.col("ins"))).first()[0] or 0) // BLOCK + 1
    columns = ["slot", "cell", "column", "key", "root", "out", "n", *MAPS, "map"]
    dealt = deal(full.where(~few), "column", F.col("out") == 1).withColumn("slot", F.col("column")).select(*columns)
    # small columns are compared many at a time
    dealt = dealt.unionByName(full.where(few).withColumn("slot", F.pmod(F.xxhash64("column"), F.lit(slots))).withColumn("cell", F.lit(None).cast(CELL)).select(*columns))

    def compare(table: pa.Table) -> pa.Table:
        column, key, own, n, outer = (table[c].to_numpy() for c in ("column", "key", "root", "n", "out"))
        maps = np.ascontiguousarray(np.column_stack([table[m].to_numpy() for m in MAPS])).view(np.uint64)
        longer = table["map"].to_pylist()

        def near(i: int, left: np.ndarray) -> np.ndarray:
            at = np.flatnonzero(left & (column == column[i]) & ((outer | outer[i]) == 1) & (den * np.minimum(n, n[i]) >= num * np.maximum(n, n[i])))
            apart = np.bitwise_count(maps[at] ^ maps[i]).sum(axis=1)
            at = at[(num + den) * apart <= (den - num) * (n[at] + n[i])]
            if n[i] > least:
                at = [j for j in at.tolist() if n[j] <= least or (num + den) * shingles.bits_apart(longer[i], longer[j]) <= (den - num) * (n[i] + n[j])]
            out = np.zeros(len(key), dtype=bool)
            out[at] = True
            return out

        # a row stands here once for each of its columns, and once at least for all of them
        x, y = spanning(near, key, own)
        return pa.table({"x": x, "y": y})

    out = durable(dealt.groupBy("slot", "cell").applyInArrow(compare, "x long, y long").distinct(), "jaccard-open-ties")
    discard(rows, stats)
    return out


def deal(rows: DataFrame, group: str, is_out: Column) -> DataFrame:
    """Rows with ``ob`` and ``ib``, the numbers of blocks of their group's outer and inner rows, dealt to
    cells, so that every outer row meets every row of its group in some cell of about two blocks."""
    tag = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.cast("long").alias("a"), b.cast("long").alias("b"))
    empty = F.array().cast(f"array<{CELL}>")
    each = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), f)).otherwise(empty)
    own = F.pmod(F.xxhash64("key", group), F.greatest(F.when(is_out, F.col("ob")).otherwise(F.col("ib")), F.lit(1)))
    rows = rows.withColumn("own", own)
    mine = F.col("own")
    outer = F.concat(each(F.col("ib"), lambda i: tag(0, i, mine)), each(F.col("ob"), lambda j: tag(1, F.least(j, mine), F.greatest(j, mine))))
    cells = F.when(is_out, outer).otherwise(each(F.col("ob"), lambda j: tag(0, mine, j)))
    return rows.withColumn("cell", F.explode(cells))


class Incidence:
    """A block's incidence matrix, without columns of one row, and rows of its product with its transpose."""

    def __init__(self, sets: list[bytes]):
        self.rows = len(sets)
        row = np.repeat(np.arange(self.rows, dtype=np.int32), [len(s) // 8 for s in sets])
        column = np.frombuffer(b"".join(sets), dtype="<u8")
        by = np.argsort(column, kind="stable")
        row, column = row[by], column[by]
        number = np.cumsum(np.append(False, column[1:] != column[:-1])) if len(column) else np.zeros(0, dtype=np.int64)
        several = np.bincount(number)[number] > 1 if len(number) else np.zeros(0, dtype=bool)
        row, number = row[several], number[several]
        number = np.cumsum(np.append(False, number[1:] != number[:-1])) if len(number) else number
        by = np.argsort(row, kind="stable")
        self.columns, self.ends = number[by], np.cumsum(np.bincount(row, minlength=self.rows))
        self._post(row, number)

    def _post(self, row: np.ndarray, number: np.ndarray) -> None:
        self.row, self.number = row, number
        self.lengths = np.bincount(number, minlength=int(self.columns.max(initial=-1)) + 1)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def overlaps(self, i: int) -> np.ndarray:
        """Row i of the product: the rows in the postings of its columns, counted."""
        mine = self.columns[(self.ends[i - 1] if i else 0) : self.ends[i]]
        n = self.lengths[mine]
        at = np.arange(n.sum()) + np.repeat(self.starts[mine] - (np.cumsum(n) - n), n)
        return np.bincount(self.row[at], minlength=self.rows)

    def post_only(self, rows: np.ndarray) -> None:
        """Leave only these rows in the postings; the others' own columns stay."""
        stay = rows[self.row]
        self._post(self.row[stay], self.number[stay])


def overlap_counts(sets: list[bytes]) -> np.ndarray:
    """The product of a block's incidence matrix with its transpose; 0 for pairs of empty sets."""
    m = Incidence(sets)
    return np.array([m.overlaps(i) for i in range(m.rows)]).reshape(m.rows, m.rows)


def links_in(table: pa.Table, num: int, den: int) -> pa.Table:
    """Links of a block's rows, as many as join its components.

    The product's rows are taken as they are needed: a row meets those that no link has reached, and
    when these are half of what the postings hold, the others leave them.
    """
    key, n = table["key"].to_numpy(), table["n"].to_numpy()
    matrix = Incidence(table["set"].to_pylist())
    held = len(key)

    def links(i: int, left: np.ndarray) -> np.ndarray:
        nonlocal held
        fits = left & (den * np.minimum(n, n[i]) >= num * np.maximum(n, n[i]))  # the bound by size
        if not fits.any():
            return fits
        both = matrix.overlaps(i)
        out = fits & (den * both >= num * (n + n[i] - both))
        if (remaining := int((left & ~out).sum())) <= held // 2:
            matrix.post_only(left & ~out)
            held = remaining
        return out

    x, y = spanning(links, key, table["root"].to_numpy() if "root" in table.column_names else None)
    return pa.table({"x": x, "y": y})


def exact_links(docs: DataFrame, clusters: DataFrame, meta: DataFrame, words: int, seed: int, num: int, den: int) -> DataFrame:
    """Links (x, y) that join each component of the rows within clusters (node, root)."""
    rows = clusters.select(F.col("node").alias("key"), F.col("root").alias("cluster")).join(meta.select("key", "n"), "key")
    rows = durable(rows, "jaccard-clustered", few_files=True)
    sets = wanted_sets(docs, rows.select("key"), words, seed)
    # blocks are bounded in rows and in shingles, so that long documents make more of them
    blocks = lambda m, s: F.greatest(F.ceil(m / BLOCK), F.ceil(s / ELEMENTS)).cast("long")
    sizes = durable(rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).withColumn("blocks", blocks(F.col("m"), F.col("s"))), "jaccard-sizes", few_files=True)
    # small clusters share blocks: a product finds no link between two clusters, as there is none
    few = (F.col("m") <= SMALL) & (F.col("s") <= ELEMENTS // 8)
    m, s = sizes.where(few).agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0))).first()
    slots = max(1, -(-m // BLOCK), -(-s // ELEMENTS))
    dealt = rows.join(sizes, "cluster").withColumn("block", F.when(~few, F.pmod(F.xxhash64("key"), F.col("blocks"))).otherwise(-1 - F.pmod(F.xxhash64("cluster"), F.lit(slots))))
    dealt = dealt.withColumn("cluster", F.when(few, F.lit(None).cast("long")).otherwise(F.col("cluster")))
    full = durable(dealt.drop("m", "s").join(sets, "key"), "jaccard-blocks", few_files=True)
    product = lambda df, *by: df.groupBy(*by).applyInArrow(lambda t: links_in(t, num, den), "x long, y long")
    links = durable(product(full.select("cluster", "block", "key", "n", "set"), "cluster", "block"), "jaccard-links")
    large = full.where(F.col("cluster").isNotNull() & (F.col("blocks") > 1))
    if large.isEmpty():
        discard(rows, sizes, full)
        return links
    # one row of each component of each block meets the others' rows
    name = lambda roots: large.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = name(connected(links))
    chosen = named.groupBy("cluster", "block", "root").agg(F.min("key").alias("key")).select("key")
    few = named.join(chosen, "key", "left_semi").drop("blocks", "block")
    many = few.groupBy("cluster").agg(blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks"))
    few = few.join(many, "cluster").withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")))
    links = links.union(durable(product(few.select("cluster", "block", "key", "n", "set", "root"), "cluster", "block"), "jaccard-links"))
    # rows outside the largest component meet all
    named = durable(name(connected(links)).drop("blocks", "block"), "jaccard-named", few_files=True)
    by_root = named.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    main = by_root.groupBy("cluster").agg(F.max_by("root", "size").alias("main"), F.max_by(F.struct("size", "n"), "size").alias("most"), F.sum("size").alias("m"), F.sum("n").alias("s"))
    main = main.where(F.col("m") > F.col("most.size")).select("cluster", "main", blocks(F.col("m") - F.col("most.size"), F.col("s") - F.col("most.n")).alias("ob"), blocks(F.col("most.size"), F.col("most.n")).alias("ib"))
    main = durable(main, "jaccard-main", few_files=True)
    rest = deal(named.join(main, "cluster"), "cluster", F.col("root") != F.col("main"))
    links = links.union(durable(product(rest.select("cluster", "cell", "key", "n", "set", "root"), "cluster", "cell"), "jaccard-links"))
    discard(rows, sizes, full, named, main)
    return links


def components(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id for every row; doc_id may be of any type that has an order.

    Two documents link when den * |A and B| >= num * |A or B| for their sets of distinct shingles
    of ``words`` words (ASCII letters lower-cased; fewer words: the whole sequence as one).
    component_id is the smallest doc_id reachable over links. num / den must be above 1/2.

    Documents without words (null, empty, only white space) link with nothing and are their own
    component. Rows with a null id take part in linking; ids in a component are compared without
    nulls, and one that has nothing else gets a null component_id. Repeated rows stay apart as rows
    and share a component. Pairs exactly at the bound link. Texts of any length are read whole; one
    text's set is held in a worker at a time, and blocks of sets are bounded in shingles. An empty
    table gives an empty result. Columns other than doc_id and text are ignored.
    """
    if not 2 * num > den >= num:
        raise ValueError("num / den must be above 1/2 and at most 1")
    # batches of a few MB, so that neither side holds many texts
    spark = docs.sparkSession
    with settings(spark, spark__sql__execution__arrow__maxBytesPerBatch="4m", spark__sql__execution__arrow__maxRecordsPerBatch="4096"), scratch(spark) as keep:
        return _components(docs, words, num, den, keep)


def _components(docs: DataFrame, words: int, num: int, den: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    seed = 0
    while True:
        first = durable(first_pass(docs, words, seed, num, den), "jaccard-first")
        rows = first.where("kind = 0").select("doc_id", "key", "check", "n", *MAPS, "map")
        if rows.where("n > 0").groupBy("key").agg(F.min("check").alias("c0"), F.max("check").alias("c1")).where("c0 <> c1").isEmpty():
            break
        discard(first)
        seed += 1  # two sets with one key: hash anew
    level = column_classes(first.where("kind = 1").select("piece", "part", "cells"))
    per = rows.where("n > 0").groupBy("key")
    classes = durable(per.agg(F.min("doc_id").alias("least_id"), F.max("n").alias("n"), *[F.max(m).alias(m) for m in MAPS], F.max("map").alias("map")), "jaccard-classes", few_files=True)
    meta = classes.select("key", "n", *MAPS, "map")
    clusters = possible_clusters(docs, meta, level, words, seed, num, den)
    roots = connected(exact_links(docs, clusters, meta, words, seed, num, den))
    named = classes.select("key", "least_id").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    ids = durable(named.join(least, "root").select("key", "component_id"), "jaccard-components", few_files=True)
    keep(first), keep(ids)  # the result reads these, all others go
    out = rows.select("doc_id", "n", "key").join(ids, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def possible_clusters(docs: DataFrame, meta: DataFrame, level: np.ndarray, words: int, seed: int, num: int, den: int) -> DataFrame:
    """node, root: classes joined by possible links."""
    table = durable(prefixes(docs, level, np.zeros(0, dtype=np.int64), words, seed, num, den), "jaccard-prefixes")
    several = shared_columns(table.where("column >= 0"))
    if len(hot := hot_columns(several)):
        discard(table, several)
        table = durable(prefixes(docs, level, hot, words, seed, num, den), "jaccard-prefixes")
        several = shared_columns(table.where("column >= 0"))
    still = several.where(F.col("rows") > HOT)
    members = meetings(table.where("column >= 0"), several.where(F.col("rows") <= HOT))
    if not still.isEmpty():
        pairs = durable(pair_columns(table, still), "jaccard-pairs")
        more = shared_columns(pairs)
        members = members.unionByName(meetings(pairs, more))
        discard(pairs, more)
    discard(table, several)
    tied = ties(members, meta, num, den)
    inner = connected(tied)
    out = connected(tied.union(open_ties(members, inner, meta, num, den)))
    discard(inner)
    return out
