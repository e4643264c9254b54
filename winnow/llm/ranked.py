"""Ranked lexical search over trees of maxima: for each term, the most that any document of a range can score.

Documents stand in blocks of consecutive rows. A block is one row of the index: its documents, their
lengths, and the postings of the terms that any item asks for. What a term's occurrences are worth in a
document, but for the term's weight, is a node's value in the term's tree: the document's own at the
bottom, above it the maximum over ``FANOUT`` neighbours, and so on up to the block; blocks have a
tree of ranges above them in a written table, up to ``TOP`` nodes.

An item's bound at a node is the weighted sum of its terms' values there. The search goes down the
written levels twice: first along each item's highest bounds to a few blocks, whose best documents give
a score that the item's last place cannot be below; then to every node whose bound is that
score or more. Within blocks a heap opens the node of the highest bound first and ends when the
bound falls below the last place; equal bounds are opened, as a tie may go to a smaller id.

Items come in chunks of bounded size, so what executors are sent does not grow with the items.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh64_intdigest

from .base import durable, map_batches, map_slices, scratch, settings, with_bytes
from .words import word_counts

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a block, at most; it also ends after about BLOCK_BYTES of text.
BLOCK_ROWS, BLOCK_BYTES = 1024, 1 << 20
#: Children of a node within a block, and in the levels above; nodes at which those levels end.
FANOUT, WIDE, TOP = 16, 64, 64
#: Pairs of item and term to a chunk of items.
CHUNK = 1 << 18
#: A task's blocks are numbered from a multiple of this power of two. Where a task has more, two blocks share a
#: number and with that their place in the tree, no more.
TASK_BITS = 12
#: Nodes of each level that an item goes down by first.
FIRST = 2
#: Nodes that are sent to executors by their numbers; more are searched by their bounds alone.
SENT = 100_000
FILTER_BITS = 24
#: Terms whose hashes a task remembers.
KNOWN = 1 << 20


def item_terms(items: DataFrame) -> DataFrame:
    """own (a number for each row), item_id, term, term_hash, times."""
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    numbered = items.select(F.monotonically_increasing_id().alias("own"), "item_id", F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("terms"))
    each = numbered.select("own", "item_id", F.explode("terms").alias("term"))
    return each.groupBy("own", "item_id", "term").agg(F.count(F.lit(1)).alias("times")).withColumn("term_hash", F.xxhash64("term"))


def asked_filter(terms: DataFrame) -> np.ndarray:
    """2 ** FILTER_BITS bits: those of the hashes of the terms that items ask for."""
    place = F.shiftrightunsigned("term_hash", 64 - FILTER_BITS)
    found = terms.select(F.shiftright(place, 3).cast("int").alias("byte"), F.call_function("shiftleft", F.lit(1), place.bitwiseAND(F.lit(7)).cast("int")).alias("bit"))
    found = found.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    out[found["byte"].to_numpy()] = found["bits"].to_numpy()
    return out


def index(docs: DataFrame, asked: np.ndarray) -> DataFrame:
    """The blocks: block (its number), docs, lengths, ready (documents with a term), all_terms, and postings
    as terms (hashes, sorted), ends (of each one's postings), places (in the block) and counts."""
    shared = docs.sparkSession.sparkContext.broadcast(asked)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        from pyspark import TaskContext

        bits, known = shared.value, {}
        number = TaskContext.get().partitionId() << TASK_BITS

        def hash_of(word: bytes) -> int | None:
            h = xxh64_intdigest(word, 42)
            at = h >> (64 - FILTER_BITS)
            out = (h - (1 << 64) if h >> 63 else h) if bits[at >> 3] >> (at & 7) & 1 else None
            if len(known) >= KNOWN:
                known.clear()
            known[word] = out
            return out

        def one(batch: pa.RecordBatch) -> dict:
            nonlocal number
            lengths, terms, places, counts = [], [], [], []
            for i, t in enumerate(batch.column("utf8").to_pylist()):
                words = word_counts(t)
                lengths.append(words.total())
                for w, n in words.items():
                    if (h := known[w] if w in known else hash_of(w)) is not None:
                        terms.append(h)
                        places.append(i)
                        counts.append(n)
            terms = np.array(terms, dtype=np.int64)
            order = np.argsort(terms, kind="stable")
            own, first = np.unique(terms[order], return_index=True)
            number += 1
            pick = lambda x: np.array(x, dtype=np.int64)[order]
            return {"block": [number - 1], "docs": [batch.column("doc_id").to_pylist()], "lengths": [lengths], "ready": [sum(n > 0 for n in lengths)], "all_terms": [sum(lengths)], "terms": [own], "ends": [np.append(first[1:], len(terms))[: len(own)]], "places": [pick(places)], "counts": [pick(counts)]}

        return one

    schema = f"block long, docs array<{kind}>, lengths array<long>, ready long, all_terms long, terms array<long>, ends array<int>, places array<int>, counts array<long>"
    return map_slices(with_bytes(docs, "doc_id"), make, schema, limit=BLOCK_BYTES, rows=BLOCK_ROWS)


@dataclass
class Corpus:
    """How many documents have terms, and how many terms there are."""

    docs: int
    terms: int

    def worth(self, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(1000000000 tf) div (1000 tf + 8 m) with m = 25 + (75 n N) div L, in 64-bit integers.

        Lengths for which 75 n N passes 64 bits are divided as Python's integers.
        """
        top = int(lengths.max(initial=0)) * 75 * self.docs
        m = 25 + (75 * lengths * self.docs // self.terms if top < 1 << 63 else np.array([75 * int(n) * self.docs // self.terms for n in lengths], dtype=np.int64))
        return 1_000_000_000 * counts // (1000 * counts + 8 * m)


def values(row: dict, corpus: Corpus) -> np.ndarray:
    """What each posting of a block is worth."""
    lengths, places, counts = (np.asarray(row[c], dtype=np.int64) for c in ("lengths", "places", "counts"))
    return corpus.worth(counts, lengths[places]) if len(counts) else counts


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, lists of numbers as arrays."""
    for i in range(batch.num_rows):
        yield {c: x[i].values.to_numpy(zero_copy_only=False) if c != "docs" and pa.types.is_list(x.type) else x[i].as_py() for c, x in zip(batch.schema.names, batch.columns, strict=True)}


LEVEL = "node long, terms array<long>, most array<long>"


def tree(blocks: DataFrame, corpus: Corpus) -> list[DataFrame]:
    """The written levels from the blocks up: node, parent, terms and most, a maximum for each term."""
    parent = F.floor(F.col("node") / WIDE).alias("parent")

    def leaves(batch: pa.RecordBatch) -> dict:
        out = {"node": batch.column("block"), "terms": batch.column("terms"), "most": []}
        for row in rows_of(batch):
            v = values(row, corpus)
            out["most"].append(np.maximum.reduceat(v, np.append(0, row["ends"][:-1])) if len(v) else v)
        return out

    def above(table: pa.Table) -> pa.Table:
        terms, most = (np.concatenate([x.values.to_numpy(zero_copy_only=False) for x in table[c]]) for c in ("terms", "most"))
        order = np.argsort(terms, kind="stable")
        own, first = np.unique(terms[order], return_index=True)
        most = np.maximum.reduceat(most[order], first) if len(own) else most
        return pa.table({"node": table["parent"][:1], "terms": pa.array([own], pa.list_(pa.int64())), "most": pa.array([most], pa.list_(pa.int64()))})

    levels = [durable(map_batches(blocks.select("block", "lengths", "terms", "ends", "places", "counts"), lambda: leaves, LEVEL).select("*", parent), "ranked-level")]
    while levels[-1].count() > TOP:
        levels.append(durable(levels[-1].groupBy("parent").applyInArrow(above, LEVEL).select("*", parent), "ranked-level"))
    return levels


@dataclass
class Chunk:
    """Items with the terms that they share with the documents: item i's are at starts[i] up to the next start."""

    own: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    at: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, pairs: pa.Table) -> Chunk:
        own, term, weight = (pairs[c].to_numpy() for c in ("own", "term_hash", "weight"))
        order = np.lexsort((term, own))
        items, starts = np.unique(own[order], return_index=True)
        terms, at = np.unique(term[order], return_inverse=True)
        return cls(items, terms, starts, at, weight[order])

    def pairs(self, item: int) -> slice:
        return slice(self.starts[item], self.starts[item + 1] if item + 1 < len(self.starts) else len(self.at))

    def bounds(self, terms: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Each item's bound at a node with these maxima."""
        place, known = self.places(terms)
        value = np.zeros(len(self.terms), dtype=np.int64)
        value[place] = most[known]
        return np.add.reduceat(self.weight * value[self.at], self.starts)

    def places(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the chunk has those of ``terms`` that it has, and which these are."""
        place = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[place] == terms
        return place[known], known


class Block:
    """A block's documents and the lower levels of its terms' trees, for some items of a chunk."""

    #: Numbers in the lowest level at once, but for an item with more terms.
    CELLS = 1 << 22

    def __init__(self, row: dict, corpus: Corpus, chunk: Chunk):
        self.docs, self.chunk, self.places, self.values = row["docs"], chunk, row["places"], values(row, corpus)
        self.sizes = np.diff(row["ends"], prepend=0)
        self.place, self.known = chunk.places(row["terms"])
        self.most = np.maximum.reduceat(self.values, np.append(0, row["ends"][:-1])) if len(self.values) else self.values
        self.bounds = chunk.bounds(row["terms"], self.most)

    def groups(self, items: np.ndarray) -> Iterator[list[int]]:
        out, held = [], 0
        for i in items.tolist():
            part = self.chunk.pairs(i)
            if out and (held + part.stop - part.start) * len(self.docs) > self.CELLS:
                yield out
                out, held = [], 0
            out.append(i)
            held += part.stop - part.start
        if out:
            yield out

    def levels(self, items: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The rows of the terms of the chunk (-1: none), and the levels, documents first."""
        wanted = np.zeros(len(self.chunk.terms), dtype=bool)
        for i in items:
            wanted[self.chunk.at[self.chunk.pairs(i)]] = True
        row = np.full(len(self.chunk.terms), -1)
        mine = self.place[wanted[self.place]]
        row[mine] = np.arange(len(mine))
        of = np.full(len(self.sizes), -1)
        of[self.known] = row[self.place]
        each = np.repeat(of, self.sizes)
        taken = each >= 0
        lowest = np.zeros((len(mine), len(self.docs)), dtype=np.int64)
        lowest[each[taken], self.places[taken]] = self.values[taken]
        out = [lowest]
        while len(out) == 1 or out[-1].shape[1] > 1:
            out.append(np.maximum.reduceat(out[-1], np.arange(0, out[-1].shape[1], FANOUT), axis=1))
        return row, out


def best_first(levels: list[np.ndarray], rows: np.ndarray, weight: np.ndarray, docs: list, k: int, floor: int, held: list) -> int:
    """Put the block's best documents into ``held``, sorted (-score, null id, id), k at most; the new floor."""
    heap = [(-int(weight @ levels[-1][rows, 0]), len(levels) - 1, 0)]
    while heap:
        bound, level, node = heapq.heappop(heap)
        if -bound < floor:
            break
        below = weight @ levels[level - 1][rows, node * FANOUT : (node + 1) * FANOUT]
        for i in np.flatnonzero(below >= floor).tolist():
            score, at = int(below[i]), node * FANOUT + i
            if level > 1:
                heapq.heappush(heap, (-score, level - 1, at))
            elif score >= floor:
                insort(held, (-score, docs[at] is None, docs[at] if docs[at] is not None else 0))
                del held[k:]
                if len(held) == k:
                    floor = max(floor, -held[-1][0])
    return floor


def found(blocks: DataFrame, corpus: Corpus, chunk: Chunk, floors: np.ndarray, k: int) -> DataFrame:
    """own, score, doc_id: of each task's documents the k best of each item, from the item's floor on."""
    shared = blocks.sparkSession.sparkContext.broadcast((chunk, floors))
    kind = blocks.schema["docs"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, floor = shared.value
        floor, held = floor.copy(), {}
        for batch in batches:
            for row in rows_of(batch):
                block = Block(row, corpus, own)
                for items in block.groups(np.flatnonzero(block.bounds >= floor)):
                    at, levels = block.levels(items)
                    for i in items:
                        rows, weight = at[own.at[own.pairs(i)]], own.weight[own.pairs(i)]
                        floor[i] = best_first(levels, rows[rows >= 0], weight[rows >= 0], block.docs, k, int(floor[i]), held.setdefault(i, []))
        rows = [(int(own.own[i]), -s, None if null else d) for i, best in held.items() for s, null, d in best]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], type=t) for j, t in enumerate(arrow)], names=["own", "score", "doc_id"])

    arrow = [pa.int64(), pa.int64(), to_arrow_type(kind)]
    return blocks.select("docs", "lengths", "terms", "ends", "places", "counts").mapInArrow(run, f"own long, score long, doc_id {kind.simpleString()}")


def bounded(level: DataFrame, chunk: Chunk, floors: np.ndarray | None = None) -> DataFrame:
    """Without floors, item, bound, node: each task's FIRST highest of each item. With floors, node: those where
    any item's bound is its floor or more."""
    shared = level.sparkSession.sparkContext.broadcast((chunk, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, floor = shared.value
        top, kept = {}, []
        for batch in batches:
            for row in rows_of(batch):
                bounds = own.bounds(row["terms"], row["most"])
                if floor is not None:
                    if (bounds >= floor).any():
                        kept.append(row["node"])
                    continue
                for i in np.flatnonzero(bounds > 0).tolist():
                    best = top.setdefault(i, [])
                    insort(best, (-int(bounds[i]), row["node"]))
                    del best[FIRST:]
            if floor is not None:
                yield pa.RecordBatch.from_pydict({"node": pa.array(kept, pa.int64())})
                kept = []
        if floor is None:
            rows = [(i, -b, n) for i, best in top.items() for b, n in best]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], names=["item", "bound", "node"])

    return level.select("node", "terms", "most").mapInArrow(run, "node long" if floors is not None else "item long, bound long, node long")


def highest(rows: DataFrame, by: str, k: int, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def children(level: DataFrame, chosen: DataFrame | None, column: str) -> DataFrame:
    """Rows of ``level`` whose ``column`` is a chosen node; all of them where none are chosen."""
    return level if chosen is None else level.join(F.broadcast(chosen.select(F.col("node").alias(column))), column, "left_semi")


def first_floors(blocks: DataFrame, levels: list[DataFrame], corpus: Corpus, chunk: Chunk, k: int) -> np.ndarray:
    """A score for each item that its last place cannot be below: along the highest bounds to a few blocks."""
    nodes = None
    for level in reversed(levels):
        best = bounded(children(level, nodes, "parent"), chunk)
        # FIRST nodes for each of a chunk's items at most
        nodes = durable(highest(best, "item", FIRST, F.col("bound").desc(), "node").select("node").distinct(), "ranked-nodes", few_files=True)
    floors = np.ones(len(chunk.own), dtype=np.int64)
    last = highest(found(children(blocks, nodes, "block"), corpus, chunk, floors, k), "own", k, F.col("score").desc()).where(F.col("rank") == k)
    last = last.select("own", "score").toArrow()  # a row an item of the chunk
    floors[np.searchsorted(chunk.own, last["own"].to_numpy())] = last["score"].to_numpy()
    return floors


def candidates(blocks: DataFrame, levels: list[DataFrame], chunk: Chunk, floors: np.ndarray) -> DataFrame:
    """The blocks whose ranges' bounds reach some item's floor."""
    nodes = None
    for level in reversed(levels):
        kept = durable(bounded(children(level, nodes, "parent"), chunk, floors), "ranked-nodes", few_files=True)
        nodes = kept if kept.count() <= SENT else None  # each block is held to its own bound all the same
    return children(blocks, nodes, "block")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of ``items`` the k documents of the highest scores above 0.

    Terms are runs of ASCII letters (lower-cased), digits and characters beyond ASCII. Equal scores go by
    smaller doc_id, null ids last; rows of equal ids are ranked each. Items of equal or null ids are
    items of their own. Null, empty and termless texts score nothing and are not counted; such items
    have no rows. Texts of any length are read whole. A score past 64 bits (an item of more than some
    10**8 words) is outside this operator. Terms are 64-bit hashes: two of V different ones are taken
    for one with probability V * V / 2**65. Empty tables give an empty result. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    with settings(spark, spark__sql__execution__arrow__maxBytesPerBatch="4m", spark__sql__execution__arrow__maxRecordsPerBatch="4096"), scratch(spark) as keep:
        terms = keep(durable(item_terms(items), "ranked-items", few_files=True))
        blocks = durable(index(docs, asked_filter(terms)), "ranked-blocks")
        corpus = Corpus(*blocks.agg(F.coalesce(F.sum("ready"), F.lit(0)), F.coalesce(F.sum("all_terms"), F.lit(0))).first())
        held = F.zip_with("ends", F.concat(F.array(F.lit(0)), "ends"), lambda a, b: a - b)
        each = blocks.select(F.explode(F.arrays_zip("terms", held.alias("held"))).alias("x")).select(F.col("x.terms").alias("term_hash"), F.col("x.held").alias("held")).where("term_hash IS NOT NULL")
        df = each.groupBy("term_hash").agg(F.sum("held").alias("df"))
        weight = F.floor(1000 * F.log(F.lit(float(2 * corpus.docs + 2)) / (2 * F.col("df") + 1))).cast("long")
        pairs = durable(terms.groupBy("own", "term_hash").agg(F.sum("times").alias("times")).join(df, "term_hash").select("own", "term_hash", (F.col("times") * weight).alias("weight")), "ranked-pairs", few_files=True)
        levels = tree(blocks, corpus)
        chunks, results = max(1, -(-pairs.count() // CHUNK)), []
        for c in range(chunks):
            table = pairs.where(F.pmod(F.xxhash64("own"), F.lit(chunks)) == c).toArrow()  # CHUNK rows or so
            if table.num_rows:
                chunk = Chunk.of(table)
                floors = first_floors(blocks, levels, corpus, chunk, k)
                best = highest(found(candidates(blocks, levels, chunk, floors), corpus, chunk, floors, k), "own", k, F.col("score").desc(), F.col("doc_id").asc_nulls_last())
                results.append(keep(durable(best, "ranked-results", few_files=True)))
    out = results[0] if results else spark.createDataFrame([], f"own long, score long, doc_id {kind}, rank int")
    for r in results[1:]:
        out = out.unionByName(r)
    names = terms.select("own", "item_id").distinct()
    return out.join(names, "own").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
