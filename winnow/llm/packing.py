"""Packing documents into fixed-length sequences along a space-filling curve.

A document's token counts, hashed into a bounded number of buckets, make a vector; a fixed random
projection takes it to a few dimensions, and its cell's index on the Hilbert curve is the key.
Documents are range-sorted by that key and each range's stream of tokens is cut into sequences, so
that a sequence holds documents that are near each other on the curve.

Only the last sequence of a range is not full. It is cut again into runs whose lengths are powers
of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .base import durable, map_slices, record, with_bytes

SEQUENCE = 2048
END_ID = 1
BUCKETS, DIMS, BITS = 4096, 4, 12
#: Bytes of ids to a range, so that more input makes more ranges and not larger ones.
RANGE_BYTES = 64 << 20
#: Rows of a block where an order is kept, and how many blocks there are at least.
ORDER_ROWS, ORDER_BLOCKS = 1024, 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: The byte-level pre-tokenizer's division of a text, with possessive quantifiers.
DIVISION = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Token bytes -> id of a byte-level BPE file, if its ids stand in the order of its merges.

    Then merging by least id is merging by merge order, and any byte-pair encoder gives the
    file's ids. None if the file is of another kind.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    # printable bytes stand for themselves, the others for the code points from 256 on, in order
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    byte_of = {chr(i if i in plain else next(others)): i for i in range(256)}
    special = {t["content"] for t in spec["added_tokens"]}
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [vocabulary.get(a + b, -1) for a, b in pairs]
    if made != sorted(set(made)) or (made and made[0] < 256) or len(made) + 256 != len(vocabulary):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items()}


#: White space that the faster encoder, which steps back through it, is not asked to divide.
LONG_SPACE = re.compile(r"\s{256}")


class Encoder:
    """Token ids of whole texts by a ``tokenizers`` file, special tokens not added.

    Where the file's ids stand in merge order (see ``byte_ranks``) a faster byte-pair encoder gives
    the same ids; files of another kind, texts that hold the string of an added token (which has an
    id of its own) and texts with very long white space are left to ``tokenizers``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.type = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks := byte_ranks(path):
            import tiktoken

            self.fast = tiktoken.Encoding("file", pat_str=DIVISION, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> list[int]:
        if self.fast is None or LONG_SPACE.search(text) or any(t in text for t in self.added):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes of ``self.type``."""
        return [np.array(self.ids(t), dtype=self.type).tobytes() for t in texts]


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The Hilbert index of integer points (n, d) with ``bits`` bits a coordinate.

    Works on the transposed index: from the highest bit down, a set bit of coordinate i inverts
    the lower bits of coordinate 0, an unset one exchanges them with coordinate i's; then the
    coordinates are Gray-decoded and their bits interleaved.
    """
    x = cells.astype(np.int64).copy()
    n, d = x.shape
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(d):
            is_set = (x[:, i] >> b) & 1 == 1
            swap = np.where(is_set, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(is_set, low, swap)
            x[:, i] ^= swap
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(n, dtype=np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, d - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(n, dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def projection(vocabulary: int) -> np.ndarray:
    """For each token id, the projection of its hashed coordinate to ``DIMS`` dimensions."""
    basis = np.random.default_rng(20240229).standard_normal((BUCKETS, DIMS)).astype(np.float32)
    ids = np.arange(vocabulary, dtype=np.uint64)
    return basis[((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64) % BUCKETS]


def curve_keys(ids: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The Hilbert key of each document; ``ids`` holds all documents' ids, one after another."""
    sums = np.add.reduceat(table[ids], starts, axis=0)
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    unit = sums / np.where(norms == 0, 1, norms)
    cells = np.minimum(((unit + 1) * (1 << (BITS - 1))).astype(np.int64), (1 << BITS) - 1)
    return hilbert(cells, BITS)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = END_ID, order: Sequence[Column] | None = None) -> DataFrame:
    """A row's number, doc_id, curve key, the document's ids with ``end_id`` after them as bytes, and their width.

    ``order``, a file's name and a number, is given as ``file`` and ``at``; without it they are null."""

    def make():
        encoder = Encoder(tokenizer)
        table = projection(max(encoder.size, end_id + 1))
        end = np.array([end_id], dtype=encoder.type).tobytes()
        width = encoder.type.itemsize
        uid = TaskContext.get().partitionId() << 40

        def one(batch: pa.RecordBatch) -> dict:
            nonlocal uid
            m = batch.num_rows
            out = [x + end for x in encoder.encode(batch.column("utf8").cast(pa.string()).to_pylist())]
            starts = np.cumsum([0] + [len(x) // width for x in out[:-1]])
            keys = curve_keys(np.frombuffer(b"".join(out), dtype=encoder.type), starts, table)
            uid += m
            return {"uid": np.arange(uid - m, uid), "doc_id": batch.column("doc_id"), "curve": keys, "ids": out, "width": [width] * m, "bytes": [len(x) for x in out], "file": batch.column("file"), "at": batch.column("at")}

        return one

    file, at = order or (F.lit(None).cast("string"), F.lit(None).cast("long"))
    rows = with_bytes(docs.select("doc_id", "text", file.alias("file"), at.alias("at")), "doc_id", "file", "at")
    return map_slices(rows, make, "uid long, doc_id long, curve long, ids binary, width int, bytes long, file string, at long")


class Cutter:
    """Cuts a stream of documents into sequences; the last, open one is held back."""

    def __init__(self, first: int, length: int):
        self.next, self.length, self.at = first, length, 0
        self.rows: list[tuple] = []
        self.open: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            n = min(self.length - self.at, len(ids) - start)
            self.open.append((doc_id, start, ids[start : start + n], len(ids)))
            start += n
            self.at += n
            if self.at == self.length:
                self._close(self.open)
                self.open, self.at = [], 0

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def finish(self) -> None:
        """Cut what is left into runs whose lengths are powers of two, the longest first."""
        pieces, left = self.open, self.at
        self.open, self.at = [], 0
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            run = []
            while want:
                doc_id, start, ids, total = pieces[0]
                n = min(want, len(ids))
                run.append((doc_id, start, ids[:n], total))
                pieces = pieces[1:] if n == len(ids) else [(doc_id, start + n, ids[n:], total), *pieces[1:]]
                want -= n
            self._close(run)


def pack(docs: DataFrame, tokenizer: str, length: int = SEQUENCE, end_id: int = END_ID, partitions: int | None = None, order: Sequence[Column] | None = None) -> DataFrame:
    """Pack every document; one row per piece (see ``PIECES``).

    A document's ids are cut wherever a sequence is full. sequence_id is unique over the table:
    the range's number times 2**32 plus a count. Null or empty text is the end id alone. A text
    that holds a special token's string gets that token's id there, as ``tokenizers`` does. Equal
    keys are told apart by doc_id and then by the row's number in the table as read, so copies,
    repeated rows and rows with null ids spread over ranges and are packed each on its own. A text
    of any length is encoded whole, one slice of texts at a time, and cut over sequences. ``order``, a file's
    name and a row's number in it, keeps the rows' order by blocks of ORDER_ROWS rows (fewer, so that
    there are ORDER_BLOCKS at least): the curve orders a block's rows, not the table. An empty table gives an empty result. Columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    tokens = durable(tokenize(docs, tokenizer, end_id, order), "packing-tokens")
    size, rows = tokens.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    block = F.floor(F.col("at") / max(1, min(ORDER_ROWS, rows // ORDER_BLOCKS))).alias("block")
    by = ["curve", "doc_id", "uid"] if order is None else ["file", "block", "curve", "doc_id", "uid"]
    placed = tokens.select("doc_id", "ids", "width", "curve", "uid", *([] if order is None else ["file", block]))
    placed = placed.repartitionByRange(n, *by).sortWithinPartitions(*by).select("doc_id", "ids", "width")
    schema = StructType.fromDDL(PIECES)
    arrow = to_arrow_schema(schema)
    names = arrow.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(TaskContext.get().partitionId() << 32, length)

        def rows() -> pa.RecordBatch:
            out, cutter.rows = cutter.rows, []
            return record(dict(zip(names, zip(*out, strict=True), strict=True)) if out else {k: [] for k in names}, arrow)

        for batch in batches:
            for doc_id, ids, width in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "width")), strict=True):
                cutter.add(doc_id, np.frombuffer(ids, dtype=f"<u{width}"))
            if cutter.rows:
                yield rows()
        cutter.finish()
        if cutter.rows:
            yield rows()

    return placed.mapInArrow(run, schema)
