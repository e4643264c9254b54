import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from winnow.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_are_the_tokenizers(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["", " ", "a", " a", "a ", "a  b", "a\n b", "a b\n\nc 's don't ...  x", "é ü 漢 字", "a  b", "a  b", "x <|endoftext|> y", "\x1c a b"]
    e = packing.Encoder(PATH)
    assert packing.byte_ranks(PATH) is not None and packing.byte_ranks(public_tokenizers.path("word_bpe_49k.json")) is None
    assert [np.frombuffer(x, dtype=e.type).tolist() for x in e.encode(texts)] == plain(texts)


def test_long_runs_do_not_end_a_worker(docs):
    """White space, letters and signs without end, before and after a word."""
    texts = [" " * 1_000_000 + "a", "a" + "\n" * 300_000, "b" + " \t\r\n" * 100_000 + "c", " " * 2_000_000, "x" * 300_000, "-" * 300_000, "a" + " " * 255 + "b" + " " * 256 + "c", "<|endoftext|>" * 3]
    e = packing.Encoder(PATH)
    assert [np.frombuffer(x, dtype=e.type).tolist() for x in e.encode(texts)] == plain(texts)
    assert plain(["a <|endoftext|> b"])[0].count(50256) == 1
    rows = list(enumerate(texts))
    check(packing.pack(docs([(i, t, "s") for i, t in rows]), PATH).collect(), rows)


def test_equal_rows_spread_over_ranges(docs):
    rows = packing.pack(docs([(None, "the same few words in each row", "s")] * 400), PATH, length=64, partitions=4).collect()
    assert len({r.sequence_id >> 32 for r in rows}) == 4 and sum(r.length for r in rows) == 400 * rows[0].doc_tokens


def test_hilbert_visits_each_cell_once_in_unit_steps():
    for d, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        keys = packing.hilbert(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def check(rows, texts):
    """rows of pieces against the documents' ids, by doc_id (texts: list of (doc_id, text))."""
    want = defaultdict(list)
    for (i, _), ids in zip(texts, plain([t for _, t in texts]), strict=True):
        want[i].append(ids + [1])
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        if len(want[i]) == 1:
            ids, at = want[i][0], 0
            for r in sorted(pieces, key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
                at += r.length
            assert at == len(ids)
        else:
            assert sum(r.length for r in pieces) == sum(map(len, want[i]))


def test_pieces_hold_every_id_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs, PATH).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert len({r.sequence_id for r in rows}) >= sum(r.length for r in rows) / 2048


def test_odd_rows(odd, empty):
    check(packing.pack(odd, PATH).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert packing.pack(empty, PATH).collect() == []
