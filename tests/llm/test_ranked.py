import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from winnow.llm import ranked


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def brute(rows, items, k=10):
    counts = [Counter(terms(lower(t))) for _, t in rows]
    n, length = sum(bool(c) for c in counts), sum(c.total() for c in counts)
    df = Counter(w for c in counts for w in c)
    out = []
    for q, text in items:
        asked, scores = Counter(terms(lower(text))), []
        for (i, _), c in zip(rows, counts, strict=True):
            s = 0
            for w, times in asked.items():
                if tf := c[w]:
                    m = 25 + 75 * c.total() * n // length
                    s += times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def known(r):
    return tuple((v is None, v or 0) for v in r)


def as_rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=known)


SMALL = {"BLOCK_ROWS": 7, "FANOUT": 2, "WIDE": 2, "TOP": 3, "CHUNK": 40, "FIRST": 1, "TASK_BITS": 4, "KNOWN": 50}


@pytest.mark.parametrize("small", [{}, SMALL, SMALL | {"SENT": 1}])
def test_same_as_brute_force(spark, monkeypatch, small):
    for name, v in small.items():
        monkeypatch.setattr(ranked, name, v)
    if small:
        monkeypatch.setattr(ranked.Block, "CELLS", 60)
    rng = random.Random(5)
    vocabulary = [f"t{int(rng.paretovariate(0.7))}" for _ in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for i in range(220)]
    rows += [(1000 - i, rows[3][1]) for i in range(40)]  # ties
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for i in range(18)] + [(90, rows[3][1]), (91, "unheard of"), (92, None), (93, "")]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, score int, node string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert as_rows(ranked.search(docs, bench)) == sorted(brute(rows, items), key=known)


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, "One two"), (1, "One two"), (None, "null w5x5 漢字 é"), (2, None), (3, "-- !"), (4, "w1x1 " * 50 + "x" * 200_000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert as_rows(ranked.search(odd, bench)) == sorted(brute(rows, items), key=known)
    assert ranked.search(empty, bench).collect() == [] and ranked.search(odd, bench.limit(0)).collect() == []


def test_low_bounds_are_not_opened():
    """Of 4096 documents that hold the term, only nodes on the way to the best one are opened."""
    lowest = np.ones((1, 4096), dtype=np.int64)
    lowest[0, 1234] = 9
    levels = [lowest]
    while levels[-1].shape[1] > 1:
        levels.append(np.maximum.reduceat(levels[-1], np.arange(0, levels[-1].shape[1], ranked.FANOUT), axis=1))
    opened = []

    class Watched(list):
        def __getitem__(self, at):
            opened.append(at)
            return super().__getitem__(at)

    held = []
    assert ranked.best_first(Watched(levels), np.array([0]), np.array([2]), list(range(4096)), 1, 1, held) == 18
    assert held == [(-18, False, 1234)] and opened == [-1, 2, 1, 0]
    same = []
    ranked.best_first(levels, np.array([0]), np.array([1]), list(range(4096))[::-1], 3, 1, same)
    assert same == [(-9, False, 4095 - 1234), (-1, False, 0), (-1, False, 1)]


def test_long_documents_pass_64_bits():
    corpus = ranked.Corpus(3 * 10**10, 10**13)
    n = np.array([10**9, 5], dtype=np.int64)
    assert corpus.worth(np.array([7, 1]), n).tolist() == [10**9 * t // (1000 * t + 8 * (25 + 75 * x * 3 * 10**10 // 10**13)) for t, x in ((7, 10**9), (1, 5))]
