import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.llm import graph, jaccard, shingles


def sets_of(text, words=3):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + words]) for i in range(len(ws) - words + 1)} if len(ws) >= words else ({tuple(ws)} if ws else set())


def brute(rows, num=90, den=100, words=3):
    """component by row number, straight from the definition"""
    sets = [sets_of(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc_id))
    return out


def key(r):
    return tuple((v is None, v) for v in r)


def agree(df, rows):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=key)
    assert got == sorted(brute(rows), key=key)


def made(seed):
    """Chains of edits, copies, documents around one passage, short ones and ties at the bound."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for g in range(12):
        base = [word() for _ in range(r.choice([5, 12, 30, 80, 200]))]
        for _ in range(r.choice([1, 2, 5, 25])):
            if r.random() < 0.6:
                base = list(base)
                base[r.randrange(len(base))] = word()
            rows.append(" ".join(base))
        if g % 3 == 0:
            rows.append(" ".join(base).upper())
    for _ in range(40):
        rows.append(" ".join([*(word() for _ in range(r.randrange(8))), *passage, *(word() for _ in range(r.randrange(8)))]))
    nine = [f"t{i}" for i in range(12)]  # 10 shingles; without the last word 9: exactly at 90 %
    rows += [" ".join(nine), " ".join(nine[:-1]), " ".join(nine[:-2])]
    rows += ["", " \n", "a", "A", "a b", "a  b", "b a", "a b c", "A\tB\nC"]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 3), (3, 7)])
def test_components_are_those_of_all_pairs(docs, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = made(seed)
    agree(jaccard.components(docs([(i, t, "s") for i, t in rows])), rows)


def test_hot_columns_come_last(docs, monkeypatch):
    """With hardly any column small, the second order of columns, pairs of columns and blocks are met."""
    monkeypatch.setattr(jaccard, "HOT", 4)
    monkeypatch.setattr(jaccard, "SMALL", 3)
    monkeypatch.setattr(jaccard, "ELEMENTS", 600)
    rows = made(5)
    agree(jaccard.components(docs([(i, t, "s") for i, t in rows])), rows)


def test_pairs_of_columns_hold_every_link(docs, monkeypatch):
    """Documents of a few common passages only, whose every column is hot."""
    monkeypatch.setattr(jaccard, "HOT", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    r = random.Random(9)
    passages = [" ".join(f"p{k}w{i}" for i in range(r.choice([6, 12, 20]))) for k in range(7)]
    rows = [(i, " ".join(r.sample(passages, r.choice([1, 2, 3, 5])))) for i in range(90)]
    rows += [(100 + i, " ".join([*r.sample(passages, 4), "tail"][: r.choice([4, 5])])) for i in range(40)]
    agree(jaccard.components(docs([(i, t, "s") for i, t in rows])), rows)
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.components(docs([(i, t, "s") for i, t in rows]), 3, 60, 100).collect()), key=key)
    assert got == sorted(brute(rows, 60, 100), key=key)


def test_five_words_and_four_fifths(docs):
    rows = made(6)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(docs([(i, t, "s") for i, t in rows]), 5, 80, 100).collect()), key=key)
    assert got == sorted(brute(rows, 80, 100, 5), key=key)


def test_ids_may_be_text(docs):
    rows = [(i, t) for i, t in made(7)[:60]]
    plain = docs([(i, t, "s") for i, t in rows])
    named = jaccard.components(plain.withColumn("doc_id", F.format_string("%04d", "doc_id")))
    whole = {(f"{r.doc_id:04d}", r.n_shingles, f"{r.component_id:04d}") for r in jaccard.components(plain).collect()}
    assert {tuple(r) for r in named.collect()} == whole


def test_odd_rows(odd, empty):
    agree(jaccard.components(odd), [(r.doc_id, r.text) for r in odd.collect()])
    assert jaccard.components(empty).collect() == []


def test_filter_hash_is_sparks(spark):
    x = np.array([0, 1, -1, 123456789012345, -(1 << 63)], dtype=np.int64)
    rows = spark.createDataFrame([(int(v),) for v in x], "k long").select(F.xxhash64("k")).collect()
    assert jaccard.spark_hash(x).view(np.int64).tolist() == [r[0] for r in rows]


def test_parity_maps_bound_the_difference():
    s = shingles.shingle_sets([b"a b c d e f", b"a b c d e g h", b""], 3)
    maps = shingles.parity_maps(s)
    assert np.bitwise_count((maps[0] ^ maps[1]).view(np.uint64)).sum() <= 3 and s.size.tolist() == [4, 5, 0] and not maps[2].any()


def test_long_maps_bound_the_difference():
    texts = [" ".join(f"w{i}" for i in range(a, a + n)).encode() for a, n in ((0, 3000), (100, 3000), (50, 5200), (9000, 3000), (0, 20))]
    s = shingles.shingle_sets(texts, 3)
    maps = shingles.long_maps(s, 90, 100)
    assert maps[4] is None and len(maps[0]) * 8 == 1024 and len(maps[2]) * 8 == 2048
    assert shingles.long_set(80, 100) == 960 and len(shingles.long_maps(s, 80, 100)[0]) * 8 == 2048
    assert shingles.bits_apart(maps[0], maps[1]) <= 200 and shingles.bits_apart(maps[0], maps[2]) <= 50 + 2250
    assert shingles.bits_apart(maps[0], maps[3]) > 400


def test_long_documents(docs):
    r = random.Random(4)
    words = [f"w{r.randrange(10**6)}" for _ in range(2600)]
    rows = [" ".join(words), " ".join([*words[:-40], *(f"x{i}" for i in range(40))]), " ".join(words[:1300] + [f"y{i}" for i in range(1300)]), " ".join([*words[:3], *(f"z{i}" for i in range(2500))]), " ".join([*words[:3], *(f"q{i}" for i in range(2500))])]
    rows = list(enumerate(rows))
    agree(jaccard.components(docs([(i, t, "s") for i, t in rows])), rows)


def test_products_and_forests():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype("<u8") for _ in range(20)]
    got = jaccard.overlap_counts([s.tobytes() for s in sets])
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(20) for j in range(20) if i != j)
    linked = np.zeros((6, 6), dtype=bool)
    for i, j in ((0, 1), (1, 2), (0, 2), (3, 4)):
        linked[i, j] = linked[j, i] = True
    x, y = jaccard.forest(linked, np.arange(6))
    assert len(x) == 3 and {frozenset(e) for e in zip(x.tolist(), y.tolist(), strict=True)} <= {frozenset(e) for e in ((0, 1), (1, 2), (0, 2), (3, 4))}
    x, y = jaccard.forest(linked, np.arange(6), np.array([0, 0, 0, 3, 4, 0]))
    assert len(x) == 1


def test_connected(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 7), (200, 201), (201, 202), (300, 300)]
    got = {r.node: r.root for r in graph.connected(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 0, 200: 200, 201: 200, 202: 200, 300: 300}
