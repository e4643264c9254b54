import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from winnow.llm import resampling, words


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(rows, target, buckets=10_000, percent=10, least=20):
    bucket = lambda w: zlib.crc32(w.encode()) % buckets
    s = Counter(bucket(w) for _, t in rows for w in terms(t))
    t = Counter(bucket(w) for x in target for w in terms(x))
    S, T = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for i, x in rows:
        w = sum(gain[bucket(v)] for v in terms(x))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(terms(x)), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    ready = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, r in enumerate(ready[: percent * len(ready) // 100]):
        r[4] = n + 1
    return [tuple(r) for r in out]


def known(r):
    return tuple((v is None, v or 0) for v in r)


def as_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=known)


@pytest.mark.parametrize("group,buckets", [(1 << 18, 10_000), (50, 300)])
def test_same_as_brute_force(spark, sf, monkeypatch, group, buckets):
    monkeypatch.setattr(resampling, "GROUP", group)
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()], buckets)
    assert as_rows(resampling.resample(docs, bench, buckets=buckets)) == sorted(want, key=known)


def test_odd_rows(spark, odd, docs, empty):
    target = docs([(1, "one two", "x"), (2, None, "x"), (3, "", "x")], extra=True)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert as_rows(resampling.resample(odd, target, percent=50, least_words=2)) == sorted(brute(rows, ["one two"], percent=50, least=2), key=known)
    assert as_rows(resampling.resample(odd, empty)) == sorted(brute(rows, []), key=known)
    assert resampling.resample(empty, target).collect() == []
    ties = [(7 - i % 3, "same words " * 20) for i in range(30)]
    drawn = [r for r in as_rows(resampling.resample(docs([(i, t, "a") for i, t in ties]), target)) if r[4]]
    assert sorted(r[4] for r in drawn) == [1, 2, 3] and len({r[0] for r in drawn}) == 1


def test_words(monkeypatch):
    monkeypatch.setattr(words, "RUN", 7)
    for t in ("", " ", "One two  two_three É9é\x7f\x00漢字 ALL", "a" * 40 + " b" * 9 + "-", "x" * 7, "x" * 6 + " " + "y" * 8):
        assert words.word_counts(t.encode()) == Counter(w.encode() for w in terms(t))
