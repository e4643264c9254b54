import hashlib
import math
import zlib
from collections import Counter, defaultdict

from winnow.llm import sharding


def winner(doc_id, weights):
    key = "null" if doc_id is None else str(doc_id)
    races = []
    for s, w in enumerate(weights):
        u = (int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        races.append((-math.log(u) / w, s))
    return min(races)[1]


def check(df, weights, grown):
    rows = sharding.shard(df, weights, grown).collect()
    data = [(r.doc_id, r.text or "") for r in df.collect()]
    want = Counter((i, len(t.encode()) + 8, zlib.crc32(t.encode()), winner(i, weights), winner(i, grown)) for i, t in data)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, len(weights))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows


def test_same_as_by_hand(docs, odd):
    check(docs([(i, f"text {i}", "s") for i in range(300)], extra=True), [1.0] * 24, [1.0] * 25)
    check(odd, [1.0] * 24, [1.0] * 25)


def test_weights_share_the_rows(docs):
    n = Counter(r.shard for r in check(docs([(i, "", "s") for i in range(4000)]), [1.0, 3.0], [1.0, 3.0, 1.0]))
    assert abs(n[1] / 4000 - 0.75) < 0.03


def test_empty(empty):
    assert sharding.shard(empty, [1.0] * 3).collect() == []
    assert all(r.grown_shard is None for r in sharding.shard(empty, [1.0]).collect())
