import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from winnow.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, weights, share=1.5, cap=2.0):
    """Targets by resharing the excess until no source is above its cap."""
    goal, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        left = goal - sum(fixed.values())
        w = sum(weights[s] for s in free)
        now = {s: left * weights[s] / w for s in free}
        above = [s for s in free if now[s] >= cap * sizes[s]]
        if not above:
            return fixed | now
        fixed |= {s: cap * sizes[s] for s in above}
        if len(above) == len(free):
            return fixed


def brute(rows):
    size = {k: len(WORD.findall(t or "")) for k, (_, t, _) in enumerate(rows)}
    per = defaultdict(int)
    for k, (_, _, s) in enumerate(rows):
        per[s] += size[k]
    order = sorted(per, key=lambda s: (s is None, s or ""))
    target = fill(dict(per), {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    out = []
    for s in per:
        own = sorted((hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest(), size[k], k) for k, (i, t, x) in enumerate(rows) if x == s)
        at = 0
        for _, n, k in own:
            middle = at + n / 2
            taken = n * ((middle < target[s]) + (middle + per[s] < target[s]))
            out.append((rows[k][0], n, per[s], round(target[s], 6), taken))
            at += n
    return sorted(out, key=str), target


def test_same_as_filling_by_hand(docs, odd):
    rows = [(i, "w " * (i * 7 % 40), f"s{i % 7 if i % 3 else 0}") for i in range(300)] + [(i, "x y", None) for i in range(300, 330)]
    for df in (docs(rows, extra=True), odd):
        data = [(r.doc_id, r.text, r.source) for r in df.collect()]
        got = mixing.mix(df).collect()
        want, target = brute(data)
        assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got), key=str) == want
        assert all(r.taken <= 2 * r.size for r in got)
        per = defaultdict(int)
        for r in got:
            per[r.source] += r.taken
        largest = max(r.size for r in got)
        assert all(abs(per[s] - target[s]) <= largest / 2 + 1e-9 for s in target)


def test_empty_and_rerun(docs, empty, sf, spark):
    assert mixing.mix(empty).collect() == []
    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(mixing.mix(d).collect()) == sorted(mixing.mix(d.repartition(7)).collect())


def test_positions_follow_the_schedule(spark):
    """The share of words placed before t is the schedule's integral up to t."""
    shape = F.array(F.lit(1.5), F.lit(1.0), F.lit(0.5))
    t = [r.t for r in spark.range(1001).select(mixing.schedule_time(F.col("id") / 1000.0, shape, 3).alias("t")).collect()]
    assert t[0] == 0 and t[-1] == pytest.approx(1) and t == sorted(t)
    for u, x in zip(range(1001), t, strict=True):
        integral = 1.5 * x - 0.5 * x * x  # of 1.5 - t, whose whole is 1
        assert integral == pytest.approx(u / 1000, abs=1e-9)


def test_order_by_position(docs):
    rows = mixing.mix_order(mixing.mix(docs([(i, "a b c", f"s{i % 3}") for i in range(60)]))).collect()
    read = [r.positions[0] for r in rows if r.positions]
    assert read == sorted(read) and all(r.positions == [] for r in rows[len(read) :])


def test_each_reading_has_its_place(docs):
    """Two epochs of a source stand one after the other, each document where the integral says."""
    rows = [(i, "a b c d", "s0") for i in range(30)] + [(i, "a b", "s1") for i in range(30, 40)]
    mixed = mixing.mix(docs(rows))
    plan = [tuple(r) for r in mixing.schedule(mixed).collect()]
    assert [p for *_, p in plan] == sorted(p for *_, p in plan)
    assert sorted((i, k) for i, k, _ in plan) == sorted((r.doc_id, k + 1) for r in mixed.collect() for k in range(r.readings))
    target, at, goal = {r.source: r.target for r in mixed.collect()}["s0"], 0, {}
    own = sorted((hashlib.md5(f"{i}:{t}".encode()).hexdigest(), i) for i, t, s in rows if s == "s0")
    for epoch in range(2):
        for _, i in own:
            goal[i, epoch + 1] = (at + 2) / target
            at += 4
    for i, k, p in plan:
        if i < 30:
            assert 1.5 * p - 0.5 * p * p == pytest.approx(goal[i, k])
    with pytest.raises(ValueError):
        mixing.mix(docs(rows), cap=1.5)
