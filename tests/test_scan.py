"""Scans and greedy cuts of keys that hold most of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from winnow.operators import lines, spans, streams
from winnow.operators.scan import Running, scan


def test_one_key_of_a_million_lines_is_many_tasks(spark):
    n = 1_000_000
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = spark.createDataFrame([(1, "\n".join("x" * (i % 7) for i in range(n)))], "doc_id long, text string")
        rows = lines.line_offsets(docs)
        per = rows.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
        assert sum(r.n for r in per) == n and max(r.n for r in per) <= n / 8
        last = rows.orderBy(F.col("line_no").desc()).first()
        size = sum(i % 7 + 1 for i in range(n)) - 1
        assert (last.line_no, last.byte_end, last.byte_start) == (n, size, size - (n - 1) % 7)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_scan(spark, width):
    rng = random.Random(width)
    rows = [(k, i, rng.randint(0, 9)) for k in ("a", None, "b") for i in rng.sample(range(300), 60)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    out = scan(df, "k", F.col("i"), width, ["i"], s=Running("sum", F.col("v")), before=Running("sum", F.col("v"), own=False), m=Running("max", F.col("v"), own=False), to=Running("next", F.col("i")))
    want = []
    for k in ("a", None, "b"):
        mine = sorted((i, v) for x, i, v in rows if x == k)
        for n, (i, v) in enumerate(mine):
            earlier = [x for _, x in mine[:n]]
            want.append((k, i, v, sum(earlier) + v, sum(earlier), max(earlier, default=None), mine[n + 1][0] if n + 1 < len(mine) else None))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("width", [3, 50])
def test_spans_over_stretches(spark, width):
    rng = random.Random(width)
    make = lambda n: [(k, a, a + rng.randint(0, 30)) for k in (1, 2) for a in rng.sample(range(600), n)]
    own, holes = make(40), make(25)
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, span_start long, span_end long")

    def runs(k, inside):
        places, out = [x for x in range(700) if inside(k, x)], []
        for x in places:
            if out and out[-1][1] == x:
                out[-1][1] = x + 1
            else:
                out.append([x, x + 1])
        return [(k, a, b) for a, b in out]

    covered = lambda rows: lambda k, x: any(a <= x < b for d, a, b in rows if d == k)
    by_own, by_holes = covered(own), covered(holes)
    assert sorted(map(tuple, spans.merge(table(own), width=width).collect())) == runs(1, by_own) + runs(2, by_own)
    left = lambda k, x: by_own(k, x) and not by_holes(k, x)
    assert sorted(map(tuple, spans.subtract(table(own), table(holes), width=width).collect())) == runs(1, left) + runs(2, left)


def walk(sizes, most_items, most_bytes):
    out, batch, count, used = [], 0, 0, 0
    for n in sizes:
        if count and (count >= most_items or used + n > most_bytes):
            batch, count, used = batch + 1, 0, 0
        count, used = count + 1, used + n
        out.append(batch)
    return out


@pytest.mark.parametrize("most_items,most_bytes", [(5, 40), (100, 25), (1, 10), (7, 10_000)])
def test_batches_are_those_of_a_walk(spark, monkeypatch, most_items, most_bytes):
    monkeypatch.setattr(streams, "ROWS", 16)
    rng = random.Random(most_items)
    rows = [(k, f"{i:04d}", rng.choice([0, 0, 1, 3, 8, 20, 60])) for k, n in (("a", 300), (None, 30), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "dir string, name string, bytes long").repartition(5)
    found = streams.batches(df, ["dir"], ["name"], "bytes", most_items=most_items, most_bytes=most_bytes)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = {(r.dir, r.name): r.batch for r in found.collect()}
    for k in ("a", None, "one"):
        mine = [(n, b) for d, n, b in rows if d == k]
        assert [got[k, n] for n, _ in mine] == walk([b for _, b in mine], most_items, most_bytes)


def test_groups_count_gaps(spark):
    units = [(1, 0, 0, 10), (1, 1, 30, 35), (1, 2, 36, 60), (1, 3, 60, 200), (1, 4, 200, 210), (1, 5, 210, 215), (1, 6, 215, 216)]
    df = spark.createDataFrame(units, "doc_id long, n long, a long, z long")
    got = [r.group for r in streams.groups(df, ["doc_id"], ["n"], "a", "z", most_units=2, most_bytes=50).orderBy("n").collect()]
    assert got == [0, 0, 1, 2, 3, 3, 4]


@pytest.mark.parametrize("seed", range(3))
def test_excerpts_grow_to_a_fixpoint(spark, seed):
    """Against the growth of one file, comment by comment."""
    from winnow.operators import excerpts

    rng = random.Random(seed)
    shown = {"comment": "# note", "blank": "  ", "text": "text"}
    files, rows, ranges = {}, [], []
    for doc in range(8):
        kinds = rng.choices(["comment", "blank", "text"], weights=[3, 3, 2 + doc], k=rng.randint(5, 60))
        files[doc] = kinds
        at = 0
        for i, k in enumerate(kinds):
            size = len(shown[k]) + (i + 1 < len(kinds))
            rows.append((doc, i + 1, at, at + size, k))
            at += size
        ranges += [(doc, a, min(len(kinds), a + rng.randint(0, 4))) for a in rng.sample(range(1, len(kinds) + 1), 2)]
    got = lines.excerpts(spark.createDataFrame(rows, "doc_id long, line_no long, byte_start long, byte_end long, kind string"), spark.createDataFrame(ranges, "doc_id long, start_line long, end_line long"))
    want = []
    for doc, kinds in files.items():
        text = "\n".join(shown[k] for k in kinds)
        own, comments = excerpts.Lines(text), [(i + 1, i + 1) for i, k in enumerate(kinds) if k == "comment"]
        grown = [excerpts.grow(own, (max(1, a - 3), min(len(kinds), z + 3)), comments) for d, a, z in ranges if d == doc]
        want += [(doc, a, z) for a, z in excerpts.merge([(own.start(a), own.end(z)) for a, z in grown])]
    assert sorted(map(tuple, got.collect())) == sorted(want)
