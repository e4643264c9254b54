import math

import numpy as np
import pytest

from winnow.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string, cell string"


def brute(rows, k, every):
    good = [(i, [math.floor(float(np.float32(c)) * 1024) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for at, (q, a) in enumerate(good):
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for n, (i, b) in enumerate(good) if n != at)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("rows_to_a_cell,queries", [(8192, 4096), (20, 3)])
def test_same_as_all_products(spark, monkeypatch, rows_to_a_cell, queries):
    for name, v in (("CELL_ROWS", rows_to_a_cell), ("QUERY_ROWS", queries), ("FIRST_ROWS", 40), ("GROWTH", 3), ("PIVOTS", 6), ("RINGS", 3)):
        monkeypatch.setattr(topk, name, v)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((5, 8))
    rows = [(i, [float(c) for c in centres[i % 5] + 0.2 * rng.standard_normal(8)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # a common vector: ties
    rows += [(None, rows[0][1]), (2000, None), (2010, [1.0, None]), (2020, [float("nan")] * 8), (2030, [float("inf")] * 8), (2040, []), (2050, [3.0, -2.0]), (5, rows[5][1]), (20, rows[20][1]), (20, rows[21][1])]
    df = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(df, every=10).collect())
    assert got == brute(rows, 10, 10)


def test_cells_are_copied_only_where_queries_visit(spark, monkeypatch):
    """Clusters far apart: a query near one reads that one, however many blocks of queries there are."""
    for name, v in (("QUERY_ROWS", 2), ("FIRST_ROWS", 30), ("PIVOTS", 8), ("RINGS", 2)):
        monkeypatch.setattr(topk, name, v)
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in np.eye(8)[i % 8] * 50 + 0.1 * rng.standard_normal(8)]) for i in range(800)]
    df = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)
    x = np.array([[math.floor(float(np.float32(c)) * 1024) for c in v] for _, v in rows])
    space = topk.Space(x, float((x.astype(float) ** 2).sum(axis=1).max()), 8, 2)
    cell, dist = space.cells(x)
    known = topk.Directory([(c, dist[cell == c].min(), dist[cell == c].max(), int((cell == c).sum())) for c in np.unique(cell)])
    q = x[::100]
    first, _ = known.visits(space, q, np.full(8, np.nan), 0, 30)
    kth = np.sort(q @ x.T, axis=1)[:, -11].astype(float)
    more, _ = known.visits(space, q, kth, 30, 800)
    assert len(first) + len(more) <= 8 * 4  # of 8 * 16 or so
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(df, every=100).collect())
    assert got == brute(rows, 10, 100)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0, "", ""), (3, [0.5, 0.5], 0, "", "")], SCHEMA)
    assert [tuple(r) for r in topk.search(df).collect()] == [(0, 1, 3, 1024 * 512 + 2048 * 512)]
    assert topk.search(df.limit(0)).collect() == [] and topk.search(df.where("vec_id = 0")).collect() == []
    same = spark.createDataFrame([(i, [0.0], 0, "", "") for i in range(200)], SCHEMA)
    assert [(r.query_id, r.vec_id) for r in topk.search(same, k=2).orderBy("query_id", "rank").collect()] == [(0, 1), (0, 2), (100, 0), (100, 1)]


def test_bounds_leave_cells_out():
    rng = np.random.default_rng(1)
    x = np.floor(1024 * np.concatenate([rng.standard_normal((200, 4)) * 0.1 + c for c in np.eye(4) * 9])).astype(np.int64)
    space = topk.Space(x, float((x.astype(float) ** 2).sum(axis=1).max()), 8, 4)
    own, dist = space.nearest(x)
    lifted = space.lift(x)
    q = np.column_stack([x[:1].astype(float), [[0.0]]])
    true = np.linalg.norm(lifted - q, axis=1)
    d = space.query_distances(x[:1])[0]
    assert (np.abs(d[own] - dist) <= true + 1e-6).all()
