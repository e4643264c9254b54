"""Exact top-k inner products by a pivot-distance index.

Components become integers. With M the largest norm, a vector x gets one more component
sqrt(M^2 - |x|^2) and a query q gets 0 there; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the highest
products are the nearest neighbours and the triangle inequality holds.

Every vector's key is its nearest pivot and its distance to it. The distances of a pivot are cut into
annuli; a pivot's annulus is a cell, and the cells' exact least and greatest distances over all
rows are the directory (pivots * rings rows). A query at distance d from a pivot is at least
max(0, d - greatest, least - d) from all of a cell. Sorted by that bound, a query's cells are taken
round by round, each round up to ``GROWTH`` times as many rows, until the next cell's bound excludes
a score as high as the k-th found. Only cells that some query visits are read in a round, and a cell
is copied once for each ``QUERY_ROWS`` queries that visit it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import discard, durable, map_batches

#: A pivot for so many rows, within these numbers, so that the directory is bounded.
PIVOT_ROWS, PIVOTS, MOST_PIVOTS, RINGS = 8192, 32, 4096, 8
#: Rows that fit pivots and cuts: so many for each pivot, and this many at least.
SAMPLE, SAMPLE_ROWS = 8, 2048
CELL_ROWS, QUERY_ROWS = 8192, 4096
#: A query's first round ends with the cell that brings its rows to this; later ones grow.
FIRST_ROWS, GROWTH = 4096, 8
SLACK = 1e-9


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and v, floor(scale * component) as longs; only rows that take part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad).select("vec_id", v.alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of longs as rows of a matrix; shorter ones are filled with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if (lengths == dims).all():
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims), dtype=np.int64)
    at = np.repeat(np.arange(len(column)), lengths)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles where no sum can reach 2^53."""
    if a.size == 0 or b.size == 0:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    most = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T  # 64-bit integers


class Space:
    """Pivots in the lifted space, and distances to them."""

    def __init__(self, rows: np.ndarray, most: float, pivots: int, rings: int, seed: int = 11):
        self.most = most
        lifted = self.lift(rows)
        rng = np.random.default_rng(seed)
        # farthest-first from a random row, each step among a random part so outliers don't take all
        chosen = [int(rng.integers(len(lifted)))] if len(lifted) else []
        near = np.full(len(lifted), np.inf)
        while len(chosen) < min(pivots, len(lifted)):
            near = np.minimum(near, np.linalg.norm(lifted - lifted[chosen[-1]], axis=1))
            part = rng.permutation(len(lifted))[: max(1, len(lifted) // 4)]
            best = int(part[np.argmax(near[part])])
            if near[best] <= 0 and not near.max() > 0:
                break
            chosen.append(best if near[best] > 0 else int(np.argmax(near)))
        self.pivots = lifted[chosen]
        own, dist = self.nearest(rows) if len(rows) else (np.zeros(0, dtype=np.int64), np.zeros(0))
        cuts = np.linspace(0, 1, rings + 1)[1:-1]
        self.cuts = np.array([np.quantile(dist[own == p], cuts) if (own == p).any() else np.full(rings - 1, np.inf) for p in range(len(chosen))]).reshape(len(chosen), rings - 1)
        self.rings = rings

    def lift(self, rows: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        p = self.pivots
        square = (lifted * lifted).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * lifted @ p.T
        return np.sqrt(np.maximum(square, 0))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(self.lift(rows))
        own = d.argmin(axis=1)
        return own, d[np.arange(len(d)), own]

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, dist = self.nearest(rows)
        return own * self.rings + (self.cuts[own] <= dist[:, None]).sum(axis=1), dist

    def query_distances(self, rows: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float64)
        return self.distances(np.column_stack([x, np.zeros(len(x))]))


class Directory:
    """The cells that hold rows: their bounds, how many rows, and into how many parts each is divided."""

    def __init__(self, rows: list[tuple]):
        rows = sorted(rows)
        self.cells = np.array([r[0] for r in rows], dtype=np.int64)
        self.low, self.high, self.held = (np.array([r[i] for r in rows], dtype=np.float64) for i in (1, 2, 3))
        self.parts = np.ceil(self.held / CELL_ROWS).astype(np.int64)

    def visits(self, space: Space, v: np.ndarray, kth: np.ndarray, taken: float, rows: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) pairs: of each query's sorted cells those that begin at its rows from ``taken``
        on and before ``rows``, unless their bound excludes the k-th score so far (NaN: nothing)."""
        d = space.query_distances(v)[:, self.cells // space.rings]
        bound = np.maximum(np.maximum(d - self.high, self.low - d), 0)
        order = np.argsort(bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, axis=1)
        before = np.cumsum(self.held[order], axis=1) - self.held[order]
        # q.x = (|q|^2 + M^2 - distance^2) / 2 at most; rounding is allowed for
        square = (v.astype(np.float64) ** 2).sum(axis=1)[:, None] + space.most
        close = bound * (1 - SLACK) - SLACK * np.sqrt(square)
        best = (square - np.maximum(close, 0) ** 2) / 2 + SLACK * square
        q, at = np.nonzero((before >= taken) & (before < rows) & (np.isnan(kth)[:, None] | (best >= kth[:, None])))
        return q, self.cells[order[q, at]]


def search(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer products of each query.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows but the
    query's own, others of its id included. Ties go to the smaller vec_id; a query with fewer
    candidates gets all.

    Rows with a null id, or a vector that is null or holds null, NaN or infinity, take no part.
    Vectors of unequal lengths are filled with 0. Repeated candidate rows are candidates each, and
    repeated query rows are answered each. An empty table gives an empty result. Columns other than
    vec_id and embedding are ignored.
    """
    spark = vectors.sparkSession
    base = integers(vectors, scale)
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    dims, most, rows = base.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(norm), F.lit(0.0)), F.count(F.lit(1))).first()
    answer = "uid long, query_id long, vec_id long, score long"
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # The sample fits pivots and ring cuts only; every row is indexed and every bound is exact.
    pivots = min(MOST_PIVOTS, max(PIVOTS, rows // PIVOT_ROWS))
    sample = base.withColumn("h", F.md5(F.col("vec_id").cast("string").cast("binary"))).orderBy("h", "vec_id").limit(max(SAMPLE_ROWS, SAMPLE * pivots)).select("v").toArrow()
    space = spark.sparkContext.broadcast(Space(matrix(sample["v"], dims), most, pivots, RINGS))

    def assign():
        own = space.value
        uid = TaskContext.get().partitionId() << 40

        def one(batch: pa.RecordBatch) -> dict:
            nonlocal uid
            cell, dist = own.cells(matrix(batch.column("v"), dims))
            uid += batch.num_rows
            return {"uid": np.arange(uid - batch.num_rows, uid), "vec_id": batch.column("vec_id"), "v": batch.column("v"), "cell": cell, "dist": dist}

        return one

    index = durable(map_batches(base, assign, "uid long, vec_id long, v array<long>, cell long, dist double"), "topk-index")
    directory = Directory([tuple(r) for r in index.groupBy("cell").agg(F.min("dist"), F.max("dist"), F.count(F.lit(1))).collect()])  # a row a cell
    shared = spark.sparkContext.broadcast(directory)
    queries = durable(index.where(F.col("vec_id") % every == 0).select("uid", F.col("vec_id").alias("query_id"), "v"), "topk-queries")

    def visits(asking: DataFrame, taken: float, limit: float) -> DataFrame:
        """uid, cell: the cells that queries (uid, v, kth) visit in this round."""

        def make():
            own, known = space.value, shared.value

            def one(batch: pa.RecordBatch) -> dict:
                kth = batch.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
                uid, v = batch.column("uid").to_numpy(), matrix(batch.column("v"), dims)
                pairs = [known.visits(own, v[a : a + 256], kth[a : a + 256], taken, limit) for a in range(0, len(uid), 256)]
                return {"uid": np.concatenate([uid[q + 256 * i] for i, (q, _) in enumerate(pairs)]), "cell": np.concatenate([c for _, c in pairs])}

            return one

        return map_batches(asking.select("uid", "v", "kth"), make, "uid long, cell long")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, own, x, q = left["vec_id"].to_numpy(), left["uid"].to_numpy(), matrix(left["v"], dims), matrix(right["v"], dims)
        uid, query_id = right["uid"].to_numpy(), right["query_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, own, x = ids[order], own[order], x[order]
        out = []
        for a in range(0, len(q), 512):
            score = products(q[a : a + 512], x)
            for i, row in enumerate(score):
                mine = np.flatnonzero(own != uid[a + i])
                if len(mine) > k:
                    # ties at the cut go to the smaller id: all rows at the k-th score are candidates
                    edge = np.partition(row[mine], len(mine) - k)[len(mine) - k]
                    mine = mine[row[mine] >= edge]
                    mine = mine[np.lexsort((ids[mine], -row[mine]))[:k]]
                out.append((np.full(len(mine), a + i), ids[mine], row[mine]))
        at, vec_id, score = (np.concatenate(c) if out else np.zeros(0, dtype=np.int64) for c in (zip(*out, strict=True) if out else ((), (), ())))
        return pa.table({"uid": uid[at], "query_id": query_id[at], "vec_id": vec_id, "score": score})

    parts = dict(zip(directory.cells.tolist(), directory.parts.tolist(), strict=True))
    keys = ("cell", "part", "block")

    def meet(visited: DataFrame) -> DataFrame:
        """The best of each visited part of a cell for each query that visits it."""
        counts = visited.groupBy("cell").count().collect()  # a row a cell
        plan = F.broadcast(spark.createDataFrame([(r["cell"], parts[r["cell"]], -(-r["count"] // QUERY_ROWS)) for r in counts], "cell long, parts long, blocks long"))
        many = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        held = index.join(plan, "cell").select("cell", F.pmod(F.xxhash64("uid"), F.col("parts")).alias("part"), many("blocks").alias("block"), "uid", "vec_id", "v")
        asked = visited.join(plan, "cell").select("uid", "cell", F.pmod(F.xxhash64("uid"), F.col("blocks")).alias("block"), many("parts").alias("part")).join(queries, "uid")
        return held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(best, answer)

    by_score = Window.partitionBy("uid").orderBy(F.col("score").desc(), "vec_id")
    top = lambda found: found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    none = spark.createDataFrame([], answer)
    found, taken, limit = none, 0.0, float(FIRST_ROWS)
    while True:
        kth = found.groupBy("uid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
        visited = durable(visits(queries.join(kth, "uid", "left"), taken, limit), "topk-visits")
        if more := not visited.isEmpty():
            before, found = found, durable(top(found.unionByName(meet(visited))).drop("rank"), "topk-found")
            discard(before)
        discard(visited)
        if limit >= rows:
            break
        # a round without visits may lie within one large cell; the next one is the last
        taken, limit = limit, limit * GROWTH if more else float(rows)
    discard(index, queries)
    return top(found).select("query_id", "rank", "vec_id", "score")
