"""Nearest neighbours by low-dimensional stable projections and kd-trees.

Vectors are projected to a few dimensions with Gaussian (2-stable) weights, so that the squared
projected distance of two vectors is their squared distance times a chi-square variable with
as many degrees of freedom. A kd-tree over a bounded sample of projections cuts the space
into cells; every vector is indexed in the block of its cell (large cells are cut into several
blocks by hash), each block with a kd-tree of its own.

A query walks projected neighbours in increasing order of their projected distance r, verifies
them on the original vectors and stops where the chi-square test holds: with the k-th distance
found so far, d, any vector nearer than d would have a projected distance below r with
probability CONFIDENCE. It does so in its own cell first; the distance found there rules out
the cells whose nearest corner already passes the test, and the rest are searched with that bound.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm.common import received, ship, table
from panelcast.session import cut_lineage

DIMS, CONFIDENCE, SEED = 8, 0.96, 7
#: Rows of a cell aimed at, bound of cells, rows of a block, rows of a leaf, bound of the sample, queries of a chunk.
CELL_ROWS, CELLS, BLOCK_ROWS, LEAF, SAMPLE, CHUNK = 4096, 4096, 16384, 128, 16384, 16384
FOUND = "_q long, _id long, _d double"


def chi_square_quantile(p: float, dims: int) -> float:
    """Of an even number of dimensions, by bisection on the closed form of the distribution."""
    def below(x):
        term, total = 1.0, 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(_id, _v double arrays): one row per id, only vectors that take part."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = rows.select(F.col(id_col).cast("long").alias("_id"), v.alias("_v")).filter("_id IS NOT NULL AND _v IS NOT NULL")
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("_v", lambda x: x != 0))
    return rows.groupBy("_id").agg(F.min("_v").alias("_v"))


class Cells:
    """A complete kd-tree of projections: halves by the median of the widest dimension."""

    def __init__(self, sample: np.ndarray, matrix: np.ndarray, depth: int):
        self.matrix, self.depth = matrix, depth
        self.dim, self.cut = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
        parts = {0: sample @ matrix}
        for node in range(2**depth - 1):
            rows = parts.pop(node)
            if len(rows):
                self.dim[node] = k = int(np.argmax(rows.max(0) - rows.min(0)))
                self.cut[node] = np.median(rows[:, k])
            right = rows[:, self.dim[node]] > self.cut[node]
            parts[2 * node + 1], parts[2 * node + 2] = rows[~right], rows[right]

    def place(self, projected: np.ndarray) -> np.ndarray:
        node = np.zeros(len(projected), np.int64)
        for _ in range(self.depth):
            right = projected[np.arange(len(node)), self.dim[node]] > self.cut[node]
            node = 2 * node + 1 + right
        return node - (2**self.depth - 1)


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _placed(rows: DataFrame, shipped, dim: int) -> DataFrame:
    """rows with the projection's coordinates and the cell."""
    def run(batches):
        cells = received(shipped)
        for batch in batches:
            p = _matrix(batch.column(1), dim) @ cells.matrix
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cells.place(p), pa.int64())] + [pa.array(c) for c in p.T.copy()],
                ["_id", "_v", "_cell"] + [f"_p{i}" for i in range(DIMS)])
    return rows.select("_id", "_v").mapInArrow(
        run, "_id long, _v array<double>, _cell long, " + ", ".join(f"_p{i} double" for i in range(DIMS)))


def _tree(p: np.ndarray) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree over p."""
    leaves, todo = [], [np.arange(len(p))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            leaves.append(rows)
            continue
        q = p[rows]
        k = int(np.argmax(q.max(0) - q.min(0)))
        half = np.argpartition(q[:, k], len(rows) // 2)
        todo += [rows[half[:len(rows) // 2]], rows[half[len(rows) // 2:]]]
    return leaves


def _search(shipped, dim: int, k: int, limit: float):
    """One block: its kd-tree, then each query's incremental walk."""
    def run(key, points, queries):
        out_q, out_id, out_d = [], [], []
        if points.num_rows and queries.num_rows:
            matrix = received(shipped).matrix
            v, ids = _matrix(points["_v"], dim), points["_id"].to_numpy()
            p = v @ matrix
            leaves = _tree(p)
            order = np.concatenate(leaves)
            sizes = np.array([len(x) for x in leaves])
            starts = np.cumsum(sizes) - sizes
            v, ids, p = v[order], ids[order], p[order]
            low, high = np.minimum.reduceat(p, starts), np.maximum.reduceat(p, starts)
            qs, bounds = _matrix(queries["_v"], dim), queries["_bound"].to_numpy()
            for q, qid, bound, x in zip(qs, queries["_id"].to_pylist(), bounds, qs @ matrix, strict=True):
                gap = (np.maximum(0, np.maximum(low - x, x - high)) ** 2).sum(1)
                best_d, best_id = np.empty(0), np.empty(0, np.int64)
                far, at = bound, 0
                walk = np.argsort(gap, kind="stable")
                while at < len(walk) and gap[walk[at]] <= limit * far * far:
                    step = walk[at:at + 4]
                    at += 4
                    rows = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in step])
                    if far < np.inf:  # the same test, point by point
                        rows = rows[((p[rows] - x) ** 2).sum(1) <= limit * far * far]
                    rows = rows[ids[rows] != qid]
                    d = np.sqrt(((v[rows] - q) ** 2).sum(1))
                    best_d, best_id = np.concatenate((best_d, d)), np.concatenate((best_id, ids[rows]))
                    top = np.lexsort((best_id, best_d))[:k]
                    best_d, best_id = best_d[top], best_id[top]
                    if len(best_d) == k:
                        far = min(far, best_d[-1])
                out_q += [qid] * len(best_d)
                out_id.append(best_id)
                out_d.append(best_d)
        return pa.table({"_q": pa.array(out_q, pa.int64()),
                         "_id": pa.array(np.concatenate(out_id) if out_id else [], pa.int64()),
                         "_d": pa.array(np.concatenate(out_d) if out_d else [], pa.float64())})
    return run


def _nearest(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("_q").orderBy("_d", "_id")
    return found.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k)


def nearest(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10,
            confidence: float = CONFIDENCE) -> DataFrame:
    """Each query's k nearest: query_id, rank (from 1), vec_id, score (Euclidean distance).

    Queries are the ids divisible by `every`. Null ids, null and zero vectors, vectors with null or
    non-finite components and those of another length than the most frequent one (the
    smaller, on a tie) take no part. Of rows that repeat an id the smallest vector stands.
    Of equal vectors, only the k + 1 smallest ids can be among the nearest and are indexed.
    Ties go to the smaller id. With no more than k candidates all are returned. An empty
    table, or one without usable vectors, gives an empty result; other columns are ignored.
    """
    spark = rows.sparkSession
    good = cut_lineage(usable(rows, id_col, vec_col))
    common = good.groupBy(F.size("_v").alias("_dim")).count().orderBy(F.desc("count"), "_dim").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = common["_dim"]
    good = good.filter(F.size("_v") == dim)
    same = Window.partitionBy("_v").orderBy("_id")
    points = good.withColumn("_k", F.row_number().over(same)).filter(F.col("_k") <= k + 1).drop("_k")
    points = cut_lineage(points)
    n = points.count()
    sample = points.select("_v").orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).collect()
    sample = np.array([r["_v"] for r in sample])
    matrix = np.random.default_rng(SEED).standard_normal((dim, DIMS))
    depth = max(0, math.ceil(math.log2(max(1, n / CELL_ROWS))))
    shipped = ship(spark, Cells(sample, matrix, min(depth, int(math.log2(CELLS)))))

    index = cut_lineage(_placed(points, shipped, dim))
    stats = index.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), *[F.min(f"_p{i}").alias(f"lo{i}") for i in range(DIMS)],
                                       *[F.max(f"_p{i}").alias(f"hi{i}") for i in range(DIMS)]).collect()  # CELLS rows at most
    boxes = (np.array([r["_cell"] for r in stats]), np.array([[r[f"lo{i}"] for i in range(DIMS)] for r in stats]),
             np.array([[r[f"hi{i}"] for i in range(DIMS)] for r in stats]))
    subs = {r["_cell"]: -(-r["n"] // BLOCK_ROWS) for r in stats}
    asked = good.filter(F.pmod("_id", F.lit(every)) == 0)
    key = ["_cell", "_sub", "_chunk"]
    limit = chi_square_quantile(confidence, DIMS)

    def search(routed: DataFrame) -> DataFrame:
        """routed: (_cell, _id, _v, _bound).  A cell's points are copied for each CHUNK of the queries that come to it."""
        come = routed.groupBy("_cell").count().collect()  # CELLS rows at most
        blocks = F.broadcast(spark.createDataFrame(
            [(r["_cell"], subs[r["_cell"]], -(-r["count"] // CHUNK)) for r in come if r["_cell"] in subs],
            "_cell long, _subs long, _chunks long"))
        pieces = (index.join(blocks, "_cell").withColumn("_sub", F.pmod(F.xxhash64("_id"), F.col("_subs")))
                  .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1))).select(*key, "_id", "_v"))
        routed = (routed.join(blocks, "_cell")
                  .withColumn("_sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_subs") - 1)))
                  .withColumn("_chunk", F.pmod(F.xxhash64("_id"), F.col("_chunks"))))
        return pieces.groupBy(*key).cogroup(routed.select(*key, "_id", "_v", "_bound").groupBy(*key)).applyInArrow(
            _search(shipped, dim, k, limit), FOUND)

    def route(batches):
        cells, low, high = boxes
        matrix = received(shipped).matrix
        for batch in batches:
            x = _matrix(batch.column(1), dim) @ matrix
            home = batch.column(2).to_numpy()
            bound = batch.column(3).to_numpy()
            for i in range(batch.num_rows):
                gap = (np.maximum(0, np.maximum(low - x[i], x[i] - high)) ** 2).sum(1)
                to = cells[(gap <= limit * bound[i] * bound[i]) & (cells != home[i])]
                one = batch.slice(i, 1).take(pa.array(np.zeros(len(to), np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), one.column(0), one.column(1), one.column(3)],
                                                 ["_cell", "_id", "_v", "_bound"])
    asked = cut_lineage(_placed(asked, shipped, dim).select("_id", "_v", "_cell"))
    first = cut_lineage(_nearest(search(asked.withColumn("_bound", F.lit(float("inf")))), k))
    # NaN-free: a query without k neighbours yet has no bound
    bounds = first.groupBy("_q").agg(F.when(F.count(F.lit(1)) >= k, F.max("_d")).alias("_far"))
    again = (asked.join(bounds, asked["_id"] == bounds["_q"], "left")
             .select("_id", "_v", "_cell", F.coalesce("_far", F.lit(float("inf"))).alias("_bound")))
    second = search(again.mapInArrow(route, "_cell long, _id long, _v array<double>, _bound double"))
    best = _nearest(first.select("_q", "_id", "_d").unionByName(second), k)
    return best.select(F.col("_q").alias("query_id"), F.col("_rank").cast("int").alias("rank"),
                       F.col("_id").alias("vec_id"), F.col("_d").alias("score"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
