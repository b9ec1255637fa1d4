"""Exact nearest neighbours by a block matrix join with int8 tiles.

Unit vectors are quantised to int8 with a scale of their own; the length of what
rounding took away is kept with them. A tile multiplies a block of queries with a
block of candidates in integers; the product and the two lengths bound each cosine
from both sides. Only pairs whose upper bound reaches the k-th best lower bound of
their query are computed again in double precision, and heaps keep k of them.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read, shared_dir

#: Rows of a block: of queries at most, of queries multiplied at a time, of candidates. Large blocks of queries keep copies of the candidates few.
QUERY_BLOCK, STRIP, CANDIDATE_BLOCK = 65536, 1024, 4096
#: Numbers in a block of queries at most (32 MB).
QUERY_CELLS = 1 << 22


def in_range(vectors: np.ndarray) -> np.ndarray:
    """Vectors whose squares could overflow or vanish are scaled by powers of two, which changes no cosine; others stay."""
    with np.errstate(over="ignore", under="ignore"):
        squares = np.einsum("ij,ij->i", vectors, vectors)
        odd = ~((squares > 1e-200) & (squares < 1e200))
        if odd.any():
            vectors = vectors.copy()
            vectors[odd] = np.ldexp(vectors[odd], -np.frexp(np.abs(vectors[odd]).max(axis=1))[1][:, None])
    return vectors


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes as floats, scale, length of the residue) of the vectors' unit forms."""
    unit = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    exact = np.float32 if vectors.shape[1] <= 1000 else np.float64  # integer products below 2^24 are exact in float32
    return codes.astype(exact), scale, lost


def tile(q_rows: np.ndarray, q: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, int, float]]:
    """(query row, candidate row, candidate id, cosine) of each query's k best candidates but itself; ties to the smaller id, then row.

    With x = s_x X + e_x: x.y = s_x s_y X.Y + e_x.y + (x - e_x).e_y, so the error is at
    most |e_x| + |e_y| (1 + |e_x|).
    """
    q, c = in_range(q), in_range(c)
    c_quantised, c_norm = quantise(c), np.sqrt(np.einsum("ij,ij->i", c, c))
    found = []
    for at in range(0, len(q), STRIP):
        found += _strip(q_rows[at : at + STRIP], q[at : at + STRIP], c_rows, c_ids, c, c_norm, c_quantised, k)
    return found


def _strip(q_rows, q, c_rows, c_ids, c, c_norm, c_quantised, k):
    (qx, qs, qe), (cx, cs, ce) = quantise(q), c_quantised
    near = (qx @ cx.T).astype(np.float64) * qs[:, None] * cs[None, :]
    error = qe[:, None] + ce[None, :] * (1 + qe[:, None]) + 1e-9
    own = q_rows[:, None] == c_rows[None, :]
    low, high = np.where(own, -np.inf, near - error), near + error
    at = max(low.shape[1] - k, 0)
    bound = np.partition(low, at, axis=1)[:, at] if low.shape[1] else np.full(len(q), -np.inf)
    rows, cols = np.nonzero((high >= bound[:, None]) & ~own)
    q_norm = np.sqrt(np.einsum("ij,ij->i", q, q))
    heaps: list[list[tuple[float, int, int]]] = [[] for _ in range(len(q))]
    for begin in range(0, len(rows), 65536):
        r, s = rows[begin : begin + 65536], cols[begin : begin + 65536]
        exact = np.einsum("ij,ij->i", q[r], c[s]) / (q_norm[r] * c_norm[s])
        for i, score, vec, row in zip(r.tolist(), exact.tolist(), c_ids[s].tolist(), c_rows[s].tolist(), strict=True):
            entry, heap = (score, -vec, -row), heaps[i]
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
    return [(int(q_rows[i]), -row, -vec, score) for i, heap in enumerate(heaps) for score, vec, row in heap]


def usable(embedding: Column) -> Column:
    """Vectors that are not null, hold only finite components, and one that is not zero."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 5, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest other rows by cosine, exactly.

    `vectors` has vec_id and embedding (array of numbers). Rows without vec_id, and
    vectors that are null, zero or hold null or non-finite components, take no part;
    very large and very small components are fine. Every row is a candidate of every
    other one: rows that share a vec_id ask on their own, with ranks of their own, and
    find each other. Vectors of other lengths than the query's are no candidates. Of
    equal vectors the k + 1 rows of least id are candidates, which hold all that can be
    among the nearest, so large groups of copies make no extra pairs. Ties go to the
    smaller vec_id; fewer candidates give fewer rows; an empty table gives none; other
    columns are dropped.
    """
    good = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("asked"))
    good = materialise(good.withColumns({"row": F.monotonically_increasing_id(), "dim": F.size("v")}), "vectors")
    alike = Window.partitionBy("v").orderBy("vec_id", "row")
    candidates = good.withColumn("nth", F.row_number().over(alike)).where(F.col("nth") <= k + 1).select("row", "vec_id", "v", "dim")
    n_candidates, n_queries, dim = good.agg(F.count(F.lit(1)), F.count_if("asked"), F.max("dim")).first()
    query_block = max(1, min(query_block, max(STRIP, QUERY_CELLS // max(dim or 1, 1))))
    c_blocks, q_blocks = max(1, -(-n_candidates // candidate_block)), max(1, -(-n_queries // query_block))

    # every block of queries meets every block of candidates in one tile
    asked = good.where("asked").select("row", "v", "dim", F.pmod(F.xxhash64("row"), F.lit(q_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"))
    others = candidates.select("row", "vec_id", "v", "dim", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), F.pmod(F.xxhash64("row", F.lit(7)), F.lit(c_blocks)).cast("int").alias("cb"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            q, c = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
            found = tile(left["row"].to_numpy(), q, right["row"].to_numpy(), right["vec_id"].to_numpy(), c, k)
        return pd.DataFrame(found, columns=["query", "row", "vec_id", "score"]).astype({"query": "int64", "row": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["dim", "qb", "cb"]
    met = asked.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInPandas(meet, "query long, row long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = good.where("asked").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return best.hint("merge").join(named.hint("merge"), "query").select("query_id", "rank", "vec_id", "score")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
v AS (SELECT vec_id, v FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(c.v, c.v))) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
