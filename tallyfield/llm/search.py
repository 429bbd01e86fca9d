"""Exact top-k search by inner product with pivot-table elimination.

Distances from every vector to a few pivots are computed once. For a query they bound each candidate's distance from
below (the largest difference of their distances to one pivot), and so its inner product from above, because
2 <q, x> = |q|^2 + |x|^2 - d(q, x)^2. Candidates are evaluated in the order of that bound, in growing portions, until no
bound left reaches the k-th best score so far; then the answer is exact. A bound that equals the k-th score is still
evaluated, so ties are settled by id.

Components are turned into whole numbers, floor(scale * x), held as doubles: products are exact while they stay below
2^53, and a cell whose vectors could exceed that is computed with Python's whole numbers.

The candidates are cut into blocks of bounded size by a hash of the id, the queries too, and each pair of a query block and
a candidate block is one cell, a group of bounded size. Each cell keeps k rows a query; these meet in a window that Spark
cuts to k rows before the shuffle. The pivots are a small sample, spread by farthest-first choice; any pivots give exact
results.

Defined results: vectors that are null or hold a null or a value that is not finite take no part, nor do rows
without an id. Rows that share an id are one vector, the smallest of them. Vectors of different lengths are not
compared. Scores beyond a long's range are held at its ends. Fewer than k candidates give fewer rows; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import query, table
from tallyfield.session import materialise

#: Rows asked for, scale of the components, every how many ids a query is.
TOP, SCALE, QUERY_STEP = 5, 256, 50
#: Number of pivots, rows they are chosen from, rows of a candidate block and of a query block.
PIVOTS, PIVOT_SAMPLE, CANDIDATE_ROWS, QUERY_ROWS = 16, 1024, 8192, 1024
#: Candidates of the first portion, and room for rounding of the bounds.
FIRST_PORTION, SLACK = 64, 1e-9
#: Doubles hold whole numbers exactly below this; scores are held at the ends of what a long can hold.
EXACT_BELOW, LONGEST = float(2**53), 2**63 - 1


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v (array of whole doubles) of the vectors that take part, one row an id."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    taken = vectors.filter(F.col("vec_id").isNotNull() & usable).select("vec_id", whole.alias("v"))
    return taken.groupBy("vec_id").agg(F.min("v").alias("v"))


def choose_pivots(sample: np.ndarray, number: int = PIVOTS) -> np.ndarray:
    """Rows of the sample, each as far as possible from those chosen before."""
    if not len(sample):
        return sample
    chosen = [0]
    gap = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(number, len(sample)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None] - 2 * x @ pivots.T, 0))


def best_of_cell(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, top: int = TOP
) -> tuple[list[int], list[int], list[int], int]:
    """Query ids, candidate ids and scores of each query's best candidates; also how many candidates were evaluated."""
    order = np.argsort(ids)
    ids, vectors = ids[order], vectors[order]
    largest = max(np.abs(queries).max(initial=0), np.abs(vectors).max(initial=0))
    exact = largest * largest * max(queries.shape[1], 1) < EXACT_BELOW
    table_, of_queries = pivot_distances(vectors, pivots), pivot_distances(queries, pivots)
    squares, query_squares = (vectors**2).sum(axis=1), (queries**2).sum(axis=1)
    if not exact:  # every candidate is evaluated, in whole numbers of any size
        queries, vectors = (np.array([[int(c) for c in row] for row in m], dtype=object).reshape(m.shape) for m in (queries, vectors))
    out_q, out_id, out_score, evaluated = [], [], [], 0
    for k, own in enumerate(query_ids):
        if exact:
            nearest = np.abs(table_ - of_queries[k]).max(axis=1, initial=0)
            room = SLACK * (squares + query_squares[k] + 1)
            bound = (squares + query_squares[k] - nearest**2) / 2 + room
        else:
            bound = np.full(len(ids), np.inf)
        open_ = np.flatnonzero(ids != own)
        if len(open_) > FIRST_PORTION:
            open_ = open_[np.argpartition(-bound[open_], FIRST_PORTION)]
        at = open_[:FIRST_PORTION]
        scores = vectors[at] @ queries[k]
        kth = np.sort(scores)[-top] if len(scores) >= top else -np.inf
        rest = open_[FIRST_PORTION:][bound[open_[FIRST_PORTION:]] >= kth]  # the others cannot reach the k-th score
        rest = rest[np.argsort(-bound[rest], kind="stable")]
        begin, portion = 0, 2 * FIRST_PORTION
        while begin < len(rest) and bound[rest[begin]] >= kth:
            more = rest[begin : begin + portion]
            at, scores = np.concatenate([at, more]), np.concatenate([scores, vectors[more] @ queries[k]])
            kth = np.sort(scores)[-top] if len(scores) >= top else -np.inf
            begin, portion = begin + portion, 2 * portion
        evaluated += len(at)
        best = sorted(zip((-scores).tolist(), ids[at].tolist(), strict=True))[:top]
        out_q += [int(own)] * len(best)
        out_id += [i for _, i in best]
        out_score += [max(-LONGEST, min(LONGEST, int(-s))) for s, _ in best]
    return out_q, out_id, out_score, evaluated


def top_k(vectors: DataFrame, is_query: Column, top: int = TOP, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score of the best candidates of each query row of ``vectors(vec_id, embedding)``."""
    rows = materialise(whole_vectors(vectors, scale).withColumn("size", F.size("v")), "whole-vectors")
    by_hash = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE)
    by_size: dict[int, list[list[float]]] = {}
    for r in by_hash.collect():
        by_size.setdefault(r["size"], []).append(r["v"])
    pivots = {size: choose_pivots(np.array(v, float)) for size, v in by_size.items()}
    counts = rows.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(is_query, 1)).alias("queries")).first()
    blocks, query_blocks = -(-counts["all"] // CANDIDATE_ROWS) or 1, -(-counts["queries"] // QUERY_ROWS) or 1
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n).cast("long"))
    place_of_query = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n).cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    candidates = rows.select("size", place(blocks).alias("block"), every(query_blocks).alias("query_block"), F.lit(False).alias("asks"), "vec_id", "v")
    queries = rows.filter(is_query).select("size", every(blocks).alias("block"), place_of_query(query_blocks).alias("query_block"), F.lit(True).alias("asks"), "vec_id", "v")

    def cell(part: pd.DataFrame) -> pd.DataFrame:
        size = int(part["size"].iloc[0])
        asks = part["asks"].to_numpy(bool)
        ids, matrix = part["vec_id"].to_numpy(np.int64), np.array(part["v"].tolist(), float).reshape(len(part), size)
        near = pivots.get(size, np.zeros((0, size)))
        q, x, s, _ = best_of_cell(ids[asks], matrix[asks], ids[~asks], matrix[~asks], near, top)
        return pd.DataFrame({"query_id": q, "vec_id": x, "score": s}, dtype=np.int64)

    found = candidates.unionAll(queries).groupBy("size", "block", "query_block").applyInPandas(cell, "query_id long, vec_id long, score long")
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", ranked).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


SQL = f"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_STEP} = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {TOP}
"""


@query("op4_topk_search", SQL)
def op4_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)
