"""Nearest neighbours by cosine over randomly rotated one-bit codes.

Every vector is scaled to length 1, moved by a centre and rotated at random; the signs of what results are its code,
one bit a component, packed. Beside the code stand three numbers: the residual's length, its alignment with the code's corner of
the cube, and its product with the centre. For a rotated query they estimate the cosine: a table for each byte of the code
holds the sums of the query's components under all 256 sign patterns, so an estimate is one look-up a byte. The estimate
is off by at most ``CONFIDENCE`` deviations, which depend on the alignment alone, for nearly all vectors. A query ranks a
cell's vectors by estimate, takes the k-th best exact cosine of the first few, and reranks exactly all vectors whose upper bound
reaches it; nothing else limits their number.

The index covers every row; only the centre is fitted, on ``CENTRE_SAMPLE`` rows at most, drawn by a hash of the id, and any centre
gives right bounds. The rotation follows from a seed and the number of components, so it is drawn where it is needed. Index
rows are cut into blocks of bounded size by a hash of the id, queries too; a block of each is one cell, a bounded group, and
hands on k rows a query. These meet in a window that Spark cuts to k rows before the shuffle. Work is queries times rows, in look-ups.

Defined results: vectors that are null or zero or hold a null or a value that is not finite take no part, nor do rows without
an id. Rows that share an id are one vector, the smallest of them. Vectors of different lengths are not compared. Ties go to
the smaller id; equal vectors have equal scores. Components are scaled by a power of two first, so no size of them overflows.
Fewer than k candidates give fewer rows; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import query, table
from tallyfield.session import materialise

#: Rows asked for, every how many ids a query is, seed of the rotation, deviations an estimate may be off.
TOP, QUERY_STEP, SEED, CONFIDENCE = 5, 50, 11, 1.9
#: Rows the centre is fitted on; rows of a block of the index and of queries; queries estimated at once; first candidates.
CENTRE_SAMPLE, INDEX_ROWS, QUERY_ROWS, AT_ONCE, FIRST = 1024, 8192, 2048, 128, 64
#: Fixed table: the signs of every byte, highest bit first.
SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1
INDEX = "vec_id long, size int, vector binary, code binary, length double, aligned double, centred double"


@lru_cache(maxsize=8)
def rotation(size: int, seed: int = SEED) -> np.ndarray:
    """A random rotation of ``size`` components, uniform over all of them."""
    q, r = np.linalg.qr(np.random.default_rng([seed, size]).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that their largest component lies from 1/2 to 1."""
    largest = np.abs(x).max(axis=1, initial=0)
    return np.ldexp(x, -np.frexp(largest)[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def encode(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed code, residual's length, alignment with the code's corner, and product with the centre of unit rows."""
    moved = (x - centre) @ rotation(x.shape[1])
    length = np.sqrt((moved * moved).sum(axis=1))
    aligned = np.abs(moved).sum(axis=1) / np.sqrt(x.shape[1]) / np.where(length > 0, length, 1)
    return np.packbits(moved > 0, axis=1), length, aligned, x @ centre


def estimates(
    queries: np.ndarray, centre: np.ndarray, codes: np.ndarray, length: np.ndarray, aligned: np.ndarray, centred: np.ndarray, confidence: float = CONFIDENCE
) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosine of every row (first axis) with every unit query, and how far it may be off."""
    size = queries.shape[1]
    moved = (queries - centre) @ rotation(size)
    ahead = np.zeros((len(queries), codes.shape[1] * 8), np.float32)
    ahead[:, :size] = moved
    sums = np.zeros((len(codes), len(queries)), np.float32)
    for byte in range(codes.shape[1]):
        by_pattern = SIGNS @ ahead[:, byte * 8 : byte * 8 + 8].T
        sums += by_pattern[codes[:, byte]]
    safe = np.where(aligned > 0, aligned, 1)
    reach = np.sqrt((moved * moved).sum(axis=1))
    found = sums * (length / safe / np.sqrt(size))[:, None] + centred[:, None] + (queries @ centre - centre @ centre)[None]
    spread = length * np.sqrt(np.maximum(1 - aligned**2, 0)) / safe * confidence / np.sqrt(max(size - 1, 1))
    return found, spread[:, None] * reach[None] + 1e-5  # room for single precision


def exact_cosines(rows: np.ndarray, query_: np.ndarray) -> np.ndarray:
    """Row by row in one order of summation, so that equal rows get equal scores."""
    return (rows * query_).sum(axis=1) / np.sqrt((rows * rows).sum(axis=1) * (query_ * query_).sum())


def best_of_cell(
    asks: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, centre: np.ndarray, index: tuple[np.ndarray, ...], top: int = TOP
) -> tuple[list[int], list[int], list[float], int]:
    """Query ids, row ids and cosines of each query's best rows; also how many rows were reranked.

    ``index`` holds the rows' codes, lengths, alignments and products with the centre.
    """
    out_q, out_id, out_score, reranked = [], [], [], 0
    units = unit(queries)
    for begin in range(0, len(asks), AT_ONCE):
        found, off = estimates(units[begin : begin + AT_ONCE], centre, *index)
        upper = np.ascontiguousarray((found + off).T)
        for k, own in enumerate(asks[begin : begin + AT_ONCE]):
            bound = upper[k]
            bound[ids == own] = -np.inf
            at = np.argpartition(-found[:, k], FIRST)[:FIRST] if len(ids) > FIRST else np.arange(len(ids))
            at = at[ids[at] != own]
            first = exact_cosines(rows[at], queries[begin + k])
            kth = np.sort(first)[-top] if len(first) >= top else -2.0
            at = np.flatnonzero(bound >= kth)
            scores = exact_cosines(rows[at], queries[begin + k])
            best = np.lexsort((ids[at], -scores))[:top]
            reranked += len(at)
            out_q += [int(own)] * len(best)
            out_id += ids[at][best].tolist()
            out_score += scores[best].tolist()
    return out_q, out_id, out_score, reranked


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of doubles) of the vectors that take part, one row an id."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    some = F.exists("embedding", lambda x: x != 0)
    taken = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & some)
    values = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # no negative zeros
    return taken.select("vec_id", values.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def fit_centres(vectors: DataFrame, sample: int = CENTRE_SAMPLE) -> dict[int, np.ndarray]:
    """Mean unit vector for each number of components, of at most ``sample`` rows of ``vectors(vec_id, v)``."""
    drawn: dict[int, list[list[float]]] = {}
    for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect():
        drawn.setdefault(len(r["v"]), []).append(r["v"])
    return {size: unit(scaled(np.array(v, float))).mean(axis=0) for size, v in drawn.items()}


def build_index(vectors: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """Index rows of all of ``vectors(vec_id, v)``: scaled vector (packed doubles), code and the three numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                chosen = np.flatnonzero(sizes == size)
                x = scaled(column.take(pa.array(chosen)).flatten().to_numpy().reshape(len(chosen), size))
                codes, *numbers = encode(unit(x), centres.get(size, np.zeros(size)))
                packed = [pa.array([row.tobytes() for row in m], pa.binary()) for m in (x, codes)]
                ids = batch.column(0).take(pa.array(chosen))
                arrays = [ids, pa.array([size] * len(chosen), pa.int32()), *packed, *(pa.array(n, pa.float64()) for n in numbers)]
                yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "size", "vector", "code", "length", "aligned", "centred"])

    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    return typed.mapInArrow(run, INDEX)


def search(index: DataFrame, is_query: Column, centres: dict[int, np.ndarray], top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest rows of a stored ``index`` to each of its query rows."""
    counts = index.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(is_query, 1)).alias("queries")).first()
    blocks, query_blocks = -(-counts["all"] // INDEX_ROWS) or 1, -(-counts["queries"] // QUERY_ROWS) or 1
    place = lambda n, *salt: F.pmod(F.xxhash64("vec_id", *salt), F.lit(n).cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    own = ["size", "vec_id", "vector"]
    numbers = ["code", "length", "aligned", "centred"]
    rows = index.select(*own, *numbers, F.lit(False).alias("asks"), place(blocks).alias("block"), every(query_blocks).alias("query_block"))
    asked = index.filter(is_query).select(*own, F.lit(True).alias("asks"), every(blocks).alias("block"), place(query_blocks, F.lit(1)).alias("query_block"))

    def cell(part: pd.DataFrame) -> pd.DataFrame:
        size = int(part["size"].iloc[0])
        vectors = np.frombuffer(b"".join(part["vector"]), np.float64).reshape(len(part), size)
        asks, ids = part["asks"].to_numpy(bool), part["vec_id"].to_numpy(np.int64)
        kept = part[~asks]
        codes = np.frombuffer(b"".join(kept["code"]), np.uint8).reshape(len(kept), -(-size // 8))
        numbers_ = (kept[n].to_numpy(float) for n in numbers[1:])
        centre = centres.get(size, np.zeros(size))
        q, x, s, _ = best_of_cell(ids[asks], vectors[asks], ids[~asks], vectors[~asks], centre, (codes, *numbers_), top)
        return pd.DataFrame({"query_id": pd.array(q, "int64"), "vec_id": pd.array(x, "int64"), "score": pd.array(s, "float64")})

    cells = rows.unionByName(asked, allowMissingColumns=True).groupBy("size", "block", "query_block")
    found = cells.applyInPandas(cell, "query_id long, vec_id long, score double")
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", ranked).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, top: int = TOP) -> DataFrame:
    """The nearest rows to each query row of ``vectors(vec_id, embedding)``: index all rows, then search."""
    rows = materialise(usable(vectors), "unit-vectors")
    centres = fit_centres(rows)
    return search(materialise(build_index(rows, centres), "vector-index"), is_query, centres, top)


@query("op12_nearest_neighbours")
def op12_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)
