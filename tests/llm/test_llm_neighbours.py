"""Nearest neighbours by one-bit codes against all exact cosines."""

import math

import numpy as np
from pyspark.sql import functions as F

from tallyfield.llm import neighbours

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, step=50, top=5):
    """(query_id, rank) -> (vec_id, score) over all pairs, one row an id."""
    kept = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            kept[i] = min(kept.get(i, v), v)
    scaled = {i: np.array([math.ldexp(x, -math.frexp(max(map(abs, v)))[1]) for x in v]) for i, v in kept.items()}
    out = {}
    for q in (i for i in kept if i % step == 0):
        scores = []
        for i, v in scaled.items():
            if i != q and len(v) == len(scaled[q]):
                scores.append((-float(v @ scaled[q]) / math.sqrt(float(v @ v) * float(scaled[q] @ scaled[q])), i))
        for rank, (s, i) in enumerate(sorted(scores)[:top], 1):
            out[q, rank] = (i, -s)
    return out


def found(spark, rows, **settings):
    vectors = spark.createDataFrame(rows, SCHEMA)
    got = neighbours.nearest(vectors, F.col("vec_id") % 50 == 0, **settings).collect()
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got}


def test_recall_on_the_given_vectors(spark, folder):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got, expected = found(spark, rows), plain(rows)
    assert got.keys() == expected.keys()
    hits = sum(got[k][0] in {expected[k[0], r][0] for r in range(1, 6)} for k in got)
    assert hits >= 0.95 * len(expected)
    exact = {(q, i): s for (q, _), (i, s) in expected.items()}
    assert all(abs(exact[q, i] - s) < 1e-12 for (q, _), (i, s) in got.items() if (q, i) in exact)


def test_recall_over_several_cells(spark, monkeypatch):
    """Clustered vectors away from the origin, cut into many small cells."""
    monkeypatch.setattr(neighbours, "INDEX_ROWS", 300)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 10)
    rng = np.random.default_rng(3)
    middles = rng.standard_normal((12, 48)) + 2
    rows = [(i, (middles[i % 12] + 0.3 * rng.standard_normal(48)).tolist()) for i in range(2000)]
    got, expected = found(spark, rows), plain(rows)
    assert got.keys() == expected.keys()
    assert sum(got[k][0] in {expected[k[0], r][0] for r in range(1, 6)} for k in got) >= 0.95 * len(expected)


def test_bounds_hold_for_nearly_all_pairs():
    rng = np.random.default_rng(5)
    x = neighbours.unit(rng.standard_normal((2000, 96)))
    centre = x[:100].mean(axis=0)
    about, off = neighbours.estimates(x[:50], centre, *neighbours.encode(x, centre))
    miss = np.abs(about - x @ x[:50].T) > off
    assert miss.mean() < 0.08 and abs((about - x @ x[:50].T).mean()) < 0.01


def test_ties_repeats_odd_sizes_and_extremes(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (3, [2.0, 0.0, 0.0]), (2, [4.0, 0.0, 0.0]), (9, [0.0, 1.0, 0.0]), (9, [0.0, 0.5, 1.0])]
    rows += [(50, [1e300, 1e300, 0.0]), (51, [5e-324, 0.0, 0.0]), (52, [-1.0, -0.0, 0.0]), (100, [1.0, 2.0]), (101, [2.0, 1.0])]
    assert {k: v[0] for k, v in found(spark, rows).items()} == {k: v[0] for k, v in plain(rows).items()}


def test_vectors_that_take_no_part_and_empty_tables(spark):
    bad = [(None, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [math.nan, 1.0]), (8, [math.inf, 1.0]), (10, [])]
    assert found(spark, []) == {}
    assert found(spark, bad) == {}
    assert found(spark, [*bad, (0, [1.0, 1.0])]) == {}
    assert {k: v[0] for k, v in found(spark, [*bad, (0, [1.0, 1.0]), (1, [1.0, 0.0])]).items()} == {(0, 1): 1}


def test_clashing_columns_are_not_read(spark):
    rows = [(i, [math.cos(i), math.sin(i), 1.0]) for i in range(60)]
    vectors = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("v", "size", "code", "block", "rank", "score", "asks")})
    got = neighbours.nearest(vectors, F.col("vec_id") % 50 == 0).count()
    assert got == 10
