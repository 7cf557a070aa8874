"""Exact top-k against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadflow.llm import topk as T

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, query_id string"


def brute(rows, k, every):
    """Every row by itself, also where ids repeat."""
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(ok):
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(ok) if m != n and len(a) == len(b))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def check(spark, rows, k=5, every=10):
    df = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA).repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in T.top_k(df, F.col("vec_id") % every == 0, k=k).collect())
    assert got == brute(rows, k, every)


def test_random_and_ties_in_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(T, "TILE_BYTES", 8 * 8 * 20)
    monkeypatch.setattr(T, "FAN_IN", 3)
    monkeypatch.setattr(T, "SCORES", 50)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 8) / 4]) for i in range(400)]
    check(spark, rows + [(1000 + i, rows[3][1]) for i in range(150)])


def test_edge_cases(spark):
    rows = [(0, [1.0, 2.0]), (10, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]),
            (None, [1.0, 1.0]), (20, [1.0]), (21, [3.0]), (30, []), (5, [-0.001, 0.001]), (6, [0.5, 0.5]), (6, [0.5, 0.5]),
            (7, [0.25, 9.0]), (7, [0.25, -9.0]), (40, [1.0, 2.0, 3.0])]
    check(spark, rows)


def test_rows_that_repeat_an_id_are_all_candidates(spark):
    check(spark, [(0, [1.0]), (1, [1.0]), (1, [2.0]), (2, [1.5]), (0, [3.0]), (10, [0.5]), (10, [0.5])], k=3)


def test_scores_beyond_doubles(spark):
    check(spark, [(0, [1e6, 1.0]), (10, [1e6, 0.5]), (1, [2e6, 3.0]), (2, [1.5e6, 0.75]), (3, [-1e6, 5.0])])


def test_empty_table(spark):
    assert T.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).collect() == []


def test_overflow_raises(spark):
    df = spark.createDataFrame([(0, [1e30]), (10, [1e30])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception):
        T.top_k(df, F.col("vec_id") % 10 == 0).collect()
