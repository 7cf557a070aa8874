"""Hard negatives: the vertical scan and the whole operator against brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from leadflow.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, row string, asked int, scores string"


def brute(rows, every, n_pos=5, n_neg=3, low=50, high=95):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v], g) for i, v, g in rows
          if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q, g) in enumerate(ok):
        if i % every:
            continue
        found = [(-sum(x * y for x, y in zip(q, v)), j, b) for b, (j, v, _) in enumerate(ok) if b != a and len(v) == len(q) and q]
        same = sorted(f for f in found if ok[f[2]][2] == g)[:n_pos]
        other = sorted(f for f in found if ok[f[2]][2] != g)
        for p, (s, j, _) in enumerate(same, 1):
            fits = [f for f in other if low * -s <= 100 * -f[0] <= high * -s][:n_neg]
            out += [(i, j, r, k, -s, -t, p) for r, (t, k, _) in enumerate(fits, 1)]
    return sorted(out)


def check(spark, rows, every=10, least=1):
    df = spark.createDataFrame([(i, v, g, "x", 1, "y") for i, v, g in rows], SCHEMA).coalesce(1)
    got = H.mine(df, F.col("vec_id") % every == 0, F.col("label"))
    want = brute(rows, every)
    assert sorted(map(tuple, got.collect())) == want and len(want) >= least


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 40), st.integers(1, 20), st.integers(1, 4), st.booleans())
def test_scan_keeps_all_that_is_wanted(seed, n, dim, k, exact):
    rng = np.random.default_rng(seed)
    columns, q = rng.integers(-9, 10, (dim, n)).astype(float), rng.integers(-9, 10, dim).astype(float)
    scores = q @ columns
    if exact:
        columns, q = (np.array(np.vectorize(int)(m), object) for m in (columns, q))
    alive = rng.random(n) < 0.8
    left = alive.copy()
    places, found = H.vertical_scan(q, columns, left, H.among_best(k))
    assert (found == scores[places]).all() and set(places) <= set(np.flatnonzero(alive))
    assert (np.flatnonzero(left) == places).all()
    assert sorted(scores[places])[::-1][:k] == sorted(scores[alive])[::-1][:k]
    windows = [(-20, 5), (3, 30), (40, 41)]
    places, found = H.vertical_scan(q, columns, alive.copy(), H.in_windows(windows, k))
    for lo, hi in windows:
        inside = scores[alive & (scores >= lo) & (scores <= hi)]
        assert sorted(s for s in found if lo <= s <= hi)[::-1][:k] == sorted(inside)[::-1][:k]


def test_bounds_prune_before_the_last_dimension():
    rng = np.random.default_rng(1)
    columns = rng.normal(size=(64, 5000)) * 100 * np.geomspace(1, 0.001, 64)[:, None]
    seen = []

    def wanted(lower, upper):
        seen.append(len(lower))
        return H.among_best(5)(lower, upper)
    H.vertical_scan(np.floor(columns[:, 0]), np.floor(columns), np.ones(5000, bool), wanted)
    assert seen == sorted(seen, reverse=True) and seen[1] < 4000 and seen[-1] < 300


def test_window_bounds_are_exact():
    for p in range(-50, 250):
        lo, hi = H.window_of(p, 50, 95)
        assert [s for s in range(-300, 300) if 50 * p <= 100 * s <= 95 * p] == list(range(lo, hi + 1))


def test_random_and_ties_in_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(H, "TILE_BYTES", 8 * 8 * 20)
    monkeypatch.setattr(H, "FAN_IN", 3)
    monkeypatch.setattr(H, "STEP", 3)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-1, 3, 8) / 4], int(rng.integers(0, 3))) for i in range(400)]
    check(spark, rows + [(1000 + i, rows[3][1], i % 3) for i in range(150)], least=100)


def test_edge_cases(spark):
    v = [1.0, 2.0]
    rows = [(0, v, 1), (10, v, 1), (1, None, 1), (2, [1.0, None], 1), (3, [float("nan"), 1.0], 2), (4, [float("inf"), 1.0], 2),
            (None, v, 1), (5, v, None), (20, [1.0], 1), (21, [3.0], 1), (22, [2.0], 2), (30, [], 1), (31, [], 2), (6, [0.5, 1.5], 2),
            (6, [0.5, 1.5], 2), (6, [1.0, 1.0], 1), (6, [1.0, 1.0], 1), (0, v, 1), (0, [-1.0, 0.0], 3), (40, [1.0, 2.0, 3.0], 1)]
    check(spark, rows)


def test_scores_beyond_doubles(spark):
    check(spark, [(0, [1e6, 1.0], 1), (10, [1e6, 0.5], 1), (1, [7e5, 3.0], 2), (2, [6e5, 0.75], 2), (3, [-1e6, 5.0], 3)])


def test_a_label_or_vector_of_a_third_of_all_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [0.5, 0.25, 0.125], 7 if i % 3 else i % 5) for i in range(0, 300)]
    rows += [(300 + i, [float(x) for x in rng.normal(size=3)], i % 5) for i in range(300)]
    check(spark, rows, every=50)


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert H.mine(empty, F.col("vec_id") % 50 == 0, F.col("label")).collect() == []
    check(spark, [(1, [1.0], 1), (2, [1.0], 2)], least=0)                   # no anchor
    check(spark, [(10, [1.0], 1), (2, [1.0], 2)], least=0)                  # no positive
    check(spark, [(10, [1.0], 1), (2, [-1.0], 1), (3, [0.5], 2)], least=0)  # a negative score's window
