"""The prefix-filtered similarity join finds exactly the pairs a brute-force comparison finds."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadflow.functions import text as TX
from leadflow.operators.similarity import fuzzy_pairs

WORDS = ["al", "ram", "kumar", "singh", "red", "gear", "gears", "x", "ana", "anna", "banana", "bo", "aaaa"]
name = st.lists(st.sampled_from(WORDS), min_size=1, max_size=4).map(" ".join)


def _brute(spark, queries, pool, cutoff):
    allp = spark.createDataFrame([(i, a, b) for (i, a), b in itertools.product(enumerate(queries), pool)],
                                 "q_id long, q_norm string, name string")
    return {(r.q_id, r.name) for r in allp.where(TX.similarity(F.col("q_norm"), F.col("name")) >= cutoff).collect()}


@settings(max_examples=8, deadline=None)
@given(st.lists(name, min_size=1, max_size=6, unique=True), st.lists(name, min_size=1, max_size=8, unique=True),
       st.sampled_from([85.0, 88.0, 67.0]))
def test_prefix_filter_is_exact(spark, queries, pool, cutoff):
    q = spark.createDataFrame(list(enumerate(queries)), "q_id long, q_norm string")
    p = spark.createDataFrame([(n, n) for n in pool], "name string, p_norm string")
    got = {(r.q_id, r.name) for r in fuzzy_pairs(q, p, cutoff).collect()}
    assert got == _brute(spark, queries, pool, cutoff)


def test_low_cutoff_refused(spark):
    q = spark.createDataFrame([(1, "a")], "q_id long, q_norm string")
    p = spark.createDataFrame([("a", "a")], "name string, p_norm string")
    with pytest.raises(ValueError):
        fuzzy_pairs(q, p, 50.0)


def test_hot_word_emits_few_candidates(spark):
    """200 queries and 200 names share the word 'kumar'; brute force would score 40,000 pairs."""
    from leadflow.operators.similarity import candidate_pairs
    queries = [f"kumar q{chr(97 + i % 26)}{chr(97 + i // 26)}zz" for i in range(200)]
    pool = [f"kumar p{chr(97 + j % 26)}{chr(97 + j // 26)}yy" for j in range(200)] + ["kumar"]
    q = spark.createDataFrame(list(enumerate(queries)), "q_id long, q_norm string")
    p = spark.createDataFrame([(n, n) for n in pool], "name string, p_norm string")
    n_cand = candidate_pairs(q, p, 85.0).count()
    assert n_cand <= 2 * len(queries)                 # each query meets at most a couple of names
    got = {(r.q_id, r.name) for r in fuzzy_pairs(q, p, 85.0).collect()}
    assert got == _brute(spark, queries, pool, 85.0)  # and nothing is lost ('kumar' is in every query)


def test_hundred_thousand_names_with_a_hot_word(spark):
    """Every name and query holds the same word, the rest is random hexadecimal (few distinct
    trigrams, the worst case for prefixes): candidates stay under a tenth of all pairs."""
    from leadflow.operators.similarity import candidate_pairs, fuzzy_pairs
    pool = spark.range(100_000).selectExpr("concat('common ', md5(cast(id AS string))) AS name").selectExpr("name", "name AS p_norm")
    queries = (spark.range(0, 100_000, 1000)
               .selectExpr("id AS q_id", "concat('common ', md5(cast(id AS string)), 'x') AS q_norm"))
    pairs = candidate_pairs(queries, pool, 88.0)
    n = pairs.count()
    assert 100 <= n <= 1_000_000                               # of 10 million possible ones
    assert fuzzy_pairs(queries, pool, 88.0).select("q_id").distinct().count() == 100
