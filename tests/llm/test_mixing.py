"""Poisson mixing: counts follow the distribution, sizes follow the weights, nothing is capped."""

import math

import pytest

from leadflow.llm.mixing import mix, poisson_cdf
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string, copy int, extra string"


def docs(spark, n=6000):
    return spark.range(n).select(
        F.col("id").alias("doc_id"), F.lit("ten chars.").alias("text"),
        F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 50 == 1, "small").otherwise("mid").alias("source"),
        F.lit(9).alias("copy"), F.lit("e").alias("extra"))


@pytest.mark.parametrize("rate", [0.2, 1.0, 7.5, 900.0])
def test_cdf(spark, rate):
    cdf = spark.range(1).select(poisson_cdf(F.lit(rate) + F.col("id") * 0).alias("c")).first().c
    for k in (0, 1, int(rate), int(rate) + 5):
        want = sum(math.exp(i * math.log(rate) - rate - math.lgamma(i + 1)) for i in range(k + 1))
        assert abs(cdf[k] - want) < 1e-9
    assert cdf[-1] > 1 - 1e-9


def test_sizes_follow_weights(spark):
    out = mix(docs(spark), weights={"big": 1, "mid": 1, "small": 2}, target=120_000)
    size = {r.source: r.s for r in out.groupBy("source").agg(F.sum(F.length("text")).alias("s")).collect()}
    for source, want in (("big", 30_000), ("mid", 30_000), ("small", 60_000)):
        assert abs(size[source] - want) < 6 * math.sqrt(want / 10) * 10
    one = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copies").alias("c"), F.max("copy").alias("m"))
    assert one.where("n <> c or n <> m").count() == 0
    assert max(r.c for r in one.collect()) > 30          # the small source repeats; nothing caps it


def test_deterministic_and_shuffled(spark):
    a = [(r.doc_id, r.copy) for r in mix(docs(spark, 500)).collect()]
    b = [(r.doc_id, r.copy) for r in mix(docs(spark, 500).repartition(7)).collect()]
    assert sorted(a) == sorted(b) and a != sorted(a)
    assert sorted(a) != sorted((r.doc_id, r.copy) for r in mix(docs(spark, 500), seed=7).collect())


def test_edge_cases(spark):
    rows = [(1, "abc", None, 1, "e"), (2, None, None, 1, "e"), (3, "", "empty", 1, "e"), (4, None, "empty", 1, "e"),
            (None, "abcd", "s", 1, "e"), (5, "abcd", "s", 1, "e"), (5, "abcd", "s", 1, "e"), (6, "x" * 200_000, "s", 1, "e")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mix(df, target=4_000_000).collect()
    assert [r.copy for r in out if r.source == "empty"] == [1, 1]
    fives = [r.copy for r in out if r.doc_id == 5]
    assert sorted(fives) == sorted(2 * list(range(1, max(fives, default=0) + 1)))
    assert {r.extra for r in out} == {"e"} and any(r.source is None for r in out)
    assert mix(df, weights={"s": 1}).where("source is null").count() == 0


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []
