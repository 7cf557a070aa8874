"""Quality rules: counts against brute force, exact binomial tail, guarantee, edge cases."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leadflow.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, lang string, m string, kept string, stratum string, n_words string"
LABELS = "doc_id long, quality int, toxic int"


def brute(t):
    t = t or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    win = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if win[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


TEXTS = [None, "", " \t\n", "one two three four", "a b c d e a b c d e", "x y " * 40, "é ñ ü ## ok a b c d e f\nq\nq\n \n\nq",
         "\x0ba\x1cb c d e f g h i j k", " ".join(map(str, range(30000))) + " 1 2 3 4 5", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 " + "<|>&$%*#",
         "a a a a a a a a a a a a", "1 2 3 4 5 6 7 8 9 10 11 12 1 2 3 4 5 2 3 4 5 6"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, *"abcd") for i, t, lang in rows], SCHEMA)


def test_counts_and_edge_cases(spark):
    rows = [(i, t, None if i % 2 else "en") for i, t in enumerate(TEXTS)] + [(None, "a b", None), (2, TEXTS[2], "en")]
    labels = spark.createDataFrame([(6, 1, 0), (6, 0, 0), (None, 1, 0), (7, None, None)], LABELS)
    out = Q.quality_report(frame(spark, rows), labels).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: tuple(r)[1:] for r in out}
    for i, t in enumerate(TEXTS):
        assert got[i] == (*brute(t), not brute(t)[-1]), (i, t and t[:40])
    assert Q.quality_report(frame(spark, []), labels).collect() == []


@pytest.mark.parametrize("n,k,share", [(10, 0, 0.1), (10, 1, 0.3), (700, 3, 0.0125), (5000, 40, 0.0125), (200, 150, 0.01), (1, 0, 0.5)])
def test_binomial_tail(spark, n, k, share):
    got = spark.range(1).select(Q.binomial_tail(F.lit(k).cast("long") + F.col("id") * 0, F.lit(n).cast("long"), share).alias("p")).first().p
    want = sum(math.comb(n, i) * share**i * (1 - share)**(n - i) for i in range(k + 1)) if k <= n * share else 1.0
    assert abs(got - want) < 1e-9


def corpus(spark, n, noisy):
    """Good documents of two languages; a share ``noisy`` of the second has symbols."""
    words = "these are plain words that stand in a good line of prose number"
    rows = [(i, f"{words} {i}" + (" v1## v2** v3##" if i % 2 and i % 100 < noisy * 100 else ""), "en" if i % 2 == 0 else "de")
            for i in range(n)]
    rows += [(n + i, f"{words} {i}" + "".join(f" w{j}###" for j in range(20)), "en" if i % 2 == 0 else "de") for i in range(200)]
    return frame(spark, rows), spark.createDataFrame([(i, 1, 0) for i in range(n)] + [(n + i, 0, 0) for i in range(200)], LABELS)


def test_cutoffs_bound_false_rejections(spark):
    docs, labels = corpus(spark, 3000, noisy=0.4)
    out = Q.quality_report(docs, labels).join(docs.select("doc_id", "lang"), "doc_id").join(labels, "doc_id")
    r = {(x.lang, x.quality): x.kept for x in out.groupBy("lang", "quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert r["en", 1] == 1 and r["en", 0] == 0             # clean stratum: the junk goes
    assert r["de", 1] >= 0.95                             # symbols are usual there: no cutoff may reject them
    few, few_labels = corpus(spark, 60, noisy=0)
    assert Q.quality_report(few, few_labels).where("not kept and not base_failed").count() == 0    # too few to certify


def test_good_documents_keep_their_columns(spark):
    docs, labels = corpus(spark, 3000, noisy=0)
    out = Q.good_documents(docs, labels)
    assert out.columns == docs.columns
    kept = Q.quality_report(docs, labels).where("kept")
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in kept.collect()}
    assert Q.good_documents(docs, spark.createDataFrame([], LABELS)).count() == docs.count()
