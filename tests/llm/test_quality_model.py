"""Ordinal classifier: gradient, held-out accuracy, order of probabilities, edge cases."""

import numpy as np
from pyspark.sql import functions as F

from leadflow.llm import quality_model as M

SCHEMA = "doc_id long, text string, kept string, grade string, tail_probability string"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = (spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", M.grade(F.col("quality"), F.col("toxic")).alias("grade"))
              .where("doc_id % 2 = 0"))
    fit_on, held = labels.where(F.pmod(F.hash("doc_id"), F.lit(4)) > 0), labels.where(F.pmod(F.hash("doc_id"), F.lit(4)) == 0)
    out = M.score(docs.join(held, "doc_id", "left_semi"), M.train(docs, fit_on)).join(held, "doc_id").toPandas()
    best, poor = out[out.grade == 2], out[out.grade == 0]
    assert len(best) > 200 and best.kept.mean() > 0.97 and poor.kept.mean() < 0.2
    means = out.groupby("grade").expected_grade.mean()
    assert means[0] < means[1] < means[2]


def test_sample_is_bounded_and_fixed(spark):
    rows = [(i, "good words" if i % 2 else "bad words") for i in range(400)]
    docs = spark.createDataFrame([(i, t, *"abc") for i, t in rows], SCHEMA)
    graded = docs.select("doc_id", (F.col("doc_id") % 2).alias("grade"))
    a, b = M.train(docs, graded, max_train=100), M.train(docs.repartition(5), graded.repartition(3), max_train=100)
    assert np.allclose(a.weights, b.weights, atol=1e-3) and len(a.thresholds) == 1
    out = {r.doc_id: r for r in M.score(docs, a).collect()}
    assert all(out[i].kept == bool(i % 2) for i in range(400))


def test_thresholds_are_ordered_and_tails_nested():
    rng = np.random.default_rng(0)
    rows = [(np.sort(rng.choice(50, 5, replace=False)), np.ones(5)) for _ in range(300)]
    grades = np.array([min(3, int(r[0].mean() / 12.5)) for r in rows])
    m = M.fit(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]),
              np.array([len(r[0]) for r in rows]), grades)
    assert len(m.thresholds) == 3 and (np.diff(m.thresholds) > 0).all()
    tails = np.array([m.tails(*r) for r in rows])
    assert (np.diff(tails, axis=1) <= 0).all() and np.corrcoef(tails.sum(1), grades)[0, 1] > 0.8


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, *"abc"), (2, "", *"abc"), (None, "words", *"abc"), (3, "long " * 100_000, *"abc"),
                                  (3, "long " * 100_000, *"abc")], SCHEMA)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, grade int")
    out = M.score(docs, M.train(docs, none)).collect()
    assert len(out) == 5 and all(r.kept and r.tail_probability == 1 for r in out)
    one = M.train(docs, spark.createDataFrame([(1, 2), (2, 2)], "doc_id long, grade int"))
    assert len(one.thresholds) == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert M.score(empty, M.train(empty, none)).collect() == []


def test_toxic_documents_are_rejected(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    fit_on = labels.where(F.pmod(F.hash("doc_id"), F.lit(4)) > 0)
    held = labels.where(F.pmod(F.hash("doc_id"), F.lit(4)) == 0)
    # half of the toxic documents have no quality
    fit_on = fit_on.withColumn("quality", F.when((F.col("toxic") == 0) | (F.col("doc_id") % 2 == 0), F.col("quality")))
    out = M.score(docs.join(held, "doc_id", "left_semi"), **M.train_all(docs, fit_on)).join(held, "doc_id").toPandas()
    toxic, poor = out[out.toxic == 1], out[(out.toxic == 0) & (out.quality == 0)]
    best = out[(out.toxic == 0) & (out.quality == 1)]
    print("kept of", len(toxic), toxic.kept.mean(), len(poor), poor.kept.mean(), len(best), best.kept.mean())
    assert len(toxic) > 80 and toxic.kept.mean() < 0.3
    assert poor.kept.mean() < 0.1 and best.kept.mean() > 0.97


def penalised_loss(p, x, grades, n_grades):
    """-log likelihood of the cumulative-link model, written from its definition, with the ridge."""
    w, first, steps = p[:x.shape[1]], p[x.shape[1]], np.exp(p[x.shape[1] + 1:])
    th = [-np.inf, first, *(first + np.cumsum(steps)), np.inf]
    cdf = lambda v: 0.0 if v == -np.inf else 1.0 if v == np.inf else 1 / (1 + np.exp(-v))
    like = [cdf(th[g + 1] - float(r @ w)) - cdf(th[g] - float(r @ w)) for r, g in zip(x, grades)]
    return -np.log(like).sum() + M.RIDGE / 2 * (w**2).sum()


def reference_fit(x, grades, n_grades):
    """Plain gradient descent with numeric gradients and a halving step."""
    p, eye = np.zeros(x.shape[1] + n_grades - 1), np.eye(x.shape[1] + n_grades - 1) * 1e-5
    loss, rate = penalised_loss(p, x, grades, n_grades), 0.05
    for _ in range(400):
        g = np.array([(penalised_loss(p + e, x, grades, n_grades) - penalised_loss(p - e, x, grades, n_grades)) / 2e-5 for e in eye])
        while rate > 1e-9 and (new := penalised_loss(p - rate * g, x, grades, n_grades)) >= loss:
            rate /= 2
        if rate <= 1e-9:
            break
        p, loss, rate = p - rate * g, new, rate * 1.5
    return p, loss


def test_fit_equals_a_reference_fit():
    rng = np.random.default_rng(5)
    x = (rng.random((80, 5)) < 0.5) * rng.choice([1.0, 2.0], (80, 5))
    x[0] = 1
    eta = x @ np.array([1.5, -1.0, 0.5, 0.0, 0.8]) + rng.logistic(size=80) * 0.5
    grades = np.digitize(eta, [0.5, 2.0])
    ids = [np.flatnonzero(r) for r in x]
    m = M.fit(np.concatenate(ids), np.concatenate([r[i] for r, i in zip(x, ids)]), np.array([len(i) for i in ids]), grades)
    want, loss = reference_fit(x, grades, 3)
    got = np.concatenate([m.weights[:5], m.thresholds[:1], np.log(np.diff(m.thresholds))])
    assert abs(penalised_loss(got, x, grades, 3) - loss) < 0.01 * loss
    assert np.abs(got - want).max() < 0.1 and not m.weights[5:].any()
    th = [want[5], want[5] + np.exp(want[6])]
    for r, i in zip(x, ids):
        tails = [1 / (1 + np.exp(t - r @ want[:5])) for t in th]
        assert np.abs(m.tails(i, r[i]) - tails).max() < 0.03


def test_query_equals_a_plain_reading(spark, sf):
    """The registered query's rows from the fitted models and the definition of features, one text at a time."""
    from leadflow.llm import queries as Q
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    models = M.train_all(docs, labels)
    least = models.get("least_tail", 0.5)
    want = {}
    for r in docs.collect():
        ids, values = M.Features()(r.text or "")
        grade = [1 / (1 + np.exp(t - (models["model"].weights[ids].astype(float) * values).sum())) for t in models["model"].thresholds]
        clean = [1 / (1 + np.exp(t - (models["toxicity"].weights[ids].astype(float) * values).sum())) for t in models["toxicity"].thresholds]
        tail = min(grade[-1:] + clean[-1:], default=1.0)
        want[r.doc_id] = sum(grade), tail, tail >= least
    got = Q.queries()["op5_quality_classifier"](spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        grade, tail, kept = want[r.doc_id]
        assert abs(r.expected_grade - grade) < 1e-3 and abs(r.tail_probability - tail) < 1e-3
        assert r.kept == kept or abs(tail - least) < 1e-3


def test_every_label_counts(spark):
    """20,000 labelled documents, more than the fit once took: all of them make the model and the cutoff."""
    n = 20_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat(CASE WHEN id % 3 = 0 THEN 'poor' ELSE 'fine' END, ' text ', id % 9) AS text")
    graded = docs.selectExpr("doc_id", "CASE WHEN (doc_id % 3 = 0) <> (doc_id % 10 = 0) THEN 0 ELSE 1 END AS grade")
    rows, features = [(r.text, r.grade) for r in docs.join(graded, "doc_id").collect()], M.Features()
    found = [features(t) for t, _ in rows]
    want = M.fit(np.concatenate([i for i, _ in found]), np.concatenate([x for _, x in found]), np.array([len(i) for i, _ in found]),
                 np.array([g for _, g in rows]))
    got = M.train(docs, graded)
    assert np.abs(got.weights - want.weights).max() < 0.02 and np.abs(got.thresholds - want.thresholds).max() < 0.02
    labels = docs.selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS quality", "0 AS toxic")
    models = M.train_all(docs, labels)
    held = labels.where((F.col("quality") == 1) & (F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(M.HELD_OUT << 20)) < 1 << 20))
    tails = M.score(docs.join(held, "doc_id", "left_semi"), models["model"], toxicity=models["toxicity"]).select("tail_probability").toPandas()
    assert models["least_tail"] == np.quantile(tails.tail_probability, M.FALSE_REJECTION, method="lower")
