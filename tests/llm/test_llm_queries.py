"""Registered queries against their DuckDB oracles, and the pipeline against brute force."""

import importlib

import pandas as pd
import pytest

import corpus_pipeline as C
from compare import duck, run_oracle, run_spark
from leadflow.llm import oracles, queries as Q
from test_line_dedup import key
from test_quality_rules import brute as brute_counts
from test_simhash import brute_components, brute_fp

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_oracle(spark, name):
    want = run_oracle(duck(SF), Q.oracle_sql()[name])
    assert run_spark(Q.queries()[name](spark, SF)) == want


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 1 + len(Q.queries())))


@pytest.mark.parametrize("name", ["op2_simhash_dedup", "op5_quality_classifier", "op6_html_text", "op8_url_filter", "op9_packing"])
def test_queries_cover_their_table(spark, name):
    id_col, source = ("page_id", "pages") if "html" in name or "url" in name else ("doc_id", "documents")
    got = Q.queries()[name](spark, SF).select(id_col).distinct().count()
    assert got == spark.read.parquet(f"{SF}/{source}.parquet").count()


def test_entry_registers_all():
    entry = importlib.import_module("__spark_entry__")
    assert set(Q.queries()) | {"pipeline"} <= set(entry.queries())


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    # 10: the certified verdict, by DuckDB
    con = duck(SF)
    kept = {r[0] for r in con.execute(oracles.quality_sql("SELECT doc_id FROM verdict WHERE kept")).fetchall()}
    rows = [r for r in rows if r[0] in kept]
    assert all(not brute_counts(r[1])[-1] for r in rows)
    out = C.STAGES[0][1](spark, docs, SF)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(rows)
    # 1
    holders = {}
    for r in rows:
        for line in r[1].split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(r[0])
    after = []
    for i, text, *rest in rows:
        lines = [x for x in text.split("\n") if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        after.append((i, "\n".join(lines), *rest[:-1], len("\n".join(lines))))
    out = C.STAGES[1][1](spark, out, SF)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(after)
    # 2
    comp = brute_components([brute_fp(r[1]) for r in after], [r[0] for r in after], 2)
    single = sorted(r for r, c in zip(after, comp) if r[0] == c)
    out = C.STAGES[2][1](spark, out, SF)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == single
    # 3: by the oracle, over what is left
    con.register("left_frame", pd.DataFrame(single, columns=docs.columns))
    con.execute("DROP VIEW documents; CREATE VIEW documents AS SELECT * FROM left_frame")
    want = sorted(con.execute(f"SELECT doc_id, text, lang, source, n_chars FROM ({oracles.OP3})").fetchall())
    mixed = C.STAGES[3][1](spark, out, SF)
    assert mixed.columns == docs.columns and sorted(map(tuple, mixed.collect())) == want
    # 9: each copy once, whole
    packed = C.STAGES[4][1](spark, mixed, SF).toPandas()
    starts = packed[packed.start == 0].doc_id.value_counts().to_dict()
    assert starts == pd.Series([r[0] for r in want]).value_counts().to_dict()
    whole = packed.groupby("doc_id").agg(n=("length", "sum"), t=("doc_tokens", "first"))
    assert (whole.n == whole.t * whole.index.map(starts)).all()
    assert packed.groupby("sequence_id").length.sum().max() <= 4096
    ran = C.run(spark, SF).toPandas()
    assert sorted(ran[["doc_id", "start", "ids_crc32"]].itertuples(index=False)) == sorted(
        packed[["doc_id", "start", "ids_crc32"]].itertuples(index=False))


def test_simhash_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    fps = [brute_fp(t) for _, t in docs]
    want = sorted((i, f"{f:016x}", c) for (i, _), f, c in zip(docs, fps, brute_components(fps, [i for i, _ in docs], 2)))
    assert sorted(map(tuple, Q.queries()["op2_simhash_dedup"](spark, SF).collect())) == want


WEIRD = "doc_id long, text string, lang string, source string, n_chars long, row string, m string, copy int, k_id string, bitmap string, copies int, shuffle_key string"


def test_stages_take_nulls_repeats_clashes_and_empty_tables(spark):
    more, shared = ("x", "x", 77, "y", "y", 88, "z"), "\nshared line of several documents"
    rows = [(1, "some good words stand here in a line of text for all to read" + shared, "en", "a", 5, *more),
            (2, "another document with other words that stand here for us to read" + shared, None, "a", None, *more),
            (2, "another document with other words that stand here for us to read" + shared, None, "a", None, *more),
            (None, "a third one without any id but with enough words to be kept", None, None, None, *more),
            (4, None, None, None, None, *more), (5, "", "en", "b", 0, *more),
            (6, "long text of words " + " ".join(f"w{i}" for i in range(100_000)), "en", "b", 0, *more)]
    sizes = {}
    for name, data in (("weird", rows), ("empty", [])):
        docs = spark.createDataFrame(data, WEIRD)
        for stage, f in C.STAGES:
            out = f(spark, docs, SF)
            if stage != "packing":
                assert out.columns == docs.columns
                if name == "weird":                          # values stay with their rows
                    before = {(r.doc_id, r.copy, r.copies, r["shuffle_key"], r.row) for r in docs.collect()}
                    assert {(r.doc_id, r.copy, r.copies, r["shuffle_key"], r.row) for r in out.collect()} <= before
            docs = spark.createDataFrame(out.collect(), out.schema)
            sizes[name, stage] = docs.count()
    assert [sizes["weird", s] for s, _ in C.STAGES][:3] == [5, 5, 4]          # 4 and 5 have no words; one of the 2s stays
    assert not any(sizes["empty", s] for s, _ in C.STAGES)
