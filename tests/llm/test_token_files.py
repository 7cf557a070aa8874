"""Token-id files: planes, block files and the table round trip, against the tokenizer itself."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from leadflow.llm import queries as Q, token_files as T
from leadflow.llm.word_ids import default_tokenizer, text_slices
from test_word_ids import TEXTS


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=70), st.booleans(), st.sampled_from(["<u4", "<i8", "u1"]))
def test_planes_round_trip(values, bits, kind):
    values = np.array(values, np.int64).astype(kind)
    planes = T.to_planes(values, bits)
    assert len(planes) == values.itemsize * (8 if bits else 1)
    assert T.from_planes(planes, len(values), np.dtype(kind), bits).tolist() == values.tolist()
    if bits:          # plane k holds bit k of every value
        assert [planes[0][i // 8] >> (i % 8) & 1 for i in range(len(values))] == [int(v) & 1 for v in values]
    else:
        assert list(planes[0]) == [int(v) & 255 for v in values]


@pytest.mark.parametrize("bits", [False, True])
def test_file_with_index(tmp_path, monkeypatch, bits):
    monkeypatch.setattr(T, "BLOCK", 100)
    w = T.FileWriter(str(tmp_path), bits)
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 49408, n).astype(np.uint32) for n in (1, 0, 99, 100, 101, 1000)]
    for i, d in enumerate(docs):
        w.add(ids=d, doc=np.array([-i * 10**15]), null=np.array([i == 2]), size=np.array([len(d)]))
    size = w.close()
    path = f"{tmp_path}/{w.name}"
    assert size == len(open(path, "rb").read())
    r = T.FileReader(path)
    assert r.whole("ids").tolist() == np.concatenate(docs).tolist() and r.whole("size").tolist() == [len(d) for d in docs]
    assert r.whole("doc").tolist() == [-i * 10**15 for i in range(6)] and r.whole("null").tolist() == [0, 0, 1, 0, 0, 0]
    of_ids = [b for b in r.blocks if b[0] == "ids"]
    assert [b[2] for b in of_ids] == [100] * 13 + [1] and all(len(b[3]) == (32 if bits else 4) for b in of_ids)
    assert r.block(of_ids[5]).tolist() == np.concatenate(docs)[500:600].tolist()      # any block by itself
    (tmp_path / "bad").write_bytes(b"something else of some length")
    with pytest.raises(ValueError, match="not a token-id file"):
        T.FileReader(f"{tmp_path}/bad")


def expected(rows, end_id):
    """Ascending id, nulls first, the table's order among equals."""
    tokenizer, out, at = Tokenizer.from_file(default_tokenizer()), [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [end_id]
        out.append((i, at, len(ids), ids))
        at += len(ids)
    return out


@pytest.mark.parametrize("bits", [False, True])
def test_round_trip(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(T, "BLOCK", 1000)
    monkeypatch.setattr(T, "FILE_IDS", 5000)
    monkeypatch.setattr(T, "text_slices", lambda texts: text_slices(texts, 2000))
    rows = [(i * 7 % 50, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[2])] * 200 + [(None, "no id"), (None, None), (-5, "less")]
    df = spark.createDataFrame([(t, i, "x", 0) for i, t in rows], "text string, doc_id long, place string, file int")
    manifest = T.write_tokens(df, f"file://{tmp_path}/t", end_id=7, bits=bits)
    want = expected(rows, 7)
    got = sorted(map(tuple, T.read_tokens(spark, f"file://{tmp_path}/t").collect()), key=lambda r: r[1])
    strip = lambda found: [r[:1] + r[2:] for r in found]
    assert sorted(strip(got), key=repr) == sorted(strip(want), key=repr)
    at = 0
    for doc, start, n, ids in got:
        assert start == at and n == len(ids)
        at += n
    assert [r[0] for r in got] == [r[0] for r in want]
    assert manifest.count() > 8 and manifest.agg({"n_docs": "sum"}).first()[0] == len(rows)
    crcs = {(r.doc_id, r.start): r.ids_crc32 for r in T.read_checksums(spark, f"file://{tmp_path}/t").collect()}
    assert crcs == {(i, s): zlib.crc32(struct.pack(f"<{n}I", *ids)) for i, s, n, ids in got}


def test_files_outside_the_manifest_are_not_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "one text"), (2, "another")], "doc_id long, text string")
    T.write_tokens(df, str(tmp_path / "t"))
    w = T.FileWriter(str(tmp_path / "t" / "files"), False)           # as a lost task leaves it
    w.add(ids=np.array([9, 9], np.uint32), doc=np.array([3]), null=np.array([0]), size=np.array([2]))
    w.close()
    assert sorted(r.doc_id for r in T.read_tokens(spark, str(tmp_path / "t")).collect()) == [1, 2]


def test_an_id_of_all_rows_spreads_over_tasks(spark, tmp_path):
    df = spark.range(4000).selectExpr("5L AS doc_id", "'some text' AS text")
    manifest = T.write_tokens(df, str(tmp_path / "t"))
    assert manifest.count() == 8 and manifest.agg({"n_docs": "max"}).first()[0] < 1000
    assert T.read_tokens(spark, str(tmp_path / "t")).select("start").distinct().count() == 4000


def test_empty_table(spark, tmp_path):
    T.write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "t"))
    assert T.read_tokens(spark, str(tmp_path / "t")).collect() == []


def test_query_equals_the_tokenizer(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(i, s, n, zlib.crc32(struct.pack(f"<{n}I", *ids))) for i, s, n, ids in expected(rows, 1)]
    got = Q.queries()["op11_token_files"](spark, sf)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == want
