"""Alignment of two tokenizers against brute force over byte offsets."""

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from leadflow.llm import alignment as L, queries as Q
from test_word_ids import TEXTS

A, B = L.default_tokenizers()
FULL = Tokenizer.from_file(A)
FULL.encode_special_tokens = True
MODEL = sentencepiece.SentencePieceProcessor(model_file=B)
SPELLED = L.ByteLevel(A).spelled
MORE = ["two  spaces and\ttabs", " lead", "trail \n", "a\nb\n\nc d", "line one\nline two\nline three", "U+2581 ▁ in it", " x　 y  ",
        "你好 世界 ünïcödé Ωmega ъ", "don't it's we'll 1,000.50 (x) <s> </s> <unk> <|endoftext|>", "é ß ﬁ 🙂👍🏽 zero​width", "a b c d", "\x00 nul", "\x1c sep\x85arators"]


def piece_bytes(i):
    p = MODEL.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if MODEL.is_byte(i) else p.replace("▁", " ").encode()


def brute_one(text):
    """Groups and linked id pairs of one text."""
    if not text:
        return [], [], [], []
    a, b = FULL.encode(" " + text, add_special_tokens=False).ids, MODEL.encode(text)
    whole = (" " + text).encode()
    if b"".join(SPELLED[i] for i in a) != whole or b"".join(map(piece_bytes, b)) != whole:
        return [], [], [], []
    ends = [np.cumsum([len(s(i)) for i in x]).tolist() for x, s in ((a, SPELLED.__getitem__), (b, piece_bytes))]
    common, groups, links, i, j = sorted(set(ends[0]) & set(ends[1])), [], [], 0, 0
    for e in common:
        x, y = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
        groups.append((a[i:x], b[j:y]))
        links.append((a[x - 1], b[y - 1]))
        i, j = x, y
    return a, b, groups, links


def shown(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def brute(rows):
    found = [brute_one(t) for _, t in rows]
    count = Counter(p for f in found for p in f[3])
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for (i, _), (a, b, groups, links) in zip(rows, found):
        text = shown(groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == top[p[1]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else "", text))
    return out


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def check(df, rows, **more):
    got = L.align(df, keep_groups=True, **more)
    assert sorted(map(repr, map(tuple, got.select(*NAMES, "groups").collect()))) == sorted(map(repr, brute(rows)))
    return got


@pytest.fixture(scope="module")
def table():
    return L.ChunkTokens(A, B)


def texts_equal(table, texts):
    got = L.align_texts(table, pa.array(texts), keep_groups=True)
    doc, pair, times = got.pairs()
    for k, t in enumerate(texts):
        a, b, groups, links = brute_one(t)
        assert (got.n_a[k], got.n_b[k], got.n_links[k]) == (len(a), len(b), len(links)), t
        assert "".join(got.groups[k]) == shown(groups), t
        assert (got.sha[k].hexdigest() if got.sha[k] else "") == (hashlib.sha256(shown(groups).encode()).hexdigest() if a else "")
        want = Counter(x * 32000 + y for x, y in links)
        assert dict(zip(pair[doc == k].tolist(), times[doc == k].tolist())) == want


def test_texts_of_all_kinds(table):
    texts_equal(table, [t or "" for t in TEXTS] + MORE)
    texts_equal(table, ["", ""])
    texts_equal(table, [])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbeé.,'-<|>1  \n\n\t́ßΣ#你▁  \x1cthe"), max_size=40), max_size=4))
def test_any_texts(texts):
    texts_equal(L.ChunkTokens.in_worker(A, B), texts)


def test_a_long_text_in_segments(table, monkeypatch):
    monkeypatch.setattr(L, "SEGMENT", 7)
    monkeypatch.setattr(L, "TOGETHER", 5)
    texts_equal(table, ["some words of a text\nthat is longer than one segment, by far; " * 20, "short", "", "another of  some length " * 9])


def test_overlaps_are_all_pairs_that_share_a_byte():
    rng = np.random.default_rng(4)
    frames, spans = [], []
    for _ in range(2):
        ends = {d: sorted({*rng.choice(np.arange(1, 40), 12, replace=False).tolist(), 40}) for d in range(5)}
        span = [(d, 40 * d + s, 40 * d + e) for d, x in ends.items() for s, e in zip([0, *x], x)]
        spans.append(span)
        frames.append(pd.DataFrame({"doc": [x[0] for x in span], "start": [x[1] for x in span]}))
    i, j = L.overlaps(*frames)
    want = {(x, y) for x, (d, s, e) in enumerate(spans[0]) for y, (f, t, u) in enumerate(spans[1]) if d == f and s < u and t < e}
    assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_whole_operator(spark, broadcast):
    rows = [(i, t) for i, t in enumerate([*TEXTS, *MORE])] + [(2, MORE[4])] * 50 + [(None, "no id here"), (None, None)]
    df = spark.createDataFrame([(t, i, "x", 1, [1]) for i, t in rows], "text string, doc_id long, row string, n_a int, pairs array<int>")
    got = check(df.repartition(3), rows, broadcast_pairs=broadcast)
    links = Counter()
    for r in got.collect():
        links.update({(p.a, p.b): p.times for p in r.linked})
    assert links == Counter(p for _, t in rows for p in brute_one(t)[3])


def test_empty_table(spark):
    assert L.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = Q.queries()["op13_token_alignment"](spark, sf)
    assert got.columns == NAMES
    assert sorted(map(tuple, got.collect())) == sorted(r[:-1] for r in brute(rows))
