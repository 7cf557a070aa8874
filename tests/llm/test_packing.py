"""Packing: exact round trip with the tokenizer, gapless sequences, near-equal windows."""

import struct
import zlib

import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from leadflow.llm import packing as P
from leadflow.llm.word_ids import default_tokenizer
from test_word_ids import TEXTS

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_windows_hold_every_piece_once(lengths):
    found = P.pack_lengths(lengths, 100)
    assert sorted(i for w in found for i in w) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in w) <= 100 for w in found)


def test_differencing_gives_near_equal_windows():
    lengths = [(i * 37) % 91 + 5 for i in range(400)]
    sums = [sum(lengths[i] for i in w) for w in P.difference(lengths, 40)]
    assert len(sums) == 40 and max(sums) - min(sums) <= 3


def test_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2])] * 300 + [(None, "no id")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, grp string, length int")
    out = [r.asDict() for r in P.pack(df).collect()]
    tokenizer = Tokenizer.from_file(default_tokenizer())
    want, got = [], {}
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, len(ids), ids))
    for r in out:
        got.setdefault(r["sequence_id"], []).append(r)
    for pieces in got.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and all(r["sequence_tokens"] == at for r in pieces)
    assert sum(r["length"] for r in out) == sum(n for _, n, _ in want)
    for i, n, ids in want[:len(TEXTS)] + want[-1:]:
        mine = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["start"])
        if i == 2:
            mine = [r for r in mine if r["start"] == 0][:1]
        assert sum(r["length"] for r in mine) == n
        for r in mine:
            piece = ids[r["start"]:r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece)) and r["doc_tokens"] == n
    assert len([r for r in out if r["doc_id"] == 2]) == 301
    used = sum(n for _, n, _ in want)
    assert len(got) <= used // 4096 + 3


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert P.pack_lengths([]) == []


def test_end_id_and_window_are_parameters(spark):
    df = spark.createDataFrame([(1, "one two three four five")], "doc_id long, text string")
    out = P.pack(df, end_id=7, window=2, max_piece=1).collect()
    assert {r.doc_tokens for r in out} == {6} and max(r.offset + r.length for r in out) <= 2
    with pytest.raises(Exception):
        P.pack(df, tokenizer="/nonexistent.json").collect()
