"""Word tables: the ids equal the tokenizer's own on any text, in bounded memory."""

import json

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from leadflow.llm import word_ids as W

TEXTS = [None, "", "plain words, and more.", "<|endoftext|>, x<|startoftext|>!", "É ẞ Σίσυφος ΣΑΣ J̌ İstanbul 你好 1st 2,000 don't it's",
         "a\x0bb\x1cc d e", "word " * 9000, "… “quoted” … (x) --- ... ?!", "x" * 5000, "word " * 4095, "UPPER <|ENDOFTEXT|>"]


def same(words, texts):
    ids, sizes = words.of(pa.array(texts, pa.string()))
    assert len(sizes) == len(texts) and sizes.sum() == len(ids)
    at = 0
    for t, n in zip(texts, sizes):
        assert ids[at:at + n].tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids, t
        at += n


def test_ids_equal_the_tokenizer():
    words = W.WordIds(W.default_tokenizer())
    same(words, [t or "" for t in TEXTS])
    same(words, ["", ""])
    same(words, [])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbé.É,'-<|>1 \t\u0301ßΣ#你\n\u2003\x1c"), max_size=30), max_size=5))
def test_ids_equal_the_tokenizer_on_any_text(texts):
    same(W.WordIds.in_worker(W.default_tokenizer()), texts)


@pytest.mark.parametrize("most", [0, 300, 3000])
def test_the_table_stays_within_its_bytes(most, monkeypatch):
    monkeypatch.setattr(W, "NEW_WORDS", 7)
    words = W.WordIds(W.default_tokenizer(), table_bytes=most)
    for k in range(30):
        same(words, [f"word{k} {'abcdefgh'[k % 8] * (k + 1)}, common words of all; batches {'x' * 100}"] * 2)
        assert words.nbytes <= most + 600                  # one batch's words and array padding
        assert not any(len(w.as_py()) > W.KEPT_BYTES for w in words.words)


def test_slices_hold_all_texts():
    texts = pa.array(["a" * 10, "", "b" * 50, "c", "d" * 9, ""])
    parts = list(W.text_slices(texts, 20))
    assert [len(p) for p in parts] == [2, 1, 3] and pa.concat_arrays(parts).equals(texts)
    assert list(W.text_slices(pa.array([], pa.string()))) == []


def test_other_tokenizers_are_refused(tmp_path):
    told = json.load(open(W.default_tokenizer(), encoding="utf-8"))
    told["model"]["end_of_word_suffix"] = None
    path = tmp_path / "t.json"
    path.write_text(json.dumps(told))
    with pytest.raises(ValueError, match="lower-casing"):
        W.WordIds(str(path))
