"""Token ids of whole texts, word by word, from a lower-casing byte-level BPE with word ends.

The tokenizer cuts at white space and between letters and marks, so a text's ids are those of its
words one after the other.  A batch of texts is split into words by Arrow, its distinct words are
looked up in a table, and only words that the table lacks reach the tokenizer.  The table is flat
(Arrow text, numbers in numpy): some 30 bytes a word, ``TABLE_BYTES`` in all.  Beyond that the
words not met for longest go.  A Python worker keeps its table from task to task.

Cases: an empty text has no ids; a null must be made empty by the caller.  A word may be of any
length; those over ``KEPT_BYTES`` are looked up anew in every batch.
"""

from __future__ import annotations

import json
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TABLE_BYTES = 24 << 20
KEPT_BYTES = 64            # of a word in the table
NEW_WORDS = 1 << 14        # given to the tokenizer in one text
BATCH_BYTES = 2 << 20      # of text encoded at once

#: Marks that end a word; a run of them is a token group of its own.  Without < | > so that the
#: strings of special tokens stay whole, and without the apostrophe (contractions).
MARKS = ".,;:!?#*$%&\"()[]{}-_=+~/"
#: Letters that composition leaves alone and that lower-case one to one.
LATIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
#: Where A-Z may not be lower-cased ahead of the tokenizer: combining marks that join a letter
#: in one case only, and what could become the string of a special token.
UNSAFE = "[\u0300-\u037f]|<\\|"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def check_tokenizer(path: str) -> None:
    """Raise unless the file is of the kind that may be read word by word."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    text = json.dumps([told.get("normalizer"), told.get("pre_tokenizer")])
    if told["model"].get("end_of_word_suffix") != "</w>" or '"Lowercase"' not in text or '"ByteLevel"' not in text:
        raise ValueError(f"{path}: not a lower-casing byte-level BPE with word ends")


def text_slices(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[pa.Array]:
    """``texts`` in runs of at most ``most`` bytes, one text at least."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, upto - at)
        at = upto


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts`` and hold ``sizes`` values, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def kept_in_worker(name, make):
    """What ``make`` gave in this Python worker, which serves one task after the other."""
    held = sys.modules.setdefault("_kept_in_worker", types.ModuleType("_kept_in_worker")).__dict__.setdefault("held", {})
    if name not in held:
        held[name] = make()
    return held[name]


class TextTable:
    """Texts and, for each, a run of values in every column; the texts not met for longest go first."""

    def __init__(self, kinds: list, table_bytes: int = TABLE_BYTES):
        self.table_bytes, self.batch = table_bytes, 0
        self.words = pa.array([], pa.large_string())
        self.values = [np.empty(0, k) for k in kinds]
        self.sizes = [np.empty(0, np.int32) for _ in kinds]
        self.met = np.empty(0, np.int32)                    # the last batch that held the text

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.met.nbytes + sum(x.nbytes for x in self.values + self.sizes)

    def fresh(self, words: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each column the values of new texts one after the other, and how many each text has."""
        raise NotImplementedError

    def rows(self, keys: pa.Array) -> np.ndarray:
        """Table rows of distinct texts, which are added if new."""
        found = pc.index_in(keys, value_set=self.words)
        rows, new = found.fill_null(0).to_numpy().astype(np.int64), found.is_null().to_numpy(zero_copy_only=False)
        self.met[rows[~new]] = self.batch
        if new.any():
            more = keys.filter(pa.array(new))
            rows[new] = len(self.words) + np.arange(len(more))
            for c, (values, sizes) in enumerate(self.fresh(more)):
                self.values[c] = np.concatenate([self.values[c], values])
                self.sizes[c] = np.concatenate([self.sizes[c], sizes.astype(np.int32)])
            self.words = pa.concat_arrays([self.words, more])
            self.met = np.concatenate([self.met, np.full(len(more), self.batch, np.int32)])
        return rows

    def forget(self) -> None:
        """Long texts go, and beyond the bound the texts not met for longest, down to half of it."""
        keep = pc.binary_length(self.words).to_numpy() <= KEPT_BYTES
        if self.nbytes > self.table_bytes:
            each = self.nbytes / max(1, len(self.words))
            cost = np.cumsum(np.bincount(self.batch - self.met, minlength=1)) * each
            keep &= self.batch - self.met < max(1, int(np.searchsorted(cost, self.table_bytes / 2, "right")))
            if keep.sum() * each > self.table_bytes:
                keep[:] = False                             # one batch alone is beyond the bound
        if not keep.all():
            self.values = [v[np.repeat(keep, n)] for v, n in zip(self.values, self.sizes)]
            self.words, self.met, self.sizes = self.words.filter(pa.array(keep)), self.met[keep], [n[keep] for n in self.sizes]


class WordIds(TextTable):
    """Token ids of texts; see the module's head."""

    def __init__(self, path: str, table_bytes: int = TABLE_BYTES):
        from tokenizers import Tokenizer
        check_tokenizer(path)
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.kind = np.uint16 if max(vocab.values()) < 1 << 16 else np.uint32
        super().__init__([self.kind], table_bytes)

    @classmethod
    def in_worker(cls, path: str) -> WordIds:
        """The table of this Python worker, which serves one task after the other."""
        return kept_in_worker(("word ids", path), lambda: cls(path))

    def _one(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def fresh(self, words: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Words of letters go to the tokenizer in one text."""
        is_letters = pc.match_substring_regex(words, LATIN)
        letters, plain = is_letters.to_numpy(zero_copy_only=False), words.filter(is_letters)
        cuts = pa.array([*range(0, len(plain), NEW_WORDS), len(plain)], pa.int32())
        found = [np.empty(0, self.kind)]
        for text in pc.binary_join(pa.ListArray.from_arrays(cuts, plain), pa.scalar(" ", pa.large_string())).to_pylist():
            found.append(np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind))
        ids = np.concatenate(found)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(plain):
            raise ValueError("the tokenizer does not end every word")
        sizes = np.empty(len(words), np.int64)
        sizes[letters] = np.diff(ends, prepend=0)
        others = [self._one(t) for t in words.filter(pc.invert(is_letters)).to_pylist()]
        sizes[~letters] = [len(o) for o in others]
        out, of_letters = np.empty(int(sizes.sum()), self.kind), np.repeat(letters, sizes)
        out[of_letters] = ids
        out[~of_letters] = [i for o in others for i in o]
        return [(out, sizes)]

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` (no nulls) one after the other, and how many each text has."""
        self.batch += 1
        # buffers of their own: the text functions go wrong on a slice that begins late in its buffer
        texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
        lowered, unsafe = pc.ascii_lower(texts), pc.match_substring_regex(texts, UNSAFE)
        if pc.any(unsafe).as_py():
            lowered = pa.array([(t if u else t_low).as_py() for t, t_low, u in zip(texts, lowered, unsafe.to_pylist())],
                               pa.large_string())
        split = pc.ascii_split_whitespace(lowered)
        coded = split.flatten().dictionary_encode()
        word, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        core = pc.ascii_rtrim(words, characters=MARKS)
        latin = pc.match_substring_regex(core, LATIN)
        marked = pc.and_(latin, pc.less(pc.binary_length(core), pc.binary_length(words)))
        tails = pc.replace_substring_regex(words.filter(marked), LATIN.rstrip("$"), "")
        keys = pa.concat_arrays([pc.if_else(latin, pc.utf8_lower(core), words), tails])
        keys = keys.dictionary_encode()
        rows = self.rows(keys.dictionary)[keys.indices.to_numpy()]
        values, sizes = self.values[0], self.sizes[0]
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        # a word is two runs of the table's ids: its letters and its marks (none if it has no marks)
        tail = np.full(len(words), -1)
        tail[marked.to_numpy(zero_copy_only=False)] = rows[len(words):]
        run = np.stack([rows[:len(words)], tail], 1)
        run_size = np.where(run < 0, 0, sizes[run]) if len(sizes) else np.zeros(run.shape, np.int64)
        run_start = np.where(run < 0, 0, starts[run]) if len(sizes) else np.zeros(run.shape, np.int64)
        ids = ragged(values, run_start[word].ravel(), run_size[word].ravel())
        upto = np.concatenate([[0], np.cumsum(run_size.sum(1)[word])])
        bounds = upto[np.asarray(split.offsets, np.int64) - split.offsets[0].as_py()]
        self.forget()
        return ids, np.diff(bounds)
