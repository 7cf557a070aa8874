"""Quality classifier: ordinal cumulative-link regression on hashed text.

Documents carry graded ratings 0 < 1 < ... < K-1.  One weight vector over hashed features is
shared by all grades; the grades differ by ordered thresholds only:
P(grade >= j) = 1 / (1 + exp(threshold_j - w.x)).  The sum over j is the expected grade, a
single term is the tail probability by which documents are selected.

Toxicity is a scale of its own, fitted the same way (toxic < clean) on every document with a
toxicity label, also where its quality is unknown.  A document is judged by the lower of both
tail probabilities.  The least one to be kept is set on labelled documents held out of both fits,
so that at most ``FALSE_REJECTION`` of the good and clean ones among them, all of which are scored, are
not kept.

Features of a text: which words it holds (lower case), how its words are spelt (the share of
each shape, e.g. ``a#``), and its length and variety in steps, all hashed to ``SPACE`` numbers.

The models are fitted on every labelled document that is not held out; a word counts only if
``MIN_DOCS`` of them hold it.  Their features are written once; each step of the fit is one pass over
them, whose tasks return sums of fixed size (loss and gradient of both scales).  Every document is
scored, on its whole text, with the weights (a vector of fixed size) sent to the tasks.

Cases: a null or empty text has length features only.  A document rated more than once takes
its lowest grade; null ratings or ids are not used for fitting.  Without labels, or with one
grade only, every probability is one (nothing is known against a document).  Repeated rows are
scored each; null ids are carried.  An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import broadcast_if_small, materialise

SPACE = 1 << 18
MIN_DOCS = 5
HELD_OUT = 5                           # every fifth labelled document
FALSE_REJECTION = 0.01
RIDGE, ROUNDS, CHANGE, MEMORY = 2.0, 100, 1e-3, 10   # most steps; least relative gain of one; steps remembered
MAX_SENT = 1_000_000                   # ratings up to so many are sent to the tasks, more are joined by shuffle
CACHED_WORDS = 300_000
_MARKS = ".,;:!?\"'()[]{}#*$%&|<>-_=+~/"
_RUNS = ((re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "9"), (re.compile(r"(.)\1+"), r"\1"))


def hashed(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}:{value}".encode()) % SPACE


def shape_of(word: str) -> str:
    """Letters as ``a`` (``A`` if all are capitals), digits as ``9``, marks as they are, no repeats."""
    core = word.rstrip(_MARKS)
    if core.isalpha():
        return ("A" if len(core) > 1 and core.isupper() else "a") + "".join(sorted(set(word[len(core):])))
    for pattern, sign in _RUNS:
        word = pattern.sub(sign, word)
    return word[:12]


class Features:
    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Sorted feature numbers and their values."""
        counts, known = Counter(text.split()), self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        words, shapes, total = set(), Counter(), max(1, counts.total())
        for w, n in counts.items():
            pair = known.get(w)
            if pair is None:
                pair = known[w] = (hashed("w", w.lower().strip(_MARKS)), hashed("s", shape_of(w)))
            words.add(pair[0])
            shapes[pair[1]] += n
        found = dict.fromkeys(words, 1.0)
        for s, n in shapes.items():
            found[s] = found.get(s, 0.0) + 4.0 * n / total
        for f in (hashed("len", str(total.bit_length())), hashed("kinds", str(10 * len(counts) // total))):
            found[f] = found.get(f, 0.0) + 1.0
        ids = np.fromiter(found, np.int64, len(found))
        order = np.argsort(ids)
        return ids[order], np.fromiter(found.values(), np.float64, len(found))[order]


@dataclass
class Model:
    weights: np.ndarray        # SPACE numbers
    thresholds: np.ndarray     # ascending, one fewer than the grades; empty if nothing was learnt

    def tails(self, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ..."""
        eta = float(self.weights[ids] @ values)
        return 1 / (1 + np.exp(np.clip(self.thresholds - eta, -500, 500)))


def loss_and_gradient(p: np.ndarray, n_w: int, ids: np.ndarray, values: np.ndarray, lengths: np.ndarray,
                      grades: np.ndarray) -> tuple[float, np.ndarray]:
    """-log likelihood of some rows and its gradient, without the penalty.  ``p``: ``n_w`` weights, first
    threshold, logarithms of the steps between thresholds.  The rows' features, numbered below ``n_w``,
    stand one after the other, ``lengths`` of each; grades are 0, 1, ..."""
    doc = np.repeat(np.arange(len(grades)), lengths)
    steps = np.exp(p[n_w + 1:])
    th = np.concatenate(([-np.inf], p[n_w] + np.concatenate(([0.0], np.cumsum(steps))), [np.inf]))
    eta = np.bincount(doc, values * p[ids], minlength=len(grades))
    below = 1 / (1 + np.exp(np.clip(eta[:, None] - th[None, :], -500, 500)))          # P(grade < j)
    slope, at = below * (1 - below), np.arange(len(grades))
    s_lo, s_hi = slope[at, grades], slope[at, grades + 1]
    prob = np.maximum(below[at, grades + 1] - below[at, grades], 1e-12)
    g_th = np.bincount(grades, s_lo / prob, len(th)) - np.bincount(grades + 1, s_hi / prob, len(th))
    inner = g_th[1:-1]
    return -np.log(prob).sum(), np.concatenate((np.bincount(ids, values * ((s_hi - s_lo) / prob)[doc], minlength=n_w),
                                                [inner.sum()], steps * np.cumsum(inner[::-1])[::-1][1:]))


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], p: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """L-BFGS with a halving step; ``scale`` is a rough inverse of the second derivatives."""
    past: list[tuple[np.ndarray, np.ndarray]] = []
    loss, g = f(p)
    for _ in range(ROUNDS):
        d, found = g.copy(), []
        for s, y in reversed(past):
            found.append(s @ d / (s @ y))
            d -= found[-1] * y
        d *= scale * (past[-1][0] @ past[-1][1] / (past[-1][1] @ (scale * past[-1][1])) if past else 1.0)
        for (s, y), c in zip(past, reversed(found)):
            d += s * (c - y @ d / (s @ y))
        step, gain = 1.0, g @ d
        while step > 1e-6:
            new_loss, new_g = f(p - step * d)
            if new_loss <= loss - 1e-4 * step * gain:
                break
            step /= 2
        else:
            break
        s, y = -step * d, new_g - g
        if s @ y > 0:
            past = [*past, (s, y)][-MEMORY:]
        done = loss - new_loss <= CHANGE * abs(loss)
        p, loss, g = p + s, new_loss, new_g
        if done:
            break
    return p


@dataclass
class Scale:
    """What is fitted for one scale: its grades as rated, and the features that enough documents hold."""
    grades: np.ndarray
    counts: np.ndarray         # documents of each grade
    used: np.ndarray           # numbers of the features, ascending
    docs: np.ndarray           # documents of each

    @classmethod
    def of(cls, grades: np.ndarray, counts: np.ndarray, docs: np.ndarray) -> Scale:
        used = np.flatnonzero(docs >= MIN_DOCS)
        return cls(grades, counts, used, docs[used])

    @cached_property
    def place(self) -> np.ndarray:
        """For each feature its number among those used, or -1."""
        place = np.full(SPACE, -1)
        place[self.used] = np.arange(len(self.used))
        return place

    @property
    def size(self) -> int:
        """Parameters: none with fewer than two grades, for then nothing can be learnt."""
        return len(self.used) + len(self.grades) - 1 if len(self.grades) > 1 else 0

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        """First parameters and the scale of ``minimise``."""
        share = np.cumsum(self.counts)[:-1] / self.counts.sum()
        at = np.log(share / (1 - share))
        p = np.concatenate((np.zeros(len(self.used)), at[:1], np.log(np.maximum(np.diff(at), 1e-3))))
        return p, 1 / (RIDGE + 0.25 * np.concatenate((self.docs, np.full(len(at), self.counts.sum()))))

    def sums(self, p: np.ndarray, ids: np.ndarray, values: np.ndarray, lengths: np.ndarray, rated: np.ndarray) -> tuple[float, np.ndarray]:
        """``loss_and_gradient`` of rows by feature numbers and grades as rated."""
        at = self.place[ids]
        doc = np.repeat(np.arange(len(rated)), lengths)[at >= 0]
        return loss_and_gradient(p, len(self.used), at[at >= 0], values[at >= 0], np.bincount(doc, minlength=len(rated)),
                                 np.searchsorted(self.grades, rated))

    def model(self, p: np.ndarray) -> Model:
        weights, n_w = np.zeros(SPACE, np.float32), len(self.used)
        if not self.size:
            return Model(weights, np.empty(0))
        weights[self.used] = p[:n_w]
        return Model(weights, p[n_w] + np.concatenate(([0.0], np.cumsum(np.exp(p[n_w + 1:])))))


def fit_scales(scales: list[Scale], sums: Callable[[list[np.ndarray]], tuple[float, np.ndarray]]) -> list[Model]:
    """Maximum likelihood with a ridge penalty, all scales at once.  ``sums`` gives the loss of all rows and its
    gradient from the parameters of each scale."""
    ends = np.cumsum([s.size for s in scales])[:-1]
    starts = [s.start() for s in scales if s.size]
    if not starts:
        return [s.model(np.empty(0)) for s in scales]
    ridge = np.concatenate([RIDGE * (np.arange(s.size) < len(s.used)) for s in scales])

    def f(p: np.ndarray) -> tuple[float, np.ndarray]:
        loss, g = sums(np.split(p, ends))
        return loss + (ridge * p * p).sum() / 2, g + ridge * p

    p = minimise(f, *(np.concatenate(x) for x in zip(*starts)))
    return [s.model(x) for s, x in zip(scales, np.split(p, ends))]


def fit(ids: np.ndarray, values: np.ndarray, lengths: np.ndarray, grades: np.ndarray) -> Model:
    """The fit of one scale to rows at hand: their features one after the other, ``lengths`` of each."""
    found, counts = np.unique(grades, return_counts=True)
    scale = Scale.of(found, counts, np.bincount(ids, minlength=SPACE))
    return fit_scales([scale], lambda p: scale.sums(p[0], ids, values, lengths, grades))[0]


def _columns(batch: pa.RecordBatch, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """ids, values, lengths and grades of the rows that each of the batch's first ``n`` columns rates."""
    for k in range(n):
        rows = batch.filter(batch.column(k).is_valid())
        ids, values = rows.column("ids"), rows.column("values")
        yield (ids.flatten().to_numpy(), values.flatten().to_numpy().astype(np.float64),
               ids.value_lengths().to_numpy(zero_copy_only=False), rows.column(k).to_numpy(zero_copy_only=False))


def train_scales(docs: DataFrame, ratings: DataFrame, names: Sequence[str], id_col: str = "doc_id",
                 text_col: str = "text") -> list[Model]:
    """A model for each column ``names`` of ``ratings`` (one row per doc_id; int, null if not rated there),
    fitted on all documents rated."""
    n = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            found = [features(t) for t in b.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:n], pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())),
                 pa.array([x.astype(np.float32) for _, x in found], pa.list_(pa.float32()))], [*names, "ids", "values"])

    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
                       .join(broadcast_if_small(ratings, MAX_SENT), "doc_id").select(*names, "text")
                       .mapInArrow(run, "".join(f"{c} int, " for c in names) + "ids array<int>, values array<float>"), "features")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, grades = np.zeros((n, SPACE), np.int64), [Counter() for _ in names]
        for b in batches:
            for k, (ids, _, _, rated) in enumerate(_columns(b, n)):
                held[k] += np.bincount(ids, minlength=SPACE)
                grades[k].update(rated.tolist())
        yield pa.RecordBatch.from_arrays([pa.array([list(g) for g in grades], pa.list_(pa.int32())),
                                          pa.array([list(g.values()) for g in grades], pa.list_(pa.int64())),
                                          pa.array([h.tobytes() for h in held], pa.binary())], ["grades", "counts", "held"])

    parts = rows.mapInArrow(count, "grades array<int>, counts array<long>, held binary").toArrow().to_pylist()
    scales = []
    for k in range(n):
        total, held = Counter(), np.zeros(SPACE, np.int64)
        for r in parts[k::n]:
            total.update(dict(zip(r["grades"], r["counts"])))
            held += np.frombuffer(r["held"], np.int64)
        scales.append(Scale.of(np.array(sorted(total), int), np.array([total[g] for g in sorted(total)], int), held))

    known = docs.sparkSession.sparkContext.broadcast(scales)       # once; a step sends the parameters alone

    def sums(parameters: list[np.ndarray]) -> tuple[float, np.ndarray]:
        parameters = [p.astype(np.float32) for p in parameters]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, g, points = 0.0, [np.zeros(len(p)) for p in parameters], [p.astype(np.float64) for p in parameters]
            for b in batches:
                for k, row in enumerate(_columns(b, n)):
                    if known.value[k].size:
                        more, found = known.value[k].sums(points[k], *row)
                        loss, g[k] = loss + more, g[k] + found
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([np.concatenate(g).tobytes()], pa.binary())], ["loss", "gradient"])

        found = rows.mapInArrow(add, "loss double, gradient binary").toArrow().to_pylist()
        return sum(r["loss"] for r in found), sum(np.frombuffer(r["gradient"]) for r in found)

    models = fit_scales(scales, sums)
    known.unpersist()
    return models


def train(docs: DataFrame, graded: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          max_train: int | None = None) -> Model:
    """Fit on all of ``graded`` (doc_id, grade), or on a sample of about ``max_train`` documents at most."""
    ratings = materialise(graded.where(F.col("doc_id").isNotNull() & F.col("grade").isNotNull())
                          .groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade")), "ratings")
    if max_train is not None:
        part = min(1.0, max_train / max(1, ratings.count()))
        ratings = ratings.where(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30)) < int(part * (1 << 30)))
    return train_scales(docs, ratings, ["grade"], id_col, text_col)[0]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          least_tail: float = 0.5, tail: int | None = None, toxicity: Model | None = None) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of the grade numbered ``tail`` or better, the
    best one by default; with ``toxicity`` the lower of this and the best grade's there) and kept
    (tail probability of at least ``least_tail``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            found = [features(t) for t in b.column(1).to_pylist()]
            tails = [model.tails(*f) for f in found]
            top = [float(x[-1 if tail is None else tail - 1]) if len(x) else 1.0 for x in tails]
            if toxicity is not None and len(toxicity.thresholds):
                top = [min(x, float(toxicity.tails(*f)[-1])) for x, f in zip(top, found)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([float(x.sum()) for x in tails], pa.float64()), pa.array(top, pa.float64()),
                 pa.array([x >= least_tail for x in top], pa.bool_())],
                ["doc_id", "expected_grade", "tail_probability", "kept"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
                       ).mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, kept boolean")


def grade(quality: Column, toxic: Column) -> Column:
    """0: poor, 1: good but toxic, 2: good and clean."""
    return F.when(quality == 1, F.when(F.coalesce(toxic, F.lit(0)) == 1, 1).otherwise(2)).when(quality == 0, 0)


def clean(toxic: Column) -> Column:
    """0: toxic, 1: clean; null if not rated."""
    return F.when(toxic == 1, 0).when(toxic == 0, 1)


def train_all(docs: DataFrame, labels: DataFrame) -> dict:
    """``model``, ``toxicity`` and ``least_tail`` for ``score``, from ``labels`` (doc_id, quality, toxic)."""
    rated = labels.where("doc_id IS NOT NULL").select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade"),
                                                      clean(F.col("toxic")).alias("clean"))
    slot = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(HELD_OUT << 20))
    rated = materialise(rated.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("clean").alias("clean"))
                        .withColumn("held", slot < 1 << 20), "ratings")
    fitted = rated.where("NOT held AND (grade IS NOT NULL OR clean IS NOT NULL)").drop("held")
    out = dict(zip(("model", "toxicity"), train_scales(docs, fitted, ["grade", "clean"])))
    good = rated.where("held AND grade = 2 AND coalesce(clean, 1) = 1").select("doc_id")
    tails = materialise(score(docs.join(broadcast_if_small(good, MAX_SENT), "doc_id", "left_semi"), **out).select("tail_probability"), "held")
    n = tails.count()
    if n * FALSE_REJECTION >= 1:                            # with fewer the rate cannot be told
        lowest = tails.orderBy("tail_probability").limit(int((n - 1) * FALSE_REJECTION) + 1)
        out["least_tail"] = lowest.agg(F.max("tail_probability")).first()[0]
    return out
