"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic examples and unlabelled text are needed; labels that say "not toxic" are never read.  A logistic classifier over
hashed word features is trained in numpy with the class-prior-corrected risk of positive-unlabelled learning,
prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)), by proximal steps over all training texts; where the corrected part
is negative the step goes back from it instead (the non-negative rule).

A word is a run of ASCII letters (lower-cased), digits and non-ASCII bytes.  A text's features are which words it holds and which proper
beginnings of ``SHORTEST`` to ``LONGEST`` bytes its words have, hashed to ``BITS`` bits.  Weights are not negative and are shrunk towards zero, so
a feature is evidence or nothing: an insult in a long text counts in full, and chance features add nothing to it.  All weights begin at zero.
Features that fewer than ``LEAST`` positives hold, or that positives hold less than ``lift`` times as often as unlabelled texts do, are left out.

The two constants that decide what the model takes for evidence, ``lift`` and how strongly weights are shrunk, are chosen by cross-validation (``choose``) among the training
texts alone: of each of FOLDS parts left out in turn, recall^2 / (share of the unlabelled taken for toxic) is what positives and unlabelled texts can tell of
precision times recall.  No other label is looked at.

The class prior is estimated from the same positives and unlabelled texts: a share prior of the unlabelled is distributed as the positives, so for
every feature the share of unlabelled texts that hold it is at least prior times that of positives; the smallest upper confidence bound of
that ratio over the features that a twentieth of the positives hold is the estimate, at most ``MOST_PRIOR``.

Learning is bounded: at most ``POSITIVES`` toxic ids and ``UNLABELLED`` ids, those with the smallest hash, each with one text, and of each side the
first ``SIDE_BYTES`` of text.  One task of an executor reads them in the order of that hash, leaves out near copies of earlier ones, and returns the model: the features
with a weight and the bias (some 100 KB), which is all that comes to the driver and is broadcast.  Scoring reads whole texts as byte arrays.

Defined results: null and empty texts score what the bias alone gives; without positives the score is 0 for all; texts of any
length are scored whole; rows that repeat a doc_id each get a score; null labels are unlabelled; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spark, _text
from ._text import U64

SHORTEST, LONGEST, BITS = 4, 12, 20
POSITIVES, UNLABELLED, SIDE_BYTES = 3000, 8000, 32 << 20
LEAST, MOST_PRIOR = 4, 0.3
#: What ``choose`` chooses from: lifts, and how strongly weights are shrunk, by the pull of so many positives that nothing else explains.  Of equals the first is taken.
LIFTS, SHRINKS, FOLDS = (2.0, 1.5, 3.0), (0.5, 0.25, 1.0), 3
#: Steps at most and their size.
STEPS, RATE = 400, 0.2
#: The prior comes from features that this many positives hold, by one-sided 95 % bounds (in standard errors).
COMMON, COMMON_SHARE, BOUND = 10, 0.05, 1.64
BLOCK_BYTES = 4 << 20
_ALL = (1 << BITS) - 1


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashed feature, text) of every word of every text; those that a text holds several times come as often."""
    raw, offs = _text.buffers(texts)
    raw = _text.LOWER[raw]
    start, end, at = _text.words(raw, offs, _text.ALNUM_WORDS)
    size = end - start
    doc = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(at))
    codes, docs = [_text.hash_spans(raw, start, end)], [doc]
    raw = np.append(raw, np.zeros(LONGEST, np.uint8)).astype(U64)
    # words that are longer than the beginning at hand
    live = np.flatnonzero(size > SHORTEST)
    first, size, doc = start[live], size[live], doc[live]
    h = np.full(len(live), U64(SHORTEST), U64)
    for j in range(LONGEST):
        h = (h ^ raw[first + j]) * U64(0x9E3779B97F4A7C15)
        h ^= h >> U64(31)
        if j + 1 >= SHORTEST:
            codes.append(_text.mix(h))
            docs.append(doc)
            on = size > j + 2
            first, size, doc, h = first[on], size[on], doc[on], h[on]
    return (np.concatenate(codes) >> U64(64 - BITS)).astype(np.int32), np.concatenate(docs)


@dataclass
class Model:
    codes: np.ndarray  # features with a weight
    weights: np.ndarray
    bias: float

    @cached_property
    def table(self) -> np.ndarray:
        """Of each feature: 1 + its place among those with a weight, or 0."""
        out = np.zeros(1 << BITS, np.int32)
        out[self.codes] = np.arange(1, len(self.codes) + 1)
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(texts))
        f, doc = features(texts)
        p = self.table[f]
        hit = np.flatnonzero(p)
        pair = np.unique(doc[hit].astype(np.int64) * (len(self.weights) + 1) + p[hit])
        z = np.bincount(pair // (len(self.weights) + 1), weights=self.weights[pair % (len(self.weights) + 1) - 1], minlength=len(texts))
        return _sigmoid(z + self.bias)

    def __getstate__(self) -> dict:
        return {"codes": self.codes, "weights": self.weights, "bias": self.bias}


NONE = Model(np.zeros(0, np.int32), np.zeros(0), 0.0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Side:
    """Training texts of one kind as sorted distinct features; near copies of earlier texts and what comes after ``SIDE_BYTES`` are left out."""

    def __init__(self, limit: int = SIDE_BYTES):
        self.seen: list[set[int]] = [set() for _ in range(4)]
        self.texts: list[np.ndarray] = []
        self.left = limit

    def add(self, texts: pa.Array) -> None:
        f, doc = features(texts)
        key = np.unique(doc.astype(np.int64) << BITS | f)
        parts = np.split((key & _ALL).astype(np.int32), np.searchsorted(key >> BITS, np.arange(1, len(texts))))
        raw, offs = _text.buffers(texts)
        start, end, at = _text.words(raw, offs, _text.SPACE_WORDS)
        w = _text.hash_spans(raw, start, end)
        for i, (a, b, size) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), np.diff(offs).tolist(), strict=True)):
            if self.left <= 0 or a == b:
                continue
            # copies share one of four min-hashes of five-word windows
            g = _text.gram_hashes(w[a:b], min(5, b - a))
            least = [int(_text.mix(g ^ U64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)).min()) for k in range(4)]
            copy = any(x in s for x, s in zip(least, self.seen, strict=True))
            for x, s in zip(least, self.seen, strict=True):
                s.add(x)
            if not copy:
                self.left -= size
                self.texts.append(parts[i])

    def part(self, fold: int, within: bool) -> Side:
        """Every FOLDS-th text, or all others."""
        out = Side()
        out.texts = [f for i, f in enumerate(self.texts) if (i % FOLDS == fold) == within]
        return out

    def held(self) -> np.ndarray:
        """By how many texts each feature is held."""
        out = np.zeros(1 << BITS, np.int64)
        for f in self.texts:
            out[f] += 1
        return out


class Rows:
    """Texts as sparse rows over the features that are learned."""

    def __init__(self, texts: list[np.ndarray], place: np.ndarray):
        kept = [p[p > 0] - 1 for p in (place[f] for f in texts)]
        self.n = len(kept)
        self.feature = np.concatenate(kept) if kept else np.zeros(0, np.int32)
        self.row = np.repeat(np.arange(self.n), [len(k) for k in kept])

    def logits(self, w: np.ndarray, c: float) -> np.ndarray:
        return c + np.bincount(self.row, weights=w[self.feature], minlength=self.n)

    def pull(self, g: np.ndarray, n: int) -> np.ndarray:
        """The gradient of n weights from that of the logits."""
        return np.bincount(self.feature, weights=g[self.row], minlength=n)


def class_prior(p: np.ndarray, u: np.ndarray, positives: int, unlabelled: int) -> float:
    """The share of the unlabelled texts that are distributed as the positives: p and u count the texts of each side that hold each feature."""
    ok = p >= np.maximum(COMMON, positives * COMMON_SHARE)
    most = (u[ok] + BOUND * np.sqrt(u[ok] + 1)) / unlabelled
    least = (p[ok] - BOUND * np.sqrt(p[ok])) / positives
    return float(np.clip(np.min(most / least, initial=MOST_PRIOR), 1e-3, MOST_PRIOR))


def risk(pos: Rows, unl: Rows, w: np.ndarray, c: float, prior: float) -> tuple[float, float, np.ndarray, float]:
    """(prior * R+, corrected R-, direction of w, direction of c): the gradient of their sum, or away from a negative corrected part."""
    zp, zu = pos.logits(w, c), unl.logits(w, c)
    corrected = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    sp, su = _sigmoid(zp), _sigmoid(zu)
    gp, gu = -prior * sp / pos.n, su / unl.n
    if corrected >= 0:
        gp += prior * (sp - 1) / pos.n
    else:
        gp, gu = -gp, -gu
    return prior * np.logaddexp(0, -zp).mean(), corrected, pos.pull(gp, len(w)) + unl.pull(gu, len(w)), gp.sum() + gu.sum()


def train(positives: Side, unlabelled: Side, prior: float | None = None, steps: int = STEPS, lift: float = LIFTS[0], shrink: float = SHRINKS[0]) -> Model:
    """A model from toxic and unlabelled texts."""
    n, m = len(positives.texts), len(unlabelled.texts)
    if not n or not m:
        return NONE
    return _fit(positives, unlabelled, positives.held(), unlabelled.held(), prior, steps, lift, shrink)


def _fit(positives: Side, unlabelled: Side, p: np.ndarray, u: np.ndarray, prior: float | None, steps: int, lift: float, shrink: float) -> Model:
    n, m = len(positives.texts), len(unlabelled.texts)
    prior = class_prior(p, u, n, m) if prior is None else prior
    codes = np.flatnonzero((p >= LEAST) & (p * m >= lift * u * n))
    if not len(codes):
        return NONE
    place = np.zeros(1 << BITS, np.int32)
    place[codes] = np.arange(1, len(codes) + 1)
    pos, unl = Rows(positives.texts, place), Rows(unlabelled.texts, place)
    w, c = np.zeros(len(codes)), float(np.log(prior / (1 - prior)))
    seen, seen_c = np.full(len(codes), 1e-8), 1e-8
    best = (np.inf, w, c)
    shrink = shrink * prior / n
    for _ in range(steps):
        plus, corrected, g, gc = risk(pos, unl, w, c, prior)
        value = plus + max(0.0, corrected) + shrink * w.sum()
        if value < best[0]:
            best = (value, w, c)
        # steps as long as a weight's gradients so far are small; shrinking keeps a weight at zero unless the risk pulls it up
        seen, seen_c = seen + g * g, seen_c + gc * gc
        w = np.maximum(0.0, w - RATE / np.sqrt(seen) * (g + shrink))
        c -= RATE / np.sqrt(seen_c) * gc
    _, w, c = best
    on = np.flatnonzero(w)
    return Model(codes[on].astype(np.int32), w[on], float(c))


def choose(positives: Side, unlabelled: Side, steps: int = STEPS) -> tuple[float, float]:
    """(lift, shrink) that judge the parts left out best, by recall^2 / share of the unlabelled that is taken for toxic."""
    folds = [[side.part(k, within) for side in (positives, unlabelled) for within in (False, True)] for k in range(FOLDS)]
    if not all(f.texts for fold in folds for f in fold):
        return LIFTS[0], SHRINKS[0]
    counts = [(fold[0].held(), fold[2].held()) for fold in folds]
    best = (-1.0, LIFTS[0], SHRINKS[0])
    for lift in LIFTS:
        for shrink in SHRINKS:
            found = taken = 0
            for (pos, pos_out, unl, unl_out), (p, u) in zip(folds, counts, strict=True):
                model = _fit(pos, unl, p, u, None, steps, lift, shrink)
                if len(model.codes):
                    found += int((Rows(pos_out.texts, model.table).logits(model.weights, model.bias) >= 0).sum())
                    taken += int((Rows(unl_out.texts, model.table).logits(model.weights, model.bias) >= 0).sum())
            recall, share = found / len(positives.texts), max(taken, 1) / len(unlabelled.texts)
            if recall * recall / share > best[0]:
                best = (recall * recall / share, lift, shrink)
    return best[1:]


def _train_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sides = Side(), Side()
    for t in _text.flushes(iter(batches), "text", BLOCK_BYTES):
        for k, side in enumerate(sides):
            of = t.filter(t.column(("positive", "unlabelled")[k]))
            if of.num_rows:
                side.add(of.column("text").combine_chunks())
    lift, shrink = choose(*sides)
    m = train(*sides, lift=lift, shrink=shrink)
    yield pa.RecordBatch.from_arrays([pa.array([m.codes.tobytes()], pa.binary()), pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.bias])], ["codes", "weights", "bias"])


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, toxic); labels are used only of rows where ``learnable`` (over doc_id) holds."""
    _spark.small_batches(docs.sparkSession)
    key = F.xxhash64(F.lit("toxic"), "doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null and doc_id is not null")
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null").where(learnable)
    # each side is limited by itself, and one text stands for each of its ids, however many rows repeat it
    toxic = said.where("toxic <> 0").select("doc_id").distinct().orderBy(key, "doc_id").limit(positives)
    every = texts.select("doc_id").distinct().orderBy(key, "doc_id").limit(unlabelled)
    both = toxic.select("doc_id", F.lit(1).alias("p"), F.lit(0).alias("u")).unionByName(every.select("doc_id", F.lit(0).alias("p"), F.lit(1).alias("u")))
    both = both.groupBy("doc_id").agg((F.max("p") == 1).alias("positive"), (F.max("u") == 1).alias("unlabelled"))
    got = texts.join(F.broadcast(both), "doc_id").groupBy("doc_id", "positive", "unlabelled").agg(F.min("text").alias("text"))
    one = got.repartition(1).sortWithinPartitions(key, "doc_id").select("text", "positive", "unlabelled")
    r = one.mapInArrow(_train_task, "codes binary, weights binary, bias double").first()
    if r is None:
        return NONE
    return Model(np.frombuffer(r["codes"], np.int32), np.frombuffer(r["weights"], np.float64), r["bias"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of docs(doc_id, text)."""
    spark = docs.sparkSession
    _spark.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _text.flushes(batches, "text", BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), pa.array(shared.value.score(t.column("text").combine_chunks()))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, at: float = 0.5) -> DataFrame:
    """docs, with all their columns, that score under ``at``."""
    spark = docs.sparkSession
    _spark.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(shared.value.score(b.column("text").cast(pa.string())) < at))

    return docs.mapInArrow(run, docs.schema)
