"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read a segment's bytes, one from each end; their states label every byte position with log
probabilities of the languages, and a text's probabilities are the softmax of its positions' mean log probabilities, sharpened
by its length.  A segment is a white-space-delimited word of lower-cased bytes with the blank before it; words over ``SEGMENT`` bytes are cut.
The network is trained in numpy by backpropagation through time with Adam.

As a position's label depends on its segment alone, a block's distinct segments are run once, in batches
of equal length, and their summed labels are put back by position: every position of every text is labelled, at the
cost of the distinct ones.

Learning is bounded: at most ``SAMPLE`` labelled texts, those with the smallest hash of their id and of them
the first ``SAMPLE_BYTES`` of text (the text that goes beyond included), come to the driver, and ``SEGMENTS`` segments of them, drawn evenly over the languages.

Defined results: a null text and one without a letter is ``und`` with score 0; equal probabilities go to the language
first in order; texts of any length are read whole; with no labelled text all is ``und``; rows that repeat a
doc_id each get a label; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _chunks, _spark, _text

HIDDEN, SEGMENT = 16, 32
SAMPLE, SAMPLE_BYTES, SEGMENTS, STEPS, BATCH = 1200, 16 << 20, 60_000, 500, 256
BLOCK_BYTES = 8 << 20
_FOLD = _text.LOWER.copy()
_FOLD[[*range(0x09, 0x0E)]] = 0x20


def segments(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(byte segments, where each text's begin): a blank and the word after it, cut after SEGMENT bytes; runs of blanks are kept with the word."""
    raw, offs = _text.buffers(texts)
    raw = _FOLD[raw]
    begin = np.zeros(len(raw) + 1, bool)
    blank = raw == 0x20
    begin[:-1] = blank
    begin[1:-1] &= ~blank[:-1]
    begin[offs] = True
    starts = np.flatnonzero(begin[: len(raw)])
    size = np.diff(np.append(starts, len(raw)))
    if (size > SEGMENT).any():
        more = (size - 1) // SEGMENT
        extra = np.repeat(starts, more) + SEGMENT * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
        starts = np.sort(np.concatenate([starts, extra]))
    return _chunks.slices(raw, starts, pa.large_binary()), np.searchsorted(starts, offs)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Network:
    """Weights: for each direction a byte table (256, 3H), a recurrent matrix (H, 3H) and its bias; one output layer (2H, L)."""

    def __init__(self, languages: list[str], seed: int = 11, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        n = len(languages)
        self.p = {}
        for d in "fb":
            self.p["E" + d] = (rng.standard_normal((256, 3 * hidden)) * 0.3).astype(np.float32)
            self.p["U" + d] = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            self.p["b" + d] = np.zeros(3 * hidden, np.float32)
        self.p["W"] = (rng.standard_normal((2 * hidden, n)) * 0.1).astype(np.float32)
        self.p["c"] = np.zeros(n, np.float32)

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (T, B, H) of bytes (T, B), read forwards or backwards."""
        e, u, b, k = self.p["E" + d], self.p["U" + d], self.p["b" + d], self.hidden
        t = len(x)
        h = np.zeros((x.shape[1], k), np.float32)
        out = np.empty((t, x.shape[1], k), np.float32)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            a, g = e[x[i]], h @ u
            g += b
            zr = _sigmoid(a[:, : 2 * k] + g[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            n = np.tanh(a[:, 2 * k :] + r * g[:, 2 * k :])
            if keep is not None:
                keep.append((i, h, z, r, n, g[:, 2 * k :]))
            h = n + z * (h - n)
            out[i] = h
        return out

    def label(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities (T, B, L) of every position."""
        s = np.concatenate([self._run(x, "f"), self._run(x, "b")], 2) @ self.p["W"] + self.p["c"]
        s -= s.max(2, keepdims=True)
        s -= np.log(np.exp(s).sum(2, keepdims=True))
        return s

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions and its gradient by backpropagation through time."""
        keep = {"f": [], "b": []}
        hs = np.concatenate([self._run(x, d, keep[d]) for d in "fb"], 2)
        s = hs @ self.p["W"] + self.p["c"]
        s -= s.max(2, keepdims=True)
        q = np.exp(s)
        q /= q.sum(2, keepdims=True)
        at = np.arange(x.shape[1])
        loss = -np.log(np.maximum(q[:, at, y], 1e-9)).mean()
        q[:, at, y] -= 1
        q /= x.size
        k, g = self.hidden, {}
        g["W"] = np.einsum("tbh,tbl->hl", hs, q)
        g["c"] = q.sum((0, 1))
        back = q @ self.p["W"].T
        for j, d in enumerate("fb"):
            u = self.p["U" + d]
            de, du, db = np.zeros_like(self.p["E" + d]), np.zeros_like(u), np.zeros_like(self.p["b" + d])
            dh = np.zeros((x.shape[1], k), np.float32)
            for i, h, z, r, n, gn in reversed(keep[d]):
                dh = dh + back[i, :, j * k : (j + 1) * k]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                da = np.concatenate([dz, dr, dn], 1)
                dg = np.concatenate([dz, dr, dn * r], 1)
                np.add.at(de, x[i], da)
                du += h.T @ dg
                db += dg.sum(0)
                dh = dh * z + dg @ u.T
            g["E" + d], g["U" + d], g["b" + d] = de, du, db
        return float(loss), g

    def distinct_sums(self, distinct: pa.Array) -> np.ndarray:
        """Sums of each segment's position labels (segments, L), in batches of one length."""
        raw = np.frombuffer(distinct.buffers()[2], np.uint8) if len(distinct) else np.zeros(0, np.uint8)
        offs = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
        size = np.diff(offs)
        out = np.zeros((len(distinct), len(self.languages)), np.float32)
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            for i in range(0, len(rows), 4096):
                part = rows[i : i + 4096]
                out[part] = self.label(raw[offs[part] + np.arange(n)[:, None]]).sum(0)
        return out

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Probabilities (texts, L), pooled over all positions."""
        seg, at = segments(texts)
        total = np.zeros((len(texts), len(self.languages)))
        if len(seg):
            met = seg.dictionary_encode()
            one = self.distinct_sums(met.dictionary)[met.indices.to_numpy()]
            upto = np.zeros((len(seg) + 1, one.shape[1]))
            np.cumsum(one, axis=0, dtype=np.float64, out=upto[1:])
            total = upto[at[1:]] - upto[at[:-1]]
        n = np.maximum(np.diff(_text.buffers(texts)[1]), 1)[:, None]
        # neighbouring positions say much the same: a mean's evidence grows with the root of its length
        z = total / n * np.sqrt(n)
        z -= z.max(1, keepdims=True)
        q = np.exp(z)
        return q / q.sum(1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 11, steps: int = STEPS, count: int = SEGMENTS) -> Network | None:
    """A network from labelled texts."""
    languages = sorted(set(langs))
    if not languages:
        return None
    net, rng = Network(languages, seed), np.random.default_rng(seed)
    seg, at = segments(pa.array(texts, pa.string()))
    y = np.repeat([languages.index(x) for x in langs], np.diff(at))
    pool = seg.to_pylist()
    size = np.array([len(x) for x in pool])
    # evenly over languages; batches of one length, lengths drawn by how many there are
    chosen = [rng.permutation(np.flatnonzero((y == k) & (size >= 2)))[: count // len(languages)] for k in range(len(languages))]
    buckets = {}
    for n in np.unique(size[np.concatenate(chosen)]) if any(map(len, chosen)) else []:
        rows = np.concatenate([c[size[c] == n] for c in chosen])
        if len(rows) >= 16:
            buckets[n] = rows
    if not buckets:
        return net
    lengths = np.array(list(buckets))
    share = np.array([len(v) for v in buckets.values()], float)
    m, v = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}
    for t in range(1, steps + 1):
        n = rng.choice(lengths, p=share / share.sum())
        rows = rng.choice(buckets[n], min(BATCH, len(buckets[n])), False)
        x = np.frombuffer(b"".join(pool[i] for i in rows), np.uint8).reshape(len(rows), n).T
        _, g = net.gradient(x, y[rows])
        rate = 0.01 * min(1.0, 2 * (1 - t / (steps + 1)))
        for k in net.p:
            gk = np.clip(g[k], -1, 1)
            m[k] = 0.9 * m[k] + 0.1 * gk
            v[k] = 0.999 * v[k] + 0.001 * gk * gk
            net.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def learn(docs: DataFrame, learnable: Column, sample: int = SAMPLE) -> Network | None:
    """A network from docs(doc_id, text, lang) where ``learnable`` (over doc_id) holds and lang is known."""
    key = F.xxhash64(F.lit("lang"), "doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null and doc_id is not null").where(learnable)
    # ids first, so that no more texts than the sample's are sorted
    ids = rows.select("doc_id").distinct().orderBy(key, "doc_id").limit(sample)
    got = rows.join(F.broadcast(ids), "doc_id").orderBy(key, "text").limit(sample).select("text", "lang", key.alias("key"))
    # of no more rows than the sample's, those that fill SAMPLE_BYTES
    upto = F.sum(F.octet_length("text")).over(Window.orderBy("key", "text").rowsBetween(Window.unboundedPreceding, -1))
    got = got.withColumn("upto", upto).where(F.coalesce("upto", F.lit(0)) < SAMPLE_BYTES).select("text", "lang").toArrow()
    return train(got.column("text").to_pylist(), got.column("lang").to_pylist())


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of docs(doc_id, text)."""
    spark = docs.sparkSession
    _spark.small_batches(spark)
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for t in _text.flushes(batches, "text", BLOCK_BYTES):
            texts = t.column("text").combine_chunks().fill_null("")
            letter = pc.match_substring_regex(texts, "\\p{L}").to_numpy(zero_copy_only=False)
            if net is None:
                q, names = np.zeros((len(texts), 1)), np.array(["und"])
                letter = np.zeros(len(texts), bool)
            else:
                q, names = net.texts(texts), np.array(net.languages)
            best = q.argmax(1)
            said = np.where(letter, names[best], "und")
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), pa.array(said.tolist(), pa.string()), pa.array(np.where(letter, q.max(1), 0.0))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
