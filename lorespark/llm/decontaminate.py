"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores the training texts' postings: each block of documents becomes a segment with its distinct
terms (64-bit hashes, sorted), how often each occurs, the places of each, and where its documents
begin.  Segments are written to the shared folder and can be searched any number of times.

``phrase_matches`` finds every occurrence of the items' windows of ``WINDOW`` words.  The windows' terms get their
frequencies from the whole index; a search starts at the postings of a window's rarest term, shifts them by the term's
place in the window, and intersects them with the shifted lists of the other terms, again the rarest first.  Terms that
no segment holds end their windows at once.  ``proximity_matches`` finds documents that hold all words of an item
within a span of words, in any order.

Benchmark items are read in blocks of ``ITEM_WORDS`` words, each of which is broadcast (with a plan of bounded size) and searched over all
segments, so a larger benchmark costs more passes, not more memory.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII bytes.  Equality is that of 64-bit hashes, a window's 13 together.

Defined results: null and empty texts have no words and no hits; an item of fewer than WINDOW words, but not
none, is one window; items with equal text each count; rows that repeat a doc_id each give a row; null item_ids
are ignored; extra columns are ignored; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark, _text
from ._text import U64

WINDOW = 13
BLOCK_BYTES, ITEM_WORDS = 8 << 20, 200_000
_SEGMENT = "terms binary, counts binary, places binary, docs binary, begins binary, hashes binary, segment long"
_PARTS = ["terms", "counts", "places", "docs", "begins", "hashes"]


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(term hashes, where each text's begin)."""
    raw, offs = _text.buffers(texts)
    raw = _text.LOWER[raw]
    start, end, at = _text.words(raw, offs, _text.ALNUM_WORDS)
    return _text.hash_spans(raw, start, end), at


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # a segment's number is its task's and its place in it
    first_segment = TaskContext.get().partitionId() << 33
    for number, t in enumerate(_text.flushes(batches, "text", BLOCK_BYTES), first_segment):
        w, at = term_hashes(t.column("text"))
        order = np.argsort(w, kind="stable").astype(np.int32)
        s = w[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(s))).astype(np.int32)
        ids = t.column("doc_id").fill_null(-(2**63)).to_numpy().astype(np.int64)
        parts = (s[first], counts, order, ids, at.astype(np.int64), t.column("text_hash").to_numpy())
        yield pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in parts), pa.array([number], pa.int64())], [*_PARTS, "segment"])


def build_index(docs: DataFrame) -> DataFrame:
    """The segments of docs(doc_id, text), written to the shared folder."""
    _spark.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    return _spark.written(docs.mapInArrow(_index, _SEGMENT), "index")


class Segment:
    def __init__(self, row: dict):
        self.terms, self.counts = np.frombuffer(row["terms"], U64), np.frombuffer(row["counts"], np.int32)
        self.places, self.docs, self.begins = np.frombuffer(row["places"], np.int32), np.frombuffer(row["docs"], np.int64), np.frombuffer(row["begins"], np.int64)
        self.hashes = np.frombuffer(row["hashes"], np.int64)
        self.ends = np.cumsum(self.counts)

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(from, to) of each term's postings; equal where it has none."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        hi = self.ends[at]
        return hi - np.where(self.terms[at] == terms, self.counts[at], 0), hi

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, places, "right") - 1


class Plan:
    """Windows of a block of items, their terms ordered rarest first."""

    def __init__(self, items: list[tuple], window: int, df: dict[int, int]):
        w, at = term_hashes(pa.array([x[1] for x in items], pa.string()))
        self.vocabulary, code = np.unique(w, return_inverse=True)
        self.df = np.array([df.get(int(x.view(np.int64)), 0) for x in self.vocabulary], np.int64)
        rows: dict[tuple, set] = {}
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            for j in range(a, max(a + 1, b - window + 1) if b > a else a):
                rows.setdefault(tuple(code[j : min(b, j + window)].tolist()), set()).add(i)
        rows = {k: v for k, v in rows.items() if all(self.df[x] for x in k)}
        self.windows = [np.array(k) for k in rows]
        self.items = list(rows.values())
        self.names = [x[0] for x in items]
        # by window, rarest first: each term and its place in the window; -1 beyond a shorter window's end
        self.length = np.array([len(k) for k in self.windows], np.int64)
        self.term = np.full((len(self.windows), int(self.length.max(initial=0))), -1, np.int64)
        self.offset = np.zeros_like(self.term)
        for i, k in enumerate(self.windows):
            o = np.argsort(self.df[k], kind="stable")
            self.term[i, : len(k)], self.offset[i, : len(k)] = k[o], o

    def search(self, seg: Segment) -> tuple[np.ndarray, np.ndarray]:
        """(window, place of its first word) of every occurrence in the segment."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not self.windows:
            return none
        lo, hi = seg.lists(self.vocabulary)
        size = hi - lo
        live = np.flatnonzero(((self.term < 0) | (size[self.term] > 0)).all(1))
        if not len(live):
            return none
        # the postings of the vocabulary's terms as sorted (term, place) keys
        known = np.flatnonzero(size)
        lists = np.concatenate([(c << 40) + seg.places[lo[c] : hi[c]].astype(np.int64) for c in known])
        rarest = self.term[live, 0]
        ends = np.cumsum(size[rarest])
        win = np.repeat(live, size[rarest])
        start = seg.places[np.arange(len(win)) + np.repeat(lo[rarest] - (ends - size[rarest]), size[rarest])].astype(np.int64) - self.offset[win, 0]
        length = self.length
        for step in range(1, self.term.shape[1]):
            more = length[win] > step
            place = start + self.offset[win, step]
            key = (self.term[win, step] << 40) + place
            at = np.minimum(np.searchsorted(lists, key), len(lists) - 1)
            ok = ~more | ((lists[at] == key) & (place >= 0))
            win, start = win[ok], start[ok]
            if not len(win):
                return none
        # a phrase lies within one document
        ok = (start >= 0) & (seg.doc_of(start) == seg.doc_of(start + length[win] - 1))
        return win[ok], start[ok]


def _item_blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    block, words = [], 0
    for row in benchmark.select("item_id", F.col("text").cast("string")).where("item_id is not null and text is not null").toLocalIterator():
        block.append(tuple(row))
        words += len(row[1]) // 4 + 1
        if words >= ITEM_WORDS:
            yield block
            block, words = [], 0
    if block:
        yield block


def _frequencies(index: DataFrame, items: list[tuple]) -> dict[int, int]:
    """How often the items' terms occur in the whole index: at most one row a term."""
    wanted = np.unique(term_hashes(pa.array([x[1] for x in items], pa.string()))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for terms, counts in zip(b.column("terms"), b.column("counts"), strict=True):
                t, c = np.frombuffer(terms.as_buffer(), U64), np.frombuffer(counts.as_buffer(), np.int32)
                at = np.searchsorted(t, wanted)
                ok = at < len(t)
                ok[ok] = t[at[ok]] == wanted[ok]
                yield pa.RecordBatch.from_arrays([pa.array(wanted[ok].view(np.int64)), pa.array(c[at[ok]].astype(np.int64))], ["term", "n"])

    return {r["term"]: r["n"] for r in index.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}


def phrase_matches(index: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, places array<int>, item_ids array<string>, text_hash) of every indexed document: its hit words and the items found, and its text's xxhash64."""
    spark = index.sparkSession
    parts = []
    for items in [*_item_blocks(benchmark)] or [[]]:
        plan = spark.sparkContext.broadcast(Plan(items, window, _frequencies(index, items)))

        def run(batches: Iterator[pa.RecordBatch], plan=plan) -> Iterator[pa.RecordBatch]:
            p: Plan = plan.value
            for b in batches:
                for row in range(b.num_rows):
                    seg = Segment({n: b.column(n)[row].as_buffer() for n in _PARTS})
                    win, start = p.search(seg)
                    doc = seg.doc_of(start)
                    hit: dict[int, set] = {}
                    names: dict[int, set] = {}
                    for k, s, d in zip(win.tolist(), start.tolist(), doc.tolist(), strict=True):
                        s -= int(seg.begins[d])
                        hit.setdefault(d, set()).update(range(s, s + len(p.windows[k])))
                        names.setdefault(d, set()).update(str(p.names[i]) for i in p.items[k])
                    n = np.diff(seg.begins)
                    m = len(seg.docs)
                    for i in range(0, m, 2048):
                        j = min(m, i + 2048)
                        ids = seg.docs[i:j]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(ids, mask=ids == -(2**63)),
                            pa.array(n[i:j]),
                            pa.array([sorted(hit.get(d, ())) for d in range(i, j)], pa.list_(pa.int32())),
                            pa.array([sorted(names.get(d, ())) for d in range(i, j)], pa.list_(pa.string())),
                            pa.array(seg.hashes[i:j]),
                            pa.array(np.full(j - i, b.column("segment")[row].as_py())),
                            pa.array(np.arange(i, j, dtype=np.int32)),
                        ], ["doc_id", "n_words", "places", "item_ids", "text_hash", "segment", "row"])

        parts.append(index.mapInArrow(run, "doc_id long, n_words long, places array<int>, item_ids array<string>, text_hash long, segment long, row int"))
    out = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            out = out.unionByName(p.where("size(places) > 0"))
        # a row of the documents is known by its segment and its place there: ids may repeat or be null
        out = out.groupBy("segment", "row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("text_hash").alias("text_hash"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    return out.select("doc_id", "n_words", "places", "item_ids", "text_hash")


def proximity_matches(index: DataFrame, benchmark: DataFrame, span: int) -> DataFrame:
    """(doc_id, item_id) of documents that hold all of an item's distinct words within ``span`` consecutive words, in any order."""
    spark = index.sparkSession
    out = spark.createDataFrame([], "doc_id long, item_id string")
    for items in _item_blocks(benchmark):
        w, at = term_hashes(pa.array([x[1] for x in items], pa.string()))
        sets = [np.unique(w[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
        names = [str(x[0]) for x in items]

        def run(batches: Iterator[pa.RecordBatch], sets=sets, names=names) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, found = [], []
                for row in range(b.num_rows):
                    seg = Segment({n: b.column(n)[row].as_buffer() for n in _PARTS})
                    for name, terms in zip(names, sets, strict=True):
                        lo, hi = seg.lists(terms)
                        if not len(terms) or not (hi > lo).all():
                            continue
                        lists = [np.sort(seg.places[a:z]).astype(np.int64) for a, z in zip(lo, hi, strict=True)]
                        # a window that holds all terms begins, at the latest, at one of their places
                        begin = np.unique(np.concatenate(lists))
                        ok = np.ones(len(begin), bool)
                        for x in lists:
                            nxt = np.searchsorted(x, begin)
                            ok &= (nxt < len(x)) & (x[np.minimum(nxt, len(x) - 1)] < begin + span)
                            ok &= seg.doc_of(x[np.minimum(nxt, len(x) - 1)]) == seg.doc_of(begin)
                        for d in np.unique(seg.doc_of(begin[ok])):
                            ids.append(int(seg.docs[d]))
                            found.append(name)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["doc_id", "item_id"])

        out = out.unionByName(index.mapInArrow(run, "doc_id long, item_id string"))
    return out
