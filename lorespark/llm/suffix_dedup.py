"""Passages that repeat across documents, by sparse suffix arrays.

A passage is a run of at least ``LENGTH`` words (50) that another document holds too.  Words are runs of
anything but white space, compared as they are; white space between them doesn't count.

1. Each block of documents retains the suffixes that begin at content-selected positions: the minimisers
   of the hashes of ``GRAM`` words over windows of LENGTH words.  Every passage of LENGTH words holds at least one, and the
   same ones wherever it stands.  Their leading keys go, once a block, to hash ranges, which send back those that two documents hold.
2. Suffixes with such a key go to a range by it, as word sequences: the words that follow it within LENGTH, and those before it.  A range is a
   piece of the sparse suffix array: it sorts its suffixes word by word and takes the length of the common prefix of each and its neighbour.
3. Matches are extended: to the right the common prefixes tell which suffixes agree on how many words; to the left the words before them, sorted and
   compared in the same way from the suffix's position outwards, tell the same.  A window of LENGTH words whose minimiser the suffix is repeats where
   another document agrees on its left and its right part.  Runs of such windows are the maximal passages.

Equal suffixes of a block go out once however many documents of it hold them, and so does a key, so what a third of all rows
holds costs a range one posting a block.  A key with more than ``HOT`` suffixes, as a common line in many surroundings has, is too much for one range: its
suffixes are dealt out by their longest keys, the whole windows around them, of which equal ones meet.  Equality is that of 64-bit hashes: of words, of GRAM words, or of
windows.

The document with the smallest doc_id keeps a window, the others are to drop it.  A passage that one
document alone repeats is not one.

Defined results: null and empty texts, and those under LENGTH words, have no passages; rows that repeat a
doc_id count as one document, each with the passages of its own text, and equal rows have theirs once, however they are dealt out; rows without a doc_id are ignored by ``passages`` and kept as they are by ``remove``;
extra columns are ignored, whatever their names; an empty table gives no rows.  ``docs`` should be a scan or a written
table: it is read twice and must give the same rows in the same order (this is checked).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from . import _spark, _text
from ._text import U64

LENGTH, GRAM = 50, 16
#: Words after a suffix's key and before it that windows around it reach.
SIDE = LENGTH - GRAM
#: Bytes of text a block holds, and whose keys or suffixes a range should hold; suffixes of one key that a range takes.
BLOCK_BYTES, RANGE_TEXT, SUFFIX_TEXT, HOT = 4 << 20, 64 << 20, 4 << 20, 20_000
_ROW = "key long, block long, part int, a binary, b binary, c binary"
_NAMES = ["key", "block", "part", "a", "b", "c"]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.table([pa.array(list(c), t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)


def _slide(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over each window of ``width`` values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = op(x[: len(x) - have], x[have:])
        have *= 2
    return op(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


class Words:
    """A block's word hashes, and each window's minimiser."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM):
        start, end, self.at = _text.words(raw, offs, _text.SPACE_WORDS)
        self.w, self.length = _text.hash_spans(raw, start, end), length
        n = max(0, len(self.w) - length + 1)
        self.inside = _text.inside_docs(self.at, len(self.w), length) if n else np.zeros(0, bool)
        grams = np.maximum(_text.gram_hashes(self.w, gram), U64(1))
        self.grams = grams
        self.least = _slide(grams, length - gram + 1, np.minimum) if n else np.zeros(0, U64)

    def suffixes(self) -> np.ndarray:
        """Positions that are the minimum of some window within a document."""
        if not len(self.least):
            return np.zeros(0, np.int64)
        width = self.length - (len(self.w) - len(self.grams) + 1) + 1
        pad = np.zeros(width - 1, U64)
        most = _slide(np.concatenate([pad, np.where(self.inside, self.least, U64(0)), pad]), width, np.maximum)
        return np.flatnonzero(most == self.grams)

    def doc(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, positions, "right") - 1

    def window_hashes(self, starts: np.ndarray) -> np.ndarray:
        acc = np.full(len(starts), U64(self.length), U64)
        for j in range(self.length):
            acc = (acc ^ self.w[starts + j]) * U64(0x9E3779B97F4A7C15)
            acc ^= acc >> U64(29)
        return _text.mix(acc)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, (doc ids, text hashes), bytes, offsets); a block's name is a hash of what it holds."""
    for t in _text.flushes(batches, "text", BLOCK_BYTES):
        raw, offs = _text.buffers(t.column("text"))
        ids = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "text_hash")])
        name = hashlib.blake2b(ids[0].tobytes() + offs.tobytes(), digest_size=8)
        name.update(np.ascontiguousarray(raw))
        yield int.from_bytes(name.digest(), "little") >> 1, ids, raw, offs


def _cuts(keys: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of sorted hashes, for the ranges that have any."""
    of = keys // (U64(2**64 - 1) // U64(ranges) + U64(1))
    new = np.ones(len(of), bool)
    new[1:] = of[1:] != of[:-1]
    cut = [*np.flatnonzero(new).tolist(), len(of)]
    return [(int(of[i]), i, j) for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _grouped(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted; the smallest document of each; whether it has others; how often each occurs."""
    if not len(keys):
        return keys, docs, np.zeros(0, bool), np.zeros(0, np.int64)
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    first = np.flatnonzero(new)
    upto = np.append(first[1:], len(k))
    return k[first], d[first], d[upto - 1] != d[first], upto - first


def _post_suffixes(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (ids, _), raw, offs in _blocks(batches):
            x = Words(raw, offs)
            p = x.suffixes()
            keys, docs, several, times = _grouped(x.grams[p], ids[x.doc(p)])
            yield from _rows([(r, block, 0, keys[i:j].tobytes(), np.concatenate([docs[i:j], times[i:j]]).tobytes(), several[i:j].tobytes()) for r, i, j in _cuts(keys, ranges)]).to_batches()

    return run


def _carry_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, ids, raw, offs in _blocks(batches):
        yield from _rows([(block, block, 1, pa.compress(raw.tobytes(), "zstd", asbytes=True) if len(raw) else b"", np.concatenate([*ids, offs]).tobytes(), None)]).to_batches()


def _shared(keys: np.ndarray, docs: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each key's rows are of several documents, the smallest of these, and the rows' places among the distinct keys."""
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(k)) - 1
    group = np.empty(len(k), np.int64)
    group[order] = np.cumsum(new) - 1
    return (d[last] != d[first]) | (np.bincount(group, weights=several, minlength=len(first)) > 0), d[first], group


def _meet_keys(t: pa.Table) -> pa.Table:
    """A range: of the keys of all blocks, those that several documents hold go back, with the smallest document and how many suffixes have them."""
    keys = [np.frombuffer(x.as_buffer(), U64) for x in t.column("a")]
    sizes, every = [len(k) for k in keys], np.concatenate(keys)
    both = [np.frombuffer(x.as_buffer(), np.int64).reshape(2, -1) for x in t.column("b")]
    docs, times = (np.concatenate([x[k] for x in both]) for k in (0, 1))
    shared, first, group = _shared(every, docs, np.concatenate([np.frombuffer(x.as_buffer(), bool) for x in t.column("c")]))
    total = np.bincount(group, weights=times).astype(np.int64)
    ends = np.cumsum(sizes)
    rows = []
    for block, lo, hi in zip(t.column("block").to_pylist(), ends - sizes, ends, strict=True):
        g = group[lo:hi]
        keep = shared[g]
        if keep.any():
            rows.append((block, block, 0, every[lo:hi][keep].tobytes(), np.concatenate([first[g[keep]], total[g[keep]]]).tobytes(), None))
    return _rows(rows)


def _back(t: pa.Table) -> tuple[dict, np.ndarray, np.ndarray]:
    """A block's own row, and what came back of ``_meet_keys``: sorted keys, with (smallest document, suffixes) of each."""
    own, keys, more = None, [], []
    for part, a, b, c in zip(t.column("part").to_pylist(), t.column("a"), t.column("b"), t.column("c"), strict=True):
        if part == 1:
            # a block of the same rows, as of a table that repeats them, has the same name and counts once
            own = {"a": a.as_buffer(), "b": b.as_buffer(), "c": c.as_buffer() if c.is_valid else None}
        elif part == 0:
            keys.append(np.frombuffer(a.as_buffer(), U64))
            more.append(np.frombuffer(b.as_buffer(), np.int64).reshape(2, -1))
    if own is None:
        raise RuntimeError("the documents were read in another order the second time; give a written table")
    k = np.concatenate(keys) if keys else np.zeros(0, U64)
    order = np.argsort(k)
    return own, k[order], (np.concatenate(more, 1) if more else np.zeros((2, 0), np.int64))[:, order]


def _among(x: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return sorted_keys[at] == x, at


#: A suffix as it goes to its range: its key, the words after the key, the words before it from the nearest on, and from how many to how many words before it the windows begin whose minimiser it is.
#: The key is big-endian, so that rows in the order of their bytes are in the order of their keys.
_SUFFIX = np.dtype([("key", ">u8"), ("right", U64, (SIDE,)), ("left", U64, (SIDE,)), ("low", np.int64), ("high", np.int64)])
_OWN = np.dtype([("row", np.int32), ("place", np.int32), ("sent", np.int32)])
_WINDOW = np.dtype([("key", U64), ("row", np.int32), ("place", np.int32)])
_MATCH = np.dtype([("sent", np.int32), ("offset", np.int32), ("keeper", np.int64)])


def suffix_rows(x: Words, positions: np.ndarray) -> np.ndarray:
    """The suffixes at these positions as ``_SUFFIX`` rows; words that none of their windows reaches are zeros.

    Which windows have a suffix as their minimiser is settled by the windows' own words, so it is the same in every document that holds them.
    """
    out = np.zeros(len(positions), _SUFFIX)
    out["key"] = x.grams[positions]
    out["low"], out["high"] = SIDE, 0
    for offset in range(SIDE + 1):
        start = positions - offset
        ok = (start >= 0) & (start < len(x.least))
        ok[ok] = x.inside[start[ok]] & (x.least[start[ok]] == out["key"][ok])
        out["low"][ok] = np.minimum(out["low"][ok], offset)
        out["high"][ok] = offset
    for j in range(SIDE):
        ok = out["low"] + j < SIDE
        out["right"][ok, j] = x.w[positions[ok] + GRAM + j]
        ok = out["high"] > j
        out["left"][ok, j] = x.w[positions[ok] - 1 - j]
    return out


def _classes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences of words, sorted: their order, each one's place in it, and how many words each shares with its neighbour before it."""
    words = np.ascontiguousarray(words)
    order = np.argsort(words.view(f"V{8 * words.shape[1]}").reshape(-1), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    s = words[order]
    common = np.zeros(len(order), np.int64)
    differ = s[1:] != s[:-1]
    common[1:] = np.where(differ.any(1), differ.argmax(1), words.shape[1])
    return order, place, common


def match_suffixes(s: np.ndarray, docs: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, words before it, smallest document) of each window of LENGTH words around the suffixes that several documents hold."""
    none = np.zeros(0, np.int64)
    if not len(s):
        return none, none, none
    # to the right: the suffixes in order, and the words, key included, that each shares with its neighbour
    _, right, common = _classes(np.concatenate([s["key"].astype(U64)[:, None], s["right"]], 1))
    _, left, before = _classes(s["left"])
    out = []
    for offset in range(SIDE + 1):
        # suffixes that share their first words form a run in suffix order; those that share the words before them a run in the other
        run = np.cumsum(common < 1 + SIDE - offset)[right]
        other = np.cumsum(before < offset)[left] if offset else np.zeros(len(s), np.int64)
        fits = np.flatnonzero((s["low"] <= offset) & (s["high"] >= offset))
        if not len(fits):
            continue
        shared, first, group = _shared((run[fits] * (len(s) + 1) + other[fits]).astype(U64), docs[fits], several[fits])
        hit = shared[group]
        out.append((fits[hit], np.full(int(hit.sum()), offset), first[group[hit]]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (none, none, none)


def _distinct(s: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows by key; the smallest document of each, whether it has others, and which of them each row is."""
    if not len(s):
        return s, docs, np.zeros(0, bool), np.zeros(0, np.int64)
    order = np.argsort(s.view(f"V{s.dtype.itemsize}").reshape(-1), kind="stable")
    s = s[order]
    flat = s.view(U64).reshape(len(s), -1)
    new = np.ones(len(s), bool)
    new[1:] = (flat[1:] != flat[:-1]).any(1)
    group = np.empty(len(s), np.int64)
    group[order] = np.cumsum(new) - 1
    low, high = np.full(int(new.sum()), 2**63 - 1), np.full(int(new.sum()), -(2**63))
    np.minimum.at(low, group, docs)
    np.maximum.at(high, group, docs)
    return s[new], low, low != high, group


def _extend(ranges: int):
    """A block: its matched suffixes to ranges by their keys (part 0), the windows around suffixes of hot keys (part 2), and a row of its own that knows where they stand (part 1)."""

    def run(t: pa.Table) -> pa.Table:
        own, keys, (_, times) = _back(t)
        block = t.column("block")[0].as_py()
        meta = np.frombuffer(own["b"], np.int64)
        m = (len(meta) - 1) // 3
        ids, hashes, offs = meta[:m], meta[m : 2 * m], meta[2 * m :]
        if not len(keys):
            return _rows([])
        raw = np.frombuffer(pa.decompress(own["a"], int(offs[-1]), "zstd"), np.uint8) if offs[-1] else np.zeros(0, np.uint8)
        x = Words(raw, offs)
        p = x.suffixes()
        hit, at = _among(x.grams[p], keys)
        p, hot = p[hit], times[at[hit]] > HOT
        q = p[~hot]
        doc = x.doc(q)
        s, docs, several, sent = _distinct(suffix_rows(x, q), ids[doc])
        _text.give_back()
        rows = [(r, block, 0, s[i:j].tobytes(), np.concatenate([docs[i:j], np.arange(i, j)]).tobytes(), several[i:j].tobytes()) for r, i, j in _cuts(s["key"].astype(U64), ranges)]
        stand = np.zeros(len(q), _OWN)
        stand["row"], stand["place"], stand["sent"] = doc, q - x.at[doc], sent
        # windows whose minimiser is a hot key
        starts = np.flatnonzero(_among(x.least, np.sort(np.unique(x.grams[p[hot]])))[0] & x.inside)
        h = x.window_hashes(starts)
        doc = x.doc(starts)
        k, d, more, _ = _grouped(h, ids[doc])
        rows += [(r, block, 2, k[i:j].tobytes(), np.concatenate([d[i:j], np.zeros(j - i, np.int64)]).tobytes(), more[i:j].tobytes()) for r, i, j in _cuts(k, ranges)]
        w = np.zeros(len(starts), _WINDOW)
        w["key"], w["row"], w["place"] = h, doc, starts - x.at[doc]
        return _rows([*rows, (block, block, 1, stand.tobytes(), np.concatenate([ids, hashes]).tobytes(), w.tobytes())])

    return run


def _meet_suffixes(t: pa.Table) -> pa.Table:
    """A range of the sparse suffix array: what ``match_suffixes`` finds goes back to the blocks."""
    s = [np.frombuffer(x.as_buffer(), _SUFFIX) for x in t.column("a")]
    both = [np.frombuffer(x.as_buffer(), np.int64).reshape(2, -1) for x in t.column("b")]
    sizes = [len(x) for x in s]
    docs, sent = (np.concatenate([x[k] for x in both]) for k in (0, 1))
    which, offset, keeper = match_suffixes(np.concatenate(s), docs, np.concatenate([np.frombuffer(x.as_buffer(), bool) for x in t.column("c")]))
    by = np.argsort(which, kind="stable")
    found = np.zeros(len(by), _MATCH)
    found["sent"], found["offset"], found["keeper"] = sent[which[by]], offset[by], keeper[by]
    ends = np.cumsum(sizes)
    cut = np.searchsorted(which[by], np.concatenate([[0], ends]))
    return _rows([(block, block, 2, None, None, found[i:j].tobytes()) for block, i, j in zip(t.column("block").to_pylist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True) if j > i])


def _meet(t: pa.Table) -> pa.Table:
    part = t.column("part")[0].as_py()
    return t if part == 1 else _meet_suffixes(t) if part == 0 else _meet_keys(t)


_SPANS = "doc_id long, start_word int, end_word int, kept boolean, first_doc_id long, text_hash long"


def _spans(t: pa.Table) -> pa.Table:
    """A block: runs of shared windows, those its document keeps apart from those it is to drop."""
    own, keys, (keepers, _) = _back(t)
    ids, hashes = np.frombuffer(own["b"], np.int64).reshape(2, -1)
    stand, windows = np.frombuffer(own["a"], _OWN), np.frombuffer(own["c"], _WINDOW)
    hit, at = _among(windows["key"], keys)
    rows, places, firsts = [windows["row"][hit]], [windows["place"][hit]], [keepers[at[hit]]]
    found = [np.frombuffer(c.as_buffer(), _MATCH) for part, c in zip(t.column("part").to_pylist(), t.column("c"), strict=True) if part == 2]
    if found:
        f = np.concatenate(found)
        # every document that holds a suffix that went out once
        by = np.argsort(stand["sent"], kind="stable")
        lo, hi = (np.searchsorted(stand["sent"][by], f["sent"], side) for side in ("left", "right"))
        n = hi - lo
        one = by[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        f = np.repeat(f, n)
        rows.append(stand["row"][one])
        places.append(stand["place"][one] - f["offset"])
        firsts.append(f["keeper"])
    # a window with several equal minimisers is met once for each
    _, one = np.unique(np.concatenate(rows).astype(np.int64) << 32 | np.concatenate(places).astype(np.int64), return_index=True)
    row, place, keeper = (np.concatenate(c)[one] for c in (rows, places, firsts))
    out = []
    for kept in (False, True):
        mine = (keeper == ids[row]) == kept
        r, p, k = row[mine], place[mine], keeper[mine]
        if not len(r):
            continue
        # windows that overlap or touch make one passage, as far as one document has their first copies
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (p[1:] > p[:-1] + LENGTH) | (k[1:] != k[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(r)) - 1
        out.append((ids[r[first]], p[first].astype(np.int32), (p[last] + LENGTH).astype(np.int32), np.full(len(first), kept), k[first], hashes[r[first]]))
    names = ["doc_id", "start_word", "end_word", "kept", "first_doc_id", "text_hash"]
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, x) for x in (np.int64, np.int32, np.int32, bool, np.int64, np.int64)]
    return pa.table([pa.array(c) for c in cols], names=names)


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, kept, first_doc_id, text_hash) of each passage: words [start, end); kept where the document has the first copy (smallest doc_id)."""
    spark = docs.sparkSession
    _spark.small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null").withColumn("text_hash", F.xxhash64("text"))
    size = _spark.text_size(docs)[1]
    keys = docs.mapInArrow(_post_suffixes(max(8, size // RANGE_TEXT)), _ROW).groupBy("key").applyInArrow(_meet_keys, _ROW)
    suffixes = keys.unionByName(docs.mapInArrow(_carry_texts, _ROW)).groupBy("block").applyInArrow(_extend(max(8, size // SUFFIX_TEXT)), _ROW)
    return suffixes.groupBy("part", "key").applyInArrow(_meet, _ROW).groupBy("block").applyInArrow(_spans, _SPANS).distinct()


def _cut(names: list[str], spans: str, gone: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = _text.buffers(b.column("text"))
            start, end, at = _text.words(raw, offs, _text.SPACE_WORDS)
            texts = b.column("text").to_pylist()
            left = np.zeros(len(texts), bool)
            for i, s in enumerate(b.column(spans).to_pylist()):
                n = int(at[i + 1] - at[i])
                drop = np.zeros(n, bool)
                for x in s:
                    drop[x["start_word"] : x["end_word"]] = True
                if drop.all():
                    left[i], texts[i] = True, ""
                    continue
                # cut from the first dropped word's beginning to the next kept word's, or to the last one's end
                edge = np.flatnonzero(np.diff(np.concatenate([[False], drop, [False]]).astype(np.int8)))
                lo, hi, body, upto = int(offs[i]), int(offs[i + 1]), [], int(offs[i])
                for f, g in zip(edge[::2], edge[1::2], strict=True):
                    body.append(raw[upto : int(start[at[i] + f])].tobytes())
                    upto = int(start[at[i] + g]) if g < n else int(end[at[i] + g - 1])
                assert lo <= upto <= hi
                body.append(raw[upto:hi].tobytes())
                texts[i] = b"".join(body).decode()
            cols = [pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(left)], [*names, gone])

    return run


def remove(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs without the words of the passages that are not kept; a document of which nothing is left goes."""
    names = docs.columns
    # names that no column of docs has, however it is spelled
    used = {c.lower() for c in names}
    doc, text, list_, gone = (next(n for i in range(len(used) + 1) if (n := f"{stem}_{i}") not in used) for stem in ("doc", "hash", "spans", "gone"))
    drops = spans.where("not kept").groupBy(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)).agg(F.collect_set(F.struct("start_word", "end_word")).alias(list_))
    # by id and text: rows that share an id only lose what their own text repeats
    joined = docs.join(drops, (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(text)), "left").drop(doc, text)
    kept = joined.where(F.col(list_).isNull()).select(names)
    schema = StructType([*docs.schema.fields, StructField(gone, BooleanType())])
    cut = joined.where(F.col(list_).isNotNull()).mapInArrow(_cut(names, list_, gone), schema).where(~F.col(gone)).select(names)
    both = kept.unionByName(cut)
    return both.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else both
