"""Positional postings in blocks, as Arrow columns: how records become blocks, how blocks are merged, opened and searched.

A block holds up to BLOCK postings of one term in key order: delta-coded keys, the records' lengths, each field's word counts, and the words' places, delta-coded
within a record's field; beside these its lowest and highest key, its greatest weighted count and its shortest record, which bound what any of its postings can add to a score.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs

BLOCK = 128
#: Bytes of words that are inverted, and of blocks that are merged, at a time.
FLUSH, MERGED = 8 << 20, 4 << 20
SCHEMA = "part int, term string, low long, high long, n int, most double, least int, keys array<long>, sizes array<int>, counts array<int>, places array<int>"
NAMES = ["part", "term", "low", "high", "n", "most", "least", "keys", "sizes", "counts", "places"]


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... size times, for each of them, one after another."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


def running(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Running sums of x within segments of the given sizes."""
    total = np.concatenate([[0], np.cumsum(x)])
    return total[1:] - np.repeat(total[np.cumsum(size) - size], size)


def steps(x: np.ndarray, size: np.ndarray, first: bool) -> np.ndarray:
    """Differences of x within segments; a segment's first value is kept, or 0."""
    out = np.diff(x, prepend=0)
    begin = (np.cumsum(size) - size)[size > 0]
    out[begin] = x[begin] if first else 0
    return out


def _lists(values: np.ndarray, size: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(values, kind))


class Posted:
    """Postings of groups, a group a term of a part: the group, key, record length and field counts of each, and all their places."""

    def __init__(self, group: np.ndarray, key: np.ndarray, size: np.ndarray, counts: np.ndarray, places: np.ndarray):
        self.group, self.key, self.size, self.counts, self.places = group, key, size, counts, places

    def taken(self, at: np.ndarray) -> Posted:
        n = self.counts.sum(1)
        return Posted(self.group[at], self.key[at], self.size[at], self.counts[at], self.places[ranges((np.cumsum(n) - n)[at], n[at])])


def opened(t: pa.Table, fields: int) -> Posted:
    """All postings of blocks; a group is a row."""
    column = lambda name: t.column(name).combine_chunks()
    n = column("n").to_numpy().astype(np.int64)
    group = np.repeat(np.arange(len(t)), n)
    key = column("low").to_numpy()[group] + running(column("keys").flatten().to_numpy(), n)
    counts = column("counts").flatten().to_numpy().astype(np.int64).reshape(-1, fields)
    places = running(column("places").flatten().to_numpy().astype(np.int64), counts.reshape(-1))
    return Posted(group, key, column("sizes").flatten().to_numpy().astype(np.int64), counts, places)


def blocks(p: Posted, parts: np.ndarray, terms: pa.Array, weights: np.ndarray) -> pa.RecordBatch:
    """Posted, in the order of groups and keys, as blocks; parts and terms are the groups'."""
    new = np.concatenate([[True], p.group[1:] != p.group[:-1]]) if len(p.group) else np.zeros(0, bool)
    number = np.arange(len(p.group)) - np.maximum.accumulate(np.where(new, np.arange(len(p.group)), 0))
    first = np.flatnonzero(number % BLOCK == 0)
    n = np.diff(np.append(first, len(p.group)))
    f = p.counts @ weights
    each = p.counts.sum(1)
    block_places = np.add.reduceat(each, first) if len(first) else np.zeros(0, np.int64)
    group = p.group[first]
    reduced = lambda op, x: op.reduceat(x, first) if len(first) else x[:0]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(parts[group], pa.int32()),
            terms.take(pa.array(group)),
            pa.array(p.key[first]),
            pa.array(p.key[first + n - 1] if len(first) else p.key),
            pa.array(n, pa.int32()),
            pa.array(reduced(np.maximum, f), pa.float64()),
            pa.array(reduced(np.minimum, p.size), pa.int32()),
            _lists(steps(p.key, n, False), n, pa.int64()),
            _lists(p.size, n, pa.int32()),
            _lists(p.counts.reshape(-1), n * p.counts.shape[1], pa.int32()),
            _lists(steps(p.places, p.counts.reshape(-1), True), block_places, pa.int32()),
        ],
        NAMES,
    )


def invert(fields: int, weights: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Records (part, key, a list of words a field) to blocks of what is read together."""

    def one(t: pa.Table) -> pa.RecordBatch:
        lists = [t.column(f"w{i}").combine_chunks() for i in range(fields)]
        long = [pc.fill_null(pc.list_value_length(x), 0).to_numpy().astype(np.int64) for x in lists]
        words = pa.chunked_array([x.flatten() for x in lists]).combine_chunks().dictionary_encode()
        row = np.concatenate([np.repeat(np.arange(len(t)), n) for n in long])
        field = np.repeat(np.arange(fields), [int(n.sum()) for n in long])
        place = np.concatenate([ranges(np.zeros(len(n), np.int64), n) for n in long])
        key, part = t.column("key").to_numpy(), t.column("part").to_numpy()
        code = words.indices.to_numpy().astype(np.int64)
        order = np.lexsort((place, field, row, key[row], part[row], code))
        code, row, field, place = code[order], row[order], field[order], place[order]
        post = np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.zeros(0, bool)
        which = np.cumsum(post) - 1
        first = np.flatnonzero(post)
        counts = np.bincount(which * fields + field, minlength=len(first) * fields).reshape(-1, fields)
        of, code = row[first], code[first]
        new = np.concatenate([[True], (code[1:] != code[:-1]) | (part[of][1:] != part[of][:-1])]) if len(of) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        return blocks(Posted(group, key[of], sum(long)[of], counts, place), part[of[head]], words.dictionary.take(pa.array(code[head])), weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for b in batches:
            for i in range(0, b.num_rows, 256):
                kept.append(b.slice(i, 256))
                size += kept[-1].nbytes
                if size >= FLUSH:
                    yield one(pa.Table.from_batches(kept))
                    kept, size = [], 0
        if kept:
            yield one(pa.Table.from_batches(kept))

    return run


def merge(fields: int, weights: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks in the order of parts and terms to full blocks; ``dead``, an array of keys if there, are left out."""

    def one(t: pa.Table) -> pa.RecordBatch:
        part, term = t.column("part").to_numpy(), t.column("term").combine_chunks()
        same = pc.equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False) & (part[1:] == part[:-1])
        head = np.concatenate([[True], ~same])
        number = np.cumsum(head) - 1
        p = opened(t, fields)
        if "dead" in t.column_names:
            gone = np.zeros(len(p.key), bool)
            dead = t.column("dead")
            n = t.column("n").to_numpy()
            ends = np.cumsum(n)
            for i in np.flatnonzero(pc.is_valid(dead).to_numpy(zero_copy_only=False)):
                gone[ends[i] - n[i] : ends[i]] = np.isin(p.key[ends[i] - n[i] : ends[i]], dead[int(i)].values.to_numpy())
            p = p.taken(np.flatnonzero(~gone))
        p.group = number[p.group]
        p = p.taken(np.lexsort((p.key, p.group)))
        at = np.flatnonzero(head)
        return blocks(p, part[at], term.take(pa.array(at)), weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        # blocks are opened to several times their bytes, so a batch is taken in pieces
        for b in (b.slice(i, step) for b in batches if b.num_rows for step in [max(1, b.num_rows * MERGED // max(b.nbytes, MERGED))] for i in range(0, b.num_rows, step)):
            # a piece's last term may go on in the next
            last = (b.column("part")[-1], b.column("term")[-1])
            cut = b.num_rows
            while cut and (b.column("part")[cut - 1], b.column("term")[cut - 1]) == last:
                cut -= 1
            if cut:
                yield one(pa.Table.from_batches([*kept, b.slice(0, cut)]))
                kept = []
            kept.append(b.slice(cut))
        if kept:
            yield one(pa.Table.from_batches(kept))

    return run


def rows(weights: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks to (term, key, length, f)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = lambda name: b.column(name)  # noqa: B023, E731
            n = column("n").to_numpy().astype(np.int64)
            group = np.repeat(np.arange(b.num_rows), n)
            key = column("low").to_numpy()[group] + running(column("keys").flatten().to_numpy(), n)
            f = column("counts").flatten().to_numpy().reshape(-1, len(weights)) @ weights
            segment = [column("segment").take(pa.array(group))] if "segment" in b.schema.names else []
            for i in range(0, len(group), 1 << 16):
                cut = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [column("term").take(pa.array(group[cut])), pa.array(key[cut]), column("sizes").flatten().cast(pa.int64())[i : i + (1 << 16)], pa.array(f[cut], pa.float64()), *(s[i : i + (1 << 16)] for s in segment)],
                    ["term", "key", "length", "f", *(["segment"] if segment else [])],
                )

    return run


def read(files: list[tuple[str, str]], part: int, terms: pa.ChunkedArray, columns: list[str], segments: bool) -> pa.Table:
    """A part's blocks of the terms, of files of (segment, path); with ``segments``, a column that says of which.

    Row groups are read one by one, those that may hold a term, and what isn't asked for is left out before the next.
    """
    asked = pc.unique(terms).drop_null().cast(pa.string())
    order = sorted(asked.to_pylist())
    kept = []
    for segment, path in files:
        system, at = fs.FileSystem.from_uri(path)
        with system.open_input_file(at) as source:
            file = pq.ParquetFile(source)
            where = file.schema_arrow.names.index("term")
            for g in range(file.num_row_groups):
                told = file.metadata.row_group(g).column(where).statistics
                if told is not None and told.has_min_max and isinstance(told.min, str):
                    i = bisect.bisect_left(order, told.min)
                    if i == len(order) or order[i] > told.max:
                        continue
                names = file.read_row_group(g, columns=["part", "term"])
                mask = pc.and_(pc.equal(names.column("part"), part), pc.is_in(names.column("term"), value_set=asked))
                if pc.any(mask).as_py():
                    t = file.read_row_group(g, columns=columns).select(columns).filter(mask)
                    kept.append(t.append_column("segment", pa.array([segment] * len(t), pa.string())) if segments else t)
    return pa.concat_tables(kept) if kept else pa.table({c: pa.array([], pa.string()) for c in columns})


def by_queries(rows: pa.Table, n: int) -> Iterator[pa.Table]:
    """Rows in the order of query_id, those of n queries at a time."""
    ids = rows.column("query_id").combine_chunks()
    first = np.flatnonzero(np.concatenate([[True], pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)])) if len(ids) else np.zeros(0, np.int64)
    ends = np.append(first[n::n], len(ids))
    for i, j in zip(np.concatenate([[0], ends[:-1]]), ends):
        yield rows.slice(int(i), int(j - i))


class Shard:
    """One part's blocks of some terms, opened as they are needed."""

    def __init__(self, t: pa.Table, weights: np.ndarray, dead: dict[str, np.ndarray], among: np.ndarray | None = None):
        t = t.sort_by([("term", "ascending"), ("low", "ascending")])
        column = lambda name: t.column(name).combine_chunks()
        self.weights, self.dead, self.among = weights, dead, among
        self.low, self.high, self.n = (column(x).to_numpy() for x in ("low", "high", "n"))
        self.most, self.least = column("most").to_numpy(), column("least").to_numpy()
        self.keys, self.key_at = self._flat(column("keys"))
        self.sizes, _ = self._flat(column("sizes"))
        self.counts, self.count_at = self._flat(column("counts"))
        self.places, self.place_at = self._flat(column("places")) if "places" in t.column_names else (None, None)
        self.segment = column("segment").to_pylist() if dead else None
        term = column("term")
        new = np.concatenate([[True], pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)]) if len(t) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.terms = {term[int(i)].as_py(): np.arange(i, j) for i, j in zip(first, np.append(first[1:], len(t)))}

    @staticmethod
    def _flat(x: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        return x.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(x).to_numpy())]).astype(np.int64)

    def bound(self, at: np.ndarray, gain: Callable) -> np.ndarray:
        """What any posting of these blocks adds at most."""
        return gain(self.most[at], self.least[at])

    def open(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, length, weighted count, block) of the postings of these blocks that are alive."""
        n = self.n[at].astype(np.int64)
        flat = ranges(self.key_at[at], n)
        group = np.repeat(at, n)
        key = self.low[group] + running(self.keys[flat], n)
        f = self.counts.reshape(-1, len(self.weights))[flat] @ self.weights
        size = self.sizes[flat]
        alive = self._alive(key, group)
        return (key, size, f, group) if alive is None else (key[alive], size[alive], f[alive], group[alive])

    def _alive(self, key: np.ndarray, group: np.ndarray) -> np.ndarray | None:
        if not self.dead and self.among is None:
            return None
        gone = np.zeros(len(key), bool) if self.among is None else ~np.isin(key, self.among)
        for name, keys in self.dead.items():
            mine = np.array([s == name for s in self.segment])[group]
            gone[mine] = np.isin(key[mine], keys)
        return ~gone

    def places_of(self, at: np.ndarray, field: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(key, place) of every word of a field in these blocks' live postings."""
        n = self.n[at].astype(np.int64)
        fields = len(self.weights)
        flat = ranges(self.key_at[at], n)
        group = np.repeat(at, n)
        key = self.low[group] + running(self.keys[flat], n)
        counts = self.counts.reshape(-1, fields)[flat].astype(np.int64)
        sizes = self.place_at[at + 1] - self.place_at[at]
        place = running(self.places[ranges(self.place_at[at], sizes)].astype(np.int64), counts.reshape(-1))
        each = np.repeat(np.tile(np.arange(fields), len(flat)), counts.reshape(-1)) == field
        owner = np.repeat(np.arange(len(flat)), counts.sum(1))
        alive = self._alive(key, group)
        if alive is not None:
            each &= alive[owner]
        return key[owner[each]], place[each]


def rounded(scores: np.ndarray) -> np.ndarray:
    return np.floor(scores * 1e6 + 0.5) / 1e6


def first(keys: np.ndarray, scores: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The k best (keys, rounded scores), all without k; ties by key, so that of many equal records no more than k leave."""
    scores = rounded(scores)
    if k is None or len(keys) <= k:
        return keys, scores
    at = np.lexsort((keys, -scores))[:k]
    return keys[at], scores[at]


def scores_of(s: Shard, keys: np.ndarray, terms: list[tuple[str, float]], gain: Callable[[float], Callable]) -> np.ndarray:
    """The scores of these records, in the order of their keys, for (term, idf) pairs; only blocks that reach over one are opened."""
    out = np.zeros(len(keys))
    for t, idf in terms:
        at = s.terms.get(t)
        if at is None or not len(keys):
            continue
        at = at[np.searchsorted(keys, s.high[at], "right") > np.searchsorted(keys, s.low[at])]
        if len(at):
            key, size, f, _ = s.open(at)
            to = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            met = keys[to] == key
            out[to[met]] += gain(idf)(f[met], size[met])
    return out


def best(s: Shard, terms: list[tuple[str, float]], k: int | None, gain: Callable[[float], Callable]) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(keys, scores, blocks, opened): the k best records of a shard for (term, idf) pairs, and how many of the terms' blocks were opened; all records without k.

    MaxScore by terms: those that can add most come first.  As soon as k records have more than the terms still to come can add together, new records can't get in:
    of those terms only blocks are opened that reach over a record that still can.
    """
    held = [(s.terms[t], gain(idf)) for t, idf in terms if t in s.terms]
    bounds = [s.bound(at, g) for at, g in held]
    order = sorted(range(len(held)), key=lambda i: -bounds[i].max())
    rest = np.append(np.cumsum([bounds[i].max() for i in reversed(order)])[::-1], 0.0) if order else np.zeros(1)
    keys, scores = np.zeros(0, np.int64), np.zeros(0)
    total = sum(len(at) for at, _ in held)
    count = 0
    slack = 1e-5  # scores are rounded before they are ranked
    for step, i in enumerate(order):
        at, g = held[i]
        if k is not None and len(keys) >= k:
            floor = np.partition(scores, len(scores) - k)[len(scores) - k] - slack
            alive = scores + rest[step] >= floor
            keys, scores = keys[alive], scores[alive]
            needed = bounds[i] + rest[step + 1] >= floor
            lo, hi = np.searchsorted(keys, s.low[at]), np.searchsorted(keys, s.high[at], "right")
            at = at[needed | (hi > lo)]
            needed = needed[needed | (hi > lo)]
        else:
            needed = np.ones(len(at), bool)
        if not len(at):
            continue
        count += len(at)
        key, size, f, block = s.open(at)
        add = g(f, size)
        if not needed.all():
            # records that are new here can only come from blocks that can still bring one in
            fresh = needed[np.searchsorted(at, block)]
            known = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key if len(keys) else np.zeros(len(key), bool)
            key, add = key[fresh | known], add[fresh | known]
        both, which = np.unique(np.concatenate([keys, key]), return_inverse=True)
        keys, scores = both, np.bincount(which, weights=np.concatenate([scores, add]), minlength=len(both))
    return *first(keys, scores, k), total, count


def phrase(s: Shard, words: list[str]) -> np.ndarray:
    """The keys of records that hold the words one after another: the rarest word's places, shifted, against the other words' blocks that reach over what is left."""
    if not words or any(w not in s.terms for w in words):
        return np.zeros(0, np.int64)
    order = sorted(range(len(words)), key=lambda i: (int(s.n[s.terms[words[i]]].sum()), i))
    key = start = None
    for i in order:
        at = s.terms[words[i]]
        if key is not None:
            have = np.unique(key)
            at = at[np.searchsorted(have, s.high[at], "right") > np.searchsorted(have, s.low[at])]
        if not len(at):
            return np.zeros(0, np.int64)
        k, p = s.places_of(at)
        p = p - i
        k, p = k[p >= 0], p[p >= 0]
        if key is None:
            key, start = k, p
        else:
            mine, theirs = (np.searchsorted(have, x) << 32 | y for x, y in ((key, start), (k, p)))
            kept = np.isin(mine, theirs[np.isin(k, have)])
            key, start = key[kept], start[kept]
        if not len(key):
            return np.zeros(0, np.int64)
    return np.unique(key)
