"""Distinct-chunk tables: cut a block of documents into chunks that encode independently, encode each distinct one once, and put the ids back by position.

The chunks of a block are adjacent slices of its byte buffer, so the table is built by Arrow's
dictionary encoding over that buffer; equality is that of the bytes, not of hashes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(raw: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Adjacent slices of a buffer, each from one start to the next, the last to the end."""
    offs = np.append(starts, len(raw)).astype(np.int64)
    return pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(raw))])


def flat(lists: list[list[int]], kind: type = np.int32) -> tuple[np.ndarray, np.ndarray]:
    ends = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)), out=ends[1:])
    out = np.fromiter((x for y in lists for x in y), kind, int(ends[-1]))
    return out, ends


class Table:
    """Distinct chunks met so far by this worker and their ids; begun anew beyond ``limit`` chunks, so its memory is bounded."""

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def places(self, chunks: pa.Array) -> np.ndarray:
        """Where each of the distinct chunks stands in the table; new ones are encoded."""
        if len(self.known) + len(chunks) > self.limit:
            self._clear()
        at = pc.index_in(chunks, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = chunks.take(pa.array(new))
            ids, ends = self.encode(fresh.to_pylist())
            at[new] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, fresh])
            self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, self.ends[-1] + ends[1:]])
        return at


def encode_distinct(chunks: pa.Array, doc_chunk_offsets: np.ndarray, table: Table, last: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of all documents; doc_chunk_offsets says where each one's chunks begin, last is put at its end."""
    if len(chunks):
        met = chunks.dictionary_encode()
        index = table.places(met.dictionary)[met.indices.to_numpy()]
    else:
        index = np.zeros(0, np.int64)
    size = np.diff(table.ends)[index]
    upto = np.zeros(len(index) + 1, np.int64)
    np.cumsum(size, out=upto[1:])
    kind = np.int32 if max(upto[-1], table.ends[-1]) < 2**31 else np.int64
    source = np.repeat((table.ends[:-1][index] - upto[:-1]).astype(kind), size)
    source += np.arange(upto[-1], dtype=kind)
    got = table.ids[source]
    at = upto[doc_chunk_offsets]
    if last is None:
        return got, at
    n = len(at) - 1
    out = np.empty(len(got) + n, np.int32)
    whole = np.ones(len(out), bool)
    closing = at[1:] + np.arange(n)
    whole[closing] = False
    out[whole], out[closing] = got, last
    return out, at + np.arange(n + 1)
