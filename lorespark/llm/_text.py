"""Vectorised text primitives shared by the training-data operators.

All work on Arrow string arrays: the UTF-8 buffer is viewed as one numpy byte array, so a
batch is tokenised and hashed without a Python object per word.  Hashes are 64 bits; where an
operator's result rests on hash equality its docstring says so.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_K1, _K2, _K3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Words longer than this many bytes are hashed one by one with blake2b.
LONG_WORD = 2048
BATCH_ROWS = 1024


def _table(separators: bytes) -> np.ndarray:
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


#: Words are runs of anything but space and the control characters 0x09-0x0D.
SPACE_WORDS = _table(bytes([0x20, *range(0x09, 0x0E)]))
#: Words are runs of ASCII letters (lower-cased), digits and bytes over 0x7F.
ALNUM_WORDS = _table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps on overflow."""
    h = (h ^ (h >> U64(30))) * _K2
    h = (h ^ (h >> U64(27))) * _K3
    return h ^ (h >> U64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; a null has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, off, data = texts.buffers()
    offs = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def words(raw: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, doc_offsets): byte spans of the words, and where each document's words begin."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = table[raw]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edges = offs[:-1]
    before[edges[edges < len(raw)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    edges = offs[1:]
    after[edges[edges > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offs)


def hash_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step for all spans at once."""
    if not len(start):
        return np.zeros(0, U64)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))
    length = end - start
    h = length.astype(U64) * _K1
    live = np.flatnonzero(length <= LONG_WORD) if (length > LONG_WORD).any() else slice(None)
    at, left, acc = start[live], length[live], h[live]
    index = None if isinstance(live, slice) else live
    while True:
        x = lanes[at]
        short = left < 8
        if short.any():
            x[short] &= (U64(1) << (left[short].astype(U64) * U64(8))) - U64(1)
        acc = (acc ^ x) * _K2
        acc ^= acc >> U64(32)
        if index is None:
            h = acc.copy() if h is not acc else acc
            more = np.flatnonzero(left > 8)
            index = more
        else:
            h[index] = acc
            more = np.flatnonzero(left > 8)
            index = index[more]
        if not len(more):
            break
        at, left, acc = at[more] + 8, left[more] - 8, acc[more]
    for i in np.flatnonzero(length > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(h)


def gram_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position; the last k-1 positions have none."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    acc = np.full(n, U64(k), U64)
    for j in range(k):
        acc = (acc ^ w[j : j + n]) * _K1
        acc ^= acc >> U64(29)
    return mix(acc)


def one_hash(w: np.ndarray) -> np.uint64:
    """Hash of a whole word sequence, its length included."""
    return gram_hashes(w, len(w))[0]


def inside_docs(doc_offsets: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """Which of the n_words-k+1 windows of k words lie within one document."""
    n = max(0, n_words - k + 1)
    ok = np.ones(n + k, bool)
    for e in range(1, k):
        at = doc_offsets[1:] - e
        ok[at[(at >= 0) & (at < n)]] = False
    return ok[:n]


def give_back() -> None:
    """Memory that is no longer used goes back to the system, so that a worker stays as small as its block."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def flushes(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Batches put together up to about ``limit`` bytes of text (a longer text comes alone)."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        step = max(1, min(b.num_rows, 256))
        for i in range(0, b.num_rows, step):
            part = b.slice(i, step)
            n = part.column(column).nbytes
            if kept and size + n > limit:
                whole = pa.Table.from_batches(kept)
                kept, size = [], 0
                yield whole
                del whole
                give_back()
            kept.append(part)
            size += n
    if kept:
        yield pa.Table.from_batches(kept)
