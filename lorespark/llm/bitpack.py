"""Token ids in the fewest bits the vocabulary needs, with block offsets for random access.

A file holds, in this order: the magic ``LSBP0001``; the packed blocks, each of BLOCK ids (the last
padded to a multiple of 64) in little-endian 64-bit words; a footer of little-endian 64-bit integers
(bits, ids, documents, blocks, then each block's byte offset, the documents' ids, and the end of each
document counted in ids); and the footer's offset as the last 8 bytes.  Document ends and offsets
let a reader fetch any range of ids with one range read and unpack it by whole numpy columns.

``write`` range-partitions documents by doc_id, rows of one id by their texts' hash, so files in order, and documents within them, ascend.  A task's
file carries its attempt in its name and counts only through the manifest row the task returns; the manifest
is written to the shared folder before anything reads it, so lost or repeated tasks leave only unused files.

Defined results: a null text is an empty one and has the end id alone; rows that repeat a doc_id are all
kept, ordered by a hash of their texts, equal rows in any order; null doc_ids come first; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _chunks, _files, _spark, _text

MAGIC = b"LSBP0001"
BLOCK = 1 << 16
BLOCK_BYTES = 8 << 20
FILE_BYTES = 32 << 20
#: Files whose ids are summed up together.
GROUP = 1000
#: Kinds of equal rows of one id, which may go to files apart.
ROWS = 1 << 16


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """ids in bits each, as little-endian 64-bit words; padded with zeros to a multiple of 64 ids."""
    x = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    x.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(x), bits), "<u8")
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= x[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= x[:, j] >> np.uint64(64 - shift)
    return out.reshape(-1)


def unpack(words: np.ndarray, bits: int) -> np.ndarray:
    """The ids of whole groups of 64."""
    x = words.reshape(-1, bits)
    out = np.empty((len(x), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        v = x[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            v = v | (x[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = v & mask
    return out.reshape(-1)


class PackedWriter:
    def __init__(self, uri: str, bits: int):
        system, path = _files.open_fs(uri)
        self.out, self.bits = system.open_output_stream(path), bits
        self.out.write(MAGIC)
        self.at, self.n, self.blocks, self.docs, self.ends = len(MAGIC), 0, [], [], []
        self.rest = np.zeros(0, np.uint32)

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.docs.append(doc_ids)
        self.ends.append(self.n + offsets[1:])
        self.n += len(ids)
        ids = np.concatenate([self.rest, ids.astype(np.uint32)])
        whole = len(ids) - len(ids) % BLOCK
        for i in range(0, whole, BLOCK):
            self._block(ids[i : i + BLOCK])
        self.rest = ids[whole:]

    def _block(self, ids: np.ndarray) -> None:
        self.blocks.append(self.at)
        body = pack(ids, self.bits).tobytes()
        self.out.write(body)
        self.at += len(body)

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        docs = np.concatenate(self.docs) if self.docs else np.zeros(0, np.int64)
        ends = np.concatenate(self.ends) if self.ends else np.zeros(0, np.int64)
        self.out.write(np.concatenate([[self.bits, self.n, len(docs), len(self.blocks)], self.blocks, docs, ends, [self.at]]).astype("<i8").tobytes())
        self.out.close()


class PackedReader:
    def __init__(self, uri: str):
        self.file = _files.RangeReader(uri)
        foot = int.from_bytes(self.file.read(self.file.size - 8, 8), "little")
        if self.file.read(0, 8) != MAGIC:
            raise ValueError(f"not a packed token file: {uri}")
        x = np.frombuffer(self.file.read(foot, self.file.size - 8 - foot), "<i8")
        self.bits, self.n, docs, blocks = x[:4].tolist()
        self.blocks = np.append(x[4 : 4 + blocks], foot)
        self.docs, self.ends = x[4 + blocks : 4 + blocks + docs], x[4 + blocks + docs :]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """ids [start, stop) by one range read."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-stop // BLOCK)
        lo = int(self.blocks[first])
        words = np.frombuffer(self.file.read(lo, int(self.blocks[last]) - lo), "<u8")
        return unpack(words, self.bits)[start - first * BLOCK : stop - first * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


@cache
def _tokenizer(path: str, specials_are_text: bool):
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = specials_are_text
    return t


@cache
def _table(path: str, specials_are_text: bool) -> _chunks.Table:
    """Chunks are encoded many in one string, as a call costs more than a chunk; each id goes to the chunk in which its characters begin."""
    t = _tokenizer(path, specials_are_text)

    def encode(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [], []
        for i in range(0, len(distinct), 256):
            part = distinct[i : i + 256]
            begin = np.zeros(len(part) + 1, np.int64)
            np.cumsum([len(x) + 1 for x in part], out=begin[1:])
            e = t.encode(" ".join(part), add_special_tokens=False)
            ids.append(np.array(e.ids, np.int32))
            at = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids))
            sizes.append(np.bincount(np.searchsorted(begin, at, "right") - 1, minlength=len(part)))
        ends = np.zeros(len(distinct) + 1, np.int64)
        np.cumsum(np.concatenate(sizes), out=ends[1:])
        return np.concatenate(ids), ends

    return _chunks.Table(encode, 700_000)


def vocabulary_size(tokenizer: str) -> int:
    return _tokenizer(tokenizer, False).get_vocab_size()


def encode_texts(texts: pa.Array, tokenizer: str, last: int | None, specials_are_text: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) as the tokenizers library gives them for whole texts, by a table of the distinct chunks that end in a space or line feed or before a comma or full stop.

    For tokenizers that drop white space and whose pre-tokens never cross it, as word_bpe_49k.json.
    """
    raw, offs = _text.buffers(texts)
    begin = np.zeros(len(raw) + 1, bool)
    begin[1:] = (raw == 0x20) | (raw == 0x0A)
    # a comma or full stop after an ASCII letter begins a pre-token as well, so a word is one chunk with and without it
    letter = (raw | 0x20) - np.uint8(97) < 26
    begin[1:-1] |= letter[:-1] & ((raw[1:] == 0x2C) | (raw[1:] == 0x2E))
    begin[offs] = True
    starts = np.flatnonzero(begin[: len(raw)])
    return _chunks.encode_distinct(_chunks.slices(raw, starts, pa.large_string()), np.searchsorted(starts, offs), _table(tokenizer, specials_are_text), last)


def write(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encodes docs(doc_id, text) into packed files; returns their manifest (part, path, docs, ids)."""
    spark = docs.sparkSession
    _spark.small_batches(spark)
    folder = _spark.fresh_path(spark, "packed")
    _files.make_dir(folder)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    files = _spark.tasks(spark, _spark.text_size(docs)[1], FILE_BYTES)
    bits = bits_for(max(end_id + 1, vocabulary_size(tokenizer)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, out = TaskContext.get(), None
        n = m = 0
        uri = f"{folder}/{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.lsbp"
        for t in _text.flushes(batches, "text", BLOCK_BYTES):
            out = out or PackedWriter(uri, bits)
            ids, offs = encode_texts(t.column("text"), tokenizer, end_id)
            out.add(t.column("doc_id").fill_null(-(2**63)).to_numpy(), ids, offs)
            n, m = n + t.num_rows, m + len(ids)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int32()), pa.array([uri]), pa.array([n], pa.int64()), pa.array([m], pa.int64())], ["part", "path", "docs", "ids"])

    # rows of one id, as those without any, are told apart by their texts' hash, and equal rows by where they come from: no file is longer for them
    told = docs.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id() % ROWS)
    ordered = told.repartitionByRange(files, "doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    return _spark.written(ordered.mapInArrow(run, "part int, path string, docs long, ids long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the files; ids are little-endian 32-bit integers, start counts the ids of all documents before."""
    spark = manifest.sparkSession
    # a prefix sum in two levels: over the sums of every GROUP files, then within them
    parts = manifest.select("part", "path", F.col("ids").alias("n"), F.floor(F.col("part") / F.lit(GROUP)).alias("group"))
    sums = parts.groupBy("group").agg(F.sum("n").alias("n"))
    sums = sums.select("group", (F.sum("n").over(Window.orderBy("group")) - F.col("n")).alias("before"))
    base = F.col("before") + F.sum("n").over(Window.partitionBy("group").orderBy("part")) - F.col("n")
    listed = parts.join(sums, "group").select("part", "path", base.alias("base")).repartition(max(1, manifest.count()), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                r = PackedReader(path)
                begin = np.concatenate([[0], r.ends[:-1]])
                lo = 0
                while lo < len(r.docs):
                    hi = max(lo + 1, int(np.searchsorted(r.ends, begin[lo] + 16 * BLOCK, "right")))
                    ids = r.ids(int(begin[lo]), int(r.ends[hi - 1])).astype("<u4")
                    cut = np.append(begin[lo:hi], r.ends[hi - 1]) - begin[lo]
                    body = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer((cut * 4).astype(np.int64)), pa.py_buffer(ids)])
                    doc = r.docs[lo:hi].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(doc, mask=doc == -(2**63)), pa.array(base + begin[lo:hi]), pa.array(np.diff(cut)), body.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                    lo = hi
                r.file.close()

    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
