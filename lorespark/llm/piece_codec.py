"""SentencePiece encoding and decoding through a distinct-chunk table.

The model's pieces hold the whitespace marker at their beginning only (checked when a model is
loaded), so no merge crosses from a word into the marker after it.  A text is cut before each
run of markers; each distinct marked word of a block is segmented once by the library, and its
ids are put back by position.  Decoding cuts the ids before each piece that begins with the
marker and decodes each distinct run once.  A model with other rules (normalisation, pieces
that cross markers) is refused.

Defined results: a null text is an empty one; an empty text is the end id alone and decodes to
an empty text; texts of any length are encoded whole; repeated rows each give a row; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _chunks, _spark, _text

MARK = "▁"
BLOCK_BYTES = 6 << 20


@cache
def load(model: str):
    """(processor, which ids begin with the marker, id of the lone marker)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("pieces of this model cross whitespace markers")
    if sp.encode("a  b　ﬁ", out_type=str) != sp.encode("a" + MARK + MARK + "b　ﬁ", out_type=str) or sp.decode(sp.encode(" a  b　ﬁ ")) != " a  b　ﬁ ":
        raise ValueError("this model normalises its input")
    return sp, np.array([p.startswith(MARK) for p in pieces]), sp.piece_to_id(MARK)


@cache
def _table(model: str) -> _chunks.Table:
    sp, _, lone = load(model)
    # the library puts a marker before what it gets: a chunk's own first one
    return _chunks.Table(lambda distinct: _chunks.flat([i or [lone] for i in sp.encode([x[1:] for x in distinct], num_threads=1)]))


def encode_texts(texts: pa.Array, model: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): each text as the library encodes it, with the end id."""
    sp = load(model)[0]
    texts = pc.replace_substring(pc.cast(texts, pa.large_string()).fill_null(""), MARK, " ")
    texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
    raw, offs = _text.buffers(texts)
    blank = raw == 0x20
    begin = blank.copy()
    begin[1:] &= ~blank[:-1]
    at = offs[:-1]
    begin[at[at < offs[1:]]] = True
    starts = np.flatnonzero(begin)

    return _chunks.encode_distinct(_chunks.slices(raw, starts, pa.large_string()), np.searchsorted(starts, offs), _table(model), sp.eos_id())


def decode_ids(ids: np.ndarray, offsets: np.ndarray, model: str) -> pa.Array:
    """Each document's text as the library decodes its ids."""
    sp, marked, _ = load(model)
    ids = np.ascontiguousarray(ids, np.int32)
    begin = marked[ids]
    at = offsets[:-1]
    begin[at[at < offsets[1:]]] = True
    starts = np.flatnonzero(begin)
    table = _chunks.slices(ids.view(np.uint8), starts * 4, pa.large_binary()).dictionary_encode()
    runs = [np.frombuffer(x.as_buffer(), np.int32).tolist() for x in table.dictionary]
    texts = sp.decode(runs) if runs else []
    texts = pa.array([" " + t if marked[r[0]] else t for r, t in zip(runs, texts, strict=True)], pa.large_string())
    raw, offs = _text.buffers(texts.take(table.indices))
    where = np.searchsorted(starts, offsets)
    lo, hi = offs[where[:-1]], offs[where[1:]]
    body = raw.tobytes()
    skip = np.zeros(len(lo), np.int64)
    full = np.flatnonzero(offsets[:-1] < offsets[1:])
    skip[full] = marked[ids[offsets[:-1][full]]]
    return pa.array([body[i + s : j].decode() for i, j, s in zip(lo.tolist(), hi.tolist(), skip.tolist(), strict=True)], pa.string())


def encode(docs: DataFrame, model: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) of docs(doc_id, text); with ``decoded``, also the text that decoding those ids gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _text.flushes(batches, "text", BLOCK_BYTES):
            ids, offs = encode_texts(t.column("text").combine_chunks(), model)
            doc = t.column("doc_id").combine_chunks()
            back = decode_ids(ids, offs, model) if decoded else None
            for i in range(0, len(doc), 256):
                o = offs[i : i + 257]
                cols = [doc[i : i + 256], pa.ListArray.from_arrays(pa.array((o - o[0]).astype(np.int32)), pa.array(ids[o[0] : o[-1]], pa.int32()))]
                yield pa.RecordBatch.from_arrays([*cols, back[i : i + 256]], ["doc_id", "ids", "text"]) if decoded else pa.RecordBatch.from_arrays(cols, ["doc_id", "ids"])
            del ids, back

    _spark.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>" + ", text string" * decoded)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded(doc_id, ids) and the text of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _text.flushes(batches, "ids", 2 * BLOCK_BYTES):
            ids = t.column("ids").combine_chunks()
            offs = ids.offsets.to_numpy().astype(np.int64)
            text = decode_ids(ids.values.to_numpy()[offs[0] : offs[-1]], offs - offs[0], model)
            yield from t.append_column("text", text).to_batches(256)

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, text string")
