"""Token counts of documents in flat, unindexed token files, by a separator scan.

A flat file is nothing but token ids of a fixed width, each document ended by the end-of-document id.
``scan`` deals every file out in blocks of ``BLOCK_IDS`` ids and searches each block for the separator in one
numpy comparison.  A block knows only the separators it holds; documents that begin in an earlier block are stitched by a prefix scan
over the blocks of a file: the running number of separators gives each document's ordinal, the running maximum of separator
places gives where the open document began.  Only the blocks' separator places are shuffled, and the files' document ids, never token ids.

``write_flat`` makes such files from documents with a tokenizers file, and a table of which document is which in each.

Defined results: a null or empty text is a document of no tokens; ids after a file's last separator are an unfinished
document and are reported with ``complete`` false; an empty file has no documents; a file whose size is no multiple
of the width is refused, and so are a vocabulary and a separator that the width can't hold; rows that repeat a doc_id each count; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _files, _spark, _text, bitpack

BLOCK_IDS = 1 << 21
BLOCK_BYTES, FILE_BYTES, TASK_BYTES = 8 << 20, 64 << 20, 32 << 20
#: Documents after which a file is closed, however small they are: its ids are one row.
FILE_DOCS = 1 << 16


def write_flat(docs: DataFrame, tokenizer: str, separator: int, width: int = 2) -> DataFrame:
    """Flat files of docs(doc_id, text); returns (path, bytes, doc_ids array<long>) of each, the file's documents in order, FILE_DOCS at most.

    Texts that spell out a special token are ordinary text, so the separator only ever ends a document.
    """
    spark = docs.sparkSession
    most = max(separator + 1, bitpack.vocabulary_size(tokenizer))
    if separator < 0 or most > 1 << (8 * width):
        raise ValueError(f"ids up to {most - 1} don't fit {width} bytes")
    _spark.small_batches(spark)
    folder = _spark.fresh_path(spark, "flat")
    _files.make_dir(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, out, made = TaskContext.get(), None, []
        docs_in: list[np.ndarray] = []
        size = 0

        def finish() -> None:
            out.close()
            made.append((uri, size, np.concatenate(docs_in)))

        for t in (whole.slice(i, FILE_DOCS) for whole in _text.flushes(batches, "text", BLOCK_BYTES) for i in range(0, whole.num_rows, FILE_DOCS)):
            if out is not None and sum(map(len, docs_in)) + t.num_rows > FILE_DOCS:
                finish()
                out = None
            if out is None:
                uri = f"{folder}/{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.tok"
                system, path = _files.open_fs(uri)
                out, docs_in, size = system.open_output_stream(path), [], 0
            ids, _ = bitpack.encode_texts(t.column("text"), tokenizer, separator, specials_are_text=True)
            body = ids.astype(f"<u{width}").tobytes()
            out.write(body)
            size += len(body)
            docs_in.append(t.column("doc_id").fill_null(-(2**63)).to_numpy())
            if size >= FILE_BYTES:
                finish()
                out = None
        if out is not None:
            finish()
        cols = list(zip(*made, strict=True)) if made else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(list(cols[2]), pa.list_(pa.int64()))], ["path", "bytes", "doc_ids"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _spark.written(docs.mapInArrow(run, "path string, bytes long, doc_ids array<long>"), "files")


def _stitched(files: DataFrame, separator: int, width: int, block_ids: int) -> DataFrame:
    """(path, seen, open, length, ends) of every block of files(path, bytes): the separators before it, where its first document begins, the file's ids, and its own separators."""
    spark = files.sparkSession
    blocks = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("bytes") / F.lit(width)) - 1, F.lit(0)), F.lit(block_ids).cast("long"))).alias("begin"), "bytes")
    size = files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, begin, size in zip(b.column("path").to_pylist(), b.column("begin").to_pylist(), b.column("bytes").to_pylist(), strict=True):
                if size % width:
                    raise ValueError(f"{path}: {size} bytes are no whole number of ids")
                r = _files.RangeReader(path)
                ids = np.frombuffer(r.read(begin * width, min(block_ids * width, size - begin * width)), f"<u{width}")
                r.close()
                one = (path, begin, begin + len(ids), size // width)
                yield pa.RecordBatch.from_arrays([pa.array([one[0]], pa.string()), *(pa.array([x], pa.int64()) for x in one[1:]), pa.array([begin + np.flatnonzero(ids == separator)], pa.list_(pa.int64()))], ["path", "begin", "upto", "length", "ends"])

    found = blocks.repartition(_spark.tasks(spark, size, TASK_BYTES), "path", "begin").mapInArrow(run, "path string, begin long, upto long, length long, ends array<long>")
    before = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("seen", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).cast("long")).withColumn("open", F.coalesce(F.max(F.array_max("ends")).over(before) + 1, F.lit(0).cast("long")))


def _starts(marks: str) -> Column:
    """Where the document that each mark ends begins."""
    return F.concat(F.array("open"), F.transform(marks, lambda x: x + 1))


def scan(files: DataFrame, separator: int, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(path, ordinal, start, n_tokens, complete) of every document in files(path, bytes); start and n_tokens count ids, separators not included in n_tokens."""
    # what follows a file's last separator, if anything
    rest = F.when((F.col("upto") == F.col("length")) & (F.coalesce(F.array_max("ends") + 1, F.col("open")) < F.col("length")), F.array(F.col("length"))).otherwise(F.array().cast("array<long>"))
    marks = _stitched(files, separator, width, block_ids).withColumn("marks", F.concat("ends", rest)).withColumn("starts", _starts("marks"))
    at = marks.select("path", "seen", F.size("ends").alias("n"), F.posexplode(F.arrays_zip("marks", F.slice("starts", F.lit(1), F.size("marks")).alias("start"))).alias("k", "m"))
    return at.select("path", (F.col("seen") + F.col("k")).alias("ordinal"), F.col("m.start").alias("start"), (F.col("m.marks") - F.col("m.start")).alias("n_tokens"), (F.col("k") < F.col("n")).alias("complete"))


def document_counts(files: DataFrame, separator: int, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(doc_id, n_tokens) of every document of write_flat's files."""
    # a file's doc_ids meet its blocks, which the scan has sorted by file already, as one row; a block takes its own out of them
    blocks = _stitched(files, separator, width, block_ids).withColumn("starts", _starts("ends"))
    both = blocks.join(files.select("path", "doc_ids").hint("merge"), "path")
    counts = F.zip_with(F.slice("doc_ids", (F.col("seen") + 1).cast("int"), F.size("ends")), F.zip_with("ends", F.slice("starts", F.lit(1), F.size("ends")), lambda e, b: e - b), lambda d, n: F.struct(F.nullif(d, F.lit(-(2**63))).alias("doc_id"), n.alias("n_tokens")))
    return both.where(F.size("ends") > 0).select(F.explode(counts).alias("c")).select("c.doc_id", "c.n_tokens")
