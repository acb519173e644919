"""Files as DataFrames: scans of folders, targeted scans, their content and conversion cache."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from ..functions import files, ids
from ..operators import changes
from . import tree


def accessible(spark: SparkSession, root: str) -> bool:
    """Whether a root can be read at all; one that can't is offline, and nothing of it was deleted."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    try:
        return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))
    except Exception:  # the file system's own errors all mean the same here
        return False


#: Bytes read at a time where a file is only hashed.
READ = 1 << 20


def scan(spark: SparkSession, root: str, source_id: str, patterns: list[str] = (), include: list[str] = (), max_bytes: int | None = None) -> DataFrame:
    """(source_id, rel_path, size, mtime, kind, language, format, file_id, error) of a folder's files that the rules don't leave out: listed, not opened.

    A folder that can't be listed is a row whose ``error`` says so; such a scan is incomplete, and nothing may be taken for deleted by it.
    """
    f = tree.listing(spark, root, patterns, include)
    if max_bytes is not None:
        f = f.where(F.col("size").isNull() | (F.col("size") <= max_bytes))
    p = F.col("rel_path")
    return f.select(F.lit(source_id).alias("source_id"), "rel_path", "size", "mtime", files.kind(p).alias("kind"), files.language(p).alias("language"), files.document_format(p).alias("format"), ids.file_id(F.lit(source_id), p).alias("file_id"), "error")


def read(found: DataFrame, root: str, content: bool = True) -> DataFrame:
    """found(rel_path, error, ...) with ``content_hash`` and, if asked for, ``content``: only these files are opened.

    Give it the files that need it, such as ``changes``' hash candidates.  A file that can't be read has an error instead.
    """
    names = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = tree.system(root.rstrip("/"))
        for b in batches:
            errors = b.column("error").to_pylist()
            for i, path in enumerate(b.column("rel_path").to_pylist()):
                digest, body = None, None
                if errors[i] is None:
                    try:
                        digest, body = _read_one(store, f"{base}/{path}", content)
                    except OSError as e:
                        errors[i] = str(e)[:500]
                row = b.slice(i, 1)
                cols = [pa.array([errors[i]], pa.string()) if n == "error" else row.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([digest], pa.string()), *([pa.array([body], pa.binary())] if content else [])], [*names, "content_hash", *(["content"] if content else [])])

    schema = StructType([*found.schema.fields, StructField("content_hash", StringType()), *([StructField("content", BinaryType())] if content else [])])
    # dealt out by chance, as a folder's large files lie together
    cores = found.sparkSession.sparkContext.defaultParallelism
    return found.repartition(4 * cores, F.xxhash64("rel_path")).mapInArrow(run, schema)


def hashed(found: DataFrame, before: DataFrame, root: str) -> DataFrame:
    """found with ``content_hash``: that of before(rel_path, size, mtime, content_hash) where size and time are the same, else of the file; only those are opened."""
    old = before.select("rel_path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("content_hash").alias("_hash"))
    both = found.join(old, "rel_path", "left")
    same = F.coalesce(F.col("error").isNull() & F.col("_hash").isNotNull() & changes.stat_unchanged(F.col("size"), F.col("mtime"), F.col("_size"), F.col("_mtime")), F.lit(False))
    kept = both.where(same).select(*found.columns, F.col("_hash").alias("content_hash"))
    return kept.unionByName(read(both.where(~same).select(*found.columns), root, content=False))


def _read_one(store: fs.FileSystem, path: str, content: bool) -> tuple[str, bytes | None]:
    h, kept = hashlib.sha256(), []
    with store.open_input_stream(path) as f:
        while part := f.read(READ):
            h.update(part)
            if content:
                kept.append(part)
    return h.hexdigest(), b"".join(kept) if content else None


def only(scanned: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files that were asked for by name or by a folder above them, names that match none): asked(rel_path)."""
    a = asked.select(F.regexp_replace("rel_path", "/+$", "").alias("asked")).distinct()
    parts = F.split("rel_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hits = scanned.select("rel_path", F.explode(above).alias("asked")).join(a, "asked").select("rel_path", "asked")
    return scanned.join(hits.select("rel_path").distinct(), "rel_path", "left_semi"), a.join(hits, "asked", "left_anti")


def uncached(found: DataFrame, cache: DataFrame, options: str) -> tuple[DataFrame, DataFrame]:
    """(files with their cached conversion, files still to convert): cache(content_hash, options, value)."""
    key = cache.where(F.col("options") == options).select("content_hash", "value")
    return found.join(key, "content_hash"), found.join(key, "content_hash", "left_anti")
