"""The folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

#: Rows that ``gathered`` puts together at a time.
GATHERED = 500_000


def base(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and all runs in one process (tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.gettempdir() + "/lorespark"
    return found.rstrip("/")


#: What this driver has made and not given a name to keep; what is still there when it ends goes.
_made: list[str] = []


def _clear() -> None:
    for path in _made:
        with contextlib.suppress(OSError, ValueError):
            store, at = fs.FileSystem.from_uri(path)
            if store.get_file_info(at).type == fs.FileType.Directory:
                store.delete_dir(at)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path within the shared one; it goes when the driver ends, unless it is renamed till then."""
    path = f"{base(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clear)
    _made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder: what reads it several times doesn't make it several times, and lineage ends here."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan of texts over all cores: one of fewer than two partitions a core, as of a table in one file, is dealt out before its texts are taken apart."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < 2 * cores else scan


def _system(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop(spark: SparkSession, path: str) -> None:
    system, at = _system(spark, path)
    system.delete(at, True)


def release(spark: SparkSession) -> None:
    """What finished jobs have shuffled goes from the executors' disks: Spark drops it as their plans are collected, which by itself may be long after."""
    gc.collect()
    spark._jvm.System.gc()


def gathered(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt out by a text, so that what joins or groups by it needs no further shuffle; on the way a batch's rows of one key are lists beside it, a fraction of the rows' bytes."""
    others = [c for c in rows.columns if c != key]
    schema = StructType([rows.schema[key], *(StructField(c, ArrayType(rows.schema[c].dataType)) for c in others)])
    names = [key, *others]

    def one(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(kept)
        told = t.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
        code = told.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(told.dictionary)))]), pa.int32())
        return pa.RecordBatch.from_arrays([told.dictionary, *(pa.ListArray.from_arrays(ends, t.column(c).combine_chunks().take(pa.array(order))) for c in others)], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for b in batches:
            kept.append(b)
            n += b.num_rows
            if n >= GATHERED:
                packed = one(kept)
                # few keys a batch, as a key may have long lists
                yield from (packed.slice(i, 1000) for i in range(0, packed.num_rows, 1000))
                kept, n = [], 0
        if n:
            packed = one(kept)
            yield from (packed.slice(i, 1000) for i in range(0, packed.num_rows, 1000))

    small = rows.select(*names).mapInArrow(pack, schema).repartition(key)
    if len(others) == 1:
        return small.select(key, F.explode(others[0]).alias(others[0]))
    return small.select(key, F.inline(F.arrays_zip(*others)))


def _place(scan: DataFrame, name: str) -> str:
    """Where ``built`` puts what is made of the files behind ``scan``."""
    spark = scan.sparkSession
    # the files' own listing; their contents are not read
    f = spark.read.format("binaryFile").load(sorted(scan.inputFiles())).select("path", "length", "modificationTime")
    seen = f.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("h")).first()
    return f"{base(spark)}/{name}-{seen['n']}-{(seen['h'] or 0) & (2**64 - 1):016x}"


def found(scan: DataFrame, name: str) -> str | None:
    """The folder that ``built`` has made of these files, if it has."""
    path = _place(scan, name)
    system, at = _system(scan.sparkSession, path)
    return path if system.exists(at) else None


def built(scan: DataFrame, name: str, build: Callable[[str], None]) -> str:
    """The folder that ``build`` fills from the files behind ``scan``: built once, and found again, also by later sessions, as long as those files are the same.

    The files are told by their paths, sizes and times.  A folder gets its name when it is complete, so half-built ones are never read.
    """
    spark = scan.sparkSession
    path = _place(scan, name)
    system, at = _system(spark, path)
    if not system.exists(at):
        made = folder(spark, name)
        build(made)
        if not system.rename(_system(spark, made)[1], at):
            drop(spark, made)
            if not system.exists(at):
                raise OSError(f"{path} could not be made")
    return path
