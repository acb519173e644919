"""Session helpers: shared folders, sizes, components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _files, _text


#: Rows of ids, numbers and short arrays that a task writes to one file.
ROWS_A_FILE = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; a temporary one only where that is unset (local tests)."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = getattr(sc, "_lorespark_dir", None)
        if folder is None:
            folder = sc._lorespark_dir = "file://" + tempfile.mkdtemp(prefix="lorespark-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


#: Paths made within each ``scratch`` that is open.
_made: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    if not _left:
        atexit.register(_clear)
    _left.append(path)
    return path


#: What this driver has made; what is still there when it ends goes.
_left: list[str] = []


def _clear() -> None:
    for path in _left:
        with contextlib.suppress(OSError, ValueError):
            system, at = _files.open_fs(path)
            if system.get_file_info(at).type == _files.fs.FileType.Directory:
                system.delete_dir(at)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What operators write to the shared folder within goes at the end; results must have been written elsewhere by then."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            drop_path(spark, path)


def tasks(spark: SparkSession, size: int, each: int) -> int:
    """As many tasks as ``size`` needs at ``each`` a task, and as the cluster has cores at least."""
    return max(spark.sparkContext.defaultParallelism, -(-size // each))


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut and lost executors cost nothing that was done.

    With ``rows``, about how many rows it has at most, no more files than they fill.  A name with a slash is the table's path.
    """
    spark = df.sparkSession
    path = name if "/" in name else fresh_path(spark, name)
    if rows is not None:
        df = df.coalesce(tasks(spark, rows, ROWS_A_FILE))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Rows an Arrow batch carries to Python: few, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(_text.BATCH_ROWS))


def text_size(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """(rows, bytes of text)"""
    r = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("bytes")).first()
    return r["rows"], r["bytes"]


def components(edges: DataFrame, rows: int | None = None, rounds: int = 60) -> DataFrame:
    """(id, component) of every id in edges(a, b): the smallest id reachable.

    Alternating large-star and small-star steps over the edge table, which is written to the
    shared folder each round; nothing is collected but one change count.  A round only ever
    makes one row of each it reads, so hubs of any degree cost no more than their edges.
    """
    spark = edges.sparkSession
    path = fresh_path(spark, "edges")
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), path, rows)
    for _ in range(rounds):
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s")).select("s.a", "s.b").where("a <> b").distinct()
        upto = fresh_path(spark, "edges")
        new = written(small, upto, rows)
        # a star forest: no id is both a member and a centre, and each member has one centre
        s = new.agg(F.count("*").alias("n"), F.count_distinct("a").alias("d")).first()
        drop_path(spark, path)
        path = upto
        done = s["n"] == s["d"] and new.join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()
        e, rows = new, s["n"]
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
