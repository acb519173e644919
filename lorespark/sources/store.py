"""Parquet tables of builds: written apart, published as numbered generations, read through the one a reader is pinned to.

A build's rows go to ``<root>/<table>/source_id=<source>/build_id=<id>``.  Publishing puts the source's next generation, a small file that names the build, in place, and only if no other
build was published since this one began (``generations``); so a build that failed half-way is never seen, of two that started from the same generation one fails, and
a reader that took a snapshot sees the same builds in all tables however often others publish.  What builds are under way is noted in a table beside them.
"""

from __future__ import annotations

import time
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .generations import ConflictError, Generations

__all__ = ["ConflictError", "Store", "digest", "retain"]

_MANIFEST = "sequence long, source_id string, build_id string, status string, base long, at double"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _system(self, path: str) -> tuple:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        system, at = self._system(path)
        return system.exists(at)

    def _generations(self, source_id: str) -> Generations:
        return Generations(self.spark, f"{self.root}/_generations/{quote(source_id, safe='')}")

    def manifest(self) -> DataFrame:
        path = f"{self.root}/_manifest"
        return self.spark.read.schema(_MANIFEST).parquet(path) if self._exists(path) else self.spark.createDataFrame([], _MANIFEST)

    def _note(self, source_id: str, build_id: str, status: str, base: int) -> None:
        row = [(time.time_ns(), source_id, build_id, status, base, time.time())]
        self.spark.createDataFrame(row, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/_manifest")

    def begin(self, source_id: str) -> str:
        """A new build of a source; it can be published as long as no other one is before it."""
        build_id = uuid.uuid4().hex
        self._note(source_id, build_id, "building", self._generations(source_id).latest())
        return build_id

    def write(self, table: str, source_id: str, build_id: str, rows: DataFrame) -> None:
        rows.drop("source_id", "build_id").write.mode("overwrite").parquet(f"{self.root}/{table}/source_id={source_id}/build_id={build_id}")

    def publish(self, source_id: str, build_id: str) -> int:
        """Makes the build the source's next generation and returns its number; raises ConflictError if another was published since the build began."""
        base = self.manifest().where((F.col("build_id") == build_id) & (F.col("status") == "building")).agg(F.max("base")).first()[0]
        if base is None:
            raise ValueError(f"no build {build_id} was begun")
        try:
            number = self._generations(source_id).publish(base, {"build_id": build_id})
        except ConflictError:
            self._note(source_id, build_id, "aborted", base)
            raise
        self._note(source_id, build_id, "published", base)
        return number

    def abort(self, source_id: str, build_id: str) -> None:
        self._note(source_id, build_id, "aborted", -1)

    def _sources(self) -> list[str]:
        system, at = self._system(f"{self.root}/_generations")
        return sorted(unquote(x.getPath().getName()) for x in system.listStatus(at)) if system.exists(at) else []

    def snapshot(self) -> dict[str, int]:
        """Each source's newest generation: what a reader pins itself to."""
        return {s: n for s in self._sources() if (n := self._generations(s).latest())}

    def _builds(self, snapshot: dict[str, int] | None = None) -> dict[str, str]:
        return {s: self._generations(s).read(n)["build_id"] for s, n in (self.snapshot() if snapshot is None else snapshot).items()}

    def active(self, snapshot: dict[str, int] | None = None) -> DataFrame:
        """(source_id, build_id) of a snapshot, or of now."""
        return self.spark.createDataFrame(list(self._builds(snapshot).items()), "source_id string, build_id string")

    def resumable(self, source_id: str) -> DataFrame:
        """Builds of a source that were neither published nor aborted."""
        m = self.manifest().where(F.col("source_id") == source_id)
        return m.where("status = 'building'").join(m.where("status <> 'building'"), "build_id", "left_anti").select("build_id")

    def read(self, table: str, snapshot: dict[str, int] | None = None) -> DataFrame:
        """Rows of the builds of a snapshot, or of now; only their folders are listed."""
        paths = [f"{self.root}/{table}/source_id={s}/build_id={b}" for s, b in self._builds(snapshot).items()]
        rows = self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*(p for p in paths if self._exists(p)))
        return rows.withColumns({c: F.col(c).cast("string") for c in ("source_id", "build_id")})

    def fresh(self, source_id: str, at: int) -> bool:
        """Whether what was made from the source's generation ``at`` is still up to date."""
        return self._generations(source_id).latest() == at

    def copy_forward(self, table: str, source_id: str, build_id: str, fresh: DataFrame, keys: list[str]) -> DataFrame:
        """A source's active rows whose keys the new ones don't have, and the new ones."""
        old = self.read(table).where(F.col("source_id") == source_id).drop("source_id", "build_id")
        return old.join(fresh.select(keys).distinct(), keys, "left_anti").unionByName(fresh)

    def collect_garbage(self, tables: list[str], keep: int = 1) -> int:
        """Removes the folders of builds that are neither among a source's last ``keep`` generations nor being built; returns how many."""
        kept = set()
        for s in self._sources():
            g = self._generations(s)
            kept |= {g.read(n)["build_id"] for n in range(max(1, g.latest() - keep + 1), g.latest() + 1)}
        m = self.manifest()
        kept |= {r["build_id"] for r in m.groupBy("build_id").agg(F.max_by("status", "sequence").alias("s")).where("s = 'building'").toLocalIterator()}
        n = 0
        for r in m.select("source_id", "build_id").distinct().toLocalIterator():
            for t in tables if r["build_id"] not in kept else []:
                system, at = self._system(f"{self.root}/{t}/source_id={r['source_id']}/build_id={r['build_id']}")
                n += bool(system.delete(at, True))
        return n

    def backup(self, tables: list[str], target: str) -> DataFrame:
        """Active rows of tables copied to another folder, with a table of (table, rows, digest)."""
        notes, at = [], self.snapshot()
        for t in tables:
            self.read(t, at).write.mode("overwrite").partitionBy("source_id", "build_id").parquet(f"{target}/{t}")
            notes.append(digest(self.spark.read.parquet(f"{target}/{t}")).select(F.lit(t).alias("table"), "rows", "digest"))
        self.active(at).write.mode("overwrite").parquet(f"{target}/_active")
        out = notes[0]
        for x in notes[1:]:
            out = out.unionByName(x)
        out.write.mode("overwrite").parquet(f"{target}/_digests")
        return self.spark.read.parquet(f"{target}/_digests")

    def restore(self, target: str) -> None:
        """Brings a backup back as published builds, after checking its digests."""
        for r in self.spark.read.parquet(f"{target}/_digests").toLocalIterator():
            rows = self.spark.read.parquet(f"{target}/{r['table']}")
            if tuple(digest(rows).first()) != (r["rows"], r["digest"]):
                raise ValueError(f"the backup of {r['table']} is damaged")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id", "build_id").parquet(f"{self.root}/{r['table']}")
        for r in self.spark.read.parquet(f"{target}/_active").toLocalIterator():
            self._note(r["source_id"], r["build_id"], "building", self._generations(r["source_id"]).latest())
            self.publish(r["source_id"], r["build_id"])


def digest(rows: DataFrame) -> DataFrame:
    """(rows, digest), whatever the order: sums of row hashes, in two halves so that no sum overflows."""
    h = F.xxhash64(*sorted(rows.columns))
    g = rows.agg(F.count("*").alias("rows"), F.sum(F.shiftright(h, 32).cast("decimal(38,0)")).alias("a"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)).cast("decimal(38,0)")).alias("b"))
    return g.select("rows", F.concat_ws(":", F.coalesce("a", F.lit(0)).cast("string"), F.coalesce("b", F.lit(0)).cast("string")).alias("digest"))


def retain(cache: DataFrame, keep: DataFrame) -> DataFrame:
    """Cache rows whose key is still wanted."""
    return cache.join(keep, "key", "left_semi")
