"""Full-text retrieval: postings, BM25, query tiers, lookups, snippets.

An index (``Index``) is built once, by one pass over the records, kept up by what changes, and stored; queries read only the blocks of their own terms, which files are
sorted by.  Phrase, prefix and term queries over records of the moment use a plain exploded view.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import shared
from ..functions import text
from ..sources import generations
from . import postings as blocks

K1, B = 1.2, 0.75
#: Up to this many terms are looked up by a filter that the scan of the postings can skip files by; more by a join.
FEW_TERMS = 1000
#: Of the stored tables; another one is built anew.
FORMAT = 6
#: Records of a part, which a task searches; queries that a task takes at once at most, and at least where there is a choice; groups of so many queries that read a part's blocks once; segments of like size that are merged.
PART_RECORDS, QUERIES, LEAST_QUERIES, GROUPS, TIER = 20_000, 1000, 25, 20, 4
#: Bytes of a row group of blocks, which a task reads at a time.
ROW_GROUP = 8 << 20


def postings(records: DataFrame, key: str, fields: dict[str, float]) -> DataFrame:
    """(key, length, term, weight) of every word of the weighted fields."""

    def side(field: str, weight: float) -> Column:
        return F.transform(text.lower_words(field), lambda t: F.struct(t.alias("term"), F.lit(float(weight)).alias("weight")))

    all_words = F.concat(*(side(f, w) for f, w in fields.items()))
    # the length is a column of its own before the words go apart, so that no row carries or counts them again
    listed = records.select(key, all_words.alias("w")).select(key, F.size("w").cast("long").alias("length"), "w")
    return listed.select(key, "length", F.explode("w").alias("p")).select(key, "length", "p.term", "p.weight")


def _gain(mean: float) -> Callable[[float], Callable]:
    return lambda idf: lambda f, length: idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean))


class ConflictError(generations.ConflictError):
    """Another update of the index has been published first."""


class Index:
    """A stored full-text index: segments of positional postings in blocks (``postings``), tombstones, and numbered generations that say which of them count.

    Records have whole numbers as keys.  Each is in one of ``parts`` by its key's hash, and a part's blocks of the asked terms are what a task searches.  A segment's blocks are
    sorted by part and term, so a scan for a few terms skips files and row groups; how often a term occurs, and where first, is said by the blocks' own columns
    without opening any.  ``update`` adds a segment for records that are new or changed and tombstones for those that are gone, and merges segments
    of like size, which drops what is dead; only the records given to it are taken apart.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, generation: int | None = None):
        self.spark, self.path, self.key = spark, path, key
        self.log = generations.Generations(spark, f"{path}/generations")
        self.generation = self.log.latest() if generation is None else generation
        self.state = self.log.read(self.generation)
        self.fields = self.state["fields"]
        self.weights = np.array([w for _, w in self.fields], np.float64)

    # ---- building and keeping up ----

    @classmethod
    def build(cls, records: DataFrame, key: str, fields: dict[str, float], path: str) -> Index:
        """A new index of records at path, as its first generation."""
        spark = records.sparkSession
        named = [[f, float(w)] for f, w in fields.items()]
        lengths = records.select(F.col(key).cast("long").alias("key"), cls._length(named).alias("length"))
        lengths.write.parquet(f"{path}/first/lengths")
        n, total = spark.read.parquet(f"{path}/first/lengths").agg(F.count("*"), F.sum("length")).first()
        state = {"fields": named, "parts": max(1, n // PART_RECORDS), "segments": [{"name": "first", "records": n, "length": total or 0}], "dead": None, "dead_records": 0, "dead_length": 0}
        shared.release(spark)
        cls._write_segment(records, key, named, state["parts"], f"{path}/first", n)
        shared.release(spark)
        generations.Generations(spark, f"{path}/generations").publish(0, state)
        return cls(spark, path, key)

    @staticmethod
    def _length(fields: list) -> Column:
        return sum((F.size(F.coalesce(text.lower_words(f), F.array())) for f, _ in fields), F.lit(0)).cast("long")

    @staticmethod
    def _write_segment(records: DataFrame, key: str, fields: list, parts: int, path: str, n: int) -> None:
        weights = np.array([w for _, w in fields], np.float64)
        k = F.col(key).cast("long")
        taken = records.select(F.pmod(F.xxhash64(k), F.lit(parts)).cast("int").alias("part"), k.alias("key"), *(F.col(f).alias(f"w{i}") for i, (f, _) in enumerate(fields))).where("key is not null")
        cores = records.sparkSession.sparkContext.defaultParallelism
        if (tasks := Index._tasks(parts, n)) >= cores:
            # a part's texts go to one task, which inverts them and puts its blocks in order: no block is shuffled
            taken = taken.repartitionById(tasks, "part")
        elif parts > 1:
            split = -(-2 * cores // parts)
            taken = taken.repartition(parts * split, "part", F.pmod(F.hash("key"), F.lit(split)))
        taken = taken.select("part", "key", *(text.lower_words(f"w{i}").alias(f"w{i}") for i in range(len(fields))))
        small = taken.mapInArrow(blocks.invert(len(fields), weights), blocks.SCHEMA)
        if tasks < cores:
            # few parts: blocks are merged where they are made, and dealt out by their terms as well
            small = Index._in_order(small, len(fields), weights).repartition(min(cores, max(4, n // 1000)), "part", "term")
        Index._write_blocks(small, len(fields), weights, path)

    @staticmethod
    def _tasks(parts: int, n: int) -> int:
        """Tasks that n records of so many parts are written by."""
        return max(1, min(parts, n // 500))

    @staticmethod
    def _in_order(small: DataFrame, fields: int, weights: np.ndarray) -> DataFrame:
        return small.sortWithinPartitions("part", "term", "low").mapInArrow(blocks.merge(fields, weights), blocks.SCHEMA)

    @staticmethod
    def _write_blocks(small: DataFrame, fields: int, weights: np.ndarray, path: str) -> None:
        """Blocks, of which a part and term's are in one partition, as a segment's: merged and sorted by part and term, and a table of which file holds which parts."""
        out = Index._in_order(small, fields, weights)
        out.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/blocks")
        name = F.element_at(F.split(F.input_file_name(), "/"), -1)
        out.sparkSession.read.schema(blocks.SCHEMA).parquet(f"{path}/blocks").select("part", name.alias("file")).distinct().coalesce(1).write.parquet(f"{path}/files")

    @classmethod
    def stored(cls, scan: DataFrame, records: DataFrame, key: str, fields: dict[str, float], name: str) -> Index:
        """The index of records made from the files of ``scan``, built if those files have none of that name and definition yet."""
        return cls(scan.sparkSession, shared.built(scan, cls._name(key, fields, name), lambda path: cls.build(records, key, fields, path)), key)

    @classmethod
    def found(cls, scan: DataFrame, key: str, fields: dict[str, float], name: str) -> Index | None:
        """The index that ``stored`` has built of these files, if it has."""
        path = shared.found(scan, cls._name(key, fields, name))
        return path and cls(scan.sparkSession, path, key)

    @staticmethod
    def _name(key: str, fields: dict[str, float], name: str) -> str:
        return f"{name}-{hashlib.sha256(json.dumps([FORMAT, key, list(fields.items()), text.WORD_GAP]).encode()).hexdigest()[:12]}"

    def copy(self, path: str) -> Index:
        """The same index under another path, to be updated apart: this generation's files are read from where they are."""
        state = self.state | {"segments": [s | {"at": s.get("at", f"{self.path}/{s['name']}")} for s in self.state["segments"]]}
        generations.Generations(self.spark, f"{path}/generations").publish(0, state)
        return Index(self.spark, path, self.key)

    def update(self, gone: DataFrame, records: DataFrame) -> Index:
        """The next generation: without the records whose keys ``gone`` or ``records`` hold, and with records.

        Raises ConflictError, and changes nothing, if another update of this generation was published first.
        """
        name = f"segment-{uuid.uuid4().hex[:12]}"
        at = f"{self.path}/{name}"
        lengths = records.select(F.col(self.key).cast("long").alias("key"), self._length(self.fields).alias("length")).where("key is not null")
        lengths.write.parquet(f"{at}/lengths")
        lengths = self.spark.read.parquet(f"{at}/lengths")
        n, total = lengths.agg(F.count("*"), F.sum("length")).first()
        state = dict(self.state)
        leaving = gone.select(F.col(self.key).cast("long").alias("key")).unionByName(lengths.select("key")).distinct()
        dead_at = f"{at}/dead"
        dead = self._live_lengths().join(leaving, "key", "left_semi")
        (dead.unionByName(self._dead()) if self.state["dead"] else dead).write.parquet(dead_at)
        m, lost = self.spark.read.parquet(dead_at).agg(F.count("*"), F.sum("length")).first()
        state |= {"dead": dead_at if m else None, "dead_records": m, "dead_length": lost or 0}
        if n:
            self._write_segment(records, self.key, self.fields, self.state["parts"], at, n)
            state["segments"] = [*state["segments"], {"name": name, "records": n, "length": total or 0}]
        try:
            self.log.publish(self.generation, state)
        except generations.ConflictError as e:
            shared.drop(self.spark, at)
            raise ConflictError(str(e)) from e
        new = Index(self.spark, self.path, self.key)
        return new.merged() if new._tier() else new

    def _tier(self) -> list[dict]:
        """Segments to merge: TIER of like size, or all that are mostly dead."""
        by: dict[int, list[dict]] = {}
        for s in self.state["segments"]:
            by.setdefault(int(np.log(max(s["records"], 1)) / np.log(TIER)), []).append(s)
        return next((s for _, s in sorted(by.items()) if len(s) >= TIER), [] if 2 * self.state["dead_records"] <= sum(s["records"] for s in self.state["segments"]) else self.state["segments"])

    def merged(self, segments: list[str] | None = None) -> Index:
        """The next generation with these segments, or a tier's, made one, without what of them is dead."""
        names = {s["name"] for s in self._tier()} if segments is None else {*segments}
        if not names:
            return self
        name = f"segment-{uuid.uuid4().hex[:12]}"
        at = f"{self.path}/{name}"
        lengths = self._live_lengths().where(F.col("segment").isin(*names)).drop("segment")
        lengths.write.parquet(f"{at}/lengths")
        n, total = self.spark.read.parquet(f"{at}/lengths").agg(F.count("*"), F.sum("length")).first()
        small = self._blocks(names)
        if self.state["dead"]:
            # a part's dead keys are fewer than its records
            part = F.pmod(F.xxhash64("key"), F.lit(self.state["parts"])).cast("int")
            dead = self._dead().groupBy("segment", part.alias("part")).agg(F.collect_list("key").alias("dead"))
            small = small.join(dead, ["segment", "part"], "left")
        small = small.drop("segment").repartitionById(self._tasks(self.state["parts"], n), "part")
        self._write_blocks(small, len(self.fields), self.weights, at)
        state = dict(self.state)
        state["segments"] = [*(s for s in state["segments"] if s["name"] not in names), {"name": name, "records": n, "length": total or 0}]
        rest = self._dead().where(~F.col("segment").isin(*names)) if self.state["dead"] else None
        if rest is not None:
            rest.write.parquet(f"{at}/dead")
            m, lost = self.spark.read.parquet(f"{at}/dead").agg(F.count("*"), F.sum("length")).first()
            state |= {"dead": f"{at}/dead" if m else None, "dead_records": m, "dead_length": lost or 0}
        self.log.publish(self.generation, state)
        return Index(self.spark, self.path, self.key)

    # ---- what is stored ----

    def _at(self, segment: dict) -> str:
        return segment.get("at", f"{self.path}/{segment['name']}")

    def _each(self, table: str, names: set[str] | None = None) -> DataFrame:
        found = [self.spark.read.parquet(f"{self._at(s)}/{table}").withColumn("segment", F.lit(s["name"])) for s in self.state["segments"] if names is None or s["name"] in names]
        return reduce(DataFrame.unionByName, found)

    def _blocks(self, names: set[str] | None = None) -> DataFrame:
        return self._each("blocks", names)

    def _dead(self) -> DataFrame:
        """(key, length, segment) of the records that are gone, by the segment that still holds them."""
        return self.spark.read.parquet(self.state["dead"])

    def _live_lengths(self) -> DataFrame:
        rows = self._each("lengths")
        return rows.join(self._dead().select("segment", "key"), ["segment", "key"], "left_anti").select("key", "length", "segment") if self.state["dead"] else rows.select("key", "length", "segment")

    @property
    def lengths(self) -> DataFrame:
        """(key, length) of every record."""
        return self._live_lengths().select(F.col("key").alias(self.key), "length")

    @property
    def measured(self) -> tuple[int, float]:
        """(number of records, their mean length)"""
        n = sum(s["records"] for s in self.state["segments"]) - self.state["dead_records"]
        return n, (sum(s["length"] for s in self.state["segments"]) - self.state["dead_length"]) / max(n, 1)

    def posted(self, terms: Callable[[DataFrame], DataFrame] = lambda b: b) -> DataFrame:
        """(term, key, length, f) of the live postings; ``terms`` filters the blocks before any is opened."""
        b = terms(self._blocks()).select("term", "low", "n", "keys", "sizes", "counts", *(["segment"] if self.state["dead"] else []))
        rows = b.mapInArrow(blocks.rows(self.weights), "term string, key long, length long, f double" + (", segment string" if self.state["dead"] else ""))
        if self.state["dead"]:
            rows = rows.join(self._dead().select("segment", "key"), ["segment", "key"], "left_anti").drop("segment")
        return rows.withColumnRenamed("key", self.key)

    @property
    def postings(self) -> DataFrame:
        return self.posted()

    def terms(self, asked: Callable[[DataFrame], DataFrame] = lambda b: b) -> DataFrame:
        """(term, n, first): of each term the number of records that hold it and the smallest key; without tombstones by the blocks' own columns, none opened."""
        if self.state["dead"]:
            return self.posted(asked).groupBy("term").agg(F.count("*").alias("n"), F.min(self.key).alias("first"))
        return asked(self._blocks().select("term", "n", "low")).groupBy("term").agg(F.sum("n").alias("n"), F.min("low").alias("first"))

    # ---- queries ----

    @staticmethod
    def _only(asked: DataFrame) -> Callable[[DataFrame], DataFrame]:
        """A filter of blocks to the terms of asked(term): few by a predicate that the scan skips files by, more by a join."""
        few = [r["term"] for r in asked.select("term").distinct().limit(FEW_TERMS + 1).collect()]
        if len(few) <= FEW_TERMS:
            return lambda b: b.where(F.col("term").isin(few))
        return lambda b: b.join(asked.select("term").distinct(), "term", "left_semi")

    def _files(self) -> dict[int, list[tuple[str, str]]]:
        """The (segment, file) pairs that hold a part's blocks."""
        out: dict[int, list[tuple[str, str]]] = {}
        for s in self.state["segments"]:
            for r in self.spark.read.schema("part int, file string").parquet(f"{self._at(s)}/files").collect():
                out.setdefault(r["part"], []).append((s["name"], f"{self._at(s)}/blocks/{r['file']}"))
        return out

    def _in_parts(self, asked: DataFrame, places: bool, run: Callable[[blocks.Shard, list[dict]], list[tuple[object, dict[str, np.ndarray]]]], out: str, among: DataFrame | None = None, most: int | None = None) -> DataFrame:
        """What ``run`` makes of each part's blocks of the asked terms and the queries' rows asked(query_id, term, ...), QUERIES queries at a time: (query_id, other columns of one length) each; columns of ``out`` that it leaves out are null.

        A task has a part and reads its blocks of the asked terms from their files, so none is shuffled; where queries leave few rows (``most`` each) once for GROUPS times as many queries.
        With ``among``, a table of keys, only those records are there; they go to their parts.
        """
        queries, cores = asked.select("query_id").distinct().count(), self.spark.sparkContext.defaultParallelism
        held_at_once = QUERIES * (1 if most is None else max(1, min(GROUPS, PART_RECORDS // max(most, 1))))
        # few parts' work is dealt out over the cores by the queries
        batches = max(1, -(-queries // held_at_once), min(queries // LEAST_QUERIES, -(-cores // self.state["parts"])))
        asked = asked.withColumn("batch", F.pmod(F.xxhash64("query_id"), F.lit(batches)).cast("int"))
        wanted = ["term", "low", "high", "n", "most", "least", "keys", "sizes", "counts", *(["places"] if places else [])]
        every = F.explode(F.sequence(F.lit(0), F.lit(self.state["parts"] - 1)))
        nothing = {c: F.lit(None).cast(t) for c, t in asked.dtypes if c != "batch"}
        right = asked.select(every.alias("part"), "batch", *nothing, F.lit(None).cast("string").alias("segment"), F.lit(None).cast("array<long>").alias("dead"), F.lit(None).cast("array<long>").alias("among"))
        part = F.pmod(F.xxhash64("key"), F.lit(self.state["parts"])).cast("int").alias("part")
        # to every batch of its part, which has PART_RECORDS records and not much over
        each = lambda rows, *columns: rows.select("part", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"), *(c.alias(n) for n, c in nothing.items()), *columns)
        if self.state["dead"]:
            gone = self._dead().groupBy(part, "segment").agg(F.sort_array(F.collect_list("key")).alias("dead"))
            right = right.unionByName(each(gone, "segment", "dead"), allowMissingColumns=True)
        if among is not None:
            kept = among.select(F.col(self.key).cast("long").alias("key")).groupBy(part).agg(F.collect_set("key").alias("among"))
            right = right.unionByName(each(kept, "among"), allowMissingColumns=True)
        weights, names, schema, some = self.weights, [*nothing], out, among is not None

        files = self._files()

        def meet(key: tuple, rows: pa.Table) -> pa.Table:
            part = key[0].as_py()
            told = pc.or_(pc.is_valid(rows.column("dead")), pc.is_valid(rows.column("among")))
            about = rows.filter(told).select(["segment", "dead", "among"]).to_pylist()
            rows = rows.filter(pc.invert(told)).select(names).sort_by("query_id")
            held = blocks.read(files.get(part, []), part, rows.column("term"), wanted, bool(about))
            if not held.num_rows or not rows.num_rows:
                return pa.Table.from_pylist([], arrow)
            dead = {r["segment"]: np.array(r["dead"], np.int64) for r in about if r["dead"] is not None}
            live = [k for r in about for k in r["among"] or ()]
            shard = blocks.Shard(held, weights, dead, np.array(live, np.int64) if some else None)
            made = [m for some_rows in blocks.by_queries(rows, QUERIES) for m in run(shard, some_rows.to_pylist())]
            size = [len(next(iter(c.values()))) for _, c in made]
            queries = pa.array([q for q, _ in made], arrow.field("query_id").type).take(pa.array(np.repeat(np.arange(len(made)), size)))
            # one chunk of a query's rows after another
            columns = [pa.chunked_array([pa.array(c[f.name], f.type) if f.name in c else pa.nulls(n, f.type) for (_, c), n in zip(made, size, strict=True)], f.type) for f in arrow if f.name != "query_id"]
            return pa.Table.from_arrays([queries, *columns], schema=arrow)

        arrow = to_arrow_schema(StructType.fromDDL(schema))
        return right.groupBy("part", "batch").applyInArrow(meet, schema)

    def _idf(self, n: Column, total: float) -> Column:
        raw = F.log((total - n + 0.5) / (n + 0.5))
        return F.when(raw > 0, raw).otherwise(1e-6)

    def scored(self, queries: DataFrame, k: int | None, among: DataFrame | None = None) -> DataFrame:
        """(query_id, key, score, blocks, opened): of each part the best records by MaxScore; and for each query and part a row without a key that says of how many blocks so many were opened."""
        asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
        only = self._only(asked)
        if among is None:
            (total, mean), terms = self.measured, self.terms(only)
        else:
            among = shared.written(among.select(self.key).where(F.col(self.key).isNotNull()).distinct(), "among")
            total, mean = self.lengths.join(among, self.key, "left_semi").agg(F.count("*").cast("double"), F.coalesce(F.avg("length"), F.lit(1.0))).first()
            terms = self._held(asked, among)
        asked = asked.join(terms, "term").select("query_id", "term", self._idf(F.col("n"), total).alias("idf"))
        gain = _gain(mean)

        def run(shard: blocks.Shard, rows: list[dict]) -> list[tuple[object, dict[str, np.ndarray]]]:
            out, by = [], {}
            for r in rows:
                by.setdefault(r["query_id"], []).append((r["term"], r["idf"]))
            for query, terms in by.items():
                keys, scores, n, opened = blocks.best(shard, terms, k, gain)
                out.append((query, {"blocks": np.array([n]), "opened": np.array([opened])}))
                out.append((query, {"key": keys, "score": scores}))
            return out

        kind = queries.schema["query_id"].dataType.simpleString()
        return self._in_parts(asked, False, run, f"query_id {kind}, key long, score double, blocks long, opened long", among, k)

    def _held(self, asked: DataFrame, among: DataFrame) -> DataFrame:
        """(term, n): how many of the records ``among`` hold a term; counted where their blocks are."""

        def run(shard: blocks.Shard, rows: list[dict]) -> list[tuple[object, dict[str, np.ndarray]]]:
            met = [(t, len(shard.open(shard.terms[t])[0])) for t in (r["term"] for r in rows) if t in shard.terms]
            return [(0, {"term": [t for t, _ in met], "n": np.array([n for _, n in met], np.int64)})]

        found = self._in_parts(asked.select(F.lit(0).alias("query_id"), "term").distinct(), False, run, "query_id int, term string, n long", among)
        return found.where("n > 0").groupBy("term").agg(F.sum("n").alias("n"))

    def search(self, queries: DataFrame, k: int | None, among: DataFrame | None = None) -> DataFrame:
        """(query_id, key, score, rank): queries(query_id, terms) ranked by weighted BM25; ties by key; the best k of each, or all.

        With ``among``, a table of keys, only those records are there: for the ranking, the frequencies and the mean length.
        """
        found = self.scored(queries, k, among).where("key is not null").select("query_id", F.col("key").alias(self.key), F.round("score", 6).alias("score"))
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), self.key)).cast("long"))
        return ranked if k is None else ranked.where(F.col("rank") <= k)

    def best_matches(self, matching: DataFrame, queries: DataFrame, k: int, phrase: bool = False) -> DataFrame:
        """(query_id, key, score): of the records that match the best k of each part, by weighted BM25 for queries(query_id, terms), ties by key.

        matching(query_id, term, slot, need): a record matches that holds terms of ``need`` slots; of a phrase all words, one after another in the order of slots.
        Matching and scoring are done where the blocks are, so that what leaves a part is no more than k records a query, however many match.
        """
        words = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term")).join(matching.select("query_id").distinct(), "query_id", "left_semi")
        only = self._only(matching.select("term").unionByName(words.select("term")))
        total, mean = self.measured
        scoring = words.join(self.terms(only), "term").select("query_id", "term", self._idf(F.col("n"), total).alias("idf"))
        asked = matching.select("query_id", "term", F.col("slot").cast("int").alias("slot"), F.col("need").cast("int").alias("need")).unionByName(scoring, allowMissingColumns=True)
        gain = _gain(mean)

        def run(shard: blocks.Shard, rows: list[dict]) -> list[tuple[object, dict[str, np.ndarray]]]:
            by: dict = {}
            for r in rows:
                by.setdefault(r["query_id"], ([], []))[r["idf"] is not None].append(r)
            held: dict[str, np.ndarray] = {}

            def keys_of(term: str) -> np.ndarray:
                if term not in held:
                    held[term] = shard.open(shard.terms[term])[0] if term in shard.terms else np.zeros(0, np.int64)
                return held[term]

            out = []
            for query, (wanted, terms) in by.items():
                if not wanted:
                    continue
                slots: dict[int, list[str]] = {}
                for r in wanted:
                    slots.setdefault(r["slot"], []).append(r["term"])
                if phrase:
                    keys = blocks.phrase(shard, [slots[i][0] for i in sorted(slots)])
                else:
                    each = [keys_of(t[0]) if len(t) == 1 else np.concatenate([keys_of(x) for x in t]) for t in slots.values()]
                    keys, n = np.unique(np.concatenate([np.unique(x) for x in each]), return_counts=True)
                    keys = keys[n >= wanted[0]["need"]]
                if len(keys):
                    keys, scores = blocks.first(keys, blocks.scores_of(shard, keys, [(r["term"], r["idf"]) for r in terms], gain), k)
                    out.append((query, {"key": keys, "score": scores}))
            return out

        kind = queries.schema["query_id"].dataType.simpleString()
        return self._in_parts(asked, phrase, run, f"query_id {kind}, key long, score double", most=k).withColumnRenamed("key", self.key)

    def matched(self, queries: DataFrame) -> DataFrame:
        """(query_id, key, matched, wanted): how many of a query's terms a record holds; no record is read."""
        asked = queries.select("query_id", F.size(F.array_distinct("terms")).cast("long").alias("wanted"), F.explode(F.array_distinct("terms")).alias("term"))
        held = self.posted(self._only(asked)).select("term", self.key)
        return held.join(asked, "term").groupBy("query_id", self.key, "wanted").agg(F.count("*").alias("matched"))

    def phrases(self, phrases: DataFrame) -> DataFrame:
        """(query_id, key): records whose first field holds all the words of phrases(query_id, words) one after another; no record is read."""
        asked = phrases.where(F.size("words") > 0).select("query_id", F.posexplode("words").alias("offset", "term"))

        def run(shard: blocks.Shard, rows: list[dict]) -> list[tuple[object, dict[str, np.ndarray]]]:
            by: dict = {}
            for r in rows:
                by.setdefault(r["query_id"], []).append((r["offset"], r["term"]))
            return [(q, {"key": blocks.phrase(shard, [t for _, t in sorted(w)])}) for q, w in by.items()]

        kind = phrases.schema["query_id"].dataType.simpleString()
        return self._in_parts(asked, True, run, f"query_id {kind}, key long").withColumnRenamed("key", self.key)

    def expanded(self, queries: DataFrame, least: int = 4) -> DataFrame:
        """(query_id, wanted, asked, term): the index's terms that begin with a query's term of ``least`` letters and more, or are one that is shorter."""
        asked = queries.select("query_id", F.size(F.array_distinct("terms")).alias("wanted"), F.explode(F.array_distinct("terms")).alias("asked")).withColumn("head", F.substring("asked", 1, least))
        names = self._blocks().select("term").distinct().withColumn("head", F.substring("term", 1, least))
        same = F.when(F.length("asked") >= least, F.startswith("term", F.col("asked"))).otherwise(F.col("term") == F.col("asked"))
        return shared.written(asked.join(names, "head").where(same).select("query_id", "wanted", "asked", "term"), "prefixes")

    def prefixes(self, queries: DataFrame, least: int = 4) -> DataFrame:
        """(query_id, key): records that hold every term, those of ``least`` letters and more as prefixes; terms are expanded by the index's own, joined on their first letters."""
        meant = self.expanded(queries, least)
        hits = self.posted(self._only(meant)).select("term", self.key).join(meant, "term").select("query_id", self.key, "wanted", "asked").distinct()
        return hits.groupBy("query_id", self.key, "wanted").count().where("count = wanted").select("query_id", self.key)


def matched_terms(records: DataFrame, key: str, field: str, queries: DataFrame) -> DataFrame:
    """(query_id, key, matched, wanted): how many of a query's terms a record holds."""
    asked = queries.select("query_id", F.size(F.array_distinct("terms")).cast("long").alias("wanted"), F.explode(F.array_distinct("terms")).alias("term"))
    held = records.select(key, F.explode(F.array_distinct(text.lower_words(field))).alias("term"))
    return held.join(asked, "term").groupBy("query_id", key, "wanted").agg(F.count("*").alias("matched"))


def phrase_hits(records: DataFrame, key: str, field: str, phrases: DataFrame) -> DataFrame:
    """(query_id, key): records that hold all the words of phrases(query_id, words) one after another.

    Each phrase is looked for from its rarest word alone: that word's postings, shifted by its place in the phrase, are the candidates,
    and the words from there on are compared.
    """
    asked = phrases.where(F.size("words") > 0).select("query_id", F.posexplode("words").alias("offset", "term"))
    posted = records.select(key, text.lower_words(field).alias("w")).select(key, F.posexplode("w").alias("at", "term"))
    frequency = posted.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    anchors = asked.join(frequency, "term").groupBy("query_id").agg(F.min(F.struct("n", "offset", "term")).alias("a")).select("query_id", "a.offset", "a.term")
    starts = posted.join(anchors, "term").select("query_id", key, (F.col("at") - F.col("offset")).alias("start")).where("start >= 0")
    bodies = records.select(key, text.lower_words(field).alias("w"))
    met = starts.join(bodies, key).join(phrases, "query_id").where(F.slice("w", F.col("start") + 1, F.size("words")) == F.col("words"))
    return met.select("query_id", key).distinct()


def prefix_hits(records: DataFrame, key: str, field: str, queries: DataFrame, least: int = 4) -> DataFrame:
    """(query_id, key): records that hold every term, those of ``least`` letters and more as prefixes; joined on the first ``least`` letters."""
    asked = queries.select("query_id", F.size(F.array_distinct("terms")).alias("wanted"), F.explode(F.array_distinct("terms")).alias("term")).withColumn("head", F.substring("term", 1, least))
    held = records.select(key, F.explode(F.array_distinct(text.lower_words(field))).alias("word")).withColumn("head", F.substring("word", 1, least))
    same = F.when(F.length("term") >= least, F.startswith("word", F.col("term"))).otherwise(F.col("word") == F.col("term"))
    hits = held.join(asked, "head").where(same).select("query_id", key, "wanted", "term").distinct()
    return hits.groupBy("query_id", key, "wanted").count().where("count = wanted").select("query_id", key)


def plan(queries: DataFrame, column: str) -> DataFrame:
    """(query_id, tier, terms, need): the tiers a text is tried by, most precise first; those that repeat an earlier one are left out.

    phrase: all words in order; all: every content term; prefix: the same with prefixes; most: at least half of them, or any if
    that has too many forms; identifiers: any that looks like one.
    """
    w = text.words(column)
    content = F.filter(w, lambda t: ~F.lower(t).isin(text.STOPWORDS))
    q = queries.select("query_id", w.alias("words"), F.when(F.size(content) > 0, content).otherwise(w).alias("content")).where("size(words) > 0")
    n = F.size("content")
    half = F.ceil(n / 2).cast("int")
    # C(n, half) > 20 from n = 7 on
    need = F.when((half == 1) | (n >= 7), 1).otherwise(half)
    names = F.filter("content", text.looks_like_identifier)


    def tier(number: int, name: str, terms: Column, need: Column) -> Column:
        return F.struct(F.lit(number).alias("tier"), F.lit(name).alias("name"), terms.alias("terms"), need.alias("need"))

    tiers = F.filter(
        F.array(
            tier(0, "phrase", F.col("words"), F.size("words")),
            F.when(~((F.size("words") == 1) & (F.col("words") == F.col("content"))), tier(1, "all", F.col("content"), n)),
            F.when((n > 1) & F.exists("content", lambda t: F.length(t) >= 4), tier(2, "prefix", F.col("content"), n)),
            F.when(n > 1, tier(3, "most", F.col("content"), need)),
            F.when((n > 1) & (F.size(names) > 0) & ~((F.size(names) == n) & (need == 1)), tier(4, "identifiers", names, F.lit(1))),
        ),
        lambda t: t.isNotNull(),
    )
    return q.select("query_id", F.explode(tiers).alias("t")).select("query_id", "t.tier", "t.name", "t.terms", "t.need")


def until_enough(hits: DataFrame, limit: int) -> DataFrame:
    """Of hits(query_id, tier, id), whole tiers up to the first that brings a query to ``limit`` distinct ids."""
    first = hits.groupBy("query_id", "id").agg(F.min("tier").alias("tier"))
    reached = first.groupBy("query_id", "tier").agg(F.count("*").alias("new"))
    upto = Window.partitionBy("query_id").orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)
    # tiers without new ids still run as long as there are too few
    tiers = hits.select("query_id", "tier").distinct().join(reached, ["query_id", "tier"], "left").withColumn("before", F.coalesce(F.sum(F.coalesce("new", F.lit(0))).over(upto), F.lit(0)))
    return hits.join(tiers.where(F.col("before") < limit).select("query_id", "tier"), ["query_id", "tier"], "left_semi")


def allowed(path: Column, source: Column, kind: Column, *, sources: list[str] = (), prefixes: list[str] = (), kinds: list[str] = ()) -> Column:
    """Hard filters; they go before any ranking, so a limit only counts rows in scope."""
    ok = F.lit(True)
    if sources:
        ok = ok & source.isin(*sources)
    if kinds:
        ok = ok & kind.isin(*kinds)
    if prefixes:
        clean = F.regexp_replace(path, r"\\", "/")
        some = F.lit(False)
        for p in prefixes:
            some = some | clean.startswith(p.removeprefix("./"))
        ok = ok & some
    return ok


def is_exact_path(path: Column, asked: Column) -> Column:
    """The whole path, its last segments or its name, whatever the case."""
    p = F.lower(F.regexp_replace(path, r"\\", "/"))
    q = F.lower(F.regexp_replace(F.regexp_replace(F.trim(asked), r"\\", "/"), r"^(\./)+", ""))
    return (q != "") & ((p == q) | F.endswith(p, F.concat(F.lit("/"), q)))


def heading_matches(heading: Column, asked: Column) -> Column:
    """The question's words stand in the heading as a run of whole words, or it is the whole heading."""
    pad = lambda c: F.concat(F.lit(" "), F.array_join(text.lower_words(c), " "), F.lit(" "))
    return (F.size(text.words(asked)) > 0) & (F.contains(pad(heading), pad(asked)) | (F.lower(F.trim(heading)) == F.lower(F.trim(asked))))


#: Rows of a block, of which two meet in a task at a time.
PAIR_ROWS = 2000


def equal_pairs(rows: DataFrame, column: str, key: str, other: str) -> DataFrame:
    """(key, other): every two rows(key, column) that are equal in column, the smaller key first.

    Rows that many share are dealt out in blocks, and every two blocks meet by themselves, so that no task has more than PAIR_ROWS squared of a value's pairs.
    """
    shares = rows.groupBy(column).agg(F.count("*").alias("_n")).where("_n > 1").select(column, F.ceil(F.col("_n") / PAIR_ROWS).cast("int").alias("_blocks"))
    dealt = rows.join(shares, column).withColumn("_block", F.pmod(F.hash(key), F.col("_blocks")))
    every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    a = dealt.select(column, key, F.col("_block").alias("_a"), every.alias("_b"))
    b = dealt.select(column, F.col(key).alias(other), every.alias("_a"), F.col("_block").alias("_b"))
    return a.join(b, [column, "_a", "_b"]).where(F.col(key) < F.col(other)).select(key, other)


def symbol_hits(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """(question_id, id, tier): exact name 0, qualified name 1, alias 2 - the alias only for questions of two segments, whatever the case."""
    name = asked.join(entities, asked.question == entities.name).select("question_id", "id", F.lit(0).alias("tier"))
    qualified = asked.join(entities, asked.question == entities.qualified_name).select("question_id", "id", F.lit(1).alias("tier"))
    two = asked.where(F.size(F.split("question", r"\.")) == 2).withColumn("a", F.lower("question"))
    alias = two.join(entities.withColumn("a", F.lower(text.alias_name("qualified_name"))), "a").select("question_id", "id", F.lit(2).alias("tier"))
    return name.unionByName(qualified).unionByName(alias).groupBy("question_id", "id").agg(F.min("tier").alias("tier"))
