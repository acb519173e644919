"""Symbols and their references: resolution, traversal, impact; all as joins."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions import files, ids, text
from . import patterns, postings

REFERENCE_TYPES = ("calls", "imports", "references")


def resolve(references: DataFrame, entities: DataFrame, words: bool = False) -> DataFrame:
    """(file_id, reference_text, target_id, symbol, resolver, confidence, ambiguous) of references(file_id, reference_text) against entities(id, name, qualified_name, file_id, start_line).

    In order: the one entity of the same file with that qualified name; those of the same file with that
    name; the first elsewhere with that qualified name (by file and line); the first elsewhere with its last segment as name (by qualified name and
    file); else unresolved.  Candidates are put together from the entities alone, a row a name, with the first of two files, of which one at least is elsewhere: so
    references are joined with single rows, however many entities have a name.  ``words`` says that the references are distinct and hold no dots.
    """
    key = ["file_id", "reference_text"]
    r = references.select(*key) if words else references.select(*key).distinct()
    e = entities.select(F.col("id").alias("target_id"), "name", "qualified_name", F.col("file_id").alias("owner"), "start_line")
    both = e.select(F.col("owner").alias("file_id"), F.col("qualified_name").alias("reference_text"), F.lit(True).alias("whole"), "qualified_name", "target_id")
    both = both.unionByName(e.select(F.col("owner").alias("file_id"), F.col("name").alias("reference_text"), F.lit(False).alias("whole"), "qualified_name", "target_id"))
    own = both.groupBy(*key).agg(
        F.count_if("whole").alias("n_qualified"),
        F.min(F.when(F.col("whole"), F.col("target_id"))).alias("own_qualified"),
        F.count_if(~F.col("whole")).alias("n_name"),
        F.min(F.when(~F.col("whole"), F.struct("qualified_name", "target_id")))["target_id"].alias("own_name"),
    )

    def firsts(column: str, name: str, *order: str) -> DataFrame:
        """The first entity of a name, the first of another file, and how many there are."""
        held = e.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key"), "owner").agg(F.min(F.struct(*order, "target_id")).alias("m"), F.count("*").alias("c"))
        w = Window.partitionBy("key")
        few = held.select("key", "owner", "m.target_id", F.row_number().over(w.orderBy("m")).alias("n"), F.sum("c").over(w).alias("all")).where("n <= 2")
        place = lambda n: F.max(F.when(F.col("n") == n, F.struct("owner", "target_id")))
        return few.groupBy("key").agg(place(1).alias(f"{name}_first"), place(2).alias(f"{name}_second"), F.max("all").alias(f"{name}_all"))

    whole, last = firsts("qualified_name", "whole", "owner", "start_line"), firsts("name", "last", "qualified_name", "owner")
    if words:
        # references and the candidates of their own files are put together by name, once; what follows needs no further shuffle
        every = r.select(*key, F.lit(True).alias("_asked")).unionByName(own.withColumn("_asked", F.lit(None).cast("boolean")), allowMissingColumns=True)
        found = _put_together(every, ["_asked", *(c for c in own.columns if c not in key)]).where("_asked").drop("_asked")
    else:
        found = r.join(own.hint("shuffle_hash"), key, "left")
    dotted = F.coalesce(F.contains("reference_text", F.lit(".")), F.lit(False))
    # a row a name of both, put together so that Spark knows it to be one, and leaves out what nothing is read of
    both = whole.unionByName(last, allowMissingColumns=True)
    table = both.groupBy(F.col("key").alias("reference_text")).agg(*(F.max(c).alias(c) for c in both.columns if c != "key"))
    met = (found if words else found.where(~dotted)).join(table, "reference_text", "left").withColumn("bare", F.col("reference_text"))
    if not words:
        more = found.where(dotted).join(whole.withColumnRenamed("key", "reference_text").hint("shuffle_hash"), "reference_text", "left")
        met = met.unionByName(more.withColumn("bare", text.bare_name("reference_text")).join(last.withColumnRenamed("key", "bare").hint("shuffle_hash"), "bare", "left"))

    def elsewhere(name: str) -> Column:
        return F.when(F.col(f"{name}_first.owner") == F.col("file_id"), F.col(f"{name}_second.target_id")).otherwise(F.col(f"{name}_first.target_id"))

    n_other = F.coalesce("whole_all", F.lit(0)) - F.coalesce("n_qualified", F.lit(0))
    step = F.when(F.col("n_qualified") == 1, "same_file_qualified").when(F.col("n_name") == 1, "same_file_name").when(F.col("n_name") > 1, "same_file_name_ambiguous").when(n_other > 1, "cross_file_qualified_ambiguous").when(n_other == 1, "cross_file_qualified").when(elsewhere("last").isNotNull(), "name_only").otherwise("unresolved")
    g = met.select(*key, "bare", step.alias("resolver"), "own_qualified", "own_name", elsewhere("whole").alias("other_qualified"), elsewhere("last").alias("other_name"))
    step = F.col("resolver")
    target = F.when(step == "same_file_qualified", F.col("own_qualified")).when(F.startswith(step, F.lit("same_file_name")), F.col("own_name")).when(F.startswith(step, F.lit("cross")), F.col("other_qualified")).when(step == "name_only", F.col("other_name"))
    confidence = F.when(step.isin("same_file_qualified", "same_file_name"), "exact").when(step.isin("name_only", "unresolved"), "medium").otherwise("high")
    # a word is its own last segment
    symbol = F.col("reference_text") if words else F.when(step == "name_only", F.col("bare")).otherwise(F.col("reference_text"))
    return g.select(*key, target.alias("target_id"), symbol.alias("symbol"), "resolver", confidence.alias("confidence"))


def _put_together(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A row of each (file_id, reference_text), with each column's value where a row has one; dealt out and in the order of reference_text, by which rows are shuffled in lists."""
    return shared.gathered(rows, "reference_text").groupBy("reference_text", "file_id").agg(*(F.max(c).alias(c) for c in columns))


def touched_keys(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key) of the names and qualified names of entities that came, went or moved: what may resolve otherwise now."""
    cols = ["id", "name", "qualified_name", "file_id", "start_line"]
    both = before.select(*cols, F.lit(1).alias("old"), F.lit(0).alias("new")).unionByName(after.select(*cols, F.lit(0).alias("old"), F.lit(1).alias("new")))
    differ = both.groupBy(*cols).agg(F.sum("old").alias("old"), F.sum("new").alias("new")).where("old <> new")
    return differ.select(F.explode(F.array("name", "qualified_name")).alias("key")).distinct()


def resolve_changes(resolved: DataFrame, references: DataFrame, before: DataFrame, after: DataFrame, words: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the resolution of references against the entities ``after``, the references that were resolved again), given the one ``resolved`` against those ``before``.

    Resolved again are only references that weren't there, and those that name a key, or end in one, of which the candidates changed; they meet only candidates of
    their own names.  The others keep what they had, as far as they are still there.  ``words`` as in ``resolve``.
    """
    key = ["file_id", "reference_text"]
    keys = shared.written(touched_keys(before, after), "keys")
    r = references.select(*key) if words else references.select(*key).distinct()
    # as in ``resolve``: a reference is looked for by its whole text and by its last segment
    ends = text.bare_name("reference_text")
    whole = keys.select(F.col("key").alias("reference_text"), F.lit(True).alias("_whole"))
    if words:
        every = r.withColumn("_now", F.lit(True)).unionByName(resolved.withColumn("_was", F.lit(True)), allowMissingColumns=True)
        columns = [c for c in resolved.columns if c not in key]
        told = _put_together(every, ["_now", "_was", *columns]).where("_now").join(whole, "reference_text", "left")
        both = told.select(*key, *columns, F.coalesce(F.coalesce("_whole", F.lit(False)) | F.col("_was").isNull(), F.lit(False)).alias("_again"))
    else:
        told = r.join(whole, "reference_text", "left")
        told = told.withColumn("_bare", ends).join(keys.select(F.col("key").alias("_bare"), F.lit(True).alias("_last")), "_bare", "left").drop("_bare")
        # one meeting of what is there with what was, read for both sides of the result
        both = told.select(*key, F.coalesce("_whole", "_last", F.lit(False)).alias("_touched")).join(resolved.withColumn("_was", F.lit(True)), key, "left")
        both = both.withColumn("_again", F.col("_touched") | F.col("_was").isNull()).drop("_touched", "_was")
    both = shared.written(both, "told")
    shared.release(references.sparkSession)
    again = both.where("_again").select(*key)
    wanted = again.select("reference_text").distinct()
    if not words:
        wanted = wanted.unionByName(wanted.select(ends.alias("reference_text"))).distinct()
    some = after.join(wanted.withColumnRenamed("reference_text", "name"), "name", "left_semi").unionByName(after.join(wanted.withColumnRenamed("reference_text", "qualified_name"), "qualified_name", "left_semi").select(after.columns)).distinct()
    return both.where("not _again").select(resolved.columns).unionByName(resolve(again, some.select(after.columns), words)), again


def hops(edges: DataFrame) -> DataFrame:
    """The ends of the edges as a table of the shared folder, which traversals read at every level."""
    return shared.written(edges.select("source_id", "target_id").where("source_id is not null and target_id is not null"), "hops")


def bfs(edges: DataFrame, starts: DataFrame, depth: int, incoming: bool = False, written: bool = False) -> DataFrame:
    """(start, node, depth): nodes within ``depth`` steps of starts(start), each at its least depth; ``written`` says that edges come from ``hops``.

    One join a level with the frontier, which is anti-joined with what was visited.  Every level is written to the shared folder, so a
    level costs its own join, however many came before it.
    """
    a, b = ("target_id", "source_id") if incoming else ("source_id", "target_id")
    spark = edges.sparkSession
    hop = (edges if written else hops(edges)).select(F.col(a).alias("node"), F.col(b).alias("next"))
    path = shared.folder(spark, "levels")
    first = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct()
    first.write.parquet(f"{path}/0")
    for d in range(1, depth + 1):
        seen = spark.read.schema(first.schema).parquet(*(f"{path}/{k}" for k in range(d)))
        frontier = spark.read.schema(first.schema).parquet(f"{path}/{d - 1}")
        met = frontier.join(hop, "node").select("start", F.col("next").alias("node"), F.lit(d).alias("depth")).distinct()
        met.join(seen.select("start", "node"), ["start", "node"], "left_anti").write.parquet(f"{path}/{d}")
    return spark.read.schema(first.schema).parquet(*(f"{path}/{k}" for k in range(1, depth + 1)))


def walk(edges: DataFrame, starts: DataFrame, depth: int, incoming: bool = False, limit: int | None = None) -> DataFrame:
    """(start, id, depth): the edges met on the way, those to nodes already visited included, by depth, type, end and id; at most ``limit`` a start."""
    a, b = ("target_id", "source_id") if incoming else ("source_id", "target_id")
    reached = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))
    if depth > 1:
        reached = reached.unionByName(bfs(edges, starts, depth - 1, incoming))
    met = reached.join(edges.select("id", "type", F.col(a).alias("node"), F.col(b).alias("end")), "node").select("start", "id", (F.col("depth") + 1).alias("depth"), "type", "end")
    first = met.groupBy("start", "id", "type", "end").agg(F.min("depth").alias("depth"))
    if limit is None:
        return first.select("start", "id", "depth")
    return first.withColumn("n", F.row_number().over(Window.partitionBy("start").orderBy("depth", "type", "end", "id"))).where(F.col("n") <= limit).select("start", "id", "depth")


def capped_edges(edges: DataFrame, node: str, cap: int) -> DataFrame:
    """At most ``cap`` edges of each node, the first by id, then in the order edges are shown: type, target, id."""
    kept = edges.withColumn("k", F.row_number().over(Window.partitionBy(node).orderBy("id"))).where(F.col("k") <= cap)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(node).orderBy("type", F.coalesce("target_id", F.lit("")), "id")).cast("long")).drop("k")


def impact(edges: DataFrame, symbols: DataFrame, links: DataFrame, paths: DataFrame, depth: int = 2) -> DataFrame:
    """(start, callers, callees, tests, documents, score, radius) of symbols(start): who depends on it, what it depends on, callers in test files, linked documents."""
    edges = hops(edges)
    back = bfs(edges, symbols, depth, incoming=True, written=True).join(paths.select(F.col("id").alias("node"), "path"), "node", "left")
    up = back.groupBy("start").agg(F.count("*").alias("callers"), F.count_if(files.is_test(F.coalesce("path", F.lit("")))).alias("tests"))
    down = bfs(edges, symbols, depth, written=True).groupBy("start").agg(F.count("*").alias("callees"))
    docs = links.select(F.col("entity_id").alias("start"), "document_id").distinct().groupBy("start").agg(F.count("*").alias("documents"))
    out = symbols.select("start").distinct().join(up, "start", "left").join(down, "start", "left").join(docs, "start", "left").fillna(0)
    score = F.col("callers") + F.col("documents")
    return out.select("start", "callers", "callees", "tests", "documents", score.alias("score"), radius(score).alias("radius"))


def radius(score: Column) -> Column:
    return F.when(score <= 2, "LOW").when(score <= 7, "MEDIUM").otherwise("HIGH")


def relationships(defined: DataFrame, resolved: DataFrame) -> DataFrame:
    """(id, source_id, target_id, symbol, type, confidence): containment of entities in their files, and references from file to entity, with running ordinals in their ids."""
    inside = defined.select(F.col("file_id").cast("string").alias("source_id"), F.col("id").alias("target_id"), F.col("qualified_name").alias("symbol"), F.lit("contains").alias("type"), F.lit("exact").alias("confidence"))
    refs = resolved.select(F.col("file_id").cast("string").alias("source_id"), "target_id", "symbol", F.lit("references").alias("type"), "confidence")
    every = inside.unionByName(refs).withColumn("key", F.coalesce("target_id", "symbol"))
    n = every.withColumn("ordinal", F.row_number().over(Window.partitionBy("source_id", "type", "key").orderBy("symbol")) - 1)
    return n.select(ids.relationship_id(F.col("source_id"), F.col("type"), F.col("key"), F.col("ordinal")).alias("id"), "source_id", "target_id", "symbol", "type", "confidence")


def mentions(entities: DataFrame, units: DataFrame, needle: Column, resolver: str, confidence: str, kind: str, most: int | None = 5) -> DataFrame:
    """(entity_id, document_id, ordinal, resolver, confidence, type, position): units(document_id, ordinal, body) that mention an entity by ``needle``, and which of its document's these are.

    Each (entity, document) keeps its first ``most`` units.  The units' identifiers are shuffled once, a batch's places of one in lists; entities of one needle, as nearly all are,
    have their units put in order where they meet them.
    """
    wanted = entities.select(F.col("id").alias("entity_id"), needle.alias("needle")).where("needle is not null and needle <> ''").distinct()
    wanted = shared.written(wanted.select("entity_id", _checked().alias("needle")), "needles")
    met = shared.gathered(_identifiers(units), "needle").join(wanted, "needle")
    several = wanted.groupBy("entity_id").agg(F.count("*").alias("_n")).where("_n > 1").select("entity_id")
    told = [F.lit(resolver).alias("resolver"), F.lit(confidence).alias("confidence"), F.lit(kind).alias("type")]
    if not several.isEmpty():
        hits = first_units(met.select("entity_id", "document_id", "ordinal", *told), most)
        return hits.withColumn("position", F.row_number().over(Window.partitionBy("entity_id", "document_id").orderBy("ordinal")).cast("long"))
    # dealt out by needle, of which an entity has one
    w = Window.partitionBy("needle", "entity_id", "document_id").orderBy("ordinal")
    seen = met.withColumn("_again", F.coalesce(F.lag("ordinal").over(w) == F.col("ordinal"), F.lit(False))).withColumn("position", F.dense_rank().over(w).cast("long"))
    seen = seen if most is None else seen.where(F.col("position") <= most)
    return seen.where(~F.col("_again")).select("entity_id", "document_id", "ordinal", *told, "position")


def identifier_hits(wanted: DataFrame, units: DataFrame) -> DataFrame:
    """Units that mention wanted(entity_id, needle, resolver, confidence, type), of which the needles are dotted identifiers: an equi-join with the identifiers of the units, which needs no further look at their text."""
    needles = wanted.where("needle is not null and needle <> ''")
    return shared.gathered(_identifiers(units), "needle").join(needles.withColumn("needle", _checked()), "needle").select("entity_id", "document_id", "ordinal", "resolver", "confidence", "type")


def _checked() -> Column:
    """The needle; one of another form would be missed in silence."""
    return F.when(F.get(text.identifiers("needle"), F.lit(0)) == F.col("needle"), F.col("needle")).otherwise(F.raise_error(F.concat(F.lit("no identifier: "), "needle")))


def _identifiers(units: DataFrame) -> DataFrame:
    return units.select("document_id", "ordinal", F.explode(F.array_distinct(text.identifiers("body"))).alias("needle"))


#: Queries of a bitmap; words that are looked up at a time.
BITS, LOOKED_UP = 2000, 40_000
_NONE = -(2**63)


def _bitmaps(path: str, block: int) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block of asked(query_id, name, but): its queries, its names, of each the place and number of its (name, but) pairs, and their ``but`` and bitmap."""
    system, at = fs.FileSystem.from_uri(f"{path}/block={block}")
    tables = []
    for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
        if f.path.endswith(".parquet"):
            with system.open_input_file(f.path) as source:
                tables.append(pq.ParquetFile(source).read(columns=["query_id", "name", "but"]))
    t = pa.concat_tables(tables) if tables else pa.table({"query_id": pa.array([], pa.int64()), "name": pa.array([], pa.string()), "but": pa.array([], pa.int64())})
    queries, of = np.unique(t.column("query_id").to_numpy(), return_inverse=True)
    told = t.column("name").combine_chunks().cast(pa.string()).dictionary_encode()
    pair, which = np.unique(np.stack([told.indices.to_numpy().astype(np.int64), pc.fill_null(t.column("but"), _NONE).to_numpy().astype(np.int64)]), axis=1, return_inverse=True)
    bits = np.zeros((pair.shape[1], max(1, -(-len(queries) // 8))), np.uint8)
    np.bitwise_or.at(bits, (which.reshape(-1), of >> 3), (1 << (of & 7)).astype(np.uint8))
    n = np.bincount(pair[0], minlength=len(told.dictionary))
    return queries, told.dictionary, np.cumsum(n) - n, n, pair[1], bits


def documents_a_query(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, n): how many documents hold a name that a query asks for: texts(document_id, words), of which a document may have several rows, and asked(query_id, name, but), where ``but`` is a document that doesn't count for the name.

    Names go to the tasks through files of the shared folder.  A document's queries are a bitmap, BITS of them at a time, and nothing else of it is shuffled: not its words, nor its pairs with queries.
    """
    spark = texts.sparkSession
    path = shared.folder(spark, "asked")
    count = asked.select("query_id").distinct().count()
    blocks = max(1, -(-count // BITS))
    asked.select(F.col("query_id").cast("long"), "name", F.col("but").cast("long").alias("but"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).repartition("block").write.partitionBy("block").parquet(path)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [_bitmaps(path, k) for k in range(blocks)]
        for b in batches:
            size = pc.fill_null(pc.list_value_length(b.column("words")), 0).to_numpy().astype(np.int64)
            ends, begin = np.cumsum(size), 0
            while begin < b.num_rows:
                # as many rows as have LOOKED_UP words, one at least
                stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + LOOKED_UP, "right")))
                piece = b.slice(begin, stop - begin)
                words, ids = piece.column("words").flatten(), np.repeat(piece.column("document_id").to_numpy(), size[begin:stop])
                begin = stop
                for k, (_, names, start, n, but, bits) in enumerate(tables):
                    code = pc.fill_null(pc.index_in(words, value_set=names), -1).to_numpy()
                    met = code >= 0
                    code, doc = code[met], ids[met]
                    at, doc = postings.ranges(start[code], n[code]), np.repeat(doc, n[code])
                    at, doc = at[but[at] != doc], doc[but[at] != doc]
                    if len(at):
                        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                        found = np.bitwise_or.reduceat(bits[at], first, axis=0)
                        yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array([k] * len(first), pa.int32()), pa.array([x.tobytes() for x in found], pa.binary())], ["document_id", "block", "bits"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [_bitmaps(path, k)[0] for k in range(blocks)]
        n = [np.zeros(len(q), np.int64) for q in queries]
        last, held = None, None
        for b in batches:
            for doc, k, bits in zip(b.column("document_id").to_pylist(), b.column("block").to_pylist(), b.column("bits").to_pylist()):
                bits = np.frombuffer(bits, np.uint8)
                if (doc, k) == last:
                    held = held | bits
                    continue
                if last is not None:
                    n[last[1]] += np.unpackbits(held, bitorder="little")[: len(n[last[1]])]
                last, held = (doc, k), bits
        if last is not None:
            n[last[1]] += np.unpackbits(held, bitorder="little")[: len(n[last[1]])]
        for q, of in zip(queries, n):
            yield pa.RecordBatch.from_arrays([pa.array(q[of > 0], pa.int64()), pa.array(of[of > 0], pa.int64())], ["query_id", "n"])

    bitmaps = texts.select(F.col("document_id").cast("long"), "words").where("document_id is not null").mapInArrow(meet, "document_id long, block int, bits binary")
    told = bitmaps.repartition("document_id").sortWithinPartitions("document_id", "block").mapInArrow(tally, "query_id long, n long")
    return told.groupBy("query_id").agg(F.sum("n").alias("n"))


def first_units(hits: DataFrame, most: int | None) -> DataFrame:
    """Of each (entity, document, resolver) the first ``most`` units."""
    cols = ["entity_id", "document_id", "ordinal", "resolver", "confidence", "type"]
    if most is None:
        return hits.select(cols).distinct()
    w = Window.partitionBy("entity_id", "document_id", "resolver").orderBy("ordinal", "confidence", "type")
    # a unit that several needles of an entity hit is one: equal rows follow one another
    row = F.struct("ordinal", "confidence", "type")
    seen = hits.withColumn("n", F.dense_rank().over(w)).withColumn("again", F.coalesce(F.lag(row).over(w) == row, F.lit(False)))
    return seen.where((F.col("n") <= most) & ~F.col("again")).select(cols)


def route_hits(routes: DataFrame, units: DataFrame) -> DataFrame:
    """Units that mention the path of a route, without a word character after it: routes(id, symbol), with symbols ``http_endpoint:METHOD:path``.

    All paths are looked for at once, wherever they stand (``patterns``).
    """
    r = routes.select(F.col("id").alias("entity_id"), text.route_parts("symbol")["path"].alias("pattern")).where("pattern is not null").distinct()
    hits = patterns.found(r, units.select("document_id", "ordinal", "body"), "body").join(r, "pattern")
    return hits.select("entity_id", "document_id", "ordinal", F.lit("linker:route_heuristic").alias("resolver"), F.lit("heuristic").alias("confidence"), F.lit("related_to").alias("type")).distinct()


def link(entities: DataFrame, units: DataFrame, most: int = 5, namespaces: DataFrame | None = None, routes: DataFrame | None = None) -> DataFrame:
    """Links by bare name, qualified name and alias; by the file name and stem of namespaces(id, path), the files' own entities; by the route path of routes(id, symbol).

    The first four look for identifiers, so the units are taken apart once for all of them.
    """

    def wanted(rows: DataFrame, needle: Column, resolver: str, confidence: str, kind: str) -> DataFrame:
        return rows.select(F.col("id").alias("entity_id"), needle.alias("needle"), F.lit(resolver).alias("resolver"), F.lit(confidence).alias("confidence"), F.lit(kind).alias("type"))

    needles = wanted(entities.where(text.links_by_bare_name("name")), F.col("name"), "linker:exact_identifier", "high", "mentioned_in")
    needles = needles.unionByName(wanted(entities.where(F.contains("qualified_name", F.lit("."))), F.col("qualified_name"), "linker:qualified_identifier", "high", "documented_by"))
    needles = needles.unionByName(wanted(entities, text.alias_name("qualified_name"), "linker:alias", "medium", "mentioned_in"))
    if namespaces is not None:
        files = namespaces.select("id", F.explode(text.file_candidates("path")).alias("file"))
        needles = needles.unionByName(wanted(files, F.col("file"), "linker:filename", "medium", "mentioned_in"))
    needles = needles.where("needle is not null")
    plain = F.equal_null(F.get(text.identifiers("needle"), F.lit(0)), F.col("needle"))
    hits = identifier_hits(needles.where(plain), units).unionByName(_other_hits(needles.where(~plain), units))
    if routes is not None:
        hits = hits.unionByName(route_hits(routes, units))
    return first_units(hits, most)


def _whole_identifier(body: str, begin: int, end: int) -> bool:
    """As ``text.contains_identifier``: no word character or dot before it, nor a word character or a dot and a word character after it."""
    word = lambda i: i < len(body) and (patterns.is_word(body[i]) or unicodedata.category(body[i])[0] == "M")
    return not (begin and (body[begin - 1] == "." or word(begin - 1))) and not word(end) and not (body[end : end + 1] == "." and word(end + 1))


def _other_hits(wanted: DataFrame, units: DataFrame) -> DataFrame:
    """Units that mention needles of other forms, as names with hyphens: all looked for at once (``patterns``), so that no text is shuffled or repeated."""
    needles = wanted.where(F.get(text.identifiers("needle"), F.lit(0)).isNotNull()).withColumnRenamed("needle", "pattern")
    hits = patterns.found(needles, units.select("document_id", "ordinal", "body"), "body", _whole_identifier)
    return hits.join(needles, "pattern").select("entity_id", "document_id", "ordinal", "resolver", "confidence", "type")


def under_roots(paths: DataFrame, path: str, roots: DataFrame) -> DataFrame:
    """paths with ``root``: the longest of roots(root) that a normalised path is or lies under, null without one; an equi-join on the path and the folders above it."""
    row = paths.withColumn("_row", F.monotonically_increasing_id())
    row = shared.written(row, "paths")
    above = row.select("_row", F.explode(files.folders_above(path)).alias("root"))
    near = above.join(roots.select("root").distinct(), "root").groupBy("_row").agg(F.max_by("root", F.length("root")).alias("root"))
    return row.join(near, "_row", "left").drop("_row")


def project_references(references: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, rel_path, reference, target, producer, status) of project files' references(source_id, rel_path, reference) to others, by the folders of sources(source_id, path).

    A reference is relative to its file, with either slash.  ``declares`` one of another source, whose folder is the longest it lies under, is ``inside`` its own, or ``outside`` all.
    """
    own = references.join(sources.select("source_id", F.col("path").alias("home")), "source_id")
    target = files.normalized(F.concat_ws("/", F.col("home"), F.regexp_replace("rel_path", "/?[^/]*$", ""), F.col("reference")))
    roots = sources.select(F.col("source_id").alias("producer"), files.normalized(F.col("path")).alias("root"))
    met = under_roots(own.withColumn("target", target), "target", roots).join(roots, "root", "left")
    status = F.when(F.col("producer").isNull(), "outside").when(F.col("producer") == F.col("source_id"), "inside").otherwise("declares")
    return met.select("source_id", "rel_path", "reference", "target", "producer", status.alias("status"))


def dependents(symbol_refs: DataFrame, changed_keys: DataFrame) -> DataFrame:
    """Files that refer to a changed key."""
    return symbol_refs.join(changed_keys, "key", "left_semi").select("file_id").distinct()


def file_symbols(defined: DataFrame, resolved: DataFrame) -> DataFrame:
    """(file_id, key, defs, refs, fingerprint): a file's symbol keys, how often it defines and uses them, and a digest of its definitions."""
    d = defined.select("file_id", F.explode(ids.symbol_keys(F.col("qualified_name"), F.col("name"))).alias("key"), F.concat_ws("|", "id", "kind", "start_line").alias("row"))
    d = d.groupBy("file_id", "key").agg(F.count("*").alias("defs"), ids.digest(F.col("row")).alias("fingerprint"))
    r = resolved.select("file_id", F.concat(F.lit("n:"), "symbol").alias("key")).groupBy("file_id", "key").agg(F.count("*").alias("refs"))
    return d.join(r, ["file_id", "key"], "full").select("file_id", "key", F.coalesce("defs", F.lit(0)).alias("defs"), F.coalesce("refs", F.lit(0)).alias("refs"), "fingerprint")


def bind_across(references: DataFrame, producers: DataFrame, allowed: DataFrame) -> DataFrame:
    """(source_id, symbol, state, producer_id): unresolved symbols of a source looked up by qualified name in the sources it depends on: bound if one has it, ambiguous if several."""
    scoped = references.join(allowed, "source_id").join(producers.select(F.col("source_id").alias("producer_source"), F.col("qualified_name").alias("symbol"), F.col("id").alias("producer_id")), ["producer_source", "symbol"])
    hits = scoped.groupBy("source_id", "symbol").agg(F.count("*").alias("n"), F.min("producer_id").alias("first"))
    return references.select("source_id", "symbol").distinct().join(hits, ["source_id", "symbol"], "left").select("source_id", "symbol", F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "single").otherwise("ambiguous").alias("state"), F.when(F.col("n") == 1, F.col("first")).alias("producer_id"))


def manual(links: DataFrame, entities: DataFrame, documents: DataFrame) -> DataFrame:
    """(entity_id, document_id, note) of links(entity_name, title, note) whose name and title each name exactly one row."""
    e = entities.groupBy(F.col("qualified_name").alias("entity_name")).agg(F.count("*").alias("n"), F.min("id").alias("entity_id")).where("n = 1").drop("n")
    d = documents.groupBy("title").agg(F.count("*").alias("n"), F.min("document_id").alias("document_id")).where("n = 1").drop("n")
    return links.join(e, "entity_name").join(d, "title").select("entity_id", "document_id", "note")


# The order in which confidences and the linker's resolvers count.
CONFIDENCES = ["exact", "high", "medium", "heuristic"]
RESOLVERS = ["linker:exact_identifier", "linker:qualified_identifier", "linker:alias", "linker:filename", "linker:route_heuristic"]


def _place(value: Column, order: list[str]) -> Column:
    out = F.lit(len(order))
    for k, x in reversed(list(enumerate(order))):
        out = F.when(value == x, k).otherwise(out)
    return out


def link_order() -> list[Column | str]:
    """The strongest of links(confidence, resolver, type, id) first."""
    return [F.least(_place(F.col("confidence"), CONFIDENCES), F.lit(len(CONFIDENCES) - 1)), _place(F.col("resolver"), RESOLVERS), "type", "id"]


def without_files(edges: DataFrame, links: DataFrame, files: DataFrame, entities: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph cleared of files(file_id): edges(file_id, ...) derived from them, and links(entity_id, document_id, ...) to their entities(id, file_id) and documents(id, file_id)."""
    gone = lambda rows, name: rows.join(files, "file_id", "left_semi").select(F.col("id").alias(name))
    left = links.join(gone(entities, "entity_id"), "entity_id", "left_anti").join(gone(documents, "document_id"), "document_id", "left_anti")
    return edges.join(files, "file_id", "left_anti"), left.select(links.columns)


def adopted(edges: DataFrame, links: DataFrame, files: DataFrame, entities: DataFrame, documents: DataFrame, made: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, DataFrame]:
    """Rows of a graph made elsewhere, as far as this build has what they are about: edges of its files(file_id), links between its entities(id) and documents(id); each id once.

    Edges may come as a row a file, of which ``made`` makes them: other files are left out before, so no edge is shuffled for that.
    """
    ours = made(edges.join(files.select("file_id"), "file_id", "left_semi")).dropDuplicates(["id"])
    ends = links.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return ours, ends.select(links.columns).dropDuplicates(["id"])
