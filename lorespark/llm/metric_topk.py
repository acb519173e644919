"""Exact top-k by inner product: M-trees of paged metric nodes, searched best first.

Vectors x get one component more, sqrt(M - |x|^2) with M the greatest squared norm, and queries q none, so that the squared distance is |q|^2 + M - 2 <q, x>:
the nearest is the one of greatest inner product, and the triangle inequality holds.

``build`` deals vectors out to shards by the nearest of a bounded sample of pivots and bulk-loads an M-tree in each.  A node is a page: of an inner node's
entries, the centre, the covering radius, the distance to the parent's centre and the child's page; of a leaf's, the vector, its id and the distance to the leaf's centre.
``search`` keeps a queue of pages by the least distance that anything in them can have (distance to the centre less covering radius) and ends when that is over
the k-th distance found.  An entry whose stored distance to the centre differs from the query's by more than its radius and the k-th distance is passed over
without computing its own distance.

Each query is first searched for in its own shard.  The k-th score found there bounds its search in the others, which many end at the root.  Queries go to
the shards' tasks through files of the shared folder, in blocks; a shard has SHARD_ROWS vectors or so whatever the number of rows, also where a third of them are alike.
Scores are integers computed exactly; distances only decide what is passed over, with a margin for rounding, and ties go to the smaller id.

Defined results: vectors that are null or hold a null or non-finite component, and rows without an id, take no part; vectors of different lengths don't
meet; equal rows are candidates each, only the query's own row is left out; a query with fewer than k candidates has them all; extra columns are ignored;
an empty table gives no rows; components so large that a score could overflow a long raise an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _files, _spark

SHARD_ROWS = 50_000
#: Entries of a node, vectors of a sample for pivots, queries of a block.
PAGE, PIVOTS, QUERY_BLOCK = 128, 256, 1024
#: Sums of products under this are exact in float64.
EXACT = 1 << 53
VECTOR = "dim int, pivot int, id long, x binary, norm double, most double"
NODE = "shard int, dim int, page int, leaf boolean, radii binary, apart binary, ids binary, x binary"
#: home, dim and row tell a query from all others.
FOUND = "home int, dim int, row int, query_id long, id long, score long, computed long"


def integers(x: np.ndarray) -> np.ndarray:
    """floor(1024 x), as float64."""
    return np.floor(1024.0 * x)


def _vectors(rows: DataFrame, scale: Callable[[np.ndarray], np.ndarray], pivots: dict[int, np.ndarray]) -> DataFrame:
    """VECTOR rows of rows(id, x): the scaled vector and its nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.array([len(x) for x in b.column("x")], np.int64)
            flat = scale(b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            begin = np.cumsum(size) - size
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                x = flat[begin[at][:, None] + np.arange(dim)]
                norm = (x * x).sum(1)
                p = pivots.get(int(dim))
                pivot = np.zeros(len(at), np.int64) if p is None else ((p * p).sum(1)[None, :] - 2 * x @ p.T).argmin(1)
                most = np.abs(x).max(1, initial=0.0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), dim), pa.int32()), pa.array(pivot, pa.int32()), b.column("id").take(pa.array(at)), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(norm), pa.array(most)],
                    ["dim", "pivot", "id", "x", "norm", "most"],
                )

    return rows.mapInArrow(run, VECTOR)


class Tree:
    """An M-tree's pages in memory: lists by page number."""

    def __init__(self) -> None:
        self.leaf: list[bool] = []
        self.x: list[np.ndarray] = []
        self.radii: list[np.ndarray] = []
        self.apart: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []

    def load(self, x: np.ndarray, ids: np.ndarray, greatest: float) -> None:
        """Bulk loading: vectors go to the nearest of PAGE of them, group by group, until a group fits into a page.  Page 0 is the root."""
        self.full = np.concatenate([x, np.sqrt(np.maximum(greatest - (x * x).sum(1), 0))[:, None]], 1)
        self.own = ids
        self._node(np.arange(len(x)), self.full[0] if len(x) else np.zeros(x.shape[1] + 1), np.random.default_rng(len(x)))

    def _node(self, at: np.ndarray, centre: np.ndarray, rng: np.random.Generator) -> int:
        page = len(self.leaf)
        for column in (self.leaf, self.x, self.radii, self.apart, self.ids):
            column.append(None)
        if len(at) <= PAGE:
            self.leaf[page], self.x[page], self.ids[page] = True, self.full[at], self.own[at]
            self.radii[page] = np.zeros(len(at))
            self.apart[page] = np.sqrt(((self.full[at] - centre) ** 2).sum(1))
            return page
        chosen = self.full[rng.choice(at, min(PAGE, -(-len(at) // (PAGE // 2))), replace=False)]
        chosen = np.unique(chosen, axis=0)
        near = ((chosen * chosen).sum(1)[None, :] - 2 * self.full[at] @ chosen.T).argmin(1)
        groups = [at[near == g] for g in range(len(chosen))]
        centres = [c for c, g in zip(chosen, groups) if len(g)]
        groups = [g for g in groups if len(g)]
        if len(groups) == 1:  # vectors alike: pages of them, one after another
            groups = np.array_split(at, min(PAGE, -(-len(at) // PAGE)))
            centres = [centres[0]] * len(groups)
        children = [self._node(g, c, rng) for g, c in zip(groups, centres)]
        self.leaf[page], self.x[page], self.ids[page] = False, np.array(centres), np.array(children, np.int64)
        self.radii[page] = np.array([np.sqrt(((self.full[g] - c) ** 2).sum(1)).max() for g, c in zip(groups, centres)])
        self.apart[page] = np.sqrt(((np.array(centres) - centre) ** 2).sum(1))
        return page


def _shard(greatest: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = list(batches)
        if not sum(b.num_rows for b in kept):
            return
        t = pa.Table.from_batches(kept).sort_by([("dim", "ascending"), ("id", "ascending")])
        dims, number = t.column("dim").to_numpy(), t.column("shard")[0].as_py()
        for dim in np.unique(dims):
            part = t.filter(pa.array(dims == dim))
            x = np.frombuffer(b"".join(part.column("x").to_pylist()), np.float64).reshape(len(part), dim)
            tree = Tree()
            tree.load(x, part.column("id").to_numpy(), greatest)
            for page in range(len(tree.leaf)):
                row = {"shard": number, "dim": int(dim), "page": page, "leaf": tree.leaf[page]}
                row |= {name: np.ascontiguousarray(getattr(tree, name)[page]).tobytes() for name in ("radii", "apart", "ids", "x")}
                yield pa.RecordBatch.from_pylist([row], NODE_SCHEMA)

    return run


NODE_SCHEMA = pa.schema([("shard", pa.int32()), ("dim", pa.int32()), ("page", pa.int32()), ("leaf", pa.bool_()), ("radii", pa.binary()), ("apart", pa.binary()), ("ids", pa.binary()), ("x", pa.binary())])


class Index:
    """Pages of all shards (``nodes``), the greatest squared norm, and whether float64 sums are exact for its vectors."""

    def __init__(self, nodes: DataFrame, greatest: float, exact: bool):
        self.nodes, self.greatest, self.exact = nodes, greatest, exact


def build(vectors: DataFrame, scale: Callable[[np.ndarray], np.ndarray] = integers, shard_rows: int = SHARD_ROWS) -> Index:
    """The index of vectors(id, x), written to the shared folder; ``scale`` makes float64 integers of components."""
    spark = vectors.sparkSession
    whole = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull() & whole)
    # PIVOTS vectors, told by their ids' hashes: they only decide who lies beside whom
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    pivots = {d: scale(np.array([r["x"] for r in sample if len(r["x"]) == d], np.float64)) for d in {len(r["x"]) for r in sample}}
    flat = _spark.written(_vectors(rows, scale, pivots), "vectors")
    s = flat.agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.max(F.col("dim") * F.col("most") * F.col("most")).alias("sum")).first()
    if (s["sum"] or 0) >= 1 << 63:
        raise ValueError("components are so large that an inner product could overflow a long")
    # by pivot and then by chance, so that many vectors alike make several shards
    dealt = flat.select("dim", "pivot", "id", "x", F.xxhash64("id", "x").alias("by")).repartitionByRange(_spark.tasks(spark, s["n"], shard_rows), "dim", "pivot", "by")
    dealt = dealt.select(F.spark_partition_id().alias("shard"), "dim", "id", "x")
    return Index(_spark.written(dealt.mapInArrow(_shard(s["norm"] or 0.0), NODE), "nodes"), s["norm"] or 0.0, (s["sum"] or 0) < EXACT)


class Searcher:
    """One shard's trees by dimension, read from its pages."""

    def __init__(self, t: pa.Table, greatest: float, exact: bool):
        self.greatest, self.exact = greatest, exact
        self.pages: dict[int, list[tuple]] = {}
        t = t.sort_by([("dim", "ascending"), ("page", "ascending")])
        for r in t.to_pylist():
            x = np.frombuffer(r["x"], np.float64).reshape(-1, r["dim"] + 1)
            self.pages.setdefault(r["dim"], []).append((r["leaf"], np.frombuffer(r["radii"], np.float64), np.frombuffer(r["apart"], np.float64), np.frombuffer(r["ids"], np.int64), x))
        # a vector's place within its shard and dimension tells the query's own row
        self.first = {d: np.cumsum([0] + [len(p[3]) if p[0] else 0 for p in pages]) for d, pages in self.pages.items()}

    def own(self, wanted: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(dim, row, id, x) of the vectors whose ids are wanted."""
        for dim, pages in self.pages.items():
            for number, (leaf, _, _, ids, x) in enumerate(pages):
                if leaf:
                    for i in np.flatnonzero(wanted(ids)):
                        yield dim, int(self.first[dim][number] + i), int(ids[i]), x[i, :dim]

    def scores(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.exact:
            return (x @ q).astype(np.int64)
        return x.astype(np.int64) @ q.astype(np.int64)

    def search(self, q: np.ndarray, k: int, row: int | None = None, least: int | None = None) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, id), less the row ``row`` and what is under ``least``, and the number of distances computed."""
        dim = len(q)
        pages = self.pages.get(dim)
        if not pages:
            return [], 0
        long = np.append(q, 0.0)
        norm = float(q @ q)
        margin = 1e-7 * (1.0 + np.sqrt(norm + self.greatest))
        best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst first
        reach = lambda s: np.sqrt(max(norm + self.greatest - 2.0 * s, 0.0)) + margin
        radius = np.inf if least is None else reach(least)
        computed = 0
        # the root's entries know no centre's distance to the query
        queue: list[tuple[float, int, float]] = [(0.0, 0, np.nan)]
        # pages opened at once: more and more, as long as the queue goes on, which costs fewer calls and at most as many distances again
        several = 1
        while queue and queue[0][0] <= radius:
            leaves = []
            for _ in range(several):
                if not queue or queue[0][0] > radius:
                    break
                _, page, to_centre = heapq.heappop(queue)
                leaf, radii, apart, ids, x = pages[page]
                if leaf:
                    leaves.append((page, to_centre))
                    continue
                at = np.arange(len(ids)) if to_centre != to_centre else np.flatnonzero(np.abs(to_centre - apart) - radii <= radius)
                computed += len(at)
                to = np.sqrt(np.maximum(((x[at] - long) ** 2).sum(1), 0))
                low = np.maximum(to - radii[at], 0)
                for j in np.flatnonzero(low <= radius):
                    heapq.heappush(queue, (float(low[j]), int(ids[at[j]]), float(to[j])))
            several = min(2 * several, PAGE)
            if not leaves:
                continue
            at, told, apart, x = self._entries(dim, leaves, radius)
            computed += len(at)
            score = self.scores(x, q)
            floor = best[0][0] if len(best) == k else least
            kept = np.ones(len(at), bool) if floor is None else score >= floor
            if row is not None:
                kept &= at != row
            score, told = score[kept], told[kept]
            order = np.lexsort((told, -score))[:k]
            for s, i in zip(score[order].tolist(), told[order].tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
                else:
                    break
            if len(best) == k:
                radius = min(radius, reach(best[0][0]))
        return [(s, -i) for s, i in best], computed

    def _entries(self, dim: int, leaves: list[tuple[int, float]], radius: float) -> tuple[np.ndarray, ...]:
        """(rows, ids, distances to the centre, vectors) of the leaves' entries that the triangle inequality leaves over."""
        parts = []
        for page, to_centre in leaves:
            _, _, apart, ids, x = self.pages[dim][page]
            at = slice(None) if to_centre != to_centre else np.abs(to_centre - apart) <= radius
            parts.append((self.first[dim][page] + np.arange(len(ids))[at], ids[at], apart[at], x[at, :dim]))
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]


def _found(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * 7
    kinds = [pa.int32()] * 3 + [pa.int64()] * 4
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["home", "dim", "row", "query_id", "id", "score", "computed"])


def _read_blocks(path: str) -> Iterator[list[dict]]:
    system, at = _files.open_fs(path)
    for f in sorted(x.path for x in system.get_file_info(_files.fs.FileSelector(at, recursive=True)) if x.path.endswith(".parquet")):
        with system.open_input_file(f) as source:
            for batch in pq.ParquetFile(source).iter_batches(QUERY_BLOCK, columns=["home", "dim", "row", "query_id", "x", "least"]):
                yield batch.to_pylist()


def top_k(index: Index, k: int, wanted: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(query_id, rank, id, score, computed): for every row of the index whose id is ``wanted`` (an array of ids to one of booleans), the k other rows of the greatest inner product, ties to the smaller id; computed is the number of distances that its searches computed."""
    nodes, greatest, exact = index.nodes, index.greatest, index.exact
    spark = nodes.sparkSession
    queries = "home int, dim int, row int, query_id long, x binary, least long, hits array<struct<id:long,score:long>>, computed long"

    def at_home(key: tuple, t: pa.Table) -> pa.Table:
        searcher, rows = Searcher(t, greatest, exact), []
        for dim, row, i, q in searcher.own(wanted):
            best, computed = searcher.search(q, k, row)
            rows.append({"home": key[0].as_py(), "dim": dim, "row": row, "query_id": i, "x": q.tobytes(), "least": min(best)[0] if len(best) == k else None, "hits": [{"id": i, "score": s} for s, i in best], "computed": computed})
        return pa.Table.from_pylist(rows, HOME_SCHEMA)

    def elsewhere(key: tuple, t: pa.Table) -> pa.Table:
        searcher, shard, rows = Searcher(t, greatest, exact), key[0].as_py(), []
        for block in _read_blocks(path):
            for r in block:
                if r["home"] != shard:
                    best, computed = searcher.search(np.frombuffer(r["x"], np.float64), k, None, r["least"])
                    rows += [(r["home"], r["dim"], r["row"], r["query_id"], i, s, 0) for s, i in best] + [(r["home"], r["dim"], r["row"], r["query_id"], None, None, computed)]
        return _found(rows)

    path = _spark.fresh_path(spark, "queries")
    nodes.groupBy("shard").applyInArrow(at_home, queries).write.parquet(path)
    home = spark.read.schema(queries).parquet(path)
    none = F.lit(None).cast("long")
    kept = home.select("home", "dim", "row", "query_id", F.explode("hits").alias("h")).select("home", "dim", "row", "query_id", "h.id", "h.score", F.lit(0).cast("long").alias("computed"))
    work = home.select("home", "dim", "row", "query_id", none.alias("id"), none.alias("score"), "computed")
    away = _spark.written(nodes.groupBy("shard").applyInArrow(elsewhere, FOUND), "found")
    whole = kept.unionByName(work).unionByName(away)
    by = ["home", "dim", "row"]
    ranked = whole.where("id is not null").withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    spent = whole.groupBy(*by).agg(F.sum("computed").alias("computed"))
    return ranked.drop("computed").join(spent, by).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score", "computed")


HOME_SCHEMA = pa.schema([("home", pa.int32()), ("dim", pa.int32()), ("row", pa.int32()), ("query_id", pa.int64()), ("x", pa.binary()), ("least", pa.int64()), ("hits", pa.list_(pa.struct([("id", pa.int64()), ("score", pa.int64())]))), ("computed", pa.int64())])


def divisible(by: int) -> Callable[[np.ndarray], np.ndarray]:
    return lambda ids: ids % by == 0
