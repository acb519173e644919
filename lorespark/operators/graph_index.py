"""Approximate nearest neighbours by dot product: layered navigable graphs, one a shard, searched by beams, the best of all shards merged.

Vectors are dealt out to shards of SHARD vectors or so, those near the same of a bounded sample of pivots together.  A shard's task links them as they would be by inserting one after
another: a vector to diverse ones among its nearest of those before it, and these back, lists that grow too long thinned out again; the nearest come from blocked products, which are exact
within a shard.  Equal vectors of a shard are one node with several ids, so that copies, however many, take no links from others.  Some vectors, by a hash of their ids, also stand in layers above, each a sixteenth of the one below.  What is stored is rows: a vector's links in each of its layers.

A search goes down the layers greedily and keeps a beam of ``ef`` at the bottom.  It begins in the shard whose centre is nearest; the others are passed over whole where
their centre and radius rule out that they hold anything better than the k-th found there.  Every product with a stored vector is counted: ``computed`` is their number.

Upkeep: added vectors make shards of their own, dead ones are passed through but not returned, and beyond COMPACT dead the shards are built anew; each state is a
numbered generation (``sources.generations``).
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import shared
from ..sources import generations, tree

#: Of the stored tables; others are built anew.
FORMAT = 1
SHARD, PIVOTS, QUERY_BLOCK = 16_384, 256, 1024
#: Links of a vector in the layers above and in the lowest; nearest ones looked at for them; the beam; the share of dead vectors from which shards are built anew.
LINKS, BASE_LINKS, NEAR, BEAM, COMPACT = 16, 32, 64, 100, 0.25
NODE = "shard string, layer int, node int, ids array<long>, x array<float>, links array<int>"
NODE_SCHEMA = pa.schema([("shard", pa.string()), ("layer", pa.int32()), ("node", pa.int32()), ("ids", pa.list_(pa.int64())), ("x", pa.list_(pa.float32())), ("links", pa.list_(pa.int32()))])


def nearest(x: np.ndarray, of: np.ndarray, among: int, k: int) -> np.ndarray:
    """The k nearest of x[:among] to each x[of], itself and later ones left out; -1 where there are fewer."""
    out = np.full((len(of), k), -1, np.int64)
    square = (x[:among] ** 2).sum(1)
    for i in range(0, len(of), 512):
        rows = of[i : i + 512]
        d = square[None, :] - 2 * (x[rows] @ x[:among].T)
        d[np.arange(among)[None, :] >= rows[:, None]] = np.inf
        m = min(k, among)
        best = np.argpartition(d, m - 1, axis=1)[:, :m] if m < among else np.tile(np.arange(among), (len(rows), 1))
        score = np.take_along_axis(d, best, 1)
        order = np.argsort(score, axis=1, kind="stable")
        best, score = np.take_along_axis(best, order, 1), np.take_along_axis(score, order, 1)
        out[i : i + 512, :m] = np.where(np.isfinite(score), best, -1)
    return out


def diverse(x: np.ndarray, of: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each row of candidates (nearest first, -1 for none) up to ``most``: first those nearer to x[of] than to any taken before, then the nearest of the rest."""
    out = np.full((len(of), most), -1, np.int64)
    for i in range(0, len(of), 256):
        c = near[i : i + 256]
        there = c >= 0
        v = x[np.where(there, c, 0)]
        own = ((v - x[of[i : i + 256], None]) ** 2).sum(2)
        square = (v * v).sum(2)
        between = square[:, :, None] + square[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        taken = np.zeros(c.shape, bool)
        closest = np.full(c.shape, np.inf)
        for j in range(c.shape[1]):
            ok = there[:, j] & (own[:, j] < closest[:, j]) & (taken.sum(1) < most)
            taken[:, j] = ok
            closest = np.where(ok[:, None], np.minimum(closest, between[:, :, j]), closest)
        # taken ones first, then the nearest
        order = np.argsort(np.where(taken, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :most]
        kept = np.take_along_axis(c, order, 1)
        out[i : i + 256, : kept.shape[1]] = kept
    return out


def linked(x: np.ndarray, most: int) -> np.ndarray:
    """Links of vectors inserted in their order, by doubling batches: (n, most) of places, -1 for none."""
    n = len(x)
    links = np.full((n, most), -1, np.int64)
    upto = 1
    while upto < n:
        new = np.arange(upto, min(2 * upto, n))
        links[new] = diverse(x, new, nearest(x, new, int(new[-1]) + 1, NEAR), most)
        # and back: lists that become too long are thinned out
        a = np.repeat(new, most)
        b = links[new].reshape(-1)
        a, b = a[b >= 0], b[b >= 0]
        rows = np.unique(b)
        _relink(x, links, rows, b, a)
        upto = int(new[-1]) + 1
    # what was not there yet when a vector came: its very nearest
    every = np.arange(n)
    if n > 1:
        _relink(x, links, every, np.repeat(every, 8), _mutual(x, 8).reshape(-1))
    return links


def _mutual(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of all to each, -1 where there are fewer."""
    n = len(x)
    out = np.full((n, k), -1, np.int64)
    square = (x * x).sum(1)
    for i in range(0, n, 512):
        d = square[None, :] - 2 * (x[i : i + 512] @ x.T)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        m = min(k, n - 1)
        out[i : i + 512, :m] = np.argpartition(d, m - 1, axis=1)[:, :m]
    return out


def _relink(x: np.ndarray, links: np.ndarray, rows: np.ndarray, of: np.ndarray, more: np.ndarray) -> None:
    """Adds the links of -> more to the lists of rows, each then thinned out to its width."""
    most = links.shape[1]
    a = np.concatenate([np.repeat(rows, most), of])
    b = np.concatenate([links[rows].reshape(-1), more])
    a, b = a[b >= 0], b[b >= 0]
    pair = np.unique(a * len(x) + b)
    a, b = pair // len(x), pair % len(x)
    d = ((x[a] - x[b]) ** 2).sum(1)
    order = np.lexsort((d, a))
    a, b = a[order], b[order]
    first = np.searchsorted(a, rows)
    size = np.searchsorted(a, rows, "right") - first
    place = np.arange(len(a)) - np.repeat(first, size)
    width = min(int(size.max(initial=0)), 2 * NEAR)
    near = np.full((len(rows), width), -1, np.int64)
    kept = place < width
    near[np.repeat(np.arange(len(rows)), size)[kept], place[kept]] = b[kept]
    links[rows] = diverse(x, rows, near, most)


def layers(ids: np.ndarray) -> np.ndarray:
    """Each vector's highest layer, by a hash of its id: a sixteenth of a layer's stand in the next."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    u = ((h ^ (h >> np.uint64(29))) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.floor(-np.log(np.maximum(u, 1e-18)) / np.log(LINKS)).astype(np.int64)


class Graph:
    """One shard: vectors, ids, and for each layer its links; the entry is the first of the top layer."""

    def __init__(self, ids: list[np.ndarray], x: np.ndarray, links: list[np.ndarray]):
        self.ids, self.x, self.links = ids, x, links
        top = np.flatnonzero((links[-1] >= 0).any(1)) if len(links) > 1 else np.zeros(0, np.int64)
        self.entry = int(top[0]) if len(top) else 0

    def search(self, q: np.ndarray, k: int, ef: int) -> tuple[list[tuple[float, int]], int]:
        """(the k best (score, id, place), how many products were computed)"""
        x = self.x
        at, best = self.entry, float(x[self.entry] @ q)
        computed = 1
        for links in reversed(self.links[1:]):
            while True:
                near = links[at]
                near = near[near >= 0]
                if not len(near):
                    break
                score = x[near] @ q
                computed += len(near)
                j = int(score.argmax())
                if score[j] <= best:
                    break
                at, best = int(near[j]), float(score[j])
        seen = np.zeros(len(x), bool)
        seen[at] = True
        queue, kept = [(-best, at)], [(best, at)]
        links = self.links[0]
        while queue:
            score, at = heapq.heappop(queue)
            if len(kept) >= ef and -score < kept[0][0]:
                break
            near = links[at]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            scores = x[near] @ q
            computed += len(near)
            for s, i in zip(scores.tolist(), near.tolist(), strict=True):
                if len(kept) < ef:
                    heapq.heappush(kept, (s, i))
                    heapq.heappush(queue, (-s, i))
                elif s > kept[0][0]:
                    heapq.heapreplace(kept, (s, i))
                    heapq.heappush(queue, (-s, i))
        return sorted(((s, i, at) for s, at in kept for i in self.ids[at][:k].tolist()), key=lambda r: (-r[0], r[1]))[:k], computed


def _link_shard(name: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        t = pa.Table.from_batches(kept).sort_by("by")
        every = t.column("id").to_numpy()
        x = t.column("embedding").combine_chunks().flatten().to_numpy().astype(np.float32).reshape(len(t), -1)
        # a node of each distinct vector, in the order of their first rows, with all its ids
        _, first, node = np.unique(x.view(f"V{4 * x.shape[1]}").reshape(-1), return_index=True, return_inverse=True)
        order = np.argsort(first)
        node = np.argsort(order)[node.reshape(-1)]
        x = np.ascontiguousarray(x[first[order]])
        by = np.lexsort((every, node))
        cut = np.concatenate([[0], np.cumsum(np.bincount(node))])
        ids = [every[by[i:j]] for i, j in zip(cut[:-1], cut[1:], strict=True)]
        # one component more makes all of one length, so that the nearest has the greatest product
        square = (x.astype(np.float64) ** 2).sum(1)
        long = np.concatenate([x, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], 1).astype(np.float32)
        level = layers(np.array([i[0] for i in ids]))
        shard = f"{name}-{t.column('part')[0].as_py()}"
        for layer in range(int(level.max()) + 1):
            at = np.flatnonzero(level >= layer)
            links = linked(long[at], BASE_LINKS if layer == 0 else LINKS)
            for i in range(0, len(at), 1024):
                mine = links[i : i + 1024]
                there = mine >= 0
                body = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(there.sum(1))]).astype(np.int32), pa.array(at[mine[there]], pa.int32()))
                rows = at[i : i + 1024]
                vectors = pa.array(list(x[rows]), pa.list_(pa.float32())) if layer == 0 else pa.nulls(len(rows), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(rows)), pa.array(np.full(len(rows), layer), pa.int32()), pa.array(rows, pa.int32()), pa.array([ids[r] if layer == 0 else None for r in rows], pa.list_(pa.int64())), vectors, body], schema=NODE_SCHEMA)

    return run


def _loaded(t: pa.Table, dead: np.ndarray) -> Graph:
    layer = t.column("layer").to_numpy()
    base = t.filter(pa.array(layer == 0)).sort_by("node")
    x = base.column("x").combine_chunks().flatten().to_numpy().reshape(len(base), -1)
    links = []
    for k in range(int(layer.max()) + 1):
        part = t.filter(pa.array(layer == k))
        lists = part.column("links").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        out = np.full((len(base), BASE_LINKS if k == 0 else LINKS), -1, np.int64)
        row = np.repeat(part.column("node").to_numpy(), size)
        out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
        links.append(out)
    return Graph([i[~np.isin(i, dead)] if len(dead) else i for i in (np.array(i, np.int64) for i in base.column("ids").to_pylist())], x, links)


def _files(path: str) -> Iterator[pa.RecordBatch]:
    store, at = tree.system(path)
    for f in sorted(x.path for x in store.get_file_info(tree.fs.FileSelector(at, recursive=True)) if x.path.endswith(".parquet")):
        with store.open_input_file(f) as source:
            yield from pq.ParquetFile(source).iter_batches(QUERY_BLOCK)


class GraphIndex:
    """A stored index of vectors(id, embedding): tables of linked nodes and of the shards' centres, and generations that say which of them count."""

    def __init__(self, spark: SparkSession, path: str, generation: int | None = None):
        self.spark, self.path = spark, path
        self.log = generations.Generations(spark, f"{path}/generations")
        self.generation = self.log.latest() if generation is None else generation
        self.state = self.log.read(self.generation)

    @classmethod
    def build(cls, vectors: DataFrame, path: str, shard: int = SHARD) -> GraphIndex:
        spark = vectors.sparkSession
        name, n = cls._write(vectors, path, shard)
        generations.Generations(spark, f"{path}/generations").publish(0, {"shard": shard, "tables": [[name, n]], "dead": None, "dead_n": 0})
        return cls(spark, path)

    @staticmethod
    def _write(vectors: DataFrame, path: str, shard: int) -> tuple[str, int]:
        spark = vectors.sparkSession
        name = uuid.uuid4().hex[:12]
        rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")).where("id is not null and embedding is not null")
        pivots = [np.array(r["embedding"], np.float32) for r in rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()]
        grid = np.array(pivots) if pivots else np.zeros((1, 1), np.float32)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = b.column("embedding").flatten().to_numpy().astype(np.float32).reshape(b.num_rows, -1)
                    near = ((grid * grid).sum(1)[None, :] - 2 * x @ grid.T).argmin(1)
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("embedding"), pa.array(near, pa.int32())], ["id", "embedding", "pivot"])

        near = rows.mapInArrow(assign, "id long, embedding array<float>, pivot int").withColumn("by", F.xxhash64("id"))
        near.write.parquet(f"{path}/{name}/vectors")
        near = spark.read.parquet(f"{path}/{name}/vectors")
        n = near.count()
        dealt = near.repartitionByRange(max(1, -(-n // shard)), "pivot", "by").withColumn("part", F.spark_partition_id())
        dealt.mapInArrow(_link_shard(name), NODE).write.parquet(f"{path}/{name}/nodes")

        def centre(key: tuple, t: pa.Table) -> pa.Table:
            x = t.column("x").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(t), -1)
            c = x.mean(0)
            return pa.table({"shard": [key[0].as_py()], "centre": [c.tolist()], "radius": [float(np.sqrt(((x - c) ** 2).sum(1).max()))]})

        base = spark.read.schema(NODE).parquet(f"{path}/{name}/nodes").where("layer = 0").select("shard", "x")
        base.groupBy("shard").applyInArrow(centre, "shard string, centre array<double>, radius double").write.parquet(f"{path}/{name}/centres")
        return name, n

    def _tables(self, table: str) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{name}/{table}" for name, _ in self.state["tables"]))

    def vectors(self) -> DataFrame:
        """(id, embedding) of the live vectors."""
        v = self._tables("vectors").select("id", "embedding")
        return v.join(self.spark.read.parquet(self.state["dead"]).select("id"), "id", "left_anti") if self.state["dead"] else v

    def update(self, add: DataFrame, dead: DataFrame) -> GraphIndex:
        """The next generation: without the ids of ``dead``, with the vectors of ``add``; an id is dead before it is added again, which builds the shards anew.

        Raises generations.ConflictError if another update of this generation was published first.
        """
        have = self.vectors().select("id")
        gone = dead.select(F.col("id").cast("long").alias("id")).distinct().join(have, "id", "left_semi")
        before = self.spark.read.parquet(self.state["dead"]).select("id") if self.state["dead"] else self.spark.createDataFrame([], "id long")
        at = f"{self.path}/dead-{uuid.uuid4().hex[:12]}"
        before.unionByName(gone).distinct().write.parquet(at)
        dead_n = self.spark.read.parquet(at).count()
        total = sum(n for _, n in self.state["tables"])
        again = not add.join(self.spark.read.parquet(at), "id", "left_semi").isEmpty() or not add.join(have.join(gone, "id", "left_anti"), "id", "left_semi").isEmpty()
        if again or dead_n > COMPACT * total:
            live = self.vectors().join(self.spark.read.parquet(at), "id", "left_anti").join(add.select("id"), "id", "left_anti").unionByName(add.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")))
            state = self.state | {"tables": [list(self._write(live, self.path, self.state["shard"]))], "dead": None, "dead_n": 0}
        else:
            name, n = self._write(add, self.path, self.state["shard"])
            state = self.state | {"tables": [*self.state["tables"], *([[name, n]] if n else [])], "dead": at if dead_n else None, "dead_n": dead_n}
        self.log.publish(self.generation, state)
        return GraphIndex(self.spark, self.path)

    def _homes(self, queries: DataFrame) -> str:
        """The queries in blocks, each with the shard whose centre is nearest, as a table of the shared folder: its path."""
        places = [f"{self.path}/{name}/centres" for name, _ in self.state["tables"]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, centres = [], []
            for place in places:
                for b in _files(place):
                    names += b.column("shard").to_pylist()
                    centres += b.column("centre").to_pylist()
            c = np.array(centres)
            for b in batches:
                if b.num_rows and len(c):
                    q = b.column("embedding").flatten().to_numpy().astype(np.float64).reshape(b.num_rows, -1)
                    near = ((c * c).sum(1)[None, :] - 2 * q @ c.T).argmin(1)
                    yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("embedding"), pa.array([names[i] for i in near])], ["query_id", "embedding", "home"])

        path = shared.folder(self.spark, "graph-queries")
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding")).where("embedding is not null")
        asked.mapInArrow(run, "query_id long, embedding array<float>, home string").write.parquet(path)
        return path

    def search(self, queries: DataFrame, k: int, ef: int = BEAM) -> DataFrame:
        """(query_id, id, score, rank, computed): about the k best of the vectors for queries(query_id, embedding), ties by id, and the number of products computed for the query in all shards."""
        nodes, dead_at = self._tables("nodes"), self.state["dead"]
        asked = self._homes(queries)
        out = "query_id long, id long, score double, computed long"
        arrow = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64()), ("computed", pa.int64())])

        def within(t: pa.Table, wanted) -> pa.Table:  # noqa: ANN001
            dead = np.concatenate([b.column("id").to_numpy() for b in _files(dead_at)] or [np.zeros(0, np.int64)]) if dead_at else np.zeros(0, np.int64)
            graph = _loaded(t, dead)
            centre = graph.x.astype(np.float64).mean(0)
            radius = float(np.sqrt(((graph.x - centre) ** 2).sum(1).max()))
            rows = []
            for query, q in wanted(centre, radius):
                found, computed = graph.search(q, k, max(ef, k))
                exact = graph.x[[at for _, _, at in found]].astype(np.float64) @ q.astype(np.float64)
                rows.append((query, None, None, computed))
                rows += [(query, i, round(float(s), 6), 0) for (_, i, _), s in zip(found, exact, strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        def at_home(key: tuple, t: pa.Table) -> pa.Table:
            def wanted(centre: np.ndarray, radius: float) -> Iterator[tuple[int, np.ndarray]]:
                for b in _files(asked):
                    mine = np.flatnonzero(np.array(b.column("home").to_pylist()) == key[0].as_py())
                    x = b.column("embedding").flatten().to_numpy().reshape(b.num_rows, -1)
                    yield from ((b.column("query_id")[int(i)].as_py(), x[i]) for i in mine)

            return within(t, wanted)

        def elsewhere(key: tuple, t: pa.Table) -> pa.Table:
            def wanted(centre: np.ndarray, radius: float) -> Iterator[tuple[int, np.ndarray]]:
                for b in _files(bounded):
                    x = b.column("embedding").flatten().to_numpy().reshape(b.num_rows, -1)
                    least = b.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                    reach = x @ centre + np.sqrt((x.astype(np.float64) ** 2).sum(1)) * radius
                    mine = np.flatnonzero((np.array(b.column("home").to_pylist()) != key[0].as_py()) & ~(reach < least - 1e-6))
                    yield from ((b.column("query_id")[int(i)].as_py(), x[i]) for i in mine)

            return within(t, wanted)

        home = shared.written(nodes.groupBy("shard").applyInArrow(at_home, out), "graph-home")
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        kth = home.where("id is not null").withColumn("r", F.row_number().over(by)).where(F.col("r") == k).select("query_id", F.col("score").alias("least"))
        bounded = shared.folder(self.spark, "graph-bounds")
        self.spark.read.schema("query_id long, embedding array<float>, home string").parquet(asked).join(kth, "query_id", "left").write.parquet(bounded)
        away = shared.written(nodes.groupBy("shard").applyInArrow(elsewhere, out), "graph-away")
        both = home.unionByName(away)
        spent = both.groupBy("query_id").agg(F.sum("computed").alias("computed"))
        ranked = both.where("id is not null").drop("computed").withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k)
        return ranked.join(spent, "query_id").select("query_id", "id", "score", "rank", "computed")
