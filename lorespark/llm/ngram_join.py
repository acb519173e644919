"""N-gram Jaccard join by a prefix-tree join over globally ordered shingle sets.

Two documents link when 100 * |A & B| >= 75 * |A | B| over their sets of distinct five-word
shingles (``k`` and ``percent`` are parameters).  The stages:

1. Each task tokenises blocks of whole texts, collapses equal sets within the block, and posts
   its shingles, packed into one 64-bit integer each, to hash ranges.  A shingle that several
   documents of one block hold is posted once (pre-aggregation), so a shingle that a third of
   all rows holds costs a range one posting a block.
2. Each range counts its shingles over the whole corpus and sends those held at least twice back to their
   blocks.  A document whose shared shingles are fewer than 75 % of its set can link with nothing and ends here.
3. What is left is ordered globally, rarest shingle first.  By the prefix filter, two linked
   documents share one of their first |A| - ceil(.75 |A|) + 1 shingles.  Each such shingle's smallest
   document is its hub, and a document joins the groups of its hubs - near copies share most of them, so a
   set travels a few times, not once a shingle.
4. Each group's sets go into a trie (common beginnings stored once).  A set walks it level by
   level, sums overlaps along shared paths and cuts subtrees whose remaining length can't
   reach the threshold.  The overlap at a leaf is the exact intersection.  A group returns
   a spanning forest of its links, not all of them.
5. A group of over ``GROUP`` members is dealt out in blocks, each compared within itself.  A few members stand for each component of a block
   in a comparison across blocks.  Members of what is then the group's largest component are settled among themselves; only the others
   are still compared with all members, so a group of near copies of any size costs its members a few comparisons each.  The forest that
   grows this way has the group's components exactly.
6. Links become components by alternating large-star and small-star steps.

Shingles are told apart by 48 bits of hash; within a pair of documents the odds of a false
match are about |A| * |B| / 2**48.

Defined results: a null or empty text, or one without words, has no set and links with
nothing (n_shingles 0, its own component); a text of fewer than k words has its whole word
sequence as its one shingle; rows that repeat a doc_id each give a row, and their links count
for all of them, also where their texts differ; a row without a doc_id is dropped; extra columns are ignored; an empty table
gives no rows.  ``docs`` should be a scan or a written table, so that a lost task reads its rows again in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _spark, _text
from ._text import U64

K, PERCENT = 5, 75
#: Bytes of text a block of documents holds; bytes of postings a hash range should hold; members a group's task holds; members that stand for a component of a block.
BLOCK_BYTES, RANGE_BYTES, GROUP, FEW = 6 << 20, 16 << 20, 512, 4
#: Text whose shared shingles a task writes to one file; sets a task has.
FILE_TEXT, SETS = 32 << 20, 20_000
_LOW = U64(0xFFFF)
_MANY = 0xFFFF


def need(n: np.ndarray | int, m: np.ndarray | int, percent: int = PERCENT):
    """The least intersection with which sets of n and m shingles link."""
    return -((-percent * (n + m)) // (100 + percent))


def shingle_sets(texts: pa.Array, k: int = K) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted; empty without words."""
    raw, offs = _text.buffers(texts)
    raw = _text.LOWER[raw]
    start, end, at = _text.words(raw, offs, _text.SPACE_WORDS)
    w = _text.hash_spans(raw, start, end)
    grams = _text.gram_hashes(w, k)
    out = []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if j - i >= k:
            out.append(np.unique(grams[i : j - k + 1]))
        else:
            out.append(np.array([_text.one_hash(w[i:j])], U64) if j > i else np.zeros(0, U64))
    return out


_POSTED = "key long, block long, part int, a binary, b binary, c binary"


def _post(ranges: int, k: int):
    """Blocks to rows: part 0 (key: range; a: postings, b: counts of those held by many) and part 1 (key: block; the block's own table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = count(1)
        for t in _text.flushes(batches, "text", BLOCK_BYTES):
            for lo in range(0, t.num_rows, _MANY - 1):
                yield from one(t.slice(lo, _MANY - 1), blocks)

    def one(t: pa.Table, blocks: Iterator[int]) -> Iterator[pa.RecordBatch]:
        ids = t.column("doc_id").to_numpy().astype(np.int64)
        sets = shingle_sets(t.column("text"), k)
        n = np.array([len(s) for s in sets], np.int64)
        sigs = np.zeros((len(sets), 2), U64)
        first: dict[tuple, int] = {}
        own, whose = [], []
        for i, s in enumerate(sets):
            if len(s):
                sigs[i] = (s.sum(dtype=U64) ^ U64(len(s)), np.bitwise_xor.reduce(_text.mix(s)))
                if first.setdefault(tuple(sigs[i].tolist()), i) == i:
                    own.append(s)
                    whose.append(np.full(len(s), i, U64))
        block = (TaskContext.get().partitionId() << 32) + next(blocks)
        posts = np.sort((np.concatenate(own) & ~_LOW) | np.concatenate(whose)) if own else np.zeros(0, U64)
        token = posts >> U64(16)
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        at = np.flatnonzero(new)
        held = np.diff(np.append(at, len(token)))
        rep = posts[at]
        rep[held > 1] |= U64(_MANY)
        many = np.repeat(held > 1, held)
        # only ranges that the block has shingles for: there may be far more of them than shingles
        of = (rep & ~_LOW) // (U64(2**64 - 1) // U64(ranges) + U64(1))
        first = np.ones(len(of), bool)
        first[1:] = of[1:] != of[:-1]
        cut = [*np.flatnonzero(first).tolist(), len(of)]
        keys, parts, a, b, c = [], [], [], [], []
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            cc = held[i:j]
            keys.append(int(of[i]))
            parts.append(0)
            a.append(rep[i:j].tobytes())
            b.append(cc[cc > 1].astype(np.uint16).tobytes())
            c.append(None)
        keys.append(block)
        parts.append(1)
        a.append(posts[many].tobytes())
        b.append(np.concatenate([ids, n]).tobytes())
        c.append(sigs.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([block] * len(keys), pa.int64()), pa.array(parts, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(c, pa.binary())], ["key", "block", "part", "a", "b", "c"])

    return run


def _count(t: pa.Table) -> pa.Table:
    """A range: postings whose shingle two or more documents hold go back to their block with its count; a block's own table passes."""
    parts = t.column("part").to_numpy()
    if parts[0] == 1:
        return t
    posts = [np.frombuffer(x.as_buffer(), U64) for x in t.column("a")]
    sizes = [len(p) for p in posts]
    every = np.concatenate(posts)
    weight = np.ones(len(every), np.int64)
    weight[(every & _LOW) == U64(_MANY)] = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in t.column("b")])
    order = np.argsort(every >> U64(16), kind="stable")
    token = every[order] >> U64(16)
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=weight[order]).astype(np.int64)
    held = np.empty(len(every), np.int64)
    held[order] = total[group]
    rows, ends = [], np.cumsum(sizes)
    for block, lo, hi in zip(t.column("block").to_pylist(), ends - sizes, ends, strict=True):
        keep = held[lo:hi] > 1
        if keep.any():
            rows.append((block, every[lo:hi][keep].tobytes(), np.minimum(held[lo:hi][keep], 65535).astype(np.uint16).tobytes()))
    cols = list(zip(*rows, strict=True)) if rows else ([], [], [])
    n = len(rows)
    return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[0], pa.int64()), pa.array([0] * n, pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary()), pa.array([None] * n, pa.binary())], names=t.column_names)


_SETS = "doc_id long, n long, sig binary, keys binary"


def _resolve(percent: int):
    """A block: each document's shared shingles as count << 48 | hash, in global order; null where too few are shared or an equal set came before."""

    def run(t: pa.Table) -> pa.Table:
        parts = t.column("part").to_numpy()
        tables = [i for i, p in enumerate(parts) if p == 1]
        ids, n, sigs, docs, keys = [], [], [], [], []
        back = [(np.frombuffer(t.column("a")[i].as_buffer(), U64), np.frombuffer(t.column("b")[i].as_buffer(), np.uint16)) for i, p in enumerate(parts) if p == 0]
        posts = np.concatenate([x[0] for x in back]) if back else np.zeros(0, U64)
        held = np.concatenate([x[1] for x in back]) if back else np.zeros(0, np.uint16)
        assert len(tables) == 1, "a block has one table"
        for i in tables:
            meta = np.frombuffer(t.column("b")[i].as_buffer(), np.int64)
            m = len(meta) // 2
            ids, n = meta[:m], meta[m:]
            sigs = np.frombuffer(t.column("c")[i].as_buffer(), np.uint8).reshape(m, 16)
            many = np.frombuffer(t.column("a")[i].as_buffer(), U64)
        single = (posts & _LOW) != U64(_MANY)
        shared = np.sort(posts[~single] >> U64(16))
        order = np.argsort(posts[~single] >> U64(16))
        counts = held[~single][order].astype(U64)
        token = np.concatenate([posts[single] >> U64(16), many >> U64(16)])
        doc = np.concatenate([posts[single] & _LOW, many & _LOW]).astype(np.int64)
        df = np.concatenate([held[single].astype(U64), counts[np.searchsorted(shared, many >> U64(16))] if len(many) else np.zeros(0, U64)])
        key = (df << U64(48)) | token
        order = np.argsort(doc, kind="stable")
        key, at = key[order], np.searchsorted(doc[order], np.arange(m + 1))
        out = []
        for d in range(m):
            got = key[at[d] : at[d + 1]]
            out.append(np.sort(got).tobytes() if len(got) and 100 * len(got) >= percent * n[d] else None)
        return pa.table([pa.array(ids), pa.array(n), pa.array([s.tobytes() if x else None for s, x in zip(sigs, n, strict=True)], pa.binary()), pa.array(out, pa.binary())], names=["doc_id", "n", "sig", "keys"])

    return run


def _prefixes(percent: int):
    """Each class's first shared shingles that a linked partner must share one of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reps, tokens = [], []
            for rep, n, keys in zip(b.column("rep").to_pylist(), b.column("n").to_pylist(), b.column("keys"), strict=True):
                x = np.frombuffer(keys.as_buffer(), np.int64)
                alone = n - len(x)
                # a partner of any size shares at least percent of this set
                take = x[: max(0, n - -(-percent * n // 100) + 1 - alone)]
                tokens.append(take)
                reps.append(np.full(len(take), rep, np.int64))
            if reps:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(reps)), pa.array(np.concatenate(tokens))], ["rep", "token"])

    return run


class Trie:
    """Sets in global order, common beginnings stored once as nodes of runs."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        seqs = [sets[i] for i in self.order]
        self.size = sizes[self.order]
        self.length = np.array([len(s) for s in seqs], np.int64)
        m = len(seqs)
        lcp = [0] * (m + 1)
        for i in range(1, m):
            a, b = seqs[i - 1], seqs[i]
            k = min(len(a), len(b))
            diff = np.flatnonzero(a[:k] != b[:k])
            lcp[i] = int(diff[0]) if len(diff) else k
        # nodes as LCP intervals: (parent depth, depth, first leaf, last leaf)
        nodes: list[list[int]] = []
        stack: list[list[int]] = [[0, 0]]  # depth, first leaf
        for i in range(m):
            nxt = lcp[i + 1] if i + 1 < m else 0
            stack_top = stack[-1][0]
            if len(seqs[i]) > stack_top:
                stack.append([len(seqs[i]), i])
            while stack[-1][0] > nxt:
                depth, first = stack.pop()
                above = max(stack[-1][0], nxt)
                nodes.append([above, depth, first, i])
                if stack[-1][0] < nxt:
                    stack.append([nxt, first])
        nodes.sort(key=lambda x: (x[0], x[2]))
        self.lo = np.array([x[2] for x in nodes], np.int64)
        self.hi = np.array([x[3] + 1 for x in nodes], np.int64)
        self.depth = np.array([x[1] for x in nodes], np.int64)
        above = np.array([x[0] for x in nodes], np.int64)
        run = self.depth - above
        flat = np.concatenate([seqs[f][a:d] for a, d, f, _ in nodes]) if nodes else np.zeros(0, U64)
        node = np.repeat(np.arange(len(nodes)), run)
        by = np.argsort(flat, kind="stable")
        self.tokens, self.node = flat[by], node[by]
        # children follow their parents; a node's parent is the deepest earlier node that holds its first leaf at depth ``above``
        self.parent = np.full(len(nodes), -1, np.int64)
        at: dict[int, list[tuple[int, int, int]]] = {}
        for k, (a, d, f, l) in enumerate(nodes):
            at.setdefault(d, []).append((f, l, k))
        firsts = {d: np.array([x[0] for x in sorted(v)]) for d, v in at.items()}
        rows = {d: sorted(v) for d, v in at.items()}
        for k, (a, _, f, _l) in enumerate(nodes):
            if a:
                self.parent[k] = rows[a][int(np.searchsorted(firsts[a], f, "right")) - 1][2]
        self.level = np.zeros(len(nodes), np.int64)
        for k in np.argsort(self.depth, kind="stable"):
            if self.parent[k] >= 0:
                self.level[k] = self.level[self.parent[k]] + 1
        self.levels = [np.flatnonzero(self.level == v) for v in range(int(self.level.max()) + 1)] if len(nodes) else []
        self.small = np.array([self.size[a:b].min() for a, b in zip(self.lo, self.hi, strict=True)], np.int64)
        self.large = np.array([self.size[a:b].max() for a, b in zip(self.lo, self.hi, strict=True)], np.int64)
        self.rest = np.array([self.length[a:b].max() for a, b in zip(self.lo, self.hi, strict=True)], np.int64) - self.depth
        self.last = flat[np.cumsum(run) - 1] if len(nodes) else np.zeros(0, U64)

    def matches(self, x: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Leaves (places in the given list) whose intersection with x reaches the threshold."""
        i, j = np.searchsorted(self.tokens, x, "left"), np.searchsorted(self.tokens, x, "right")
        width = j - i
        total = int(width.sum())
        if not total:
            return np.zeros(0, np.int64)
        hits = self.node[np.repeat(i - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(total)]
        seg = np.bincount(hits, minlength=len(self.parent))
        overlap = np.zeros(len(self.parent), np.int64)
        alive = np.zeros(len(self.parent), bool)
        # no member of the subtree can have a size in range
        fits = (100 * self.large >= percent * size) & (percent * self.small <= 100 * size)
        after = len(x) - np.searchsorted(x, self.last, "right")
        least = need(size, np.maximum(self.small, -(-percent * size // 100)), percent)
        for nodes in self.levels:
            up = self.parent[nodes]
            go = fits[nodes] & ((up < 0) | alive[up])
            nodes, up = nodes[go], up[go]
            overlap[nodes] = np.where(up >= 0, overlap[up], 0) + seg[nodes]
            alive[nodes] = overlap[nodes] + np.minimum(after[nodes], self.rest[nodes]) >= least[nodes]
            if not len(nodes):
                break
        ends = np.flatnonzero(alive)
        found = [np.arange(self.lo[k], self.hi[k])[(self.length[self.lo[k] : self.hi[k]] == self.depth[k]) & (overlap[k] >= need(size, self.size[self.lo[k] : self.hi[k]], percent))] for k in ends if overlap[k] >= least[k]]
        return np.array([self.order[q] for q in np.concatenate(found)], np.int64) if found else np.zeros(0, np.int64)


def group_links(ids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], queries: np.ndarray, targets: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between queries and targets (masks over the members)."""
    where = np.flatnonzero(targets)
    trie = Trie([sets[i] for i in where], sizes[where])
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for q in np.flatnonzero(queries).tolist():
        for hit in trie.matches(sets[q], int(sizes[q]), percent):
            t = int(where[hit])
            a, b = find(q), find(t)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(ids[q]), int(ids[t])))
    return out


def _join_group(percent: int):
    def run(t: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), U64) for x in t.column("keys")]
        asks, told = (np.array(t.column(c).to_pylist(), bool) for c in ("asks", "told"))
        out = group_links(t.column("rep").to_numpy(), t.column("n").to_numpy(), sets, asks, told, percent) if asks.any() and told.any() else []
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return run


def _compared(tasks: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of tasks(hub, i, j, rep, asks, told): in each, the members that ask against those that are told."""
    return tasks.join(members, "rep").groupBy("hub", "i", "j").applyInArrow(_join_group(percent), "a long, b long")


def _every(count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), count - 1))


def _across_blocks(placed: DataFrame, links: DataFrame, members: DataFrame, percent: int, rows: int) -> DataFrame:
    """The links of groups of several blocks, placed(hub, rep, b, blocks), beyond those within blocks."""

    def known(links: DataFrame) -> DataFrame:
        found = _spark.components(links, rows).withColumnRenamed("id", "rep")
        return _spark.written(placed.join(found, "rep", "left").select("hub", "rep", "b", "blocks", F.coalesce("component", "rep").alias("c")), "known")

    def forest(k: DataFrame) -> DataFrame:
        return k.where("rep <> c").select(F.col("rep").alias("a"), F.col("c").alias("b")).distinct()

    yes, no = F.lit(True), F.lit(False)
    # a few members of each component of a block, but for single ones
    k = known(links)
    of = Window.partitionBy("hub", "b", "c")
    some = k.withColumn("n", F.row_number().over(of.orderBy("rep"))).withColumn("size", F.count("*").over(of)).where((F.col("n") <= FEW) & (F.col("size") > 1))
    some = _spark.written(some.select("hub", "rep"), "few")
    parts = some.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(GROUP)).cast("int").alias("parts"))
    some = some.join(parts, "hub").withColumn("p", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    some = some.select("hub", "rep", "p", _every(F.col("parts")).alias("o")).select("hub", "rep", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), (F.col("p") <= F.col("o")).alias("asks"), (F.col("p") >= F.col("o")).alias("told"))
    k = known(forest(k).unionByName(_compared(some, members, percent)))
    # what is not of the group's largest component asks all
    most = k.groupBy("hub", "c").agg(F.count("*").alias("n")).groupBy("hub").agg(F.max_by("c", F.struct("n", "c")).alias("big"), F.sum("n").alias("all"), F.max("n").alias("n"))
    most = most.select("hub", "big", F.ceil((F.col("all") - F.col("n")) / F.lit(GROUP)).cast("int").alias("parts")).where("parts > 0")
    k_open = k.join(most, "hub")
    told = k_open.select("hub", _every(F.col("parts")).alias("i"), F.col("b").alias("j"), "rep", no.alias("asks"), yes.alias("told"))
    asks = k_open.where("c <> big").select("hub", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("i"), _every(F.col("blocks")).alias("j"), "rep", yes.alias("asks"), no.alias("told"))
    return forest(k).unionByName(_compared(told.unionByName(asks), members, percent))


def shared_sets(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, sig, keys) of each document: set size, the set's signature, and its shared shingles in global order where they can reach the threshold."""
    spark = docs.sparkSession
    _spark.small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    _, size = _spark.text_size(docs)
    ranges = max(8, 2 * size // RANGE_BYTES)
    posted = docs.mapInArrow(_post(ranges, k), _POSTED)
    counted = posted.groupBy("part", "key").applyInArrow(_count, _POSTED)
    return _spark.written(counted.groupBy("block").applyInArrow(_resolve(percent), _SETS).coalesce(_spark.tasks(spark, size, FILE_TEXT)), "sets")


def ngram_join(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs(doc_id, text)."""
    sets = shared_sets(docs, k, percent)
    classes = sets.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys", ignorenulls=True).alias("keys"))
    spark, held = docs.sparkSession, sets.where("keys is not null").count()
    members = _spark.written(classes.where("keys is not null").select("rep", "n", "keys").coalesce(_spark.tasks(spark, held, SETS)), "classes")
    prefix = _spark.written(members.mapInArrow(_prefixes(percent), "rep long, token long"), "prefix")
    hubs = prefix.groupBy("token").agg(F.min("rep").alias("hub"), F.count("*").alias("held")).where("held > 1").drop("held")
    dealt = _spark.written(prefix.join(hubs, "token").select("hub", "rep").distinct(), "groups", 4 * held)
    # a group of many members becomes blocks by hash
    sizes = dealt.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(GROUP)).cast("int").alias("blocks"), F.count("*").alias("size")).where("size > 1")
    placed = _spark.written(dealt.join(sizes, "hub").select("hub", "rep", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("b"), "blocks"), "placed", 4 * held)
    within = placed.select("hub", "rep", F.col("b").alias("i"), F.col("b").alias("j"), F.lit(True).alias("asks"), F.lit(True).alias("told"))
    links = _spark.written(_compared(within, members, percent), "links", 4 * held)
    large = placed.where("blocks > 1")
    if not large.isEmpty():
        links = links.unionByName(_across_blocks(large, links, members, percent, 4 * held))
    # an id with several sets links what each of them links
    several = sets.where("sig is not null").groupBy("doc_id").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).where("low <> high").select("doc_id")
    own = sets.join(several, "doc_id", "left_semi").select("doc_id", "sig").join(classes.select("sig", "rep"), "sig").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = _spark.components(links.unionByName(own), 4 * held)
    named = classes.select("sig", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("sig", F.coalesce("component", "rep").alias("component_id"))
    # of the copies of a set a hot one may hold a third of the rows: its one row goes out to several salts
    salts = 16
    left = sets.select("doc_id", F.col("n").alias("n_shingles"), "sig", F.pmod("doc_id", F.lit(salts)).cast("int").alias("salt"))
    right = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, ["sig", "salt"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs, with all their columns, but of each group of linked documents only the one with the smallest doc_id; of rows that are equal in doc_id and text one stays.

    Rows without a doc_id stay, and so do rows of one id whose texts differ.
    """
    others = ngram_join(docs.select("doc_id", "text")).where("doc_id <> component_id").select("doc_id")
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    kept = docs.join(others, "doc_id", "left_anti")
    once, twice = kept.join(again, "doc_id", "left_anti"), kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.select(docs.columns).unionByName(twice.select(docs.columns))
