"""Versions of dimension rows out of changes that arrive in any order: divide-and-conquer priority envelopes.

A change is an update or delete, which holds from its start on, or a correction, which holds from its start to its end and goes before updates
and deletes.  Where corrections overlap, the later arrival holds; of updates and deletes the one with the latest start, ties to the later arrival.

Each correction is a step function of one segment.  Two neighbours in arrival order merge into one function that keeps the later arrival per
segment, and so on by halves until one is left (``envelope``): log2 of their number linear merges, done in numpy for all keys of a task at once.  A
last merge lays it over the base, the step function of the updates and deletes, and what follows on with an equal value is coalesced.

Spread over tasks, so that no key need fit into one: changes of equal key, kind, start and end are first reduced to the last arrival where they
lie; the rest is dealt out in ranges of (key, start, end), each range's corrections merged to one envelope.  Keys that lie within a range are done then.  Of keys
that reach over a range's border, time is cut at the borders: each block of time gets the segments that reach into it, at most one from each range
before, and the last base point before it; blocks are merged apart and their versions joined again at the borders by one summary row each.

Defined results: a change without key, start or kind, or a correction that ends before it begins, changes nothing; a null end is endless; a null
value is a value (null follows on null) and only a delete or nothing is absence; changes that agree in key, kind, start and arrival are settled by value, nulls
first; equal rows are one; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _spark

#: What no time reaches.
ENDLESS = (1 << 63) - 1
#: Changes that a task merges.
RANGE_ROWS = 200_000
PIECE = "key long, part int, done boolean, base boolean, gone boolean, start long, stop long, arrival array<long>, value string"


# ---- step functions: segments (function, start, stop, item), in a function apart and in order ----


def merge(fn: np.ndarray, start: np.ndarray, stop: np.ndarray, item: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, ...]:
    """The segments of every function ``fn`` made of two: where both have one, that of the ``upper`` holds.  Linear but for the sort of the borders."""
    n = len(fn)
    f, at = np.concatenate([fn, fn]), np.concatenate([start, stop])
    opens = np.repeat([True, False], n)
    side, who = np.concatenate([upper, upper]), np.concatenate([item, np.full(n, -1)])
    # at one time, what closes goes before what opens
    order = np.lexsort((opens, at, f))
    f, at, side, who = f[order], at[order], side[order], who[order]
    index = np.arange(2 * n)
    first = np.maximum.accumulate(np.where(np.concatenate([[True], f[1:] != f[:-1]]), index, 0))

    def holds(mine: np.ndarray) -> np.ndarray:
        last = np.maximum.accumulate(np.where(mine, index, -1))
        return np.where(last >= first, who[last], -1)

    below, above = holds(~side), holds(side)
    winner = np.where(above >= 0, above, below)
    # the state after the last border of a time holds until the next time
    last = np.concatenate([(f[1:] != f[:-1]) | (at[1:] != at[:-1]), [True]])
    f, at, winner = f[last], at[last], winner[last]
    until = np.concatenate([at[1:], [0]])
    kept = winner >= 0
    f, at, until, winner = f[kept], at[kept], until[kept], winner[kept]
    return join_equal(f, at, until, winner, winner)


def join_equal(fn: np.ndarray, start: np.ndarray, stop: np.ndarray, item: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments that follow on in one function with equal ``told`` as one."""
    if not len(fn):
        return fn, start, stop, item
    new = np.concatenate([[True], (fn[1:] != fn[:-1]) | (start[1:] != stop[:-1]) | (told[1:] != told[:-1])])
    at = np.flatnonzero(new)
    return fn[at], start[at], stop[np.concatenate([at[1:] - 1, [len(fn) - 1]])], item[at]


def envelope(group: np.ndarray, start: np.ndarray, stop: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """(group, start, stop, item) of each group's corrections, later ranks over earlier ones: merged by halves."""
    order = np.lexsort((rank, group))
    group, start, stop, item = group[order], start[order], stop[order], order
    if not len(group):
        return group, start, stop, item
    first = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), np.arange(len(group)), 0))
    number = np.arange(len(group)) - first
    while number.max(initial=0) > 0:
        both = number // 2
        fn = np.cumsum(np.concatenate([[False], (group[1:] != group[:-1]) | (both[1:] != both[:-1])]))
        to_group, to_number = np.zeros(fn[-1] + 1, group.dtype), np.zeros(fn[-1] + 1, np.int64)
        to_group[fn], to_number[fn] = group, both
        fn, start, stop, item = merge(fn, start, stop, item, number % 2 == 1)
        group, number = to_group[fn], to_number[fn]
    return group, start, stop, item


def base(group: np.ndarray, start: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """(group, start, stop, item): each update or delete from its start to the next one's; of one start the last rank's."""
    order = np.lexsort((rank, start, group))
    group, start = group[order], start[order]
    last = np.concatenate([(group[1:] != group[:-1]) | (start[1:] != start[:-1]), [True]]) if len(group) else np.zeros(0, bool)
    group, start, item = group[last], start[last], order[last]
    stop = np.full(len(group), ENDLESS)
    same = group[1:] == group[:-1]
    stop[:-1][same] = start[1:][same]
    return group, start, stop, item


class Changes:
    """Rows of PIECE as numpy columns: groups of keys, ranks by arrival and value."""

    def __init__(self, t: pa.Table):
        self.table = t
        column = lambda name: t.column(name).combine_chunks()
        self.key = column("key").to_numpy()
        self.start, self.stop = column("start").to_numpy(), column("stop").to_numpy()
        self.base, self.gone = (column(x).to_numpy(zero_copy_only=False) for x in ("base", "gone"))
        arrival = column("arrival")
        parts = pc.list_flatten(arrival).to_numpy(zero_copy_only=False).reshape(len(t), -1) if len(t) else np.zeros((0, 1), np.int64)
        value = column("value")
        self.value = pc.rank(value, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        order = np.lexsort((self.value, *(parts[:, i] for i in reversed(range(parts.shape[1])))))
        self.rank = np.empty(len(t), np.int64)
        self.rank[order] = np.arange(len(t))

    def corrections(self, of: np.ndarray) -> tuple[np.ndarray, ...]:
        """The envelope's (group, start, stop, row); ``of`` is each row's group."""
        at = np.flatnonzero(~self.base)
        group, start, stop, item = envelope(of[at], self.start[at], self.stop[at], self.rank[at])
        return group, start, stop, at[item]

    def versions(self, of: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(group, start, stop, row) of the corrections over the base, without what is gone and with equal neighbours joined; each group cut at its low and high."""
        at = np.flatnonzero(self.base)
        lower = base(of[at], self.start[at], self.rank[at])
        upper = self.corrections(of)
        both = [np.concatenate([x, y]) for x, y in zip((*lower[:3], at[lower[3]]), upper)]
        group, start, stop, item = merge(*both, np.repeat([False, True], [len(lower[0]), len(upper[0])]))
        if low is not None:
            start, stop = np.maximum(start, low[group]), np.minimum(stop, high[group])
        kept = (start < stop) & ~self.gone[item]
        group, start, stop, item = group[kept], start[kept], stop[kept], item[kept]
        return join_equal(group, start, stop, item, self.value[item])


def _rows(c: Changes, item: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """The rows item with some columns put in their place."""
    t = c.table.take(pa.array(item))
    for name, x in columns.items():
        t = t.set_column(t.schema.get_field_index(name), t.schema.field(name), pa.array(x, t.schema.field(name).type))
    return t.combine_chunks().to_batches()[0] if t.num_rows else pa.RecordBatch.from_pylist([], t.schema)


def _of_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range's rows: the versions of the keys that it holds whole; of its first and last key, which may go on elsewhere, the envelope of their corrections and their base points."""
    kept = list(batches)
    if not sum(b.num_rows for b in kept):
        return
    c = Changes(pa.Table.from_batches(kept))
    outer = (c.key == c.key.min()) | (c.key == c.key.max())
    keys, of = np.unique(c.key, return_inverse=True)
    group, start, stop, item = c.versions(of)
    inner = ~outer[item]
    yield _rows(c, item[inner], start=start[inner], stop=stop[inner], done=np.ones(inner.sum(), bool))
    points = np.flatnonzero(c.base & outer)
    yield _rows(c, points)
    _, start, stop, item = c.corrections(of)
    open_ = outer[item]
    yield _rows(c, item[open_], start=start[open_], stop=stop[open_])


def _to_blocks(key: tuple, rows: pa.Table, borders: pa.Table) -> pa.Table:
    """The segments of one (key, range) once for each block of time that they reach into."""
    if not rows.num_rows:
        return rows
    low = borders.column("lows")[0].values.to_numpy()
    parts = borders.column("parts")[0].values.to_numpy()
    stop = rows.column("stop").to_numpy()
    first = np.searchsorted(low, rows.column("start").to_numpy(), "right") - 1
    last = np.where(rows.column("base").to_numpy(), first, np.maximum(np.searchsorted(low, stop, "left") - 1, first))
    times = last - first + 1
    at = np.repeat(np.arange(len(times)), times)
    block = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    return rows.take(pa.array(at)).set_column(rows.schema.get_field_index("part"), rows.schema.field("part"), pa.array(parts[block], rows.schema.field("part").type))


def _of_block(key: tuple, rows: pa.Table) -> pa.Table:
    """The versions of one (key, block), cut at its borders; ``i`` numbers them."""
    c = Changes(rows)
    low, high = (rows.column(x)[:1].to_numpy() for x in ("low", "high"))
    _, start, stop, item = c.versions(np.zeros(len(c.key), np.int64), low, high)
    value = rows.column("value").take(pa.array(item))
    n = len(item)
    return pa.table({"key": pa.array([key[0].as_py()] * n, pa.int64()), "part": pa.array([key[1].as_py()] * n, pa.int32()), "i": pa.array(np.arange(n)), "start": pa.array(start), "stop": pa.array(stop), "value": value})


def versions(changes: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(key, version, valid_from, valid_to, value) of changes(key, kind, start, stop, arrival, value): each key's maximal runs of time with one value, numbered by their start.

    kind is 'update', 'delete' or 'correction'; times are integers, valid_to exclusive and null where endless; arrival is an array of as many integers in every row, compared one by one.
    """
    spark = changes.sparkSession
    fits = (F.col("kind") != "correction") | F.col("stop").isNull() | (F.col("start") < F.col("stop"))
    rows = changes.where(F.col("key").isNotNull() & F.col("start").isNotNull() & F.col("kind").isNotNull() & F.col("arrival").isNotNull() & fits)
    based = F.col("kind") != "correction"
    rows = rows.select(F.col("key").cast("long").alias("key"), based.alias("base"), (F.col("kind") == "delete").alias("gone"), F.col("start").cast("long").alias("start"), F.when(based | F.col("stop").isNull(), ENDLESS).otherwise(F.col("stop")).cast("long").alias("stop"), F.col("arrival").cast("array<long>").alias("arrival"), F.col("value").cast("string").alias("value"))
    last = rows.groupBy("key", "base", "start", "stop").agg(F.max(F.struct("arrival", "value", "gone")).alias("l"))
    last = _spark.written(last.select("key", F.lit(0).alias("part"), F.lit(False).alias("done"), "base", "l.gone", "start", "stop", "l.arrival", "l.value"), "changes")
    ranges = _spark.tasks(spark, last.count(), range_rows)
    dealt = last.repartitionByRange(ranges, "key", "start", "stop").withColumn("part", F.spark_partition_id())
    found = _spark.written(dealt.mapInArrow(_of_range, PIECE), "envelopes")

    whole = found.where("done").select("key", "start", "stop", "value")
    numbered = F.row_number().over(Window.partitionBy("key").orderBy("start"))
    whole = whole.select("key", numbered.alias("version"), "start", "stop", "value")
    return _ended(whole.unionByName(_joined(_blocks(found.where("not done")))))


def _ended(df: DataFrame) -> DataFrame:
    return df.select("key", F.col("version").cast("int").alias("version"), F.col("start").alias("valid_from"), F.when(F.col("stop") < ENDLESS, F.col("stop")).alias("valid_to"), "value")


def _blocks(open_: DataFrame) -> DataFrame:
    """(key, part, i, start, stop, value): the versions of keys of several ranges, block of time by block of time."""
    lows = open_.groupBy("key", "part").agg(F.min("start").alias("low"), F.max(F.when(F.col("base"), F.struct("start", "gone", "stop", "arrival", "value"))).alias("point"))
    by = Window.partitionBy("key").orderBy("part")
    # a range that holds only base points or corrections of one start with the next has no time of its own; its rows go on to the next blocks
    lows = lows.select("key", "part", "low", F.coalesce(F.lead("low").over(by), F.lit(ENDLESS)).alias("high"), F.last("point", True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("point"))
    lows = _spark.written(lows, "borders")
    listed = lows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "low"))).alias("l")).select("key", F.col("l.part").alias("parts"), F.col("l.low").alias("lows"))
    borders = lows.select("key", "part").hint("merge").join(listed, "key")
    rows = open_.select("key", "part", "base", "gone", "start", "stop", "arrival", "value")
    kinds = "key long, part int, base boolean, gone boolean, start long, stop long, arrival array<long>, value string"
    cut = rows.groupBy("key", "part").cogroup(borders.groupBy("key", "part")).applyInArrow(_to_blocks, kinds)
    before = lows.where("point is not null").select("key", "part", F.lit(True).alias("base"), "point.gone", "point.start", "point.stop", "point.arrival", "point.value")
    mine = cut.unionByName(before).hint("merge").join(lows.select("key", "part", "low", "high"), ["key", "part"])
    return _spark.written(mine.groupBy("key", "part").applyInArrow(_of_block, "key long, part int, i long, start long, stop long, value string"), "blocks")


def _joined(pieces: DataFrame) -> DataFrame:
    """(key, version, start, stop, value): pieces of neighbouring blocks that follow on with an equal value are one; numbers go on from block to block."""
    by = Window.partitionBy("key").orderBy("part")
    ends = pieces.groupBy("key", "part").agg(F.count("*").alias("n"), F.min(F.struct("i", "start", "value")).alias("a"), F.max(F.struct("i", "stop", "value")).alias("z"))
    on = (F.lag("z.stop").over(by) == F.col("a.start")) & F.lag("z.value").over(by).eqNullSafe(F.col("a.value"))
    ends = ends.select("key", "part", "n", F.coalesce(on, F.lit(False)).alias("goes_on"))
    fresh = F.col("n") - F.col("goes_on").cast("long")
    ends = ends.select("key", "part", "goes_on", F.coalesce(F.sum(fresh).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    told = pieces.hint("merge").join(ends, ["key", "part"])
    number = F.col("before") + F.col("i") + 1 - F.col("goes_on").cast("long")
    return told.groupBy("key", number.alias("version")).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("value").alias("value"))
