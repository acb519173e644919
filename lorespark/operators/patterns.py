"""Many patterns in many texts: Aho-Corasick automata over blocks of patterns, one pass of a text a block however many patterns it has.

Patterns go to the tasks through a table of the shared folder, BLOCK of them at a time; texts are neither joined with them nor shuffled.  The automaton itself is pyahocorasick's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..sources import tree

#: Patterns of an automaton.
BLOCK = 50_000
#: Texts held against a block before the next one is built, in bytes.
TEXT = 32 << 20

_built: dict[tuple[str, int], object] = {}


def is_word(c: str) -> bool:
    """Letters, digits and ``_``."""
    return c == "_" or c.isalpha() or c.isnumeric()


def no_word_after(body: str, begin: int, end: int) -> bool:
    return end == len(body) or not is_word(body[end])


def _automata(path: str) -> Iterator[object]:
    """The automata of the patterns in a table, one after another; a worker keeps the last."""
    import ahocorasick

    store, at = tree.system(path)
    number = 0
    for f in sorted(x.path for x in store.get_file_info(tree.fs.FileSelector(at)) if x.path.endswith(".parquet")):
        with store.open_input_file(f) as source:
            for batch in pq.ParquetFile(source).iter_batches(BLOCK, columns=["pattern"]):
                if (path, number) not in _built:
                    _built.clear()
                    automaton = ahocorasick.Automaton()
                    for p in batch.column("pattern").to_pylist():
                        automaton.add_word(p, p)
                    automaton.make_automaton()
                    _built[path, number] = automaton
                yield _built[path, number]
                number += 1


def found(patterns: DataFrame, units: DataFrame, body: str, accepts: Callable[[str, int, int], bool] = no_word_after) -> DataFrame:
    """The columns of units but ``body``, and ``pattern``: each of patterns(pattern) that a unit's body holds where ``accepts`` (of the body, begin and end) agrees, once a unit; empty patterns are in none."""
    path = shared.folder(units.sparkSession, "patterns")
    patterns.select("pattern").where("pattern is not null and pattern <> ''").distinct().write.parquet(path)
    names = [c for c in units.columns if c != body]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for b in batches:
            kept.append(b)
            size += b.nbytes
            if size >= TEXT:
                yield from search(pa.Table.from_batches(kept))
                kept, size = [], 0
        if kept:
            yield from search(pa.Table.from_batches(kept))

    def search(t: pa.Table) -> Iterator[pa.RecordBatch]:
        texts = t.column(body).to_pylist()
        for automaton in _automata(path):
            rows, hits = [], []
            for i, text in enumerate(texts):
                if text:
                    met = {p for end, p in automaton.iter(text) if accepts(text, end + 1 - len(p), end + 1)}
                    rows += [i] * len(met)
                    hits += sorted(met)
            if rows:
                out = t.select(names).take(pa.array(rows)).append_column("pattern", pa.array(hits, pa.string()))
                yield from out.combine_chunks().to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema if f.name != body)
    return units.select(*names, F.col(body).cast("string").alias(body)).mapInArrow(run, f"{schema}, pattern string")
