"""A folder tree as a Spark data source that leaves out, on the way down, what the ignore rules leave out.

Folders are listed by the tasks, a partition a folder or subtree; nothing under an ignored folder is listed, and no file is opened at all: contents are read
afterwards, of the files that are left (``sources.files``).  The driver lists only the topmost folders, until there are enough to deal out.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import files

#: Folders to deal out before the driver stops listing.
SPREAD = 64
#: Rows of a batch.
ROWS = 4096
#: Files of patterns, one a line, at the root.
IGNORE_FILES = (".gitignore", ".loreignore")
SCHEMA = "rel_path string, size long, mtime double, error string"


def system(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a URI or a local path."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def rules(patterns: list[str], include: list[str]) -> Callable[[str, bool], bool]:
    """Whether a path, which is a folder or not, is left out: the folders never scanned, secret names, and the patterns that no include takes back.

    A pattern with a slash is for the whole path, another for the name; one that ends in a slash is for folders only.
    """

    def compiled(some: list[str]) -> list[tuple[bool, bool, re.Pattern]]:
        out = []
        for p in some:
            only, p = p.endswith("/"), p.rstrip("/")
            out.append((only, "/" in p, re.compile(files.glob_pattern(p.lstrip("/")))))
        return out

    named, kept = compiled(patterns), compiled(include)
    secret = re.compile("|".join(files.glob_pattern(g) for g in files.SECRET_NAMES))
    skipped = set(files.SKIPPED_FOLDERS)

    def any_of(some: list[tuple[bool, bool, re.Pattern]], path: str, name: str, folder: bool) -> bool:
        return any((folder or not only) and p.match(path if whole else name) for only, whole, p in some)

    def ignored(path: str, folder: bool) -> bool:
        name = path.rsplit("/", 1)[-1]
        if name in skipped if folder else secret.match(name):
            return True
        return any_of(named, path, name, folder) and not any_of(kept, path, name, folder)

    return ignored


class Part(InputPartition):
    def __init__(self, folder: str, deep: bool):
        super().__init__((folder, deep))
        self.folder, self.deep = folder, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.patterns, self.include = (json.loads(options.get(x, "[]")) for x in ("patterns", "include"))
        self.spread = int(options.get("spread", SPREAD))

    def _rules(self, store: fs.FileSystem, base: str) -> Callable[[str, bool], bool]:
        read = []
        for name in IGNORE_FILES:
            if store.get_file_info(f"{base}/{name}").type == fs.FileType.File:
                with store.open_input_stream(f"{base}/{name}") as f:
                    lines = [x.strip() for x in f.read().decode("utf-8", "replace").splitlines()]
                read += [x for x in lines if x and not x.startswith("#")]
        return rules([*self.patterns, *read], self.include)

    def _list(self, store: fs.FileSystem, base: str, folder: str, ignored: Callable[[str, bool], bool]) -> tuple[list[tuple], list[str]]:
        """(rows, folders) of one folder, in the order of their names."""
        try:
            infos = store.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base))
        except OSError as e:
            return [(folder, None, None, str(e)[:500])], []
        rows, below = [], []
        for x in sorted(infos, key=lambda x: x.path):
            path = f"{folder}/{x.base_name}" if folder else x.base_name
            # a link may lead out of the root or back into it
            if isinstance(store, fs.LocalFileSystem) and os.path.islink(x.path) or ignored(path, x.type == fs.FileType.Directory):
                continue
            if x.type == fs.FileType.Directory:
                below.append(path)
            elif x.type == fs.FileType.File:
                rows.append((path, x.size, x.mtime_ns / 1e9 if x.mtime_ns is not None else None, None))
        return rows, below

    def partitions(self) -> list[Part]:
        store, base = system(self.root)
        ignored = self._rules(store, base)
        done, open_ = [], deque([""])
        while open_ and len(done) + len(open_) < self.spread:
            folder = open_.popleft()
            done.append(Part(folder, False))
            open_.extend(self._list(store, base, folder, ignored)[1])
        return [*done, *(Part(f, True) for f in open_)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        store, base = system(self.root)
        ignored = self._rules(store, base)
        rows, left = [], [part.folder]
        while left:
            more, below = self._list(store, base, left.pop(), ignored)
            rows += more
            if part.deep:
                left += reversed(below)
            while len(rows) >= ROWS:
                yield _batch(rows[:ROWS])
                rows = rows[ROWS:]
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.float64(), pa.string()), strict=True)], ["rel_path", "size", "mtime", "error"])


class TreeSource(DataSource):
    """``spark.read.format("lorespark_tree").load(root)``: (rel_path, size, mtime, error); a folder that can't be listed is a row with an error."""

    @classmethod
    def name(cls) -> str:
        return "lorespark_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> TreeReader:
        return TreeReader(self.options)


def listing(spark: SparkSession, root: str, patterns: list[str] = (), include: list[str] = ()):  # noqa: ANN201
    """(rel_path, size, mtime, error) of the files under root that the rules leave."""
    spark.dataSource.register(TreeSource)
    return spark.read.format(TreeSource.name()).option("patterns", json.dumps([*patterns])).option("include", json.dumps([*include])).load(root)
