"""Reading and writing files of the shared folder from tasks, by URI."""

from __future__ import annotations

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a URI such as file:///x, hdfs://host/x or s3://bucket/x."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    system, path = open_fs(uri)
    system.create_dir(path, recursive=True)


class RangeReader:
    """Reads ranges of one file; never the whole of it."""

    def __init__(self, uri: str):
        system, path = open_fs(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        return self.file.read_at(length, offset)

    def close(self) -> None:
        self.file.close()
