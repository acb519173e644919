"""Numbered generations of a folder's state: readers are pinned to one, writers make the next, and of two that start from the same one only one succeeds.

A generation is a small JSON file named by its number.  It is put in place whole and only where none of that number is yet: by a hard link on local
file systems, by a rename that doesn't overwrite on others.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


class ConflictError(RuntimeError):
    """Another writer has published from the same base first."""


class Generations:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str) -> tuple:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def latest(self) -> int:
        """The newest generation's number; 0 without any."""
        system, at = self._path("")
        if not system.exists(at):
            return 0
        names = [s.getPath().getName() for s in system.listStatus(at)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def read(self, number: int) -> dict:
        """What generation ``number`` says; an empty state for 0."""
        if not number:
            return {}
        system, at = self._path(f"{number:010d}.json")
        stream = system.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, base: int, state: dict) -> int:
        """Makes ``state`` the generation after ``base``; raises ConflictError if that is there already."""
        system, at = self._path(f"{base + 1:010d}.json")
        system.mkdirs(at.getParent())
        if base < self.latest():
            raise ConflictError(f"generation {base + 1} of {self.folder} is there already")
        _, made = self._path(f".{uuid.uuid4().hex}")
        out = system.create(made, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        try:
            if at.toUri().getScheme() in (None, "file") and system.getScheme() == "file":
                os.link(made.toUri().getPath(), at.toUri().getPath())
            elif not system.rename(made, at):
                raise FileExistsError
        except OSError as e:
            raise ConflictError(f"generation {base + 1} of {self.folder} is there already") from e
        finally:
            if system.exists(made):
                system.delete(made, False)
        return base + 1
