"""Embedding texts with a pluggable model, and keeping vectors in step with texts."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Characters of a text that a model reads.
# Fixed value: the characters of a text that a model is given; a model has a context of its own.
LIMIT = 4000


def hashing_model(dimension: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A stand-in for a model without weights at hand: words hashed to signed places, of unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dimension] += 1 if h & 0x10000 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embed(text: Column, model: Callable[[list[str]], np.ndarray]) -> Column:
    @pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(list(model([(t or "")[:LIMIT] for t in b]).astype(np.float32)))

    return run(text)


def build(subjects: DataFrame, cache: DataFrame, model: Callable[[list[str]], np.ndarray], fingerprint: str) -> tuple[DataFrame, DataFrame]:
    """((id, text_hash, embedding) of subjects(id, text), the cache's new rows): equal texts are embedded once, cached ones (text_hash, fingerprint, embedding) not at all, blank ones never."""
    s = subjects.where(F.trim("text") != "").withColumn("text_hash", F.sha2("text", 256))
    known = cache.where(F.col("fingerprint") == fingerprint).select("text_hash", "embedding")
    misses = s.groupBy("text_hash").agg(F.min("text").alias("text")).join(known, "text_hash", "left_anti")
    fresh = misses.select("text_hash", embed(F.col("text"), model).alias("embedding"))
    return s.select("id", "text_hash").join(known.unionByName(fresh), "text_hash"), fresh.withColumn("fingerprint", F.lit(fingerprint))


def sync(index: DataFrame, vectors: DataFrame, compact_at: float = 0.25) -> tuple[DataFrame, DataFrame, Column]:
    """What an index(id, text_hash, live) needs to follow vectors(id, text_hash): rows to add, ids to mark dead, and whether so many are dead that it should be built anew."""
    live = index.where("live")
    add = vectors.join(live, ["id", "text_hash"], "left_anti")
    dead = live.join(vectors, ["id", "text_hash"], "left_anti").select("id")
    share = (F.count_if(~F.col("live") | F.col("gone")) / F.count("*")) > compact_at
    return add, dead, share
