"""Many patterns at once against looking for each, and the longest-prefix join against trying each."""

from __future__ import annotations

import os.path
import random
import re

import pytest
from pyspark.sql import functions as F

from lorespark.functions import files
from lorespark.operators import graph, patterns


@pytest.mark.parametrize("block", [3, 50_000])
def test_found_equals_naive_search(spark, monkeypatch, block):
    monkeypatch.setattr(patterns, "BLOCK", block)
    monkeypatch.setattr(patterns, "TEXT", 2000)
    rng = random.Random(4)
    piece = lambda n: "".join(rng.choice("ab/é_1 .") for _ in range(n))
    wanted = {"/", "a", "/a", "/a/b", "é", "", "b1", *(piece(rng.randrange(1, 4)) for _ in range(30))}
    bodies = [None, "", *(piece(rng.randrange(40)) for _ in range(300)), "a" * 500]
    units = spark.createDataFrame([(i, i % 3, b) for i, b in enumerate(bodies)], "document_id int, ordinal int, body string").repartition(3)
    got = {(r["document_id"], r["pattern"]) for r in patterns.found(spark.createDataFrame([(w,) for w in wanted] + [(None,)], "pattern string"), units, "body").collect()}
    assert got == {(i, w) for i, b in enumerate(bodies) for w in wanted if b and w and re.search(re.escape(w) + r"(?!\w)", b)}
    assert patterns.found(spark.createDataFrame([], "pattern string"), units, "body").count() == 0


def test_normalized_paths_and_folders(spark):
    cases = {"a/b/../c": "a/c", "./a//b/.": "a/b", "..\\x\\y": "x/y", "a/../../b": "b", "/r/./s/../t": "/r/t", "": "", "..": ""}
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    assert {r["p"]: r["n"] for r in df.select("p", files.normalized(F.col("p")).alias("n")).collect()} == cases
    assert spark.createDataFrame([("a/b/c",)], "p string").select(files.folders_above("p").alias("f")).first()["f"] == ["a", "a/b", "a/b/c"]


def test_project_references(spark):
    rng = random.Random(6)
    sources = [("one", "/w/one"), ("two", "/w/two"), ("nested", "/w/two/in"), ("deep", "/w/two/in/deep"), ("like", "/w/twoo")]
    refs = [(rng.choice(sources)[0], rng.choice(["p.csproj", "a/p.csproj", "a/b/p.csproj"]), rng.choice(["../" * n + t for n in range(5) for t in ("x.csproj", "two/x.csproj", "two/in/x.csproj", "two\\in\\deep\\x.csproj", "twoo/x", "twooo/x")])) for _ in range(300)]
    got = sorted(map(tuple, graph.project_references(spark.createDataFrame(refs, "source_id string, rel_path string, reference string"), spark.createDataFrame(sources, "source_id string, path string")).collect()), key=str)
    want, homes = [], dict(sources)
    for s, p, r in refs:
        target = os.path.normpath(os.path.join(homes[s], os.path.dirname(p), r.replace("\\", "/")))
        held = [(len(path), i) for i, path in sources if target == path or target.startswith(path + "/")]
        producer = max(held)[1] if held else None
        want.append((s, p, r, target, producer, "outside" if producer is None else "inside" if producer == s else "declares"))
    assert got == sorted(want, key=str)
