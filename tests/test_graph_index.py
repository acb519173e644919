"""Graph-shaped neighbour index: recall and products computed against exact search, upkeep."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.operators import graph_index, neighbours
from lorespark.sources import generations


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, embedding array<float>")


def recall(spark, index, vectors, queries, k=10, ef=graph_index.BEAM):
    got = index.search(queries, k, ef).collect()
    want = neighbours.exact(vectors, queries, k).collect()
    # of vectors alike, one is as good as another
    least = {}
    for r in want:
        least[r["query_id"]] = min(r["score"], least.get(r["query_id"], np.inf))
    computed = {r["query_id"]: r["computed"] for r in got}
    return sum(r["score"] >= least[r["query_id"]] - 1e-5 for r in got) / len(want), float(np.mean(list(computed.values())))


def clustered(n, d=32, centres=100, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    x = c[rng.integers(0, centres, n)] + rng.normal(size=(n, d)) * 0.25
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_recall_and_growth_on_clustered_vectors(spark, tmp_path):
    found = {}
    for n in (5000, 20_000):
        x = clustered(n)
        v = frame(spark, x).repartition(4)
        index = graph_index.GraphIndex.build(v, f"file://{tmp_path}/{n}")
        queries = v.where(F.col("id") % (n // 100) == 0).withColumnRenamed("id", "query_id")
        found[n] = recall(spark, index, v, queries)
    assert min(r for r, _ in found.values()) >= 0.9
    # four times the vectors, far fewer than four times the products; a fraction of all
    assert found[20_000][1] < 2.5 * found[5000][1] and found[20_000][1] < 0.15 * 20_000


def test_recall_on_the_given_vectors(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    index = graph_index.GraphIndex.build(e, f"file://{tmp_path}/index")
    r, computed = recall(spark, index, e, e.where("id % 20 = 0").withColumnRenamed("id", "query_id"))
    assert r >= 0.9 and computed < 2000


def test_many_shards_and_a_third_alike(spark, tmp_path):
    x = clustered(3000)
    x[1000:2000] = x[1000]
    v = frame(spark, x).repartition(3)
    index = graph_index.GraphIndex.build(v, f"file://{tmp_path}/index", shard=500)
    assert index._tables("centres").count() >= 5
    queries = v.where("id % 150 = 7").withColumnRenamed("id", "query_id")
    r, _ = recall(spark, index, v, queries)
    got = index.search(queries, 10)
    assert r >= 0.9 and got.groupBy("query_id").count().where("count <> 10").isEmpty() and got.select("query_id", "id").distinct().count() == got.count()


def test_upkeep(spark, tmp_path):
    x = clustered(2000)
    index = graph_index.GraphIndex.build(frame(spark, x[:1500]), f"file://{tmp_path}/index")
    new = index.update(frame(spark, x[1500:1600], range(1500, 1600)), spark.createDataFrame([(i,) for i in range(0, 200, 2)], "id long"))
    assert len(new.state["tables"]) == 2 and new.state["dead_n"] == 100
    live = new.vectors()
    assert live.count() == 1500
    queries = frame(spark, x[::40], range(0, 2000, 40)).withColumnRenamed("id", "query_id")
    assert recall(spark, new, live, queries)[0] >= 0.9
    with pytest.raises(generations.ConflictError):
        index.update(frame(spark, x[:0]), spark.createDataFrame([(3,)], "id long"))
    # beyond a quarter dead, and when an id comes back, shards are built anew
    anew = new.update(frame(spark, x[1600:1610], range(4, 14)), spark.createDataFrame([(i,) for i in range(300, 800)], "id long"))
    assert len(anew.state["tables"]) == 1 and anew.state["dead"] is None
    assert anew.vectors().count() == anew.vectors().select("id").distinct().count() == 1500 - 500 + 5
    assert recall(spark, anew, anew.vectors(), queries)[0] >= 0.9


def test_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id long, embedding array<float>")
    index = graph_index.GraphIndex.build(none, f"file://{tmp_path}/none")
    assert index.search(none.withColumnRenamed("id", "query_id"), 5).count() == 0
    one = graph_index.GraphIndex.build(spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id long, embedding array<float>"), f"file://{tmp_path}/one")
    got = one.search(spark.createDataFrame([(9, [1.0, 1.0]), (8, None)], "query_id long, embedding array<float>"), 5).collect()
    assert [(r["query_id"], r["id"], r["score"], r["rank"]) for r in got] == [(9, 1, 1.0, 1)]
