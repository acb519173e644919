"""What is shuffled and written: no blocks of the index, no index where texts do, no edges or hits where their files or needles do."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lorespark import registry, shared
from lorespark.operators import graph, lexical, search

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_read_their_blocks_from_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "PART_RECORDS", 500)
    records = spark.createDataFrame([(i, f"alpha w{i % 7} x{i}") for i in range(4000)], "doc_id long, text string")
    index = lexical.Index.build(records, "doc_id", {"text": 1}, f"file://{tmp_path}/index")
    asked = spark.createDataFrame([(1, ["w3", "x10"]), (2, ["none"])], "query_id long, terms array<string>")
    found = index.search(asked, 3)
    assert "CoGroup" not in plan(found)
    assert [r["doc_id"] for r in found.orderBy("rank").collect()] == [10, 3, 17]
    # a part's blocks are in one file, with all of its records
    files = spark.read.parquet(f"file://{tmp_path}/index/first/files")
    assert index.state["parts"] == 8 and files.count() == 8 and files.select("part").distinct().count() == 8
    assert index.terms().where("term = 'alpha'").first()["n"] == 4000


@pytest.mark.parametrize("name", ["c14_graph_clear_adopt", "g14_links_by_name", "v16_explore", "g20_file_symbols", "g4_delta_resolution"])
def test_words_need_no_index(spark, monkeypatch, name):
    def build(*args):
        raise AssertionError("an index is built")

    monkeypatch.setattr(shared, "built", build)
    monkeypatch.setattr(shared, "found", lambda *args: None)
    assert registry.queries()[name](spark, SF).count()


def test_edges_are_made_after_other_files_are_gone(spark):
    texts = spark.createDataFrame([(1, "a b a"), (2, "c"), (2, "c")], "file_id long, text string")
    links = spark.createDataFrame([("l", 1, 2)], "id string, entity_id long, document_id long")
    files, own = spark.createDataFrame([(2,)], "file_id long"), spark.createDataFrame([(2,)], "id long")
    made = lambda rows: rows.select("file_id", F.explode(F.array_distinct(F.split("text", " "))).alias("id"))
    edges, left = graph.adopted(texts, links, files, own, own, made)
    assert [tuple(r) for r in edges.select("file_id", "id").collect()] == [(2, "c")] and left.count() == 0
    assert plan(edges).index("Generate") < plan(edges).index("Join")


def test_mentions_are_put_in_order_where_needles_meet(spark):
    units = spark.createDataFrame([(1, i, f"run x{i}") for i in range(9)] + [(1, 3, "run"), (2, 0, "walk run")], "document_id long, ordinal long, body string")
    entities = spark.createDataFrame([("e", "run"), ("w", "walk")], "id string, name string")
    m = graph.mentions(entities, units, F.col("name"), "r", "c", "k", 5)
    assert "hashpartitioning(entity_id" not in plan(m)
    got = sorted((r["entity_id"], r["document_id"], r["ordinal"], r["position"]) for r in m.collect())
    assert got == [("e", 1, i, i + 1) for i in range(5)] + [("e", 2, 0, 1), ("w", 2, 0, 1)]
    # of an entity with two needles a unit that has both is one
    both = entities.unionByName(spark.createDataFrame([("e", "walk")], "id string, name string"))
    got = sorted((r["entity_id"], r["document_id"], r["ordinal"], r["position"]) for r in graph.mentions(both, units, F.col("name"), "r", "c", "k", 5).collect())
    assert got == [("e", 1, i, i + 1) for i in range(5)] + [("e", 2, 0, 1), ("w", 2, 0, 1)]
    assert graph.mentions(entities, units, F.col("name"), "r", "c", "k", None).count() == 11


def test_documents_a_query_are_counted_from_bitmaps(spark, monkeypatch):
    monkeypatch.setattr(graph, "BITS", 3)
    monkeypatch.setattr(graph, "LOOKED_UP", 4)
    texts = [(d, [f"w{(d * k) % 11}" for k in range(1 + d % 5)]) for d in range(40)] + [(3, ["w9"]), (3, ["w9"]), (5, []), (6, None)]
    asked = [(q, f"w{(q * k) % 13}", None if q % 2 else k) for q in range(10) for k in range(4)] + [(1, "w1", 4), (1, "w1", 7)]
    rows = spark.createDataFrame(texts, "document_id long, words array<string>").repartition(3)
    out = graph.documents_a_query(rows, spark.createDataFrame(asked, "query_id long, name string, but long"))
    want = {q: n for q in range(10) if (n := len({d for d, w in texts for a, name, but in asked if a == q and name in (w or ()) and d != but}))}
    assert {r["query_id"]: r["n"] for r in out.collect()} == want


def test_file_symbols_of_words_need_no_candidates(spark):
    entities = spark.createDataFrame([("e", "run", "m.run", 1, 1, "class")], "id string, name string, qualified_name string, file_id long, start_line long, kind string")
    references = spark.createDataFrame([(1, "run"), (2, "run"), (2, "x")], "file_id long, reference_text string")
    found = graph.file_symbols(entities, graph.resolve(references, entities, words=True))
    assert plan(found).count("Join") == 1
    assert sorted((r["file_id"], r["key"], r["defs"], r["refs"]) for r in found.collect()) == [(1, "n:run", 1, 1), (1, "q:m.run", 1, 0), (2, "n:run", 0, 1), (2, "n:x", 0, 1)]


def test_references_of_words_are_shuffled_once(spark):
    entities = spark.createDataFrame([("e", "run", "m.run", 1, 1), ("f", "run", "m.run", 2, 1), ("g", "go", "m.go", 2, 4)], "id string, name string, qualified_name string, file_id long, start_line long")
    references = spark.createDataFrame([(1, "run"), (2, "run"), (3, "run"), (3, "go"), (3, "x")], "file_id long, reference_text string")
    found = graph.resolve(references, entities, words=True)
    # by their names, in lists; by files only the candidates
    assert plan(found).count("hashpartitioning(file_id") == 1 and "MapInArrow" in plan(found)
    told = {(r["file_id"], r["reference_text"]): (r["target_id"], r["symbol"], r["resolver"]) for r in found.collect()}
    assert told == {(1, "run"): ("e", "run", "same_file_name"), (2, "run"): ("f", "run", "same_file_name"), (3, "run"): ("e", "run", "name_only"), (3, "go"): ("g", "go", "name_only"), (3, "x"): (None, "x", "unresolved")}
    done, again = graph.resolve_changes(found, references, entities, entities.where("id <> 'g'"), words=True)
    assert [tuple(r) for r in again.collect()] == [(3, "go")]
    later = {(r["file_id"], r["reference_text"]): (r["target_id"], r["symbol"], r["resolver"]) for r in done.collect()}
    assert later == told | {(3, "go"): (None, "go", "unresolved")}


def test_bodies_are_read_for_the_heads_alone(spark):
    questions = spark.createDataFrame([(1, "alpha beta")], "query_id long, question string")
    hits = spark.createDataFrame([(1, i, 1, i + 1) for i in range(6)], "query_id long, id long, tier int, rank long")
    near = spark.createDataFrame([(1, 9, 1)], "query_id long, id long, rank long")
    records = spark.createDataFrame([(i, "s", "alpha beta" if i == 2 else "alpha") for i in range(10)], "id long, source string, body string")
    found = search.hybrid(questions, hits, near, records, 4, 4, 4)
    # capped and ranked before bodies are joined: only the last order is left
    assert plan(found).count("Window [") == 1
    assert [r["id"] for r in found.orderBy("position").collect()] == [2, 0, 9, 1]
