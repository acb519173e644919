"""Results stay whole where the work is dealt out: equal rows, ties, titles that many share, needles with signs, small parts of an index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lorespark.operators import documents, graph, lexical, postings, search


def test_equal_records_leave_a_part_no_more_than_k_at_a_time():
    keys, scores = np.arange(5000), np.ones(5000)
    kept, told = postings.first(keys, scores, 10)
    assert kept.tolist() == list(range(10)) and told.tolist() == [1.0] * 10


def test_merging_opens_blocks_in_pieces(monkeypatch):
    sizes = []
    opened = postings.opened
    monkeypatch.setattr(postings, "opened", lambda t, fields: sizes.append(len(t)) or opened(t, fields))
    monkeypatch.setattr(postings, "MERGED", 2000)
    words = pa.table({"part": pa.array([0] * 400, pa.int32()), "key": list(range(400)), "w0": [["a", f"b{i % 50}", f"c{i}"] for i in range(400)]})
    made = [b for batch in words.to_batches(100) for b in postings.invert(1, np.array([1.0]))(iter([batch]))]
    rows = pa.Table.from_batches(made).sort_by([("part", "ascending"), ("term", "ascending"), ("low", "ascending")]).combine_chunks()
    out = pa.Table.from_batches(list(postings.merge(1, np.array([1.0]))(iter(rows.to_batches()))))
    assert max(sizes) < rows.num_rows / 4
    assert {t: n for t, n in zip(out["term"].to_pylist(), out["n"].to_pylist()) if t[0] == "b"} == {f"b{i}": 8 for i in range(50)}
    assert sum(n for t, n in zip(out["term"].to_pylist(), out["n"].to_pylist()) if t == "a") == 400 and out.num_rows == 4 + 50 + 400


def test_pairs_of_a_value_that_many_share(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PAIR_ROWS", 7)
    rows = spark.createDataFrame([(i, "x" if i < 60 else f"y{i // 2}") for i in range(80)] + [(99, None), (98, None)], "id long, t string")
    got = sorted(map(tuple, lexical.equal_pairs(rows, "t", "id", "other").collect()))
    assert got == sorted([(i, j) for i in range(60) for j in range(i + 1, 60)] + [(i, i + 1) for i in range(60, 80, 2)])


def test_resolution_has_a_row_a_reference_without_a_join_on_every_candidate(spark):
    entities = spark.createDataFrame([(f"{f}", "run", f"m{f}.run", f, 1) for f in range(50)], "id string, name string, qualified_name string, file_id long, start_line long")
    references = spark.createDataFrame([(f, "run") for f in range(60)], "file_id long, reference_text string")
    for words in (False, True):
        r = graph.resolve(references, entities, words)
        got = {x["file_id"]: (x["target_id"], x["resolver"]) for x in r.collect()}
        assert got == {f: (f"{f}", "same_file_name") if f < 50 else ("0", "name_only") for f in range(60)}


def test_needles_with_signs_are_found_without_the_texts_in_a_shuffle(spark):
    units = spark.createDataFrame([(1, 0, "a my-utils.py, x.my-utils my-utils.p my-utils. é́my-utils"), (2, 0, "my-utilsé my-utils.py.x")], "document_id long, ordinal long, body string")
    wanted = spark.createDataFrame([("n", "my-utils", "r", "c", "k"), ("m", "my-utils.py", "r", "c", "k"), ("o", "--", "r", "c", "k")], "entity_id string, needle string, resolver string, confidence string, type string")
    hits = graph._other_hits(wanted, units)
    assert sorted((h["entity_id"], h["document_id"]) for h in hits.collect()) == [("m", 1), ("n", 1)]
    assert "body" not in [c for line in hits._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line for c in line.split()]


def test_tiers_send_no_more_than_twice_the_limit_a_question(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "PART_RECORDS", 100)
    records = spark.createDataFrame([(i, "alpha beta" if i % 3 else f"alpha gamma w{i}") for i in range(400)], "doc_id long, text string")
    index = lexical.Index.build(records, "doc_id", {"text": 1}, f"file://{tmp_path}/index")
    sent = []
    written = search.shared.written
    monkeypatch.setattr(search.shared, "written", lambda df, name: (sent.append(out.count()) if name == "hits" else None, out)[1] if (out := written(df, name)) is not None else None)
    questions = spark.createDataFrame([(1, "what is alpha beta"), (2, "alpha gamma")], "query_id long, question string")
    got = search.tiered(index, questions, 5).collect()
    assert sorted((r["query_id"], r["doc_id"], r["tier"]) for r in got) == sorted([(1, i, 1) for i in (1, 2, 4, 5, 7)] + [(2, i, 0) for i in (0, 3, 6, 9, 12)])
    assert sent and max(sent) <= 2 * 2 * 5


def test_documents_are_converted_and_chunked_in_pieces(spark):
    rows = [{"k": i, "t": "x" * 30_000} for i in range(200)]
    sizes = [len(p) for p in documents._pieces(iter([pa.RecordBatch.from_pylist(rows)]))]
    assert sum(sizes) == 200 and max(sizes) <= documents.PIECE // 30_000 + 1
    pages = spark.createDataFrame([(1, "<h1>A</h1><p>one two</p>", "html"), (2, None, "html")], "id long, html string, kind string")
    got = documents.chunk(documents.units(pages, "id", "html", "kind"), "id").orderBy("id", "ordinal").collect()
    assert [(r["id"], r["kind"], r["body"], r["headings"]) for r in got if r["id"] == 1] == [(1, "heading", "A", []), (1, "paragraph", "one two", ["A"])]
