"""Operators on small rows made by hand."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorespark import config
from lorespark.functions import files, routing, text
from lorespark.operators import changes, code, documents, evidence, expressions, graph, lexical, neighbours, ranking
from lorespark.sources import files as file_source
from lorespark.sources import tree
from lorespark.sources.store import ConflictError, Store
from lorespark.streaming import events


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("given", "want"),
    [("HTTPServer", "http server"), ("ProjectStore v2Api", "project store v 2 api"), ("embedding_digest", ""), ("", "")],
)
def test_identifier_words(spark, given, want):
    assert one(spark, text.identifier_words("c"), given) == want


@pytest.mark.parametrize(
    ("body", "needle", "want"),
    [("call settle.", "settle", True), ("resettle", "settle", False), ("a.settle", "settle", False), ("settle.now", "settle", False), ("settle. Now", "settle", True)],
)
def test_contains_identifier(spark, body, needle, want):
    r = spark.createDataFrame([(body, needle)], "b string, n string").select(text.contains_identifier("b", "n").alias("r")).first()["r"]
    assert r is want


def test_redaction(spark):
    assert one(spark, text.redact("c"), "git https://u:p@h/x and admin:pw@db.local a/b:c@d") == "git https://h/x and db.local a/b:c@d"


def test_globs():
    import re

    assert re.match(files.glob_pattern("*.pem"), "a.pem") and not re.match(files.glob_pattern("*.pem"), "a.pemx")
    assert re.match(files.glob_pattern("[!a]?"), "bc") and not re.match(files.glob_pattern("[!a]?"), "ac")


@pytest.mark.parametrize(
    ("question", "intent", "target"),
    [
        ("", "ambiguous", None),
        ("src/a/b.py", "path_lookup", "src/a/b.py"),
        ("notes.md", "path_lookup", "notes.md"),
        ("Order.settle", "exact_symbol", "Order.settle"),
        ("who calls settle_order", "code_navigation", "settle_order"),
        ("what breaks if Order changes", "impact_analysis", "Order"),
        ("compare RetryWorker and OrderQueue", "cross_source_comparison", "RetryWorker"),
        ("what is a? what is b?", "multi_hop", None),
        ("what does the policy say", "document_fact", None),
        ("why is the sky so blue", "conceptual", None),
        ("blue sky", "ambiguous", None),
    ],
)
def test_route(spark, question, intent, target):
    r = one(spark, routing.route(F.col("c")), question)
    assert (r["intent"], r["target"]) == (intent, target)


@pytest.mark.parametrize(
    ("question", "parts"),
    [
        ("compare the A plan and the B plan on price", ["A plan price", "B plan price"]),
        ("difference between A and B?", ["A", "B"]),
        ("A vs B retries", ["A retries", "B retries"]),
        ("from intake through billing to the ledger", ["intake", "billing", "ledger"]),
        ("how do I pay? and how do I cancel?", ["how do I pay", "and how do I cancel"]),
        ("plain words", []),
        ("compare A and a", []),
    ],
)
def test_decompose(spark, question, parts):
    assert [x["text"] for x in one(spark, routing.decompose(F.col("c")), question)] == parts


def test_diff_rules(spark):
    cols = "rel_path string, size long, mtime double, content_hash string, kind string"
    scan = spark.createDataFrame([("a", 1, 1.0, "x", "code"), ("b", 2, 9.0, "y", "code"), ("c", 3, 3.0, "z", "code"), ("n1", 5, 1.0, "gone", "code"), ("n2", 5, 1.0, "gone", "code"), ("n3", 5, 1.0, "twice", "code")], cols)
    base = spark.createDataFrame([("a", 1, 1.0, "x", "code"), ("b", 2, 2.0, "y", "code"), ("c", 3, 1.0, "w", "code"), ("o1", 5, 1.0, "gone", "code"), ("o2", 5, 1.0, "twice", "code"), ("o3", 5, 1.0, "twice", "code")], cols)
    got = {r["rel_path"]: (r["decision"], r["old_path"]) for r in changes.diff(scan, base).collect()}
    assert got == {"a": ("unchanged", None), "b": ("unchanged_restat", None), "c": ("changed", None), "n1": ("moved", "o1"), "n2": ("new", None), "n3": ("new", None), "o2": ("deleted", None), "o3": ("deleted", None)}
    partial = {r["rel_path"]: r["decision"] for r in changes.diff(scan, base, complete=False).collect()}
    assert partial["o1"] == partial["o2"] == "unseen" and partial["n1"] == "new"
    racy = base.withColumn("indexed_at", F.lit(1.5))
    assert {r["rel_path"]: r["decision"] for r in changes.diff(scan, racy).collect()}["a"] == "unchanged_restat"


def test_resolution_steps(spark):
    e = spark.createDataFrame([("1", "f", "a.f", "A", 1), ("2", "g", "a.g", "A", 2), ("3", "g", "a.C.g", "A", 3), ("4", "h", "b.h", "B", 1), ("5", "h", "c.h", "C", 1)], "id string, name string, qualified_name string, file_id string, start_line long")
    r = spark.createDataFrame([("A", "a.f"), ("A", "f"), ("A", "g"), ("A", "b.h"), ("A", "x.h"), ("A", "none")], "file_id string, reference_text string")
    got = {x["reference_text"]: (x["target_id"], x["resolver"], x["confidence"], x["symbol"]) for x in graph.resolve(r, e).collect()}
    assert got["a.f"][:3] == ("1", "same_file_qualified", "exact")
    assert got["f"][:3] == ("1", "same_file_name", "exact")
    assert got["g"][:3] == ("3", "same_file_name_ambiguous", "high")
    assert got["b.h"][:3] == ("4", "cross_file_qualified", "high")
    assert got["x.h"] == ("4", "name_only", "medium", "h")
    assert got["none"][:3] == (None, "unresolved", "medium")


def test_bfs_handles_cycles_and_self_edges(spark):
    e = spark.createDataFrame([("1", "a", "b", "calls"), ("2", "b", "a", "calls"), ("3", "b", "c", "calls"), ("4", "c", "c", "calls")], "id string, source_id string, target_id string, type string")
    s = spark.createDataFrame([("a",), ("zz",)], "start string")
    assert sorted(map(tuple, graph.bfs(e, s, 5).collect())) == [("a", "b", 1), ("a", "c", 2)]
    assert {r["id"] for r in graph.walk(e, s, 3).collect()} == {"1", "2", "3", "4"}


def test_check_answer(spark):
    valid = F.array(F.lit("E1"), F.lit("E2"))
    ask = lambda t: one(spark, evidence.check_answer(F.col("c"), valid), t)["status"]
    assert ask("It is so [E1].") == "grounded"
    assert ask("It is so [E7].") == "ungrounded"
    assert ask("It is so [E1]. But this sentence of many words cites nothing at all.") == "partially_grounded"
    assert ask("There is not enough evidence to answer this question here.") == "grounded"


def test_mmr_prefers_the_different(spark):
    h = spark.createDataFrame([(1, 10, 1, ["a", "b"]), (1, 11, 2, ["a", "b"]), (1, 12, 3, ["c", "d"])], "query_id long, id long, rank long, tokens array<string>")
    assert [r["id"] for r in ranking.mmr(h, "query_id").orderBy("position").collect()] == [10, 12, 11]


def test_budget_skips_what_does_not_fit(spark):
    items = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(s).alias("n")) for i, s in enumerate([50, 60, 30, 30])))
    assert [x["id"] for x in one(spark, ranking.within_budget(items, lambda x: x["n"], 100, 3), "x")] == [0, 2]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_code_recall(spark, sf):
    """Of the neighbours nine tenths are among the few that are scored exactly."""
    e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = e.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    want = {(r["query_id"], r["id"]) for r in neighbours.exact(e, q, 10).collect()}
    index = neighbours.codes(e)
    got = {(r["query_id"], r["id"]) for r in neighbours.approximate(index, e, q, 10).collect()}
    assert len(want & got) / len(want) >= 0.9 and index.count() == e.count()


def test_neighbours_within_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 3)
    monkeypatch.setattr(neighbours, "VECTOR_BLOCK", 5)
    rows = [(i, [float(i % 4), 1.0, float(i % 3)], i % 2) for i in range(40)]
    e = spark.createDataFrame([*rows, (99, None, 0)], "id long, embedding array<double>, half int")
    got = sorted((r["query_id"], r["half"], r["rank"], r["id"], r["score"]) for r in neighbours.exact(e, e.where("id < 7").withColumnRenamed("id", "query_id"), 3, "half").collect())
    want = []
    for i, v, _ in rows[:7]:
        for h in (0, 1):
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w, g in rows if g == h)[:3]
            want += [(i, h, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_index_is_built_once_and_again_for_other_files(spark, tmp_path):
    from lorespark import shared
    from lorespark.operators import lexical

    d = f"{tmp_path}/docs"
    made = []
    spark.createDataFrame([(1, "a b b"), (2, "b c")], "doc_id long, text string").write.parquet(d)
    q = spark.createDataFrame([(7, ["b", "c"])], "query_id long, terms array<string>")

    def hits():
        scan = spark.read.parquet(d)
        path = shared.built(scan, "test-index", lambda p: (made.append(p), lexical.Index.build(scan, "doc_id", {"text": 1}, p)))
        return [r["doc_id"] for r in lexical.Index(spark, path, "doc_id").search(q, 5).orderBy("rank").collect()]

    assert hits() == hits() == [2, 1] and len(made) == 1
    spark.createDataFrame([(3, "c c c")], "doc_id long, text string").write.mode("append").parquet(d)
    assert sorted(hits()) == [1, 2, 3] and len(made) == 2


def test_links_by_file_and_route(spark):
    from lorespark.operators import graph

    units = spark.createDataFrame([(1, 0, "see my-utils.py and app.core."), (1, 1, "GET /api/orders/{id}. and my-utils"), (2, 0, "/api/orders1 core..x my-utils.pyc")], "document_id long, ordinal long, body string")
    names = spark.createDataFrame([("n1", "src/my-utils.py"), ("n2", "src/core")], "id string, path string")
    routes = spark.createDataFrame([("r1", "http_endpoint:GET:/api/orders/{id}"), ("r2", "http_endpoint:GET:/api/orders"), ("r3", "calls")], "id string, symbol string")
    none = spark.createDataFrame([], "id string, name string, qualified_name string")
    got = sorted((r["entity_id"], r["document_id"], r["ordinal"], r["resolver"].split(":")[1]) for r in graph.link(none, units, 5, names, routes).collect())
    assert got == [("n1", 1, 0, "filename"), ("n1", 1, 1, "filename"), ("n2", 2, 0, "filename"), ("r1", 1, 1, "route_heuristic"), ("r2", 1, 1, "route_heuristic")]


def test_identifiers_are_what_contains_identifier_finds(spark):
    from lorespark.functions import text

    bodies = ["a.b c", ".a b.", "a..b", "x.a.b y", "a.b.", "ab a_b a1", "(a) a.b,c"]
    needles = ["a", "b", "a.b", "c", "x.a.b", "a1"]
    df = spark.createDataFrame([(b, n) for b in bodies for n in needles], "body string, needle string")
    for r in df.select("*", text.contains_identifier("body", F.col("needle")).alias("x"), F.array_contains(text.identifiers("body"), F.col("needle")).alias("y")).collect():
        assert r["x"] == r["y"], r



def test_html_and_markdown():
    title, units = documents.html_units("<title>T</title><nav>n</nav><h1>A</h1><p>one <b>two</b></p><script>x</script><table><tr><th>a</th><td>b</td></tr><tr><td>c</td></tr></table><p>end")
    assert title == "T" and units == [("heading", 1, "A"), ("paragraph", 0, "one two"), ("table", 0, "a | b\nc"), ("paragraph", 0, "end")]
    assert documents.markdown_units("# A\n\ntext\nmore\n\n| a | b |\n|---|---|\n| c | d |\n")[1] == [("heading", 1, "A"), ("paragraph", 0, "text more"), ("table", 0, "a | b\nc | d")]


def test_email_parts():
    from email.message import EmailMessage

    m = EmailMessage()
    m["Subject"] = "S"
    m.set_content("one\n\ntwo\n")
    m.add_attachment(b"abc", maintype="application", subtype="octet-stream", filename="a.bin")
    subject, units, found = documents.email_parts(m.as_bytes())
    assert subject == "S" and [u[2] for u in units] == ["one", "two"] and [(f[0], f[1], f[3]) for f in found] == [(0, "a.bin", 3)]


def test_docx():
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>body</w:t></w:r></w:p></w:body></w:document>')
    assert documents.convert(buffer.getvalue(), "docx")[1] == [("heading", 1, "Top"), ("paragraph", 0, "body")]


@pytest.mark.parametrize("most", [24, 64, 256])
def test_chunks_fit_and_cover(most):
    words = [f"w{i}" for i in range(900)]
    body = " ".join(w + ("." if i % 17 == 0 else "") for i, w in enumerate(words))
    out = documents.chunk_document("Title", [("heading", [], "Head"), ("paragraph", ["Head"], body), ("table", ["Head"], "a | b\n" + "\n".join(f"{i} | x" for i in range(200)))], most, most // 4, most // 8, 4)
    assert all(c[4] <= most - 4 for c in out)
    seen = " ".join(c[2] for c in out if c[0] == "paragraph")
    assert set(words) <= set(seen.replace(".", "").split())


def test_small_neighbours_are_evened_out():
    word = lambda k: f"w{k}"
    # greedy packing gives 4 + 4 + 1; the last two are evened out, and so is any other pair with a small one
    assert [len(c.split()) for c in documents.pack([word(k) for k in range(9)], 4, 0, 3)] == [4, 3, 2]
    assert [len(c.split()) for c in documents.pack(["a", "b c d e", "f g h i"], 4, 0, 3)] == [1, 4, 4]
    assert [c for c in documents.pack([word(k) for k in range(6)], 4, 2, 1)] == ["w0 w1 w2 w3", "w2 w3 w4 w5"]
    left, right = documents.halves([("a", 5), ("b", 1), ("c", 1)])
    assert [p for p, _ in left] == ["a"] and [p for p, _ in right] == ["b", "c"]
    assert documents.halves([("a", 5)]) == ([("a", 5)], [])


def test_broken_file_becomes_a_row(spark):
    f = spark.createDataFrame([(1, bytearray(b"not a zip"), "docx"), (2, bytearray(b"# A\n\nx"), "markdown")], "k long, body binary, kind string")
    got = documents.units(f, "k", "body", "kind").collect()
    assert {(r["k"], r["kind"]) for r in got} == {(1, "error"), (2, "heading"), (2, "paragraph")}
    assert [r["headings"] for r in got if r["k"] == 2 and r["kind"] == "paragraph"] == [["A"]]


def test_python_facts():
    f = code.python_facts("import os\n@app.get('/x')\nclass A(B):\n    def m(self):\n        return g(os.getcwd())\n")
    assert ("class", "A", "A", "", 3) in f and ("method", "m", "A.m", "A", 4) in f and ("base", "B", "B", "A", 3) in f and ("call", "g", "g", "A.m", 5) in f and ("decorator", "app.get", "app.get('/x')", "A", 2) in f


def test_code_that_does_not_parse():
    assert code.facts("def (", "python")[0][0] == "error" and code.facts("class A { (", "java")[-1][0] == "error" and code.facts("}", "go")[0][0] == "error"
    assert code.facts("whatever", "cobol") == [] and code.facts("", "rust") == []


def test_store_publishes_and_restores(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    rows = lambda *v: spark.createDataFrame([(x, x * 2) for x in v], "id long, v long")
    a = s.begin("s1")
    s.write("t", "s1", a, rows(1, 2))
    s.publish("s1", a)
    b = s.begin("s1")
    s.write("t", "s1", b, rows(3))
    assert sorted(r["id"] for r in s.read("t").collect()) == [1, 2]
    assert [r["build_id"] for r in s.resumable("s1").collect()] == [b]
    s.backup(["t"], f"file://{tmp_path}/copy")
    s.publish("s1", b)
    assert [r["id"] for r in s.read("t").collect()] == [3]
    merged = s.copy_forward("t", "s1", "x", rows(3, 4), ["id"])
    assert sorted(r["id"] for r in merged.collect()) == [3, 4]
    assert s.collect_garbage(["t"]) == 1
    s.restore(f"file://{tmp_path}/copy")
    assert sorted(r["id"] for r in s.read("t").collect()) == [1, 2]


def test_two_publishers_from_one_generation(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "id long")
    one, other = s.begin("s1"), s.begin("s1")
    for b, v in ((one, 2), (other, 3)):
        s.write("t", "s1", b, rows(v))
        s.write("u", "s1", b, rows(v * 10))
    assert s.publish("s1", one) == 1
    pinned = s.snapshot()
    with pytest.raises(ConflictError):
        s.publish("s1", other)
    assert [r["id"] for r in s.read("t").collect()] == [2] and s.resumable("s1").count() == 0
    # a reader keeps its generation in every table while others publish
    third = s.begin("s1")
    s.write("t", "s1", third, rows(4))
    s.write("u", "s1", third, rows(40))
    assert s.publish("s1", third) == 2
    assert [[r["id"] for r in s.read(t, pinned).collect()] for t in ("t", "u")] == [[2], [20]]
    assert [[r["id"] for r in s.read(t).collect()] for t in ("t", "u")] == [[4], [40]]
    assert not s.fresh("s1", pinned["s1"]) and s.fresh("s1", 2)
    assert s.collect_garbage(["t", "u"], keep=2) == 2 and [r["id"] for r in s.read("t", pinned).collect()] == [2]
    with pytest.raises(ValueError, match="no build"):
        s.publish("s1", "unknown")


def test_folder_scan(spark, tmp_path):
    for n, body in (("a.py", "x"), ("sub/b.md", "# b"), ("node_modules/c.js", "c"), ("id_rsa", "k"), ("d.log", "l"), ("sub/deep/e.tmp", "t"), ("sub/deep/f.txt", "f"), ("keep.log", "k"), (".gitignore", "# c\n*.tmp\nprivate/\n"), ("private/g.txt", "g")):
        (tmp_path / n).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / n).write_text(body)
    (tmp_path / "link.txt").symlink_to(tmp_path / "a.py")
    # a file that no one could read whole, in a folder that is left out
    with open(tmp_path / "node_modules/huge.bin", "wb") as f:
        f.truncate(3 << 30)
    root = f"file://{tmp_path}"
    found = file_source.scan(spark, root, "s", ["*.log"], ["keep.log"])
    names = ["a.py", "sub/b.md", "sub/deep/f.txt", "keep.log", ".gitignore"]
    assert sorted(r["rel_path"] for r in found.collect()) == sorted(names)
    assert {(r["rel_path"], r["kind"], r["language"]) for r in found.collect()} >= {("a.py", "code", "python"), ("sub/b.md", "document", None)}
    assert sorted(r["rel_path"] for r in file_source.scan(spark, root, "s", ["*.log"], max_bytes=1).collect()) == ["a.py", "sub/deep/f.txt"]
    got = {r["rel_path"]: (r["content_hash"], bytes(r["content"])) for r in file_source.read(found, root).collect()}
    assert got["a.py"] == (hashlib.sha256(b"x").hexdigest(), b"x") and len(got) == 5
    assert "content" not in file_source.read(found, root, content=False).columns
    hit, missing = file_source.only(found, spark.createDataFrame([("sub/",), ("zz",)], "rel_path string"))
    assert sorted(r["rel_path"] for r in hit.collect()) == ["sub/b.md", "sub/deep/f.txt"] and [r["asked"] for r in missing.collect()] == ["zz"]
    assert file_source.accessible(spark, root) and not file_source.accessible(spark, f"{root}/none")


def test_folder_scan_opens_and_lists_only_what_is_left(tmp_path, monkeypatch):
    for n in ("a.py", "node_modules/c.js", "node_modules/x/d.js", "sub/target/e.o", "sub/f.txt", "sub/x/g.txt"):
        (tmp_path / n).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / n).write_text(n)
    listed, real = [], tree.TreeReader._list
    monkeypatch.setattr(tree.TreeReader, "_list", lambda self, store, base, folder, ignored: (listed.append(folder), real(self, store, base, folder, ignored))[1])
    for spread in (1, 2, 64):
        listed.clear()
        reader = tree.TreeReader({"path": str(tmp_path), "spread": str(spread)})
        rows = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
        assert sorted(r["rel_path"] for r in rows) == ["a.py", "sub/f.txt", "sub/x/g.txt"] and {*listed} == {"", "sub", "sub/x"}


def test_folder_scan_tells_what_it_cannot_read(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a")
    (tmp_path / "b.txt").write_text("b")
    found = file_source.scan(spark, f"file://{tmp_path}", "s").collect()
    (tmp_path / "b.txt").unlink()
    rows = spark.createDataFrame(found, file_source.scan(spark, f"file://{tmp_path}", "s").schema)
    got = {r["rel_path"]: (r["error"] is None, r["content_hash"]) for r in file_source.read(rows, f"file://{tmp_path}").collect()}
    assert got == {"a.txt": (True, hashlib.sha256(b"a").hexdigest()), "b.txt": (False, None)}
    reader = tree.TreeReader({"path": str(tmp_path / "none")})
    rows = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert len(rows) == 1 and rows[0]["error"]


def test_only_hash_candidates_are_opened(spark, tmp_path):
    import os

    root = f"file://{tmp_path}"
    for n in ("same.txt", "touched.txt", "grown.txt", "gone.txt"):
        (tmp_path / n).write_text(n)
    before = file_source.read(file_source.scan(spark, root, "s"), root, content=False).collect()
    before = spark.createDataFrame(before, file_source.read(file_source.scan(spark, root, "s"), root, content=False).schema)
    at = os.stat(tmp_path / "same.txt").st_mtime_ns
    # other bytes of the same size and time: were it opened, its hash would be another
    (tmp_path / "same.txt").write_text("SAME.txt")
    os.utime(tmp_path / "same.txt", ns=(at, at))
    os.utime(tmp_path / "touched.txt", ns=(at + 10**10, at + 10**10))
    (tmp_path / "grown.txt").write_text("grown.txt and more")
    (tmp_path / "gone.txt").unlink()
    (tmp_path / "new.txt").write_text("new")
    got = {r["rel_path"]: r["content_hash"] for r in file_source.hashed(file_source.scan(spark, root, "s"), before, root).collect()}
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {"same.txt": h("same.txt"), "touched.txt": h("touched.txt"), "grown.txt": h("grown.txt and more"), "new.txt": h("new")}


def test_split_table_keeps_its_cells():
    rows = ["h1 | h2", *(" | ".join(f"cell{i * 7 + j} word" for j in range(6)) for i in range(4)), "short | row", "one cell that is far too long for any chunk of this size by itself | x"]
    for most in (6, 8, 12, 20, 60):
        parts = documents.split_table("\n".join(rows), most)
        assert all(p.split("\n")[0] == rows[0] for p in parts)
        body = [line for p in parts for line in p.split("\n")[1:]]
        words = lambda lines: " ".join(lines).replace("|", " ").split()
        assert words(body) == words(rows[1:])
        assert all(len(documents._tokens(p)) <= most for p in parts)
        # pieces of a row, put together at their cells, are the row
        text, at = " | ".join(body), 0
        for r in rows[1:-1]:
            assert text[at:].startswith(r)
            at += len(r) + 3


def test_any_text_becomes_an_expression(spark):
    texts = ['a OR b', '"x" AND (', "--", "", 'say "hi there" now*', "AND", "un*ter OR ( a.b"]
    got = {r["t"]: r["e"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", expressions.safe("t").alias("e")).collect()}
    assert got["a OR b"] == '"a" AND "OR" AND "b"' and got["--"] is None and got[""] is None
    for t, e in got.items():
        if e is not None:
            found = [w for kind, v in expressions.leaves(expressions.parse(e)) for w in (v if kind == "phrase" else [v])]
            assert found == re.findall(r"\w+", t.lower()), t


def test_put_setting():
    s = config.load(None, {})
    config.put(s, "search.limit", "9")
    assert config.get(s, "search.limit") == 9
    for path, value in (("search.none", 1), ("search.limit", "many"), ("search", 3)):
        with pytest.raises(ValueError):
            config.put(s, path, value)


def test_settings(tmp_path):
    p = tmp_path / "s.yaml"
    p.write_text("search:\n  limit: 5\n  rerank: yes\n")
    s = config.load(str(p), {"LORESPARK_SEARCH__LIMIT": "7", "LORESPARK_INDEXING__EXCLUDE": "a, b"})
    assert (config.get(s, "search.limit"), s.search.rerank, s.indexing.exclude) == (7, True, ["a", "b"])
    with pytest.raises(ValueError, match="search.limit"):
        config.load(None, {"LORESPARK_SEARCH__LIMIT": "many"})


def test_request_folding():
    out, status, paths, until = events.fold_requests(iter([(0, "a"), (5, "b"), (6, "c"), (30, "d")]), "idle", set(), 0, 10, 3)
    assert out == [(0, 1, 0), (10, 2, 0), (30, 1, 0)] and status == "running" and until == 40
    out, *_ = events.fold_requests(iter([(0, "a"), (1, "b"), (2, "c"), (25, "x")]), "idle", set(), 0, 10, 1)
    assert out[1] == (10, 0, 1)


def test_coalescing_stream(spark, tmp_path):
    rows = [(1, pd.Timestamp("2024-01-01 00:00:00"), "a"), (1, pd.Timestamp("2024-01-01 00:00:01"), "b"), (2, pd.Timestamp("2024-01-02 00:00:00"), "c")]
    spark.createDataFrame(pd.DataFrame(rows, columns=["user", "ts", "path"])).write.parquet(f"{tmp_path}/in")
    e = spark.read.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in").withWatermark("ts", "1 second")
    out = events.coalesce_stream(s, "user", "ts", "path", 10_000, 3)
    out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    # the first user's follow-up runs ten seconds later, once the second user's day has moved the watermark
    base = 1704067200000
    assert sorted(map(tuple, got.collect())) == [("1", base, 1, 0), ("1", base + 10_000, 1, 0), ("2", base + 86_400_000, 1, 0)]


def test_exact_path(spark):
    r = spark.createDataFrame([("ml/src/Ann.rs", "ann.rs"), ("ml/src/ann.rs", ".\\src/ann.rs"), ("a/xann.rs", "ann.rs"), ("a", "")], "p string, q string")
    assert [x["r"] for x in r.select(lexical.is_exact_path(r.p, r.q).alias("r")).collect()] == [True, True, False, False]


@pytest.mark.parametrize(
    ("expression", "want"),
    [("a AND b", {1}), ("a OR c", {1, 2, 3}), ('"a b"', {1}), ('"b a"', set()), ("a AND (b OR c*)", {1, 3}), ("cd", set()), ("c* AND d", {2})],
)
def test_expressions(spark, expression, want):
    from lorespark.operators import expressions

    d = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "a cx c"), (4, "")], "k long, body string")
    assert {r["k"] for r in expressions.matches(d, "k", "body", expressions.parse(expression)).collect()} == want


@pytest.mark.parametrize("bad", ["", "a AND", "(a", "a)", "AND a", "a b"])
def test_bad_expressions(bad):
    from lorespark.operators import expressions

    with pytest.raises(ValueError):
        expressions.parse(bad)


def test_embedding_is_cached(spark):
    from lorespark.operators import embedding

    calls = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, " "), (4, "c")], "id long, text string")
    empty = spark.createDataFrame([], "text_hash string, fingerprint string, embedding array<float>")
    rows, fresh = embedding.build(calls, empty, embedding.hashing_model(8), "m")
    assert {r["id"] for r in rows.collect()} == {1, 2, 4} and fresh.count() == 2
    cache = spark.createDataFrame(fresh.collect(), "text_hash string, embedding array<float>, fingerprint string")
    assert embedding.build(calls, cache, embedding.hashing_model(8), "m")[1].count() == 0
    assert embedding.build(calls, cache, embedding.hashing_model(8), "other")[1].count() == 2


def test_retry_and_uptime(spark):
    r = spark.range(0, 6).select(changes.backoff(F.col("id")).alias("w"), text.uptime(F.col("id") * 4000).alias("u"), text.percentage(F.col("id").cast("double"), F.lit(4.0)).alias("p")).collect()
    assert [x["w"] for x in r] == [2.0, 2.0, 4.0, 8.0, 16.0, None]
    assert [x["u"] for x in r][:3] == ["0s", "1h 6m", "2h 13m"] and [x["p"] for x in r] == [0.0, 25.0, 50.0, 75.0, 100.0, 100.0]


def test_times(spark):
    t = spark.createDataFrame([("1704067200000",), ("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00",), ("never",), ("",), ("9" * 40,)], "c string")
    assert [r["t"] for r in t.select(text.parse_time("c").cast("long").alias("t")).collect()] == [1704067200] * 3 + [None] * 3
