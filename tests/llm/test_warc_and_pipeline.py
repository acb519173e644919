"""WARC archives and the corpus pipeline."""

from __future__ import annotations

import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorespark.llm import _spark, registry, warc_zip

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("zip64", [False, True])
def test_warc(spark, zip64):
    big, small = "é" * 600, "x" * 900
    pages = [(1, "http://a/1", big), (2, "http://a/2", big), (3, "http://a/3", small), (4, "http://a/4", small), (5, None, None), (6, "http://a/6", ""), (7, "u\r\nX: y", "line\r\n\r\nWARC/1.1\r\n"), (8, "http://a/8", "z" * 300_000), (9, "http://a/9", big), (9, "http://a/9", big), (None, "n", big)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string")
    manifest = warc_zip.write(df, force_zip64=zip64)
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"]) if r["payload"] is not None else None) for r in warc_zip.read(manifest).collect())
    want = []
    for i, _, h in pages:
        if i is None:
            continue
        body = (h or "").encode()
        best = max((j for j, _, x in pages if j is not None and (x or "").encode() == body), default=i) if len(body) >= 1000 else i
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "response" if best == i else "revisit", None if best == i else best, body if best == i else None))
    assert sorted(got, key=str) == sorted(want, key=str)
    for r in manifest.collect():
        with zipfile.ZipFile(r["path"].removeprefix("file://")) as z:
            assert z.testzip() is None and {m.compress_type for m in z.infolist()} == {zipfile.ZIP_STORED}
    assert warc_zip.read(warc_zip.write(df.where("false"))).count() == 0


def test_warc_query_with_revisits(spark, tmp_path):
    """The registered query over a table of which most pages are copies."""
    body = {k: ("<p>é" + str(k)) * n for k, n in ((0, 400), (1, 250), (2, 100), (3, 0))}
    rows = [(i, f"http://h/{i}", body[0] if i % 3 else body[i % 4]) for i in range(240)] + [(500, "u", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: tuple(r)[1:] for r in registry.op8_warc_zip(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()}
    raw = {i: (h or "").encode() for i, _, h in rows}
    last = {b: max(i for i in raw if raw[i] == b) for b in raw.values()}
    want = {}
    for i, b in raw.items():
        again = len(b) >= 1000 and last[b] != i
        want[i] = (len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last[b] if again else None)
    assert got == want and sum(w[2] == "revisit" for w in want.values()) > 150


def test_warc_reads_ranges_only(spark, monkeypatch):
    manifest = warc_zip.write(spark.createDataFrame([(i, "u", str(i) * 5000) for i in range(50)], "page_id long, url string, html string"))
    row = max(manifest.collect(), key=lambda r: r["records"])
    read = []
    whole = warc_zip._files.RangeReader.read
    monkeypatch.setattr(warc_zip._files.RangeReader, "read", lambda s, o, n: (read.append(n), whole(s, o, n))[1])
    heads = [h["x-page-id"] for h, _ in warc_zip.records(row["path"], 1, 3)]
    assert len(heads) == min(2, row["records"] - 1)
    assert max(read[1:]) < 22 + 65535


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in _spark.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100}
    assert _spark.components(edges.where("false")).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = _spark.written(stage(spark, docs, SF), name)
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert ids <= before and ids
        if name == "toxicity":
            scored = registry.op6_toxicity(spark, SF)
            assert ids == {r["doc_id"] for r in scored.where("predicted = 0").collect()}
        if name == "ngram_join":
            from lorespark.llm import ngram_join

            links = ngram_join.ngram_join(docs)
            assert ids == {r["doc_id"] for r in links.where("doc_id = component_id").collect()}
        if name == "decontaminate":
            bad = registry.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated")
            assert before - ids == {r["doc_id"] for r in bad.collect()}
        if name == "sentencepiece":
            want = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in registry.piece_digests(docs).collect()}
            assert {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect()} == want
        else:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert out.where(F.length("text") != F.col("n_chars")).count() == docs.where(F.length("text") != F.col("n_chars")).count()
        seen.append(name)
        docs = out
    assert seen == ["toxicity", "ngram_join", "suffix_dedup", "decontaminate", "sentencepiece"]


def test_pipeline_keeps_clean_rows_of_a_contaminated_id(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame([(1, item, "en", "s", len(item)), (1, "a clean row", "en", "s", 11), (2, "another", "en", "s", 7)], schema)
    assert {r["text"] for r in corpus_pipeline.drop_contaminated(spark, docs, SF).collect()} == {"a clean row", "another"}


def test_pipeline_keeps_one_of_equal_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, a), (1, a), (2, a), (3, b), (3, "an other text of the same id"), (None, a), (None, a), (4, None), (4, None), (5, ""), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)
    out = corpus_pipeline.drop_near_duplicates(spark, _spark.written(docs, "docs"), SF)
    want = [(1, a), (3, "an other text of the same id"), (3, b), (None, a), (None, a), (4, None), (5, ""), (6, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted(want, key=repr)


def brute_pipeline(spark):
    """The pipeline's rows by plain loops, but for the learned toxicity scores, which op6 gives."""
    import re
    from collections import defaultdict

    import sentencepiece

    word, alnum = re.compile(r"[^\x20\x09-\x0d]+"), re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    toxic = {r["doc_id"] for r in registry.op6_toxicity(spark, SF).where("predicted = 1").collect()}
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r["doc_id"] not in toxic}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in docs.items():
        w = word.findall(t.translate(lower))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(docs):
        for b in sorted(docs):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    docs = {i: t for i, t in docs.items() if find(i) == i}
    held = defaultdict(set)
    words = {i: word.findall(t) for i, t in docs.items()}
    for i, w in words.items():
        for j in range(len(w) - 49):
            held[tuple(w[j : j + 50])].add(i)
    for i, w in words.items():
        drop = {j + k for j in range(len(w) - 49) if min(held[tuple(w[j : j + 50])]) < i for k in range(50)}
        if drop:
            docs[i] = " ".join(x for k, x in enumerate(w) if k not in drop) if len(drop) < len(w) else None
    docs = {i: t for i, t in docs.items() if t is not None}
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = alnum.findall((r["text"] or "").encode().translate(fold))
        windows |= {tuple(w[j : j + 13]) for j in range(max(1, len(w) - 12) if w else 0)}
    sp = sentencepiece.SentencePieceProcessor(model_file=registry.tokenizer_path("piece_bpe_32k.model"))
    out = {}
    for i, t in docs.items():
        w = alnum.findall(t.encode().translate(fold))
        hit = {j + k for n in {len(x) for x in windows} for j in range(len(w) - n + 1) if tuple(w[j : j + n]) in windows for k in range(n)}
        if not hit or 20 * len(hit) < len(w):
            out[i] = word.findall(sp.decode([*sp.encode(t), 2]))
    return out


def test_pipeline_against_brute_force(spark):
    """Words, as cutting may leave other white space than joining does."""
    import re

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=registry.tokenizer_path("piece_bpe_32k.model"))
    got = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0d]+", sp.decode(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == brute_pipeline(spark) and got


def test_pipeline_takes_odd_rows(spark):
    rows = [(None, "a b c", "en", "s", 5), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "same text here now ok", "en", "s", 20), (3, "same text here now ok", "en", "s", 20)]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        given = docs.count()
        for _, stage in corpus_pipeline.STAGES:
            docs = _spark.written(stage(spark, docs, SF), "odd")
        # of the two equal rows one stays
        assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in docs.collect()) == ([("1", 1), ("2", 1), ("3", 6), ("None", 4)] if given else [])
