"""The stored full-text index against plain loops: blocks, MaxScore, phrases, prefixes, upkeep by segments, generations."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from lorespark import shared
from lorespark.operators import expressions, lexical, postings
from lorespark.sources import generations

RECORDS = "doc_id long, text string"


def words(rng, n):
    # a few very frequent words, many rare ones
    return " ".join(f"w{min(int(rng.expovariate(0.15)), 60)}" if rng.random() < 0.9 else f"rare{rng.randrange(400)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    out = {i * 3 - 50: words(rng, rng.choice([0, 1, 3, 20, 60, 200])) for i in range(900)}
    out[7] = "W1 w2, w1 -- w2 w3 é_x"
    out[10**15] = "w1 w2"
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), RECORDS)


def ranked(texts, terms, k, fields=None):
    """Plain BM25 over {key: text}."""
    held = {i: (t or "").lower().replace(",", " ").replace("-", " ").split() for i, t in texts.items()}
    mean, total = sum(map(len, held.values())) / len(held), len(held)
    scores = {}
    for t in dict.fromkeys(terms):
        having = {i: w.count(t) for i, w in held.items() if t in w}
        raw = math.log((total - len(having) + 0.5) / (len(having) + 0.5)) if having else 0
        for i, f in having.items():
            scores[i] = scores.get(i, 0) + (raw if raw > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(held[i]) / mean))
    best = sorted((-round(s, 6), i) for i, s in scores.items())[:k]
    return [(i, -s, r + 1) for r, (s, i) in enumerate(best)]


QUERIES = {1: ["w0", "w5"], 2: ["rare3", "w0", "w1", "w2"], 3: ["nothing"], 4: ["rare7"], 5: ["w40", "w41", "rare9", "w0", "w0"]}


def asked(spark, queries=QUERIES):
    return spark.createDataFrame(list(queries.items()), "query_id long, terms array<string>")


def check(spark, index, texts, k=10, queries=QUERIES):
    got = {}
    for r in index.search(asked(spark, queries), k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"], r["rank"]))
    for q, terms in queries.items():
        want = ranked(texts, terms, k)
        assert [(i, r) for i, _, r in got.get(q, [])] == [(i, r) for i, _, r in want]
        assert np.allclose([s for _, s, _ in got.get(q, [])], [s for _, s, _ in want], atol=2e-6)


@pytest.mark.parametrize(("parts", "block", "queries_a_task"), [(200_000, 128, 1000), (100, 8, 2)])
def test_search_equals_plain_bm25(spark, tmp_path, monkeypatch, texts, parts, block, queries_a_task):
    monkeypatch.setattr(lexical, "PART_RECORDS", parts)
    monkeypatch.setattr(lexical, "QUERIES", queries_a_task)
    index = lexical.Index.build(frame(spark, texts).repartition(3), "doc_id", {"text": 1}, f"{tmp_path}/index")
    check(spark, index, texts)
    check(spark, index, texts, 3)
    assert index.search(asked(spark), None).where("query_id = 1").count() == len(ranked(texts, QUERIES[1], None))
    assert index.measured == (len(texts), pytest.approx(sum(len(t.replace(",", " ").replace("-", " ").split()) for t in texts.values()) / len(texts)))
    some = frame(spark, {i: t for i, t in texts.items() if i % 2})
    got = [(r["doc_id"], r["rank"]) for r in index.search(asked(spark), 5, some.select("doc_id")).where("query_id = 2").orderBy("rank").collect()]
    assert got == [(i, r) for i, _, r in ranked({i: t for i, t in texts.items() if i % 2}, QUERIES[2], 5)]


def test_phrases_prefixes_and_terms_equal_plain_loops(spark, tmp_path, monkeypatch, texts):
    monkeypatch.setattr(lexical, "PART_RECORDS", 300)
    index = lexical.Index.build(frame(spark, texts), "doc_id", {"text": 1}, f"{tmp_path}/index")
    held = {i: t.lower().replace(",", " ").replace("-", " ").split() for i, t in texts.items()}
    phrases = {1: ["w0", "w1"], 2: ["w1", "w2", "w1"], 3: ["w3"], 4: ["w0", "nothing"], 5: [], 6: ["w0", "w0", "w0"]}
    got = {(r["query_id"], r["doc_id"]) for r in index.phrases(spark.createDataFrame(list(phrases.items()), "query_id long, words array<string>")).collect()}
    assert got == {(q, i) for q, p in phrases.items() if p for i, w in held.items() if any(w[j : j + len(p)] == p for j in range(len(w)))}
    starts = {1: ["rare1"], 2: ["rare1", "w0"], 3: ["rar"], 4: ["rare39", "rare1"]}
    got = {(r["query_id"], r["doc_id"]) for r in index.prefixes(asked(spark, starts)).collect()}
    assert got == {(q, i) for q, p in starts.items() for i, w in held.items() if all(any(x.startswith(t) if len(t) >= 4 else x == t for x in w) for t in p)}
    got = {(r["query_id"], r["doc_id"], r["matched"], r["wanted"]) for r in index.matched(asked(spark)).collect()}
    assert got == {(q, i, n, len({*t})) for q, t in QUERIES.items() for i, w in held.items() if (n := sum(x in w for x in {*t}))}
    terms = {r["term"]: (r["n"], r["first"]) for r in index.terms().collect()}
    assert terms == {t: (len(k), min(k)) for t in {x for w in held.values() for x in w} for k in [[i for i, w in held.items() if t in w]]}
    tree = expressions.parse('("w0 w1" AND w3) OR rare1* OR (w40 AND w41)')
    truth = lambda w: (any(w[j : j + 2] == ["w0", "w1"] for j in range(len(w))) and "w3" in w) or any(x.startswith("rare1") for x in w) or ("w40" in w and "w41" in w)
    assert {r["doc_id"] for r in expressions.indexed(index, tree).collect()} == {i for i, w in held.items() if truth(w)} == {r["doc_id"] for r in expressions.matches(frame(spark, texts), "doc_id", "text", tree).collect()}


def test_max_score_skips_blocks(spark, tmp_path):
    """A rare word decides the best; of a word that nearly all records hold, only blocks over its records are opened."""
    texts = {i: "common filler" + (" rare rare rare" if i % 1000 == 5 else "") + " x" * (i % 7) for i in range(20_000)}
    index = lexical.Index.build(frame(spark, texts), "doc_id", {"text": 1}, f"{tmp_path}/index")
    queries = {1: ["rare", "common"]}
    check(spark, index, texts, 5, queries)
    told = index.scored(asked(spark, queries), 5).where("key is null").first()
    assert told["blocks"] > 150 and told["opened"] < 0.2 * told["blocks"]


def test_upkeep_equals_a_full_build(spark, tmp_path, monkeypatch, texts):
    monkeypatch.setattr(lexical, "PART_RECORDS", 400)
    index = lexical.Index.build(frame(spark, texts), "doc_id", {"text": 1}, f"{tmp_path}/index")
    rng, now = random.Random(2), dict(texts)
    for step in range(4):
        gone = rng.sample(sorted(now), 30)
        changed = {i: words(rng, 30) for i in rng.sample(sorted(set(now) - {*gone}), 40)} | {5000 + step * 10 + j: words(rng, 10) for j in range(5)}
        now = {i: t for i, t in now.items() if i not in gone} | changed
        before = index.generation
        index = index.update(frame(spark, {i: "" for i in gone}), frame(spark, changed))
        assert index.generation > before and index.measured[0] == len(now)
        check(spark, index, now)
        held = {i: t.lower().split() for i, t in now.items()}
        phrase = spark.createDataFrame([(1, ["w0", "w1"])], "query_id long, words array<string>")
        assert {r["doc_id"] for r in index.phrases(phrase).collect()} == {i for i, w in held.items() if any(w[j : j + 2] == ["w0", "w1"] for j in range(len(w)))} - {7}
        assert index.terms(lambda b: b.where("term = 'w0'")).first()["n"] == sum("w0" in w for w in held.values())
    # small segments became one, and without what is dead the whole is one again
    assert len(index.state["segments"]) < 5
    whole = index.merged([s["name"] for s in index.state["segments"]])
    assert len(whole.state["segments"]) == 1 and whole.state["dead"] is None
    check(spark, whole, now)


def test_only_what_changes_is_taken_apart(spark, tmp_path, texts):
    index = lexical.Index.build(frame(spark, texts), "doc_id", {"text": 1}, f"{tmp_path}/index")
    new = index.update(frame(spark, {7: ""}), frame(spark, {1: "w1", 2: "w2 w2"}))
    assert [s["records"] for s in new.state["segments"]] == [len(texts), 2]
    # a copy reads the same files and is kept up apart
    other = new.copy(f"{tmp_path}/other").update(frame(spark, {1: ""}), frame(spark, {}))
    assert other.measured[0] == new.measured[0] - 1 and lexical.Index(spark, f"{tmp_path}/index", "doc_id").measured == new.measured


def test_two_updates_of_one_generation_conflict(spark, tmp_path):
    index = lexical.Index.build(frame(spark, {1: "a", 2: "b"}), "doc_id", {"text": 1}, f"{tmp_path}/index")
    late = lexical.Index(spark, f"{tmp_path}/index", "doc_id")
    new = index.update(frame(spark, {1: ""}), frame(spark, {3: "c"}))
    with pytest.raises(lexical.ConflictError):
        late.update(frame(spark, {2: ""}), frame(spark, {}))
    now = lexical.Index(spark, f"{tmp_path}/index", "doc_id")
    assert now.generation == new.generation and {r["doc_id"] for r in now.lengths.collect()} == {2, 3}
    # a reader of the older generation still sees it
    assert {r["doc_id"] for r in lexical.Index(spark, f"{tmp_path}/index", "doc_id", 1).lengths.collect()} == {1, 2}


def test_an_index_of_another_definition_is_another_index(spark, tmp_path):
    d = f"{tmp_path}/docs"
    spark.createDataFrame([(1, "alpha", "beta"), (2, "beta", "alpha"), *((i, "gamma", "delta") for i in range(3, 8))], "doc_id long, text string, other string").write.parquet(d)
    scan = spark.read.parquet(d)
    q = asked(spark, {1: ["alpha"]})
    name = f"test-{tmp_path.name}"
    for fields, want in (({"text": 1}, [1]), ({"other": 1}, [2]), ({"text": 1, "other": 2}, [2, 1]), ({"text": 2, "other": 1}, [1, 2])):
        index = lexical.Index.stored(scan, scan, "doc_id", fields, name)
        assert [r["doc_id"] for r in index.search(q, 5).orderBy("rank").collect()] == want
    assert shared.base(spark)


def test_weighted_fields_and_nulls(spark, tmp_path):
    rows = [(1, "a b", None), (2, None, "a a"), (3, None, None), (None, "a", "a"), (4, "", "")]
    index = lexical.Index.build(spark.createDataFrame(rows, "doc_id long, title string, body string"), "doc_id", {"title": 3, "body": 0.5}, f"{tmp_path}/index")
    assert sorted((r["term"], r["doc_id"], r["length"], r["f"]) for r in index.postings.collect()) == [("a", 1, 2, 3.0), ("a", 2, 2, 1.0), ("b", 1, 2, 3.0)]


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    n = 1000
    group = np.sort(rng.integers(0, 7, n))
    key = np.concatenate([np.sort(rng.choice(10**12, int((group == g).sum()), replace=False)) - 10**11 for g in range(7)])
    counts = rng.integers(0, 4, (n, 2))
    counts[counts.sum(1) == 0] = 1
    places = np.concatenate([np.sort(rng.choice(1000, c, replace=False)) for c in counts.reshape(-1)])
    p = postings.Posted(group, key, rng.integers(1, 500, n), counts, places)
    batch = postings.blocks(p, np.zeros(7, np.int64), pa.array([f"t{g}" for g in range(7)]), np.array([1.0, 2.0]))
    assert max(batch.column("n").to_pylist()) <= postings.BLOCK
    back = postings.opened(pa.Table.from_batches([batch]), 2)
    assert (back.key == key).all() and (back.counts == counts).all() and (back.places == places).all() and (back.size == p.size).all()
    shard = postings.Shard(pa.Table.from_batches([batch]), np.array([1.0, 2.0]), {})
    k, size, f, _ = shard.open(shard.terms["t3"])
    assert (k == key[group == 3]).all() and (f == (counts @ [1.0, 2.0])[group == 3]).all()


def test_generations_are_put_only_once(spark, tmp_path):
    g = generations.Generations(spark, f"file://{tmp_path}/g")
    assert g.latest() == 0 and g.read(0) == {}
    assert g.publish(0, {"a": 1}) == 1 and g.publish(1, {"a": 2}) == 2
    for base in (0, 1):
        with pytest.raises(generations.ConflictError):
            g.publish(base, {"a": 9})
    assert (g.read(1), g.read(2), g.latest()) == ({"a": 1}, {"a": 2}, 2)
