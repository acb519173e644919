"""The training-data operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing extra columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorespark.llm import _text, bitpack, decontaminate, language_id, ngram_join, piece_codec, quality_rules, registry, suffix_dedup, token_counts, toxicity

W = re.compile(r"[^\x20\x09-\x0d]+")
EXTRA = "doc_id long, text string, n_words string, score string, key string, ids string, rep string"


def docs_of(spark, rows):
    """rows of (doc_id, text) with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", "y", "z", "q", "r") for i, t in rows], EXTRA)


def written(spark, tmp_path, rows):
    docs_of(spark, rows).write.parquet(f"{tmp_path}/docs")
    return spark.read.parquet(f"{tmp_path}/docs")


@pytest.fixture(scope="module")
def corpus_rows():
    """Texts with copies, near copies, shared passages, repeated lines, odd white space, and the empty kinds."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 9)))
    passage = [word() for _ in range(60)]
    rows, texts = [], []
    for i in range(120):
        if i % 7 == 3 and texts:
            t = rng.choice(texts).split(" ")
            for _ in range(max(1, len(t) // 60)):
                t[rng.randrange(len(t))] = word()
            t = " ".join(t)
        elif i % 11 == 4 and texts:
            t = rng.choice(texts)
        else:
            t = " ".join(word() for _ in range(rng.choice([1, 3, 4, 5, 6, 12, 49, 50, 51, 200])))
            if i % 5 == 0:
                t = " ".join([word() for _ in range(20)] + passage[: rng.choice([40, 49, 50, 51, 60])] + [word() for _ in range(20)])
        if i % 13 == 5:
            t = t.replace(" ", "\n", 3).replace(" ", " \t ", 2) + " "
        texts.append(t)
        rows.append((i, t))
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "Aa Bb"), (504, "aA bB"), (505, texts[0].upper()), (506, " ".join(["ab"] * 3000)), (507, "x" * 50_000), (508, "one two three four five\n" * 30)]
    return rows


def shingles(t):
    w = W.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def link_all(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_ngram_join(spark, tmp_path, corpus_rows):
    sets = {i: shingles(t) for i, t in corpus_rows}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(written(spark, tmp_path, corpus_rows)).collect()}
    assert got == {i: (len(sets[i]), c) for i, c in link_all(sets).items()}
    assert len({c for _, c in got.values()}) < len(got)


def test_ngram_join_in_blocks_of_a_large_group(spark, tmp_path, monkeypatch):
    """A group of near copies that is dealt out as pairs of blocks."""
    monkeypatch.setattr(ngram_join, "GROUP", 8)
    rng = random.Random(1)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(80)] = f"x{rng.random()}"
        rows.append((i, " ".join(t)))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(written(spark, tmp_path, rows)).collect()}
    assert got == link_all({i: shingles(t) for i, t in rows})


def test_ngram_join_repeated_ids_and_empty(spark, tmp_path):
    got = ngram_join.ngram_join(written(spark, tmp_path, [(1, "a b"), (1, "a b"), (None, "a b"), (2, "a b")])).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (1, 1, 1), (2, 1, 1)]
    assert ngram_join.ngram_join(docs_of(spark, [])).count() == 0


def test_ngram_join_of_a_large_group_in_parts(spark, tmp_path, monkeypatch):
    """One shared beginning, several clusters of near copies and single texts: blocks, a few for each component, and the rest against all."""
    monkeypatch.setattr(ngram_join, "GROUP", 6)
    rng = random.Random(2)
    head = [f"h{k}" for k in range(60)]
    rows = []
    for c in range(5):
        tail = [f"t{c}-{k}" for k in range(14)]
        for _ in range(rng.randint(1, 30)):
            t = head + tail
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(t)))
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(written(spark, tmp_path, rows)).collect()}
    want = link_all({i: shingles(t) for i, t in rows})
    assert got == want


def test_ngram_join_repeated_ids_of_several_texts(spark, tmp_path):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    got = ngram_join.ngram_join(written(spark, tmp_path, [(3, a), (5, a), (5, b), (7, b), (9, "z")])).collect()
    assert sorted(map(tuple, got)) == [(3, 2, 3), (5, 2, 3), (5, 2, 3), (7, 2, 3), (9, 1, 9)]


def test_ngram_join_with_more_ranges_than_shingles(spark, tmp_path, monkeypatch, corpus_rows):
    monkeypatch.setattr(ngram_join, "RANGE_BYTES", 1)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(written(spark, tmp_path, corpus_rows)).collect()}
    assert got == link_all({i: shingles(t) for i, t in corpus_rows})


def test_trie_matches_equal_brute_force():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(80)]
    sets += [sets[0], sets[1][:5], np.unique(np.concatenate([sets[2], [np.uint64(61)]]))]
    sizes = np.array([len(s) + int(rng.integers(0, 3)) for s in sets])
    trie = ngram_join.Trie(sets, sizes)
    for q, n in zip(sets, sizes, strict=True):
        want = {j for j, s in enumerate(sets) if len(np.intersect1d(q, s)) >= ngram_join.need(n, sizes[j])}
        assert set(trie.matches(q, int(n), 75).tolist()) == want


def test_need_is_the_contract():
    for a in range(1, 40):
        for b in range(1, 40):
            for o in range(min(a, b) + 1):
                assert (o >= ngram_join.need(a, b)) == (100 * o >= 75 * (a + b - o))


def test_suffix_dedup(spark, tmp_path, corpus_rows):
    docs = written(spark, tmp_path, corpus_rows)
    words = {i: W.findall(t or "") for i, t in corpus_rows}
    held = defaultdict(set)
    for i, w in words.items():
        for j in range(len(w) - 49):
            held[tuple(w[j : j + 50])].add(i)
    want = {(i, j + k, min(x) == i) for i, w in words.items() for j in range(len(w) - 49) if len(x := held[tuple(w[j : j + 50])]) > 1 for k in range(50)}
    spans = suffix_dedup.passages(docs)
    got = {(r["doc_id"], k, r["kept"]) for r in spans.collect() for k in range(r["start_word"], r["end_word"])}
    assert got == want and want
    drop = {(i, k) for i, k, kept in want if not kept}
    left = {r["doc_id"]: r["text"] for r in suffix_dedup.remove(docs, spans).collect()}
    for i, t in corpus_rows:
        kept = [x for k, x in enumerate(words[i]) if (i, k) not in drop]
        if kept or not words[i]:
            assert W.findall(left[i] or "") == kept
            if not any(d == i for d, _ in drop):
                assert left[i] == t
        else:
            assert i not in left


@pytest.mark.parametrize(("hot", "text"), [(-1, 8 << 20), (3, 1), (20_000, 1)])
def test_suffix_dedup_with_hot_keys_and_many_ranges(spark, tmp_path, monkeypatch, corpus_rows, hot, text):
    """All or some keys too hot for one range, and far more ranges than a block has keys: the same passages."""
    docs = written(spark, tmp_path, corpus_rows)
    want = sorted(map(tuple, suffix_dedup.passages(docs).collect()))
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "RANGE_TEXT", text)
    monkeypatch.setattr(suffix_dedup, "SUFFIX_TEXT", text)
    assert sorted(map(tuple, suffix_dedup.passages(docs).collect())) == want and want


def test_suffix_order_and_extension():
    """Matches come from suffixes sorted word by word: common prefixes of neighbours to the right, and of what is before them to the left."""
    rng = np.random.default_rng(4)
    side, whole = suffix_dedup.SIDE, suffix_dedup.LENGTH
    base = rng.integers(1, 2**60, 2 * side).astype(np.uint64)
    s = np.zeros(40, suffix_dedup._SUFFIX)
    for k in range(40):
        left, right = rng.integers(0, side + 1, 2)
        s[k]["key"] = 7 + k % 2
        s[k]["left"], s[k]["right"] = base[:side], base[side:]
        s[k]["left"][left:] = rng.integers(1, 2**60, side - left)
        s[k]["right"][right:] = rng.integers(1, 2**60, side - right)
        s[k]["low"], s[k]["high"] = sorted(rng.integers(0, side + 1, 2))
    order, place, common = suffix_dedup._classes(s["right"])
    rows, lcp = s["right"][order].tolist(), lambda x, y: next((j for j in range(side) if x[j] != y[j]), side)
    assert [place[k] for k in order] == list(range(40))
    for a in range(40):
        for b in range(a + 1, 40):
            # as in a suffix array: two suffixes share what the neighbours between them share at least
            assert lcp(rows[a], rows[b]) == min(common[a + 1 : b + 1])
    docs = rng.integers(0, 15, 40)
    got = set(zip(*(x.tolist() for x in suffix_dedup.match_suffixes(s, docs, np.zeros(40, bool))), strict=True))
    want = set()
    for a in range(40):
        for o in range(whole - suffix_dedup.GRAM + 1):
            fits = lambda k, o=o: s[k]["low"] <= o <= s[k]["high"]
            same = lambda b, a=a, o=o: s[a]["key"] == s[b]["key"] and (s[a]["left"][:o] == s[b]["left"][:o]).all() and (s[a]["right"][: side - o] == s[b]["right"][: side - o]).all()
            held = {int(docs[b]) for b in range(40) if fits(a) and fits(b) and same(b)}
            if len(held) > 1:
                want.add((a, o, min(held)))
    assert got == want and want


def test_suffix_dedup_keeps_each_window_once(spark, tmp_path):
    """Documents that share more with one another than with the first that holds a passage: each window has one keeper, the smallest."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, pool = [], []
    for i in range(60):
        w = [word() for _ in range(30)]
        for _ in range(3):
            if pool and rng.random() < 0.7:
                src = rng.choice(pool)
                a = rng.randrange(max(1, len(src) - 60))
                w += src[a : a + rng.randint(45, 140)] + [word() for _ in range(rng.randint(0, 9))]
        pool.append(w)
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    held = defaultdict(set)
    words = {i: t.split() for i, t in rows}
    for i, w in words.items():
        for j in range(len(w) - 49):
            held[tuple(w[j : j + 50])].add(i)
    want = {(i, j + k, min(x) == i) for i, w in words.items() for j in range(len(w) - 49) if len(x := held[tuple(w[j : j + 50])]) > 1 for k in range(50)}
    spans = suffix_dedup.passages(written(spark, tmp_path, rows)).collect()
    assert {(r["doc_id"], k, r["kept"]) for r in spans for k in range(r["start_word"], r["end_word"])} == want and want
    assert all(r["first_doc_id"] == min(held[tuple(words[r["doc_id"]][j : j + 50])]) for r in spans for j in (r["start_word"], r["end_word"] - 50))


def test_suffix_dedup_by_row(spark, tmp_path):
    """Rows that share an id lose only what their own text repeats; columns may have any name."""
    passage = " ".join(f"w{k}" for k in range(55))
    rows = [(1, passage), (2, "other words " * 3 + passage), (2, " ".join(f"z{k}" for k in range(80))), (2, "other words " * 3 + passage)]
    df = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], "doc_id int, text string, _spans string, spans_0 string, gone_0 string, text_hash string")
    df.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    out = suffix_dedup.remove(docs, suffix_dedup.passages(docs))
    assert out.columns == docs.columns
    assert sorted(r["text"].split()[0] + str(len(r["text"].split())) for r in out.collect()) == ["other6", "other6", "w055", "z080"]


@pytest.mark.parametrize("parts", [1, 4])
def test_suffix_dedup_of_repeated_rows(spark, tmp_path, parts):
    """Equal rows have their passages once, in one block or in several."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (1, text), (2, text), (2, text)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id", F.rand(1)).write.parquet(f"{tmp_path}/docs")
    got = sorted((r["doc_id"], r["start_word"], r["end_word"], r["kept"]) for r in suffix_dedup.passages(spark.read.parquet(f"{tmp_path}/docs")).collect())
    assert got == [(1, 0, 60, True), (2, 0, 60, False)]


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.passages(docs_of(spark, [])).count() == 0
    short = docs_of(spark, [(1, "a b"), (2, None), (3, "")])
    assert suffix_dedup.passages(short).count() == 0 and suffix_dedup.remove(short, suffix_dedup.passages(short)).count() == 3
    one = docs_of(spark, [(1, " ".join(["a b c d e f g h i j"] * 20)), (None, "x " * 100)])
    assert suffix_dedup.passages(one).count() == 0
    assert suffix_dedup.remove(one, suffix_dedup.passages(one)).count() == 2


def alnum(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))


def test_decontaminate(spark):
    rng = random.Random(5)
    items = [(k, " ".join(f"w{rng.randrange(30)}" for _ in range(n))) for k, n in enumerate([40, 13, 12, 1, 0, 20])] + [(6, None), (None, "w1"), (7, "W1, w2; w3")]
    rows = []
    for i in range(60):
        t = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 60))]
        if i % 3 == 0:
            src = items[i % 4][1].split(" ")
            k = rng.randrange(len(src))
            t[5:5] = src[k : k + rng.choice([12, 13, 14, 40])]
        rows.append((i, (", " if i % 2 else " ").join(t)))
    rows += [(100, None), (101, ""), (102, "w1 w2 w3"), (103, items[0][1].upper()), (103, "w1"), (104, "a" * 100_000)]
    b = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    win = defaultdict(set)
    for i, t in items:
        w = alnum(t)
        if i is not None:
            for j in range(max(1, len(w) - 12) if w else 0):
                win[tuple(w[j : j + 13])].add(str(i))
    want = []
    for i, t in rows:
        w, hit, names = alnum(t), set(), set()
        for n in {len(k) for k in win}:
            for j in range(len(w) - n + 1):
                if x := win.get(tuple(w[j : j + n])):
                    hit |= set(range(j, j + n))
                    names |= x
        want.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    got = registry.contamination(docs_of(spark, rows), b)
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(x[5] for x in want)
    none = registry.contamination(docs_of(spark, rows), b.where("item_id = -1"))
    assert none.where("contaminated").count() == 0 and none.count() == len(rows)
    assert registry.contamination(docs_of(spark, []), b).count() == 0


def test_decontaminate_in_item_blocks(spark, monkeypatch):
    docs = docs_of(spark, [(1, "a b c d"), (2, "c d e"), (3, "z")])
    b = spark.createDataFrame([(1, "a b"), (2, "d e"), (3, "c d")], "item_id long, text string")
    whole = sorted(map(tuple, registry.contamination(docs, b).collect()))
    monkeypatch.setattr(decontaminate, "ITEM_WORDS", 1)
    assert sorted(map(tuple, registry.contamination(docs, b).collect())) == whole


def test_decontaminate_in_item_blocks_by_row(spark, monkeypatch):
    docs = docs_of(spark, [(1, "a b c d"), (1, "z z"), (1, "a b"), (1, "a b"), (None, "c d"), (None, "z"), (2, None)]).repartition(3)
    b = spark.createDataFrame([(1, "a b"), (2, "d e"), (3, "c d")], "item_id long, text string")
    rows = lambda: sorted(map(repr, registry.contamination(docs, b).collect()))
    whole = rows()
    monkeypatch.setattr(decontaminate, "ITEM_WORDS", 1)
    assert rows() == whole and len(whole) == 7


def test_proximity(spark):
    index = decontaminate.build_index(docs_of(spark, [(1, "b x a"), (2, "a x x x b"), (3, "a"), (4, "b"), (5, "x a b x")]))
    b = spark.createDataFrame([(9, "a b")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.proximity_matches(index, b, 3).collect()) == [1, 5]


def test_quality_features(spark, corpus_rows):
    rows = [*corpus_rows, (600, "a #b\n\n a #b\na #b\n*$%&|<>"), (601, "a b c d e f a b c d e g"), (602, "a a a a a a a")]
    got = {r["doc_id"]: tuple(r)[1:] for r in quality_rules.features(docs_of(spark, rows)).collect()}
    for i, t in rows:
        t = t or ""
        w = W.findall(t)
        g = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        again = {j + k for j in range(len(w) - 4) if g[tuple(w[j : j + 5])] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if W.search(x)]
        assert got[i] == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)), i


def test_quality_verdict_is_a_walk_down_the_list(spark, corpus_rows):
    """The conditional expression that rules become, against going through them row by row."""
    rng = random.Random(12)
    feature = lambda r: {"n_words": float(r["n_words"]), "mean_word": r["word_chars"] / max(r["n_words"], 1), "symbol_share": r["n_symbols"] / max(r["n_words"], 1), "dup_line_share": r["n_dup_lines"] / max(r["n_words"], 1), "repeat_share": r["n_repeat_words"] / max(r["n_words"], 1)}
    measured = quality_rules.features(docs_of(spark, corpus_rows)).cache()
    rows = measured.collect()
    kinds = set()
    for _ in range(12):
        rules = [[(f, rng.choice([">=", "<"]), feature(rng.choice(rows))[f]) for f in rng.sample(quality_rules.FEATURES, rng.randint(1, 3))] for _ in range(rng.randint(0, 4))]
        for r in quality_rules.apply(measured, rules).collect():
            v = feature(r)
            first = next((i for i, rule in enumerate(rules, 1) if all(v[f] >= cut if op == ">=" else v[f] < cut for f, op, cut in rule)), None)
            assert (r["rule"], r["kept"]) == ((None, False) if r["base_failed"] else (first, first is None))
            kinds.add((r["rule"] is None, r["kept"]))
    assert len(kinds) == 3


def test_quality_rules_learn_and_hold_out(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.3
        t = " ".join(("#" if bad and rng.random() < 0.5 else "") + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(40))
        rows.append((i, t))
        labels.append((i, int(not bad) if i % 50 else None, "clash"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, n_words string")
    out = {r["doc_id"]: r["kept"] for r in quality_rules.quality(docs_of(spark, rows), lab.where("doc_id < 600")).collect()}
    held = [(out[i], q) for i, q, _ in labels if i >= 600 and q is not None]
    assert sum(k == bool(q) for k, q in held) / len(held) > 0.95
    none = quality_rules.quality(docs_of(spark, rows[:5]), lab.where("doc_id < 0"))
    assert none.where("kept").count() == 5
    assert quality_rules.quality(docs_of(spark, []), lab).count() == 0


def test_language_id(spark):
    rng = random.Random(4)
    kinds = {"aa": "abcd", "ee": "efgh", "ii": "ijéß"}
    make = lambda s: " ".join("".join(rng.choice(s) for _ in range(rng.randint(2, 7))) for _ in range(30))
    rows = [(i, make(kinds[k := list(kinds)[i % 3]]), k) for i in range(240)]
    docs = spark.createDataFrame([(i, t, g, "clash") for i, t, g in rows], "doc_id long, text string, lang string, score string")
    net = language_id.learn(docs, F.col("doc_id") < 150)
    more = docs.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(900, None, ""), (901, "", ""), (902, "12 !?", ""), (903, "abcd" * 20_000, ""), (904, "a", "")], "doc_id long, text string, score string"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(more, net).collect()}
    assert all(got[i][0] == g for i, _, g in rows if i >= 150) and all(0 <= s <= 1 for _, s in got.values())
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[903][0] == "aa"
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.learn(docs.where("doc_id < 0"), F.lit(True))).collect()} == {"und"}
    assert language_id.predict(docs.where("doc_id < 0"), net).count() == 0


def test_language_id_gradient_and_table():
    net = language_id.Network(["a", "b"], hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 103, (5, 3)), np.array([0, 1, 0])
    _, g = net.gradient(x, y)
    for k in net.p:
        at = tuple(rng.integers(0, n) for n in net.p[k].shape) if not k.startswith("E") else (int(x[2, 1]), 5)
        old, eps = net.p[k][at], 1e-3
        net.p[k][at] = old + eps
        up, _ = net.gradient(x, y)
        net.p[k][at] = old - eps
        down, _ = net.gradient(x, y)
        net.p[k][at] = old
        assert abs((up - down) / (2 * eps) - g[k][at]) < 1e-3
    text = "abc abd abc " + "q" * 70
    seg, _ = language_id.segments(pa.array([text]))
    total = sum(net.label(np.frombuffer(s, np.uint8)[:, None]).sum((0, 1)) for s in seg.to_pylist())
    z = total / len(text) * np.sqrt(len(text))
    assert np.allclose(np.exp(z - z.max()) / np.exp(z - z.max()).sum(), net.texts(pa.array([text]))[0], atol=1e-5)
    assert b"".join(seg.to_pylist()) == text.encode() and max(map(len, seg.to_pylist())) == language_id.SEGMENT


def test_toxicity(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8)))
    bad = ["zorkish", "vuxation"]
    rows, labels = [], []
    for i in range(1500):
        t, toxic = [word() for _ in range(40)], i % 8 == 0
        if toxic:
            t[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic) if i % 3 else None, "clash"))
    rows += [(5000, None), (5001, ""), (5002, " ".join([word() for _ in range(20_000)] + ["zorkish"])), (5003, "x")]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    docs = docs_of(spark, rows)
    model = toxicity.learn(docs, lab, F.col("doc_id") < 1000)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert all(got[i] >= 0.5 for i in range(1000, 1500) if i % 8 == 0) and got[5002] >= 0.5
    assert sum(got[i] >= 0.5 for i in range(1000, 1500) if i % 8) <= 5 and max(got[5000], got[5001], got[5003]) < 0.5
    kept = toxicity.keep(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}
    none = toxicity.learn(docs, lab.where("doc_id < 0"), F.lit(True))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs_of(spark, []), model).count() == 0


def toxic_rows(n, toxic_every, copies):
    """n texts, each toxic_every-th with an insult, and as many near copies of a clean one as said."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(n):
        t = [word() for _ in range(40)]
        if i % toxic_every == 0:
            t[rng.randrange(40)] = rng.choice(["zorkish", "vuxation"])
        rows.append((i, " ".join(t)))
    base = [word() for _ in range(40)]
    for i in range(n, n + copies):
        t = list(base)
        if i % 2:
            t[rng.randrange(40)] = word()
        rows.append((i, " ".join(t)))
    return rows, [(i, int(i < n and i % toxic_every == 0)) for i in range(n + copies)]


def toxic_found(spark, rows, labels, **limits):
    """(toxic found, toxic, others taken for toxic) by a model learned from all labels."""
    docs, lab = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.learn(docs, lab, F.lit(True), **limits)).collect()
    bad = {i for i, x in labels if x}
    found = [r["doc_id"] for r in got if r["score"] >= 0.5]
    return len(bad & set(found)), len(bad), len(set(found) - bad)


def test_toxicity_with_a_third_clean_copies(spark):
    found, toxic, wrong = toxic_found(spark, *toxic_rows(1200, 8, 600))
    assert found == toxic == 150 and wrong <= 5


def test_toxicity_where_all_rows_repeat(spark):
    rows, labels = toxic_rows(600, 8, 0)
    found, toxic, wrong = toxic_found(spark, [r for r in rows for _ in range(2)], labels, positives=100, unlabelled=400)
    assert found == toxic == 75 and wrong <= 5


def test_toxicity_features():
    f, doc = toxicity.features(pa.array(["Abcdef abcde", None, "abc, abcdef!"]))
    # whole words, and proper beginnings of four bytes and more: "abcd" of both words, "abcde" of the longer
    assert sorted(doc.tolist()) == [0] * 5 + [2] * 4
    assert len(set(f.tolist())) == 5 and set(f[doc == 2].tolist()) - set(f[doc == 0].tolist()) == set(f[doc == 2][:1].tolist())


def toxic_sides(rng, n=300, share=0.2):
    """Positives that hold one of two features, and unlabelled texts of which ``share`` do; all hold chance features."""
    noise = lambda: set(rng.integers(100, 400, 12).tolist())
    sides = toxicity.Side(), toxicity.Side()
    for _ in range(n):
        sides[0].texts.append(np.array(sorted({int(rng.integers(0, 2))} | noise()), np.int32))
    for _ in range(4 * n):
        sides[1].texts.append(np.array(sorted(({int(rng.integers(0, 2))} if rng.random() < share else set()) | noise()), np.int32))
    return sides


def test_toxicity_risk_gradient():
    rng = np.random.default_rng(1)
    sides = toxic_sides(rng, 40)
    place = np.zeros(1 << toxicity.BITS, np.int32)
    place[:400] = np.arange(1, 401)
    pos, unl = (toxicity.Rows(s.texts, place) for s in sides)
    w, c = rng.random(400) / 4, -0.5
    for prior, sign in ((0.2, 1), (0.99, -1)):
        plus, corrected, g, gc = toxicity.risk(pos, unl, w, c, prior)
        # with a prior far too large the corrected part is negative, and the step goes back from it alone
        assert (corrected >= 0) == (sign > 0)
        total = lambda w, c, p=prior, s=sign: sum(toxicity.risk(pos, unl, w, c, p)[:2]) if s > 0 else -toxicity.risk(pos, unl, w, c, p)[1]
        eps = 1e-5
        for k in (0, 1, 150, 399):
            step = np.zeros(400)
            step[k] = eps
            assert abs((total(w + step, c) - total(w - step, c)) / (2 * eps) - g[k]) < 1e-6
        assert abs((total(w, c + eps) - total(w, c - eps)) / (2 * eps) - gc) < 1e-6


def test_toxicity_prior_and_training():
    sides = toxic_sides(np.random.default_rng(2))
    n, m = (len(s.texts) for s in sides)
    prior = toxicity.class_prior(sides[0].held(), sides[1].held(), n, m)
    assert 0.15 < prior < 0.27
    model = toxicity.train(*sides)
    weight = dict(zip(model.codes.tolist(), model.weights.tolist(), strict=True))
    hit = [model.bias + sum(weight.get(x, 0) for x in t) > 0 for t in sides[1].texts]
    toxic = [t[0] < 2 for t in sides[1].texts]
    assert sum(a and b for a, b in zip(hit, toxic, strict=True)) > 0.95 * sum(toxic) and sum(a and not b for a, b in zip(hit, toxic, strict=True)) <= 0.02 * m
    # weights begin at zero: without training nothing is found
    assert not len(toxicity.train(*sides, steps=1).weights)


def test_toxicity_chooses_its_constants_from_training_texts():
    sides = toxic_sides(np.random.default_rng(4))
    lift, shrink = toxicity.choose(*sides)
    assert lift in toxicity.LIFTS and shrink in toxicity.SHRINKS
    assert toxicity.choose(*sides) == (lift, shrink)
    few = toxicity.Side()
    few.texts = sides[0].texts[:2]
    assert toxicity.choose(few, sides[1]) == (toxicity.LIFTS[0], toxicity.SHRINKS[0])


def test_toxicity_side_limits():
    side = toxicity.Side(30)
    side.add(pa.array(["one two three four five six", "one two three four five six", "", "seven eight", "nine"]))
    # the copy is left out, and what comes after the limit
    assert len(side.texts) == 2


ODD = ["", " ", "  ", "▁", "▁▁a", "\n", "a  b", " a", "a ", "é", "é", "ﬁ", "İstanbul", "<|endoftext|>", "a<|endoftext|>b c", "don't", "12.5", "</s> <unk>", "\x00x", "中文", "🎉🎉 x", "　x\xa0y", "x" * 30_000, "loser, loser. LOSER,", "a,b.c ,. ..", "\r\n\t"]


def test_sentencepiece(spark, corpus_rows):
    import sentencepiece

    path = registry.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [*corpus_rows, *((1000 + i, t) for i, t in enumerate(ODD)), (1000, "again")]
    want = [(i, [*sp.encode(t or ""), 2]) for i, t in rows]
    encoded = piece_codec.encode(docs_of(spark, rows), path)
    assert sorted((r["doc_id"], r["ids"]) for r in encoded.collect()) == sorted(want)
    texts = sorted((i, sp.decode(ids)) for i, ids in want)
    assert sorted((r["doc_id"], r["text"]) for r in piece_codec.decode(encoded, path).collect()) == texts
    digests = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in registry.piece_digests(docs_of(spark, rows)).collect()}
    assert digests == {(i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(sp.decode(x).encode()).hexdigest()) for i, x in want}
    assert piece_codec.encode(docs_of(spark, []), path).count() == 0


def test_bitpack(spark, corpus_rows):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [*corpus_rows, *((1000 + i, x) for i, x in enumerate(ODD)), (1000, "again"), (None, "no id")]
    # rows of one id by their texts' hash
    told = {r["text"]: r["h"] for r in docs_of(spark, rows).select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, told[r[1]]))
    at, want = 0, []
    for i, x in order:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    manifest = bitpack.write(docs_of(spark, rows), path, 2)
    got = bitpack.read(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert bitpack.read(bitpack.write(docs_of(spark, []), path, 2)).count() == 0
    first = bitpack.PackedReader(manifest.orderBy("part").first()["path"])
    whole = first.ids(0, first.n)
    assert (first.ids(3, 11) == whole[3:11]).all() and (first.document(0) == whole[: first.ends[0]]).all()


def test_bitpack_with_one_id_for_most_rows(spark, monkeypatch):
    """Rows without an id, or with one id, and equal rows among them, are no longer file than others."""
    monkeypatch.setattr(bitpack, "FILE_BYTES", 2000)
    rows = [(None if i % 2 else i, "same text" if i % 4 == 1 else f"text number {i}") for i in range(4000)]
    manifest = bitpack.write(docs_of(spark, rows).repartition(8), registry.tokenizer_path("word_bpe_49k.json"), 2)
    files = [r["docs"] for r in manifest.collect()]
    assert sum(files) == 4000 and len(files) > 10 and max(files) < 3 * sum(files) / len(files)
    got = bitpack.read(manifest).select("doc_id", "start", "n_tokens").orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids == [None] * 2000 + list(range(0, 4000, 2)) and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 31, 32])
def test_bit_round_trip(bits):
    x = np.random.default_rng(bits).integers(0, 2**bits, 1000, dtype=np.uint64).astype(np.uint32)
    packed = bitpack.pack(x, bits)
    assert len(packed) == 16 * bits and (bitpack.unpack(packed, bits)[:1000] == x).all()


def test_token_counts(spark, corpus_rows, monkeypatch):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rows = [*corpus_rows, *((1000 + i, x) for i, x in enumerate(ODD)), (1000, "again"), (None, "no id")]
    want = sorted(((i is not None, i or 0, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows))
    files = token_counts.write_flat(docs_of(spark, rows), path, registry.END_OF_DOCUMENT)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"]) for r in token_counts.document_counts(files, registry.END_OF_DOCUMENT).collect())
    assert got == want
    assert token_counts.document_counts(token_counts.write_flat(docs_of(spark, []), path, 49407), 49407).count() == 0


def test_token_counts_of_many_tiny_texts(spark, monkeypatch):
    """A file holds so many documents at most, however small they are."""
    monkeypatch.setattr(token_counts, "FILE_DOCS", 100)
    rows = [(i, None if i % 3 == 0 else "" if i % 3 == 1 else "a b") for i in range(2050)]
    files = token_counts.write_flat(docs_of(spark, rows).repartition(2), registry.tokenizer_path("word_bpe_49k.json"), registry.END_OF_DOCUMENT)
    sizes = [len(r["doc_ids"]) for r in files.collect()]
    assert max(sizes) <= 100 and sum(sizes) == 2050
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.document_counts(files, registry.END_OF_DOCUMENT).collect()}
    assert got == {i: 2 if i % 3 == 2 else 0 for i in range(2050)}


def test_token_counts_across_blocks_and_widths(spark, corpus_rows):
    path = registry.tokenizer_path("word_bpe_49k.json")
    docs = docs_of(spark, corpus_rows[:30])
    want = sorted(map(tuple, token_counts.document_counts(token_counts.write_flat(docs, path, registry.END_OF_DOCUMENT), registry.END_OF_DOCUMENT).collect()))
    wide = token_counts.write_flat(docs, path, registry.END_OF_DOCUMENT, 4)
    assert sorted(map(tuple, token_counts.document_counts(wide, registry.END_OF_DOCUMENT, 4, 50).collect())) == want and len(want) == 30
    for separator, width in ((registry.END_OF_DOCUMENT, 1), (1 << 16, 2), (-1, 4)):
        with pytest.raises(ValueError, match="don't fit"):
            token_counts.write_flat(docs, path, separator, width)


def test_integer_ids_and_groups_of_files(spark, monkeypatch):
    rows = [(i, f"text number {i}") for i in range(40)]
    small, wide = (spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(5) for kind in ("int", "long"))
    pieces, words = registry.tokenizer_path("piece_bpe_32k.model"), registry.tokenizer_path("word_bpe_49k.json")
    assert sorted(map(tuple, registry.piece_digests(small).collect())) == sorted(map(tuple, registry.piece_digests(wide).collect()))
    packed = lambda d: sorted(map(tuple, bitpack.read(bitpack.write(d, words)).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()))
    want = packed(wide)
    monkeypatch.setattr(bitpack, "GROUP", 2)
    monkeypatch.setattr(bitpack, "FILE_BYTES", 100)
    assert packed(small) == want
    counts = lambda d: sorted(map(tuple, token_counts.document_counts(token_counts.write_flat(d, words, registry.END_OF_DOCUMENT), registry.END_OF_DOCUMENT).collect()))
    assert counts(small) == counts(wide)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 100])
def test_separator_scan_stitches_blocks(spark, tmp_path, block):
    kinds = {"a": [1, 2, 0, 0, 3, 0, 4, 5], "b": [0], "c": [7, 7, 7], "d": [], "e": [0, 0, 1, 0]}
    rows = []
    for n, ids in kinds.items():
        (tmp_path / n).write_bytes(np.array(ids, "<u2").tobytes())
        rows.append((f"file://{tmp_path}/{n}", 2 * len(ids)))
    got = defaultdict(list)
    for r in token_counts.scan(spark.createDataFrame(rows, "path string, bytes long"), 0, 2, block).orderBy("path", "ordinal").collect():
        got[r["path"][-1]].append((r["start"], r["n_tokens"], r["complete"]))
    assert got == {"a": [(0, 2, True), (3, 0, True), (4, 1, True), (6, 2, False)], "b": [(0, 0, True)], "c": [(0, 3, False)], "e": [(0, 0, True), (1, 0, True), (2, 1, True)]}


def test_word_hashes_by_bytes():
    raw, offs = _text.buffers(pa.array(["ab cdefghijk", None, "", " cdefghijk  ab ", "x" * 5000 + " " + "x" * 5000]))
    start, end, at = _text.words(raw, offs, _text.SPACE_WORDS)
    h = _text.hash_spans(raw, start, end)
    assert at.tolist() == [0, 2, 2, 2, 4, 6]
    assert h[0] == h[3] and h[1] == h[2] and h[4] == h[5] and len(set(h.tolist())) == 3
