"""Spelling variants, dimension history and exact top-k against plain loops: nulls, ties, repeated rows, empty tables, extra columns, hot keys."""

from __future__ import annotations

import itertools
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.llm import dimension_history, metric_topk, registry, spelling_groups

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    said = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in said.description]
    want = sorted(map(repr, said.fetchall()))
    got = sorted(repr(tuple(r)) for r in registry.queries()[name](spark, SF).select(*columns).collect())
    assert got == want and got


# ---- spelling variants ----


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words: dict[str, int], times: int = 5) -> set[tuple]:
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o.encode()), default=None)
        if best is not None and words[best] >= times * n:
            form[w] = best
    out = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return out


def test_variants_of_random_words(spark):
    rng = random.Random(5)
    # few letters, so that words share their letters in another order, and chains of forms; letters whose values agree modulo 4096 and beyond the BMP
    words = {"".join(rng.choice("abcé") for _ in range(rng.choice([6, 6, 7, 8]))): rng.choice([1, 2, 5, 25, 125, 700, 4000]) for _ in range(500)}
    words |= {"abcde" + chr(0x61 + 4096): 7, "abcdea": 40, "abcde\U0001f600": 3, "zzzzzz": 5, "zzzzzzz": 5, "x" * 5000: 2, "x" * 5001: 10}
    rows = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = [tuple(r) for r in spelling_groups.variants(rows).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(words) and set(got) == plain_variants(words)
    assert any(r[1] and r[2] != r[1] for r in got)  # chains


def test_variants_of_permutations(spark):
    # one class of letters in all orders and all words that lack one of them: a hot key
    words = {"".join(p): 1 + i % 3 for i, p in enumerate(itertools.permutations("abcdefg"))}
    words |= {"".join(p): 30 for p in itertools.islice(itertools.permutations("abcdef"), 200)}
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    near = {tuple(r) for r in spelling_groups.near_pairs(rows).select("word", "near").collect()}
    want = {(a, b) for a in words if len(a) == 7 for i in range(7) if (b := a[:i] + a[i + 1 :]) in words}
    want |= {(b, a) for a, b in want} | {(a, b) for a in words for b in words if len(a) == len(b) == 6 and one_edit(a, b)}
    assert near == want


def test_runs_and_edges(spark):
    docs = spark.createDataFrame([(1, "Étude-ÉTUDE naïve's X2y", "z"), (1, "Étude-ÉTUDE naïve's X2y", "z"), (None, "abc", "z"), (3, None, "z"), (4, "", "z")], "doc_id long, text string, word string")
    got = sorted(r["run"] for r in spelling_groups.runs(docs).collect())
    # only A to Z are lower-cased
    assert got == sorted(["Étude"] * 4 + ["naïve"] * 2 + ["s"] * 2 + ["x"] * 2 + ["y"] * 2 + ["abc"])
    w = spark.createDataFrame([("abcdef", 0), ("abcdef", 5), ("añb", 1)], "w string, i int")
    cut = {tuple(r) for r in w.select("w", "i", spelling_groups.without(F.col("w"), F.col("i"))).collect()}
    assert cut == {("abcdef", 0, "bcdef"), ("abcdef", 5, "abcde"), ("añb", 1, "ab")}
    none = spark.createDataFrame([], "word string, n long")
    assert spelling_groups.variants(none).count() == 0
    with pytest.raises(ValueError, match="too short"):
        spelling_groups.near_pairs(spark.createDataFrame([("abc", 1)], "word string, n long"))


# ---- dimension history ----


def plain_versions(rows: list[tuple], days: int) -> set[tuple]:
    """rows of (key, kind, start, stop, arrival, value); days: after which nothing changes."""
    out = set()
    order = lambda r: (tuple(r[4]), r[5] is not None, r[5] or "")
    for key in {r[0] for r in rows if r[0] is not None}:
        mine = [r for r in rows if r[0] == key and r[1] is not None and r[2] is not None]
        told, n = [], 0
        for d in range(days + 1):
            over = [r for r in mine if r[1] == "correction" and r[2] <= d and (r[3] is None or d < r[3])]
            under = [r for r in mine if r[1] != "correction" and r[2] <= d]
            best = max(over, key=order) if over else max(under, key=lambda r: (r[2], order(r), r[1] == "delete"), default=None)
            told.append(("gone",) if best is None or best[1] == "delete" else ("is", best[5]))
        for value, run in itertools.groupby(range(days + 1), key=lambda d: told[d]):
            run = list(run)
            if value[0] == "is":
                n += 1
                out.add((key, n, run[0], run[-1] + 1 if run[-1] < days else None, value[1]))
    return out


@pytest.mark.parametrize("range_rows", [3, 40, 10_000])
def test_versions(spark, range_rows):
    rng = random.Random(range_rows)
    rows = []
    for i in range(700):
        key = 7 if i % 3 == 0 else rng.randrange(40)
        start = rng.randrange(60)
        kind = rng.choice(["update", "update", "delete", "correction", "correction"])
        stop = rng.choice([start + rng.randrange(1, 30), start + 10, None]) if rng.random() < 0.97 else start
        rows.append((key, kind, start, stop if kind == "correction" else rng.choice([None, 3]), [rng.randrange(200), i % 2], rng.choice(["a", "b", None, ""])))
    rows += rows[:50] + [(None, "update", 1, None, [1, 1], "q"), (3, None, 1, None, [1, 1], "q"), (3, "update", None, None, [1, 1], "q"), (-5, "update", 0, None, [0, 0], None)]
    rows += [(11, "correction", 5, 6, [i, 0], str(i)) for i in range(30)] + [(11, "delete", 5, None, [i, 0], None) for i in range(30)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "key long, kind string, start long, stop long, arrival array<long>, value string, part string")
    got = [tuple(r) for r in dimension_history.versions(df.repartition(5), range_rows).select("key", "version", "valid_from", "valid_to", "value").collect()]
    want = plain_versions([r for r in rows if r[1] != "correction" or r[3] is None or r[2] < r[3]], 100)
    assert len(got) == len(set(got)) and set(got) == want


def test_versions_of_nothing(spark):
    df = spark.createDataFrame([], "key long, kind string, start long, stop long, arrival array<long>, value string")
    assert dimension_history.versions(df).count() == 0


def test_one_key_spread_over_ranges(spark):
    # a third of the rows and more have one key; no range may hold it whole
    rng = random.Random(1)
    rows = [(1, "correction" if i % 2 else "update", rng.randrange(5000), None, [i], str(rng.randrange(3))) for i in range(1500)]
    rows = [(k, kind, s, s + rng.randrange(1, 80) if kind == "correction" else None, a, v) for k, kind, s, _, a, v in rows]
    df = spark.createDataFrame(rows, "key long, kind string, start long, stop long, arrival array<long>, value string")
    got = {tuple(r) for r in dimension_history.versions(df, 100).select("key", "version", "valid_from", "valid_to", "value").collect()}
    assert got == plain_versions(rows, 5200)


def test_merge_keeps_the_upper(spark):
    fn = np.zeros(2, np.int64)
    f, start, stop, item = dimension_history.merge(fn, np.array([0, 3]), np.array([10, 5]), np.array([0, 1]), np.array([False, True]))
    assert list(zip(start, stop, item)) == [(0, 3, 0), (3, 5, 1), (5, 10, 0)]


# ---- exact top-k ----


def plain_top(rows: list[tuple], k: int, by: int) -> list[tuple]:
    x = [(i, np.array([int(np.floor(1024 * float(c))) for c in v], dtype=object)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for a, (q, u) in enumerate(x):
        if q % by == 0:
            best = sorted((-int(sum(u * w)), i) for b, (i, w) in enumerate(x) if b != a and len(w) == len(u))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def top(spark, rows, k, by, shard_rows):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "id long, x array<double>, row string").repartition(3)
    index = metric_topk.build(df, shard_rows=shard_rows)
    return index, metric_topk.top_k(index, k, metric_topk.divisible(by))


@pytest.mark.parametrize("shard_rows", [40, 100_000])
def test_top_k(spark, shard_rows):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=5) * (3 if i % 9 == 0 else 1)).tolist()) for i in range(400)]
    same = rng.normal(size=5).tolist()
    rows += [(1000 + i, same) for i in range(200)]  # many alike: ties
    rows += [(40, rows[3][1]), (40, rows[3][1]), (2000, [0.0] * 5), (2020, [1.0, 2.0]), (2021, [1.0, 3.0]), (2040, []), (2060, [7.0] * 3)]
    rows += [(None, same), (2080, None), (2100, [1.0, None, 1.0, 1.0, 1.0]), (2120, [1.0, float("nan"), 1.0, 1.0, 1.0]), (2140, [float("inf")] + same[1:])]
    _, got = top(spark, rows, 10, 20, shard_rows)
    assert sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in got.collect()) == plain_top(rows, 10, 20)


def test_top_k_of_large_components(spark):
    rows = [(i, [1e5 * (i % 7) + i, -2e5 * (i % 5), 3.0]) for i in range(60)]
    index, got = top(spark, rows, 4, 10, 100)
    assert not index.exact
    assert sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in got.collect()) == plain_top(rows, 4, 10)
    with pytest.raises(ValueError, match="overflow"):
        top(spark, [(1, [1e300])], 1, 1, 10)


def test_top_k_passes_over_most_of_what_is_clustered(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16)) * 4
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * 0.05).tolist()) for i in range(8000)]
    _, got = top(spark, rows, 10, 400, 1500)
    computed = [r["computed"] for r in got.where("rank = 1").collect()]
    assert len(computed) == 20 and np.mean(computed) < 0.25 * len(rows)


def test_top_k_of_nothing(spark):
    _, got = top(spark, [], 10, 1, 10)
    assert got.count() == 0
