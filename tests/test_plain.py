"""Queries without SQL against plain loops over the smallest tables."""

from __future__ import annotations

import html
import re

import pytest

from lorespark import registry
from lorespark.operators import documents

SF = "/root/testdata/sf0.001"
Q = registry.queries()


def units_of(page: str) -> list[tuple[str, str]]:
    """Text between block tags, without what is skipped, of pages that have no tables."""
    page = re.sub(r"(?s)<!--.*?-->", "", page)
    for tag in ("head", "script", "style", "nav", "noscript", "template"):
        page = re.sub(rf"(?s)<{tag}\b.*?</{tag}>", "", page)
    out, heading, run = [], False, ""
    for part in [*re.split(r"(<[^>]*>)", page), "<p>"]:
        tag = re.match(r"</?([a-z0-9!]+)", part)
        if not tag:
            run += html.unescape(part)
        elif re.fullmatch(r"h[1-6]|p|li|div|section|article|blockquote|pre|dd|dt|figcaption|br|td|th", tag[1]):
            if body := " ".join(run.split()):
                out.append(("heading" if heading else "paragraph", body))
            run, heading = "", bool(re.match(r"<h[1-6]", part))
    return out


def test_html_units(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {}
    for r in Q["n1_html_units"](spark, SF).orderBy("page_id", "ordinal").collect():
        got.setdefault(r["page_id"], []).append((r["kind"], r["body"]))
    plain = {i: units_of(h or "") for i, h in pages.items() if "<table" not in (h or "")}
    assert len(plain) > 20 and {i: got.get(i, []) for i in plain} == plain
    titles = {r["page_id"]: r["title"] for r in Q["n1_html_units"](spark, SF).collect()}
    assert all(t == " ".join(html.unescape(m[1]).split()) for i, t in titles.items() if (m := re.search(r"(?s)<title>(.*?)</title>", pages[i])))


@pytest.mark.parametrize("name", ["n2_chunks", "n2_text_chunks"])
def test_chunks_hold_all_words_within_their_budget(spark, name):
    key = "page_id" if name == "n2_chunks" else "doc_id"
    if key == "page_id":
        units = Q["n1_html_units"](spark, SF).select(key, "ordinal", "kind", "body").collect()
    else:
        from lorespark import corpus

        units = corpus.chunks(spark, SF).select(key, "ordinal", "kind", "body").collect()
    want: dict = {}
    for u in sorted(units, key=lambda u: (u[key], u["ordinal"])):
        want.setdefault(u[key], []).append((u["kind"], u["body"]))
    got: dict = {}
    for r in Q[name](spark, SF).orderBy(key, "ordinal").collect():
        got.setdefault(r[key], []).append(r)
    words = lambda s: re.findall(r"\w+|[^\w\s]", s)
    for i, rows in want.items():
        chunks = got[i]
        assert [c["ordinal"] for c in chunks] == list(range(len(chunks)))
        assert all(c["tokens"] == len(words(c["contextual"])) and c["contextual"].endswith(c["body"]) for c in chunks)
        assert all(c["tokens"] <= 252 for c in chunks if c["kind"] != "table")
        for kind in ("heading", "paragraph"):
            # every sentence that fits stands whole in a chunk, and chunks hold nothing else
            bodies = [" ".join(c["body"].split()) for c in chunks if c["kind"] == kind]
            whole = " ".join(" ".join(b.split()) for k, b in rows if k == kind)
            sentences = [x for k, b in rows if k == kind for x in re.split(r"(?<=[.!?])\s+", " ".join(b.split()))]
            assert all(any(x in b for b in bodies) for x in sentences if len(words(x)) <= 100)
            assert {w for b in bodies for w in words(b)} == {*words(whole)} or any(len(x) > 1000 for x in whole.split())
            # the first of each chunk come in the text's order
            firsts = [whole.find(b[:30]) for b in bodies if len(b) >= 30 and whole.count(b[:30]) == 1]
            assert firsts == sorted(firsts) and -1 not in firsts


def hits(spark, k):
    from lorespark.plans import ranking

    out: dict = {}
    for r in ranking._with_text(spark, SF, k).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r)
    return out


def test_mmr(spark):
    got = sorted((r["query_id"], r["position"], r["id"]) for r in Q["t11_mmr"](spark, SF).collect())
    want = []
    for q, page in hits(spark, 20).items():
        sets = [{w for w in re.findall(r"\w+", r["text"].lower()) if len(w) >= 3} for r in page]
        dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0
        chosen: list[int] = []
        while len(chosen) < len(page):
            gains = {i: 0.7 * (1 - i / len(page)) - 0.3 * max((dice(sets[i], sets[j]) for j in chosen), default=0.0) for i in range(len(page)) if i not in chosen}
            best = max(gains.values())
            chosen.append(next(i for i, g in gains.items() if g > best - 1e-12))
        want += [(q, n + 1, page[i]["id"]) for n, i in enumerate(chosen)]
    assert got == sorted(want)


def test_reranked_by_the_given_scorer(spark):
    got = {}
    for r in Q["v12_neural_rerank"](spark, SF).orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    asked = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    for q, page in hits(spark, 20).items():
        order = sorted(page, key=lambda r: (-len({*asked[q].lower().split()} & {*r["text"].lower().split()}), r["rank"]))
        assert got[q] == [r["id"] for r in order]


def test_coalesced_requests(spark):
    """A run takes eight hours; what is asked for meanwhile waits for the next one, more than three paths for a full one."""
    asked: dict = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id", "event_type", "unix_millis(cast(ts as timestamp)) as ms").collect():
        asked.setdefault(str(r["user_id"]), []).append((r["ms"], r["event_type"]))
    run, want = 8 * 3600 * 1000, []
    for user, requests in asked.items():
        ends, waiting = None, set()
        for at, path in [*sorted(requests), (float("inf"), None)]:
            while ends is not None and at >= ends:
                if waiting:
                    want.append((user, ends, 0 if len(waiting) > 3 else len(waiting), int(len(waiting) > 3)))
                    waiting, ends = set(), ends + run
                else:
                    ends = None
            if path is None:
                break
            if ends is None:
                want.append((user, at, 1, 0))
                ends = at + run
            else:
                waiting.add(path)
    assert sorted(tuple(r) for r in Q["x4_coalesce_requests"](spark, SF).collect()) == sorted(want) and len(want) > 50


def test_route_targets(spark):
    """Of the forms whose target is plain: a dotted name, a path, and what a question of calls or changes is about."""
    words = {r["item_id"]: [w for w in re.findall(r"\w+", r["text"]) if len(w) >= 5] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {r["question_id"]: r["target"] for r in Q["v13_route_targets"](spark, SF).collect()}
    plain = {i: w for i, w in words.items() if len(w) > 1 and (w[0] + w[1]).isascii() and w[0].isalpha() and w[1].isalpha()}
    assert plain and all((got[i * 100 + 1], got[i * 100 + 3], got[i * 100 + 5], got[i * 100 + 6]) == (f"{w[0]}.{w[1]}", f"src/{w[0]}.py", w[0], w[0]) for i, w in plain.items())


def test_tokens_are_words_and_signs():
    assert documents.words_and_signs("a b, c_d!é") == 6
