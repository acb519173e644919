"""Word pieces by the trie against a plain greedy loop, and chunks whose budgets are those of a given vocabulary."""

from __future__ import annotations

import random
import re
import unicodedata

import pytest

from lorespark.operators import documents, wordpiece

VOCABULARY = ["[PAD]", "[UNK]", "a", "b", "c", "ab", "abc", "bca", "##a", "##b", "##c", "##ab", "##cab", "é", "e", "##e", "the", "##re", "th", "1", "##1", "2", ".", ",", "|", "!", "日", "##", "本", "x", "#"]


def words(text):
    out = unicodedata.normalize("NFD", text.lower())
    out = "".join(c for c in out if c in "\t\n\r " or unicodedata.category(c)[0] != "C" and unicodedata.category(c) != "Mn" and c != "�")
    alone = lambda c: unicodedata.category(c)[0] == "P" or c in "$+<=>^`|~" or any(a <= ord(c) <= b for a, b in wordpiece.IDEOGRAPHS)
    out = "".join(f" {c} " if alone(c) else " " if unicodedata.category(c) == "Zs" else c for c in out)
    return re.split(r"[ \t\n\r]+", out.strip()) if out.strip() else []


def greedy(text, vocabulary):
    n = 0
    for w in words(text):
        pieces, at = 0, 0
        while at < len(w) and len(w) <= wordpiece.LONGEST:
            end = next((e for e in range(len(w), at, -1) if ("##" if at else "") + w[at:e] in vocabulary), None)
            if end is None:
                break
            at, pieces = end, pieces + 1
        n += pieces if at == len(w) else 1
    return n


def test_counts_equal_a_greedy_loop():
    rng = random.Random(9)
    model, vocabulary = wordpiece.WordPiece(VOCABULARY), {*VOCABULARY}
    texts = ["", " \n\t", None, "ABC abc, é é É", "日本 a日b", "a" * 100, "a" * 101, "x\u0000y‍", "##a #", "there", "a b　c", "Straße ÀÉ", "\U0001f600 a", "a.b|c!"]
    texts += ["".join(rng.choice("aabbcceé th.r,1 2|日") for _ in range(rng.randrange(60))) for _ in range(500)]
    assert model.count(texts).tolist() == [greedy(t or "", vocabulary) for t in texts]
    assert wordpiece.WordPiece([]).count(["a b", ""]).tolist() == [2, 0]


@pytest.mark.parametrize("most", [12, 20, 64])
def test_budgets_are_exact_for_the_given_vocabulary(tmp_path, most):
    path = tmp_path / "vocabulary.txt"
    path.write_text("\n".join(VOCABULARY) + "\n", encoding="utf-8")
    size, vocabulary = documents.pieces_of(str(path)), {*VOCABULARY}
    rng = random.Random(most)
    sentence = lambda: " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 9))) + "."
    rows = [("heading", ["ab"], "ab abc")] + [("paragraph", ["ab"], " ".join(sentence() for _ in range(rng.randrange(1, 6)))) for _ in range(20)]
    rows += [("table", ["ab"], "a | b\n" + "\n".join(f"{sentence()} | {sentence()}" for _ in range(6)))]
    chunks = documents.chunk_document("abc", rows, most, most // 4, most // 6, 2, size)
    assert all(n == greedy(whole, vocabulary) for _, _, _, whole, n in chunks)
    assert all(n <= most - 2 for kind, _, _, _, n in chunks if kind != "table")
    # nothing is lost: all letters are there, in their order, before the overlap repeats some
    plain = documents.chunk_document("", rows[1:-1], most, 0, 0, 2, size)
    assert "".join("".join(b.split()) for _, _, b, _, _ in plain) == "".join("".join(b.split()) for _, _, b in rows[1:-1])


def test_chunk_query_takes_a_vocabulary(spark, tmp_path):
    path = tmp_path / "vocabulary.txt"
    path.write_text("\n".join(VOCABULARY), encoding="utf-8")
    units = spark.createDataFrame([(1, "t", 0, "paragraph", "abcabc abc " * 30, []), (2, "t", 0, "paragraph", "", [])], "k long, title string, ordinal int, kind string, body string, headings array<string>")
    got = documents.chunk(units, "k", 40, 5, 0, 4, str(path)).collect()
    assert got and all(r["tokens"] == greedy(r["contextual"], {*VOCABULARY}) <= 36 for r in got)
