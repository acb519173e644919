"""Token counts by a WordPiece vocabulary: longest matches from a trie, walked for all words of many texts at once.

A text is lower-cased, freed of accents and control characters, and cut at white space, punctuation and ideographs; a word is then the longest piece of the vocabulary that it begins
with, and so on with pieces marked ``##``; one that can't be made up of pieces, or is longer than LONGEST, is one unknown token.  The trie's edges are one sorted array of numbers, and so are words: no object is made for a token.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

#: Code points of the longest word that is taken apart; what marks a piece within a word; blocks of ideographs.
LONGEST, WITHIN = 100, "##"
IDEOGRAPHS = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)]
_WORD, _SPACE, _ALONE, _NOTHING = range(4)
_CODES = 1 << 21


@cache
def _classes() -> np.ndarray:
    """Of each code point: part of a word, white space, a word of its own, or nothing."""
    out = np.full(0x110000, _WORD, np.uint8)
    for c in range(0x30000):
        kind = unicodedata.category(chr(c))
        if kind == "Zs" or c in (9, 10, 13):
            out[c] = _SPACE
        elif kind[0] == "C" or c == 0xFFFD or kind == "Mn":
            out[c] = _NOTHING
        elif kind[0] == "P" or 33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126:
            out[c] = _ALONE
    for a, b in IDEOGRAPHS:
        out[a : b + 1] = _ALONE
    return out


class WordPiece:
    def __init__(self, vocabulary: list[str]):
        nodes: dict[tuple[int, int], int] = {}
        ends = {}
        roots = (0, 1)
        n = 2
        for piece in vocabulary:
            node = roots[piece.startswith(WITHIN) and len(piece) > len(WITHIN)]
            for c in piece[len(WITHIN) :] if node else piece:
                child = nodes.setdefault((node, ord(c)), n)
                n += child == n
                node = child
            if node > 1:
                ends[node] = True
        keys = np.array([a * _CODES + c for a, c in nodes], np.int64) if nodes else np.zeros(0, np.int64)
        order = np.argsort(keys)
        self.keys, self.children = keys[order], np.array(list(nodes.values()), np.int64)[order] if nodes else keys
        self.accepts = np.zeros(n, bool)
        self.accepts[list(ends)] = True

    @classmethod
    def load(cls, path: str) -> WordPiece:
        """A vocabulary file, a piece a line."""
        return _load(path)

    def count(self, texts: list[str | None]) -> np.ndarray:
        """The number of tokens of each text, no special ones added."""
        spelled = [unicodedata.normalize("NFD", (t or "").lower()) for t in texts]
        codes = np.frombuffer("\n".join(spelled).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in spelled])[: len(codes)] if texts else np.zeros(0, np.int64)
        kind = _classes()[codes]
        kept = kind != _NOTHING
        codes, owner, kind = codes[kept], owner[kept], kind[kept]
        inside = kind == _WORD
        before = np.concatenate([[False], inside[:-1] & (owner[1:] == owner[:-1])])[: len(inside)]
        start = np.flatnonzero(inside & ~before | (kind == _ALONE))
        more = np.concatenate([inside[1:] & (owner[1:] == owner[:-1]), [False]])[: len(inside)]
        end = np.flatnonzero(inside & ~more | (kind == _ALONE)) + 1
        return np.bincount(owner[start], weights=self._pieces(codes, start, end), minlength=len(texts)).astype(np.int64)

    def _pieces(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of pieces of each word."""
        out = np.zeros(len(start), np.int64)
        at = start.copy()
        live = np.flatnonzero(end - start <= LONGEST)
        out[end - start > LONGEST] = 1
        while len(live):
            # the longest piece from each word's place on
            node = np.where(at[live] == start[live], 0, 1)
            far, place, on = at[live].copy(), at[live].copy(), np.arange(len(live))
            while len(on):
                key = node[on] * _CODES + codes[place[on]]
                i = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
                hit = self.keys[i] == key if len(self.keys) else np.zeros(len(on), bool)
                on, i = on[hit], i[hit]
                node[on] = self.children[i]
                place[on] += 1
                good = on[self.accepts[node[on]]]
                far[good] = place[good]
                on = on[place[on] < end[live[on]]]
            stuck = far == at[live]
            out[live[stuck]] = 1  # unknown, whatever came before
            out[live[~stuck]] += 1
            at[live] = far
            live = live[~stuck & (far < end[live])]
        return out


@cache
def _load(path: str) -> WordPiece:
    with open(path, encoding="utf-8") as f:
        return WordPiece([line.rstrip("\r\n") for line in f])
