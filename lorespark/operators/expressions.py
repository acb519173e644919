"""Query expressions - quoted terms and phrases, prefixes, AND, OR, parentheses - parsed on the driver into a plan over postings."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import lexical

_TOKEN = re.compile(r'\s*(?:"([^"]*)"|(\()|(\))|(AND\b)|(OR\b)|([^\s()"]+))')


def parse(expression: str) -> tuple:
    """("term", word), ("prefix", head), ("phrase", words), ("and", parts) or ("or", parts); AND binds tighter. A bad expression is a ValueError."""
    tokens, at = [], 0
    while at < len(expression.rstrip()):
        m = _TOKEN.match(expression, at)
        if not m:
            raise ValueError(f"cannot read {expression[at:]!r}")
        tokens.append(m)
        at = m.end()
    k = 0

    def either() -> tuple:
        nonlocal k
        parts = [both()]
        while k < len(tokens) and tokens[k][5]:
            k += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def both() -> tuple:
        nonlocal k
        parts = [atom()]
        while k < len(tokens) and tokens[k][4]:
            k += 1
            parts.append(atom())
        return parts[0] if len(parts) == 1 else ("and", parts)

    def atom() -> tuple:
        nonlocal k
        if k == len(tokens):
            raise ValueError("the expression ends too soon")
        m = tokens[k]
        k += 1
        if m[2]:
            inner = either()
            if k == len(tokens) or not tokens[k][3]:
                raise ValueError("a parenthesis is not closed")
            k += 1
            return inner
        if m[1] is not None:
            words = re.findall(r"\w+", m[1].lower())
            return ("phrase", words) if len(words) > 1 else ("term", words[0] if words else "")
        if m[6]:
            word = m[6].lower()
            return ("prefix", word[:-1]) if word.endswith("*") else ("term", word)
        raise ValueError(f"{m[0].strip()!r} stands in the wrong place")

    out = either()
    if k < len(tokens):
        raise ValueError(f"{tokens[k][0].strip()!r} stands in the wrong place")
    return out


def safe(asked: Column | str) -> Column:
    """An expression for any text: its words, each quoted, must all be there; what would be an operator in it is a word.  A text without words gives null."""
    c = F.col(asked) if isinstance(asked, str) else asked
    parts = F.filter(F.split(F.replace(c, F.lit('"'), F.lit(" ")), r"\s+"), lambda x: x.rlike(r"[\p{L}\p{N}_]"))
    return F.nullif(F.array_join(F.transform(parts, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " AND "), F.lit(""))


def leaves(tree: tuple) -> list[tuple]:
    return [x for p in tree[1] for x in leaves(p)] if tree[0] in ("and", "or") else [tree]


def _distinct(tree: tuple) -> list[tuple]:
    return list(dict.fromkeys((k, tuple(v) if k == "phrase" else v) for k, v in leaves(tree)))


def _value(tree: tuple, at: dict[tuple, Column]) -> Column:
    if tree[0] in ("and", "or"):
        return reduce(Column.__and__ if tree[0] == "and" else Column.__or__, (_value(x, at) for x in tree[1]))
    return at[(tree[0], tuple(tree[1]) if tree[0] == "phrase" else tree[1])]


def matches(records: DataFrame, key: str, field: str, tree: tuple) -> DataFrame:
    """(key) of the records an expression holds for.

    All terms and prefixes come from one pass over the postings, pivoted to one truth a leaf; phrases join as semi-joins on their own.
    """
    parts = _distinct(tree)
    posted = records.select(key, F.explode_outer(F.array_distinct(text.lower_words(field))).alias("w"))
    truth = [F.coalesce(F.bool_or(F.col("w") == v if k == "term" else F.startswith("w", F.lit(v))), F.lit(False)).alias(f"p{i}") for i, (k, v) in enumerate(parts) if k != "phrase"]
    rows = posted.groupBy(key).agg(*(truth or [F.count("*").alias("_n")]))
    for i, (k, v) in enumerate(parts):
        if k == "phrase":
            asked = records.sparkSession.createDataFrame([(0, list(v))], "query_id int, words array<string>")
            rows = rows.join(lexical.phrase_hits(records, key, field, asked).select(key).withColumn(f"p{i}", F.lit(True)), key, "left").fillna(False, [f"p{i}"])
    return rows.where(_value(tree, {p: F.col(f"p{i}") for i, p in enumerate(parts)})).select(key)


def indexed(index: lexical.Index, tree: tuple) -> DataFrame:
    """(key) of the records of a stored index that an expression holds for: its leaves' postings only, and no record, is read.

    An expression has no negation, so a record it holds for has one leaf's postings at least.
    """
    parts = _distinct(tree)
    words = [(i, k, v) for i, (k, v) in enumerate(parts) if k != "phrase"]
    found = []
    if words:
        of = lambda i, k, v: F.when(F.col("term") == v if k == "term" else F.startswith("term", F.lit(v)), F.lit(i))
        met = F.filter(F.array(*(of(*w) for w in words)), lambda x: x.isNotNull())
        any_of = reduce(Column.__or__, (F.col("term") == v if k == "term" else F.startswith("term", F.lit(v)) for _, k, v in words))
        found.append(index.posted(lambda b: b.where(any_of)).select(index.key, F.explode(met).alias("leaf")))
    if phrases := [(i, list(v)) for i, (k, v) in enumerate(parts) if k == "phrase"]:
        asked = index.spark.createDataFrame(phrases, "query_id int, words array<string>")
        found.append(index.phrases(asked).select(index.key, F.col("query_id").alias("leaf")))
    rows = reduce(DataFrame.unionByName, found).groupBy(index.key).agg(*(F.bool_or(F.col("leaf") == i).alias(f"p{i}") for i in range(len(parts))))
    return rows.where(_value(tree, {p: F.col(f"p{i}") for i, p in enumerate(parts)})).select(index.key)
