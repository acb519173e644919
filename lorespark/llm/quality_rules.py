"""Quality rules: learned decision lists as ordered Spark conditional expressions.

``features`` measures whole texts with built-in functions only (no Python on the executors).  ``learn`` fits a
decision list by sequential covering: each rule is a conjunction of thresholds on those statistics, grown
condition by condition to the best FOIL gain on two thirds of the labelled rows and pruned back on the other third;
rows it covers leave, and the next rule is learned from the rest.  Rules that don't beat their class's share on the pruning rows
end the list.  ``apply`` turns the list into one ``when ... when ... otherwise`` expression.

Learning is bounded: at most ``SAMPLE`` labelled rows, those with the smallest hash of their id, and only their
numbers, come to the driver.

A word is a run of anything but 0x20 and 0x09-0x0D.  n_repeat_words compares windows of five words by a 64-bit hash within one text.

Defined results: null and empty texts have no words, fail the base rules and aren't kept; labels that are null are not
learned from; without labels of both classes the list is empty and every text that passes the base rules is kept; rows that
repeat a doc_id each get a verdict; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spark

BLANK = "[\\x20\\x09-\\x0D]+"
SAMPLE, BINS, MAX_RULES, MAX_CONDITIONS = 20_000, 24, 12, 4
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, though body uses it in a lambda many times."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    n = F.size(words)

    def covered(h: Column) -> Column:
        def places(s: Column) -> Column:
            same = lambda x, i, j: (j >= 0) & (j < F.size(s)) & F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            hit = F.filter(s, lambda x, i: same(x, i, i - 1) | same(x, i, i + 1))
            return F.array_sort(F.transform(hit, lambda x: x["i"]))

        def length(p: Column) -> Column:
            step = F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(5)), F.lit(5)).cast("long"))
            return F.aggregate(step, F.lit(0).cast("long"), lambda a, b: a + b)

        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(pairs, lambda s: _let(places(s), length)))

    hashes = F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice(words, i, 5)))
    return F.when(n < 6, F.lit(0).cast("long")).otherwise(_let(hashes, covered))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of docs(doc_id, text)."""
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    words = F.filter(F.split("t", BLANK), lambda x: x != "")
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r"))

    d = d.select(
        "doc_id",
        F.length(F.regexp_replace("t", BLANK, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        _let(words, of_words).alias("w"),
    )
    d = d.select("doc_id", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words"))
    return d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def statistics() -> dict[str, Column]:
    """The shares that rules put thresholds on."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {"n_words": F.col("n_words").cast("double"), "mean_word": F.col("word_chars") / n, "symbol_share": F.col("n_symbols") / n, "dup_line_share": F.col("n_dup_lines") / n, "repeat_share": F.col("n_repeat_words") / n}


#: (feature, ">=" or "<", threshold)
Condition = tuple[str, str, float]


def _holds(c: Condition, row: dict) -> bool:
    return row[c[0]] >= c[2] if c[1] == ">=" else row[c[0]] < c[2]


def _counts(rows: list[dict]) -> tuple[int, int]:
    bad = sum(1 for r in rows if not r["good"])
    return bad, len(rows) - bad


def _grow(rows: list[dict]) -> list[Condition]:
    """Adds the threshold of the greatest FOIL gain until only bad rows are covered."""
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS:
        p0, n0 = _counts(rows)
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        base = math.log2(p0 / (p0 + n0))
        for f in FEATURES:
            values = sorted(r[f] for r in rows)
            cuts = sorted({values[len(values) * k // BINS] for k in range(1, BINS)} | {values[max(0, len(values) - 1 - len(values) // 200)], values[len(values) // 200]})
            up = sorted(((r[f], not r["good"]) for r in rows), reverse=True)
            k = p = n = 0
            for cut in reversed(cuts):
                while k < len(up) and up[k][0] >= cut:
                    p, n, k = p + up[k][1], n + (not up[k][1]), k + 1
                for op, a, b in ((">=", p, n), ("<", p0 - p, n0 - n)):
                    if a and (g := a * (math.log2(a / (a + b)) - base)) > gain:
                        best, gain = (f, op, cut), g
        if best is None:
            break
        rule.append(best)
        rows = [r for r in rows if _holds(best, r)]
    return rule


def _worth(rule: list[Condition], rows: list[dict]) -> float:
    p, n = _counts([r for r in rows if all(_holds(c, r) for c in rule)])
    return (p - n) / (p + n) if p + n else -1.0


def _prune(rule: list[Condition], rows: list[dict]) -> list[Condition]:
    while len(rule) > 1 and _worth(rule[:-1], rows) >= _worth(rule, rows):
        rule = rule[:-1]
    return rule


def learn_rows(rows: list[dict]) -> list[list[Condition]]:
    """An ordered list of rules for bad texts from labelled rows, {feature: value, good: bool, fold: 0, 1 or 2}."""
    grow, prune = [r for r in rows if r["fold"]], [r for r in rows if not r["fold"]]
    rules: list[list[Condition]] = []
    while len(rules) < MAX_RULES and _counts(grow)[0] and _counts(prune)[0]:
        rule = _prune(_grow(grow), prune)
        # precise on rows it was not grown from, and on all that are left
        if not rule or _worth(rule, prune) <= 0.5 or _worth(rule, grow) <= 0.5:
            break
        rules.append(rule)
        covered = lambda r, rule=rule: all(_holds(c, r) for c in rule)
        grow, prune = [r for r in grow if not covered(r)], [r for r in prune if not covered(r)]
    return rules


def learn(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Condition]]:
    """A decision list from features() and labels(doc_id, quality)."""
    key = F.xxhash64(F.lit("quality"), "doc_id")
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality is not null and doc_id is not null")
    chosen = said.select("doc_id", "quality", key.alias("k")).orderBy("k", "doc_id", "quality").limit(sample)
    stats = statistics()
    got = measured.where("not base_failed").join(F.broadcast(chosen), "doc_id").select("k", "quality", *(v.alias(f) for f, v in stats.items())).orderBy("k").limit(2 * sample).collect()
    return learn_rows([{f: r[f] for f in FEATURES} | {"good": r["quality"] != 0, "fold": r["k"] % 3} for r in got])


def verdict(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that holds, from 1; null if none does."""
    stats = statistics()
    out = F.lit(None).cast("int")
    for i, rule in reversed([*enumerate(rules, 1)]):
        hold = F.lit(True)
        for f, op, cut in rule:
            hold = hold & (stats[f] >= cut if op == ">=" else stats[f] < cut)
        out = F.when(hold, F.lit(i)).otherwise(out)
    return out


def apply(measured: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """features() with rule (which one rejects the text) and kept."""
    return measured.withColumn("rule", F.when(~F.col("base_failed"), verdict(rules))).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Features are computed once, written to the shared folder, learned from and judged."""
    measured = _spark.written(features(docs), "features")
    return apply(measured, learn(measured, labels))
