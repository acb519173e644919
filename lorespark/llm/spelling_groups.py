"""Spelling variants of words: anagram hashing.

A word's key is the sum of a power of each of its letters, so words of the same letters share it, whatever their order, and one letter added,
taken away or exchanged changes it by that letter's value.  Each word states its key and, for each of its distinct letters, the key without that
letter.  A key met among the others' shortened ones is one letter less; two shortened ones that meet are an exchange.  Of words that meet so, the
order of letters is then verified: ``levenshtein`` of at most 1 is exactly one inserted, deleted or replaced code point.

Words whose letters are the same may be many (random strings, say), and so may words that share all letters but one.  They are therefore dealt
out further by their ends: of two words one edit apart, the first AFFIX code points or the last AFFIX are the same, as no word has under
2 * AFFIX.  So only words that share letters and an end are held against each other, inside the join, which no pair leaves unverified.

A word has at most some alphabet-times-length near words, which bounds what one group gathers.  Forms are far more frequent than their words, so
chains of forms are short (a factor a step) and without circles; roots are found by doubling, each round a written table.

Defined results: null texts hold no words; a null doc_id is written as nothing before the colon; repeated rows count each; extra columns are ignored;
an empty table gives no rows; words of any letters and of any length from 2 * AFFIX on work (letters share values modulo 4096, keys are modulo 2**62: words that meet by chance
are verified like all others).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spark

#: The words' letters, and the power that tells sums of letters apart.
LETTERS = r"[A-Za-zÀ-ÿ]+"
POWER = 5
SPACE = 1 << 62
#: Code points of a word's end by which words of like letters are dealt out; words have twice as many at least.
AFFIX = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run): every maximal run of letters of every text, A to Z lower-cased."""
    found = F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))


def without(word: Column, at: Column) -> Column:
    """The word less its code point at ``at``, from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))


def count_words(words: DataFrame, least: int = 2 * AFFIX, often: int = 5) -> DataFrame:
    """(word, n) of words(word) with ``least`` code points and ``often`` occurrences at least; summed up in the tasks before they are shuffled."""
    return words.where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def _value(letter: Column) -> Column:
    code = (F.ascii(letter) % 4096).cast("long")
    out = code
    for _ in range(POWER - 1):
        out = out * code
    return out


def with_key(words: DataFrame) -> DataFrame:
    """words and their ``letters`` and ``key``, the sum of the letters' powers."""
    split = words.withColumn("letters", F.split("word", ""))
    return split.withColumn("key", F.aggregate("letters", F.lit(0).cast("long"), lambda total, c: F.pmod(total + _value(c), F.lit(SPACE))))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of words(word, n), each once: all pairs, in both directions, that are one edit apart.  Words of under 2 * AFFIX code points are refused."""
    if short := words.where(F.char_length("word") < 2 * AFFIX).head(1):
        raise ValueError(f"{short[0]['word']!r} is too short: words of under {2 * AFFIX} code points need share no end of {AFFIX} with those one edit away")
    keyed = with_key(words)
    whole = keyed.select("word", "n", F.col("key").alias("value"), F.lit(False).alias("shorter"))
    each = keyed.select("word", "n", "key", F.explode(F.array_distinct("letters")).alias("letter"))
    less = each.select("word", "n", F.pmod(F.col("key") - _value(F.col("letter")), F.lit(SPACE)).alias("value"), F.lit(True).alias("shorter"))

    def ends(df: DataFrame, *more: str) -> DataFrame:
        both = F.array(F.concat(F.lit("<"), F.substring("word", 1, AFFIX)), F.concat(F.lit(">"), F.substring("word", -AFFIX, AFFIX)))
        return df.select("word", "n", "value", *more, F.explode(both).alias("end"))

    a, b = ends(less).alias("a"), ends(less.unionByName(whole), "shorter").alias("b")
    size = lambda side: F.char_length(f"{side}.word")
    one_less = ~F.col("b.shorter") & (size("a") == size("b") + 1)
    exchange = F.col("b.shorter") & (size("a") == size("b")) & (F.col("a.word") < F.col("b.word"))
    # words that share both ends meet twice; the first counts
    first = F.col("a.end").startswith("<") | (F.substring("a.word", 1, AFFIX) != F.substring("b.word", 1, AFFIX))
    verified = F.levenshtein("a.word", "b.word", 1) == 1
    same = (F.col("a.value") == F.col("b.value")) & (F.col("a.end") == F.col("b.end"))
    # rows are told from the words' file, compressed and before they go apart, so by their own size they seem small enough to be sent to the driver whole
    met = a.join(b.hint("merge"), same & (one_less | exchange) & first & verified).select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))
    # letters that share a value modulo 4096 may bring two words together twice
    met = met.distinct()
    turned = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return met.select(F.explode(turned).alias("p")).select("p.*")


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words(word, n), a row each.

    The form is the near word of largest n, ties to the smallest in code-point order, if that n is ``times`` the word's at least; else null.
    The root is the last word that forms lead to, the word itself without any.
    """
    words = _spark.written(words, "words")
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    told = words.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("b.m")).alias("m"), "b.near")
    taken = F.col("m") >= times * F.col("n")
    told = _spark.written(told.select("word", "n", "n_near", F.when(taken, F.col("near")).alias("form"), F.when(taken, F.col("m")).alias("form_n")), "forms")
    ends = roots(told.where("form is not null").select("word", "form"))
    return told.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form), which has no circle: each round's step is twice the one before."""
    spark = forms.sparkSession
    now, path = forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), None
    while True:
        upto = _spark.fresh_path(spark, "roots")
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = _spark.written(now.join(step.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), upto)
        if path:
            _spark.drop_path(spark, path)
        now, path = new, upto
        if new.where("moved").isEmpty():
            return new.select("word", "root")
