"""Cited evidence: references, verification, support, verdicts, and checks of answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

CITATION = r"\[(E\d+)\]"


def references(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """hits(query, rank, source_id, build_id, record_id, path, heading, body) with their numbers E1, E2, ... and fingerprints."""
    n = F.row_number().over(Window.partitionBy(query).orderBy("rank"))
    return hits.withColumn("evidence_id", F.concat(F.lit("E"), n)).withColumn("fingerprint", F.sha2(text.normalized("body"), 256))


def verify(refs: DataFrame, builds: DataFrame, records: DataFrame, allowed: Column) -> DataFrame:
    """refs with (valid, reason): unknown_source, stale_build, filtered or missing_record; builds(source_id, active_build_id), records(source_id, record_id)."""
    j = refs.join(builds, "source_id", "left").join(records.select("source_id", "record_id").distinct().withColumn("found", F.lit(True)), ["source_id", "record_id"], "left")
    reason = F.when(F.col("active_build_id").isNull(), "unknown_source").when(F.col("build_id") != F.col("active_build_id"), "stale_build").when(~allowed, "filtered").when(F.col("found").isNull(), "missing_record")
    return j.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull()).drop("active_build_id", "found")


def support(questions: DataFrame, refs: DataFrame, least: float = 0.5, query: str = "query_id") -> DataFrame:
    """(query, part, status, coverage, missing, evidence) of questions(query, part, question): which of their content terms the valid references hold."""
    terms = questions.select(query, "part", F.explode_outer(text.content_terms("question")).alias("term"))
    body = refs.where("valid").select(query, "evidence_id", F.lower(F.concat_ws(" ", "body", "path", F.coalesce("heading", F.lit("")))).alias("all_text"))
    some = body.groupBy(query).agg(F.count("*").alias("refs"))
    hits = terms.where("term is not null").join(body, query).where(F.contains("all_text", F.col("term")))
    found = hits.select(query, "part", "term").distinct().withColumn("hit", F.lit(1))
    used = hits.groupBy(query, "part").agg(F.array_sort(F.collect_set(F.substring("evidence_id", 2, 10).cast("int"))).alias("evidence"))
    g = terms.join(found, [query, "part", "term"], "left").groupBy(query, "part").agg(F.count("term").alias("wanted"), F.count("hit").alias("held"), F.array_sort(F.collect_set(F.when(F.col("hit").isNull(), F.col("term")))).alias("missing"))
    g = g.join(some, query, "left").join(used, [query, "part"], "left")
    none = F.coalesce("refs", F.lit(0)) == 0
    coverage = F.when(F.col("wanted") == 0, F.when(none, 0.0).otherwise(1.0)).otherwise(F.col("held") / F.col("wanted"))
    status = F.when(none | (coverage == 0), "missing").when(coverage >= least, "supported").otherwise("partial")
    return g.select(query, "part", status.alias("status"), F.round(coverage, 3).alias("coverage"), "missing", F.transform(F.coalesce("evidence", F.array().cast("array<int>")), lambda i: F.concat(F.lit("E"), i)).alias("evidence"))


def verdict(parts: DataFrame, query: str = "query_id") -> DataFrame:
    ok = F.col("status") == "supported"
    return parts.groupBy(query).agg(F.when(F.bool_and(ok), "supported").when(F.bool_or(ok), "partial").otherwise("insufficient_evidence").alias("verdict"))


def check_answer(answer: Column, valid: Column) -> Column:
    """(cited, invalid, unsupported, status) of an answer's citations against the valid evidence ids: sentences of six words and more that cite nothing are unsupported, unless they abstain."""
    named = F.array_distinct(F.regexp_extract_all(answer, F.lit(CITATION), 1))
    cited, invalid = F.filter(named, lambda x: F.array_contains(valid, x)), F.filter(named, lambda x: ~F.array_contains(valid, x))
    sentences = F.transform(F.split(answer, r"[.!?\n]"), F.trim)
    bare = F.filter(sentences, lambda s: (F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= 6) & ~s.rlike(CITATION) & ~F.lower(s).rlike("insufficient|does not answer|not enough evidence|no evidence|cannot answer"))
    none = (F.size(cited) == 0) & (F.size(invalid) == 0) & (F.size(bare) == 0)
    status = F.when(none, "grounded").when((F.size(invalid) > 0) | (F.size(cited) == 0), "ungrounded").when(F.size(bare) == 0, "grounded").otherwise("partially_grounded")
    return F.struct(cited.alias("cited"), invalid.alias("invalid"), bare.alias("unsupported"), status.alias("status"))


def prompts(refs: DataFrame, questions: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, prompt, valid_ids) of questions(query, question): the question and its valid refs(query, evidence_id, rank, path, body, valid), each neutralised under its number."""
    one = F.concat(F.lit("["), "evidence_id", F.lit("] "), "path", F.lit("\n"), text.neutralize("body"))
    held = refs.where("valid").groupBy(query).agg(F.sort_array(F.collect_list(F.struct("rank", one.alias("part"), "evidence_id"))).alias("e"))
    parts, ids = F.transform("e", lambda x: x["part"]), F.transform("e", lambda x: x["evidence_id"])
    head = F.concat(F.lit("Answer from the evidence alone and cite it by its numbers. Question: "), text.neutralize("question"))
    return questions.join(held, query).select(query, F.concat_ws("\n\n", F.array(head), parts).alias("prompt"), ids.alias("valid_ids"))


def ask(refs: DataFrame, questions: DataFrame, verdicts: DataFrame, provider: Callable[[list[str]], list[str]], query: str = "query_id") -> DataFrame:
    """(query, verdict, answer, status): what a provider, a function from prompts to answers, says to each question that isn't abstained from by verdicts(query, verdict), and how well it cites.

    The provider is called on the executors, a batch of prompts at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["answer"] = provider(b["prompt"].tolist())
            yield b.drop(columns="prompt")

    open_ = prompts(refs, questions, query).join(verdicts.where("verdict <> 'insufficient_evidence'").select(query), query, "left_semi")
    said = open_.mapInPandas(run, f"`{query}` {questions.schema[query].dataType.simpleString()}, valid_ids array<string>, answer string")
    judged = said.select(query, "answer", check_answer(F.col("answer"), F.col("valid_ids"))["status"].alias("status"))
    return verdicts.select(query, "verdict").join(judged, query, "left")


def by_coverage(hits: DataFrame, questions: DataFrame, query: str = "query_id") -> DataFrame:
    """hits(query, rank, body) in order of how many of the question's content terms they hold, then by rank."""
    q = questions.select(query, text.content_terms("question").alias("terms"))
    held = F.size(F.filter("terms", lambda t: F.contains(F.lower("body"), t)))
    n = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("held"), "rank")).cast("long")
    return hits.join(q, query).withColumn("held", held.cast("long")).withColumn("position", n).drop("terms")


def keep_each_side(hits: DataFrame, query: str, side: str, page: int) -> DataFrame:
    """The page's first hits, with the best hit of every side in it: a side that has none takes the last places."""
    best = F.row_number().over(Window.partitionBy(query, side).orderBy("rank")) == 1
    flagged = hits.withColumn("best", best)
    order = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("best"), "rank"))
    kept = flagged.withColumn("n", order).where(F.col("n") <= page)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(query).orderBy("rank")).cast("long")).drop("best", "n")


def expand_context(chunks: DataFrame, hits: DataFrame, tokens: Column, budget: int, reach: int = 1) -> DataFrame:
    """(query_id, doc_id, ordinal) of each hit with its neighbours: ``reach`` on each side as long as their running size fits what the hit leaves of the budget; a side stops at the first that doesn't."""
    c = chunks.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal"))).withColumn("size", tokens)
    h = hits.join(c, ["doc_id", "ordinal"]).select("query_id", "doc_id", F.col("n").alias("at"), F.col("size").alias("own"))
    near = h.withColumn("n", F.explode(F.sequence(F.col("at") - reach, F.col("at") + reach))).join(c.select("doc_id", "n", "ordinal", "size"), ["doc_id", "n"])
    near = near.withColumn("side", F.signum(F.col("n") - F.col("at"))).withColumn("far", F.abs(F.col("n") - F.col("at")))
    running = F.sum("size").over(Window.partitionBy("query_id", "doc_id", "at", "side").orderBy("far"))
    return near.withColumn("run", running).where((F.col("side") == 0) | (2 * F.col("run") <= budget - F.col("own"))).select("query_id", "doc_id", "ordinal").distinct()
