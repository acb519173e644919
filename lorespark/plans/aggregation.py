"""Aggregates: counts, roll-ups, percentiles, digests, retrieval measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import corpus
from ..functions import ids
from ..operators import graph
from . import lexical as lexical_plans
from ._base import query


@query("a1_chunk_kind_counts", f"SELECT doc_id, count(*) FILTER (kind = 'heading') AS headings, count(*) FILTER (kind = 'paragraph') AS paragraphs, count(*) FILTER (kind = 'table') AS tables FROM ({corpus.CHUNKS}) GROUP BY doc_id")
def a1_chunk_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"headings": "heading", "paragraphs": "paragraph", "tables": "table"}
    return corpus.chunks(spark, sf_dir).groupBy("doc_id").agg(*(F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()))


@query("a2_build_summary", f"SELECT count(*) AS files, count(*) FILTER (size > 2000) AS large, count(DISTINCT content_hash) AS distinct_files, min(size) AS smallest, max(size) AS largest, sum(size)::BIGINT AS bytes, min(mtime) AS first_time, max(mtime) AS last_time, count(DISTINCT source_id) AS sources, count(*) FILTER (lang = 'en') AS english, count(DISTINCT lang) AS languages FROM ({corpus.FILES})")
def a2_build_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpus.files(spark, sf_dir)
    return f.agg(
        F.count("*").alias("files"), F.count_if(f.size > 2000).alias("large"), F.countDistinct("content_hash").alias("distinct_files"), F.min("size").alias("smallest"), F.max("size").alias("largest"), F.sum("size").alias("bytes"),
        F.min("mtime").alias("first_time"), F.max("mtime").alias("last_time"), F.countDistinct("source_id").alias("sources"), F.count_if(f.lang == "en").alias("english"), F.countDistinct("lang").alias("languages"),
    )


_TABLES = ["documents", "pages", "conversations", "embeddings", "events", "labels", "benchmark"]


@query("a3_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _TABLES))
def a3_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t in _TABLES:
        one = corpus.table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("a4_newest_error", "SELECT user_id, max(ts) AS newest FROM events WHERE event_type = 'error' GROUP BY user_id")
def a4_newest_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "events").where("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("newest"))


@query("a5_status_rollup", "SELECT user_id, event_type, count(*) AS n, round(max(value), 6) AS most, min(ts) AS earliest FROM events GROUP BY ROLLUP (user_id, event_type)")
def a5_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "events").rollup("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("most"), F.min("ts").alias("earliest"))


@query("a6_graph_aggregates", f"SELECT type, count(*) AS edges, count(DISTINCT source_id) AS sources, count(DISTINCT target_id) AS targets FROM ({corpus.CALLS}) GROUP BY type")
def a6_graph_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.calls(spark, sf_dir).groupBy("type").agg(F.count("*").alias("edges"), F.countDistinct("source_id").alias("sources"), F.countDistinct("target_id").alias("targets"))


@query("a8_status_summary", "SELECT CASE WHEN bool_or(q IS NULL) THEN NULL ELSE sum(q) END::BIGINT AS quality, count(q) AS known, count(*) AS files FROM (SELECT doc_id, max(quality) AS q FROM documents LEFT JOIN labels USING (doc_id) GROUP BY doc_id)")
def a8_status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.table(spark, sf_dir, "documents").join(corpus.table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("doc_id").agg(F.max("quality").cast("long").alias("q"))
    return d.agg(F.when(~F.bool_or(F.col("q").isNull()), F.sum("q")).alias("quality"), F.count("q").alias("known"), F.count("*").alias("files"))


@query("a9_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def a9_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "events").groupBy("event_type").agg(*(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)").alias(n) for n, p in (("p50", 0.5), ("p95", 0.95))))


@query("a10_page_range", f"SELECT doc_id, min(ordinal) AS first_line, max(ordinal) AS last_line, count(*) AS lines FROM ({corpus.CHUNKS}) GROUP BY doc_id")
def a10_page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunks(spark, sf_dir).groupBy("doc_id").agg(F.min("ordinal").alias("first_line"), F.max("ordinal").alias("last_line"), F.count("*").alias("lines"))


@query("a11_low_text_density", f"SELECT doc_id, sum(length(body))::DOUBLE / count(*) < 50 OR 2 * count(DISTINCT CASE WHEN length(trim(body)) > 10 THEN ordinal END) < count(*) AS scanned FROM ({corpus.CHUNKS}) GROUP BY doc_id")
def a11_low_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = corpus.chunks(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.length("body")).alias("chars"), F.count("*").alias("lines"), F.countDistinct(F.when(F.length(F.trim("body")) > 10, F.col("ordinal"))).alias("full"))
    return g.select("doc_id", ((F.col("chars") / F.col("lines") < 50) | (2 * F.col("full") < F.col("lines"))).alias("scanned"))


@query("a12_digests", "SELECT l_orderkey, sha256(array_to_string(list_sort(list(l_partkey || ':' || l_linenumber)), chr(10))) AS digest FROM lineitem GROUP BY l_orderkey")
def a12_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(ids.digest(F.concat_ws(":", "l_partkey", "l_linenumber")).alias("digest"))


@query("a13_blast_radius", "SELECT target_id, count(DISTINCT source_id) AS score, CASE WHEN count(DISTINCT source_id) <= 2 THEN 'LOW' WHEN count(DISTINCT source_id) <= 7 THEN 'MEDIUM' ELSE 'HIGH' END AS radius FROM (" + corpus.CALLS + ") GROUP BY target_id")
def a13_blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = corpus.calls(spark, sf_dir).groupBy("target_id").agg(F.countDistinct("source_id").alias("score"))
    return g.withColumn("radius", graph.radius(F.col("score")))


@query("a14_highest_confidence", "SELECT user_id, CASE max(CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) WHEN 3 THEN 'exact' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'heuristic' END AS confidence FROM events GROUP BY user_id")
def a14_highest_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.table(spark, sf_dir, "events")
    name = F.when(e.event_type == "purchase", "exact").when(e.event_type == "signup", "high").when(e.event_type == "click", "medium").otherwise("heuristic")
    rank = F.when(e.event_type == "purchase", 3).when(e.event_type == "signup", 2).when(e.event_type == "click", 1).otherwise(0)
    return e.groupBy("user_id").agg(F.max_by(name, rank).alias("confidence"))


_HITS = lexical_plans._bm25_sql("SELECT doc_id, text FROM documents", "doc_id", {"text": 1}, 10)


@query("a15_retrieval_measures", f"""WITH h AS ({_HITS}), rel AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
 n AS (SELECT query_id, count(*) AS total FROM rel GROUP BY query_id), x AS (SELECT rel.query_id, total, rank FROM rel JOIN n USING (query_id) LEFT JOIN h USING (query_id, doc_id)),
 i AS (SELECT query_id, sum(1 / log2(1 + k)) AS ideal FROM (SELECT query_id, unnest(range(1, least(total, 10) + 1)) AS k FROM n) GROUP BY query_id)
 SELECT query_id, round(count(rank) FILTER (rank <= 3) / max(total)::DOUBLE, 4) AS recall_3, round(count(rank) / max(total)::DOUBLE, 4) AS recall_10, round(coalesce(1.0::DOUBLE / min(rank), 0), 4) AS mrr, round(coalesce(sum(1 / log2(1 + rank)), 0) / max(ideal), 4) AS ndcg_10 FROM x JOIN i USING (query_id) GROUP BY query_id""")
def a15_retrieval_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.table(spark, sf_dir, "documents")
    b = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    from ..functions import text

    # relevant: documents that hold the item's text; found among those that hold all its words in order, then compared as they are
    near = corpus.index(spark, sf_dir).phrases(b.select("query_id", text.lower_words("text").alias("words")))
    rel = near.join(d.select("doc_id", F.col("text").alias("body")), "doc_id").join(b, "query_id").where(F.contains("body", F.col("text"))).select("query_id", "doc_id")
    hits = corpus.index(spark, sf_dir).search(corpus.queries(spark, sf_dir), 10)
    total = rel.groupBy("query_id").agg(F.count("*").alias("total"))
    gain = 1 / F.log2(1 + F.col("rank"))
    x = rel.join(total, "query_id").join(hits.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.max("total").alias("total"), F.count_if(F.col("rank") <= 3).alias("r3"), F.count("rank").alias("r10"), F.min("rank").alias("first"), F.sum(gain).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("total"), F.lit(10)).cast("int")), F.lit(0.0), lambda a, k: a + 1 / F.log2(1 + k))
    return x.select("query_id", F.round(F.col("r3") / F.col("total"), 4).alias("recall_3"), F.round(F.col("r10") / F.col("total"), 4).alias("recall_10"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 4).alias("mrr"), F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 4).alias("ndcg_10"))


@query("a16_verdicts", "SELECT source, CASE WHEN bool_and(ok) THEN 'supported' WHEN bool_or(ok) THEN 'partial' ELSE 'insufficient_evidence' END AS verdict FROM (SELECT source, lang <> 'es' AND n_chars > 40 AS ok FROM documents) GROUP BY source")
def a16_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.table(spark, sf_dir, "documents").withColumn("ok", F.expr("lang <> 'es' and n_chars > 40"))
    return d.groupBy("source").agg(F.when(F.bool_and("ok"), "supported").when(F.bool_or("ok"), "partial").otherwise("insufficient_evidence").alias("verdict"))


@query("a17_health", "SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 90) THEN 'failed' WHEN bool_or(event_type = 'error' AND value > 60) THEN 'unknown' WHEN bool_or(event_type = 'error') THEN 'degraded' ELSE 'ok' END AS health FROM events GROUP BY user_id")
def a17_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.table(spark, sf_dir, "events").withColumn("bad", F.expr("event_type = 'error'"))
    return e.groupBy("user_id").agg(F.when(F.bool_or(F.expr("bad and value > 90")), "failed").when(F.bool_or(F.expr("bad and value > 60")), "unknown").when(F.bool_or("bad"), "degraded").otherwise("ok").alias("health"))


@query("j17_max_per_key", "SELECT c_custkey, max(o_totalprice) AS most, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def j17_max_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.table(spark, sf_dir, "customer").join(corpus.table(spark, sf_dir, "orders"), F.expr("c_custkey = o_custkey"), "left")
    return c.groupBy("c_custkey").agg(F.max("o_totalprice").alias("most"), F.count("o_orderkey").alias("orders"))


@query("n10_chunk_diagnostics", f"SELECT kind, count(*) AS chunks, max(length(body)) AS longest, sum(length(body))::BIGINT AS characters FROM ({corpus.CHUNKS}) GROUP BY kind")
def n10_chunk_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("body").cast("long")
    return corpus.chunks(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("chunks"), F.max(n).alias("longest"), F.sum(n).alias("characters"))
