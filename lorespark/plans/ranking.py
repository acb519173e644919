"""Ranking queries over search results of the benchmark items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import corpus
from ..functions import text
from ..functions.vectors import dice
from ..operators import lexical as lex
from ..operators import ranking as op
from ..streaming import events
from . import lexical as lexical_plans
from ._base import query

_W = corpus.sql_words("lower(text)")
_HITS = "SELECT query_id, doc_id AS id, score, rank FROM (" + lexical_plans._bm25_sql("SELECT doc_id, text FROM documents", "doc_id", {"text": 1}, 50) + ")"
_NORM = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


def _hits(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    return corpus.index(spark, sf_dir).search(corpus.queries(spark, sf_dir), k).withColumnRenamed("doc_id", "id")


def _with_text(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    return _hits(spark, sf_dir, k).join(corpus.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), "id")


@query("u1_merge_best", "SELECT source AS kind, lang AS id, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1")
def u1_merge_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.table(spark, sf_dir, "documents").select(F.col("source").alias("kind"), F.col("lang").alias("id"), "doc_id", "n_chars")
    return op.best_of(d, ["kind", "id"], [F.desc("n_chars"), "doc_id"])


@query("t1_sort_key", "SELECT doc_id, row_number() OVER (ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END, n_chars DESC, source, doc_id) AS position FROM documents")
def t1_sort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.table(spark, sf_dir, "documents")
    first = F.when(d.lang == "en", 0).when(d.lang == "fr", 1).when(d.lang == "de", 2).otherwise(3)
    # positions without one task for all rows: ranks within a language after the sizes of the languages before it
    sizes = d.groupBy(first.alias("k")).count()
    before = sizes.select("k", F.coalesce(F.sum("count").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return d.withColumn("k", first).withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("n_chars"), "source", "doc_id"))).join(before, "k").select("doc_id", (F.col("before") + F.col("n")).alias("position"))


@query("u2_dedup_content", f"""WITH h AS (SELECT query_id, id, rank, {_NORM} AS body FROM ({_HITS}) JOIN documents ON id = doc_id), k AS (SELECT *, CASE WHEN len(string_split(body, ' ')) >= 4 THEN body ELSE id::VARCHAR END AS b FROM h)
 SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, b ORDER BY rank) AS n FROM k) WHERE n = 1""")
def u2_dedup_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _with_text(spark, sf_dir)
    return op.dedup(h, ["query_id"], ["id"], text.normalized("text"), ["rank"]).select("query_id", "id", "rank")


@query("w5_caps_per_source", f"SELECT query_id, id, rank FROM (SELECT h.*, source, lang = 'es' AS pinned, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n FROM ({_HITS}) h JOIN documents ON id = doc_id) WHERE n <= 2 OR pinned")
def w5_caps_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _with_text(spark, sf_dir).withColumn("pinned", F.col("lang") == "es")
    return op.cap(h, ["query_id", "source"], ["rank"], 2, "pinned").select("query_id", "id", "rank")


@query("f19_dice_pairs", f"""WITH h AS (SELECT query_id, id, rank, list_distinct(list_filter({_W}, lambda x: length(x) >= 3)) AS w FROM ({_HITS}) JOIN documents ON id = doc_id WHERE rank <= 10)
 SELECT a.query_id, a.id, b.id AS other_id, round(CASE WHEN len(a.w) + len(b.w) > 0 THEN 2.0::DOUBLE * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)) ELSE 0 END, 6) AS dice FROM h a JOIN h b ON a.query_id = b.query_id AND b.rank = a.rank + 1""")
def f19_dice_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _with_text(spark, sf_dir, 10).select("query_id", "id", "rank", F.array_distinct(F.filter(text.lower_words("text"), lambda x: F.length(x) >= 3)).alias("w"))
    nxt = h.select("query_id", F.col("id").alias("other_id"), (F.col("rank") - 1).alias("rank"), F.col("w").alias("v"))
    return h.join(nxt, ["query_id", "rank"]).select("query_id", "id", "other_id", F.round(dice(F.col("w"), F.col("v")), 6).alias("dice"))


@query("t11_mmr")
def t11_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _with_text(spark, sf_dir, 20).select("query_id", "id", "rank", F.array_distinct(F.filter(text.lower_words("text"), lambda x: F.length(x) >= 3)).alias("tokens"))
    return op.mmr(h, "query_id")


@query("w10_running_budget", f"""WITH RECURSIVE h AS ({_HITS}), a AS (SELECT query_id, rank, id, n_chars FROM h JOIN documents ON id = doc_id WHERE rank <= 20),
 w(query_id, rank, n, used, kept) AS (SELECT query_id, 0::BIGINT, 0, 0::BIGINT, false FROM (SELECT DISTINCT query_id FROM a) UNION ALL SELECT w.query_id, a.rank, w.n + CASE WHEN w.used + n_chars <= 30000 AND w.n < 20 THEN 1 ELSE 0 END, w.used + CASE WHEN w.used + n_chars <= 30000 AND w.n < 20 THEN n_chars ELSE 0 END, w.used + n_chars <= 30000 AND w.n < 20 FROM w JOIN a ON a.query_id = w.query_id AND a.rank = w.rank + 1)
 SELECT w.query_id, w.rank, a.id, a.n_chars FROM w JOIN a USING (query_id, rank) WHERE kept""")
def w10_running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _with_text(spark, sf_dir, 20).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "n_chars"))).alias("items"))
    kept = op.within_budget(F.col("items"), lambda x: x["n_chars"], 30_000, 20)
    return g.select("query_id", F.explode(kept).alias("x")).select("query_id", "x.rank", "x.id", "x.n_chars")


_CONF = "CASE confidence WHEN 'exact' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"


@query("u4_t7_evidence_order", f"""WITH e AS (SELECT event_id, user_id AS path, CASE event_type WHEN 'purchase' THEN 'exact' WHEN 'signup' THEN 'high' WHEN 'click' THEN 'medium' ELSE 'heuristic' END AS confidence, CASE WHEN value > 50 THEN event_id % 7 END AS line FROM events),
 b AS (SELECT *, row_number() OVER (PARTITION BY path, line ORDER BY {_CONF} DESC, event_id) AS n FROM e)
 SELECT event_id, path, row_number() OVER (PARTITION BY path ORDER BY {_CONF} DESC, line NULLS LAST, event_id) AS position FROM b WHERE n = 1""")
def u4_t7_evidence_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.table(spark, sf_dir, "events")
    c = F.when(e.event_type == "purchase", 3).when(e.event_type == "signup", 2).when(e.event_type == "click", 1).otherwise(0)
    e = e.select("event_id", F.col("user_id").alias("path"), c.alias("c"), F.when(e.value > 50, e.event_id % 7).alias("line"))
    b = op.best_of(e, ["path", "line"], [F.desc("c"), "event_id"])
    return b.withColumn("position", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("c"), F.asc_nulls_last("line"), "event_id")).cast("long")).select("event_id", "path", "position")


@query("t9_rerank_head", f"""WITH h AS ({_HITS}), s AS (SELECT h.*, CASE WHEN rank <= 20 THEN 0 ELSE 1 END AS tail, CASE WHEN rank <= 20 THEN n_chars END AS other FROM h JOIN documents ON id = doc_id)
 SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY tail, other DESC NULLS LAST, rank, id) AS position FROM s""")
def t9_rerank_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _with_text(spark, sf_dir)
    return op.rerank(h.select("query_id", "id", "rank"), "query_id", h.select("query_id", "id", F.col("n_chars").alias("other"))).select("query_id", "id", "position")


@query("v12_neural_rerank")
def v12_neural_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorer is pluggable; without weights at hand, shared words stand in for it."""
    b = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    h = _with_text(spark, sf_dir, 20).join(b, "query_id").select("query_id", "id", "rank", "question", F.col("text").alias("passage"))
    scored = op.pandas_score(lambda q, p: [float(len(set(a.lower().split()) & set(c.lower().split()))) for a, c in zip(q, p, strict=True)], h)
    return op.rerank(h.select("query_id", "id", "rank"), "query_id", scored.select("query_id", "id", "other")).select("query_id", "id", "position")


@query("t12_error_feed", "SELECT event_id, user_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, user_id, event_id LIMIT 20")
def t12_error_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "events").where("event_type = 'error'").orderBy(F.desc("ts"), "user_id", "event_id").limit(20).select("event_id", "user_id", "ts")


_PICK = "CASE WHEN ts <= TIMESTAMP '2024-01-02' THEN 0 WHEN event_type = 'purchase' THEN 1 ELSE 2 END, CASE WHEN ts <= TIMESTAMP '2024-01-02' THEN ts END, event_id"


@query("t13_fair_pick", f"SELECT event_id FROM events ORDER BY {_PICK} LIMIT 1")
def t13_fair_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as waiting requests, purchases as urgent ones, a day's wait as the longest."""
    return _queue(spark, sf_dir).orderBy(*_order()).limit(1).select("event_id")


@query("x5_fair_order", f"SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY {_PICK}) AS turn FROM events")
def x5_fair_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for every user's queue: in which order its requests would be taken at one moment."""
    w = Window.partitionBy("user_id").orderBy(*_order())
    return _queue(spark, sf_dir).select("event_id", "user_id", F.row_number().over(w).cast("long").alias("turn"))


def _order() -> list[Column]:
    return events.pick_order(F.lit("2024-01-03").cast("timestamp_ntz"), 86_400)


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.col("ts").alias("enqueued_at"), (e.event_type == "purchase").alias("urgent"), F.col("event_id").alias("place"))


@query("w1_top_per_key", "SELECT l_orderkey, l_partkey, rank FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 3")
def w1_top_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = corpus.table(spark, sf_dir, "lineitem")
    return op.top(li, ["l_orderkey"], [F.desc("l_extendedprice"), "l_linenumber", "l_partkey"], 3).select("l_orderkey", "l_partkey", "rank")


@query("w6_sibling_window", f"""WITH c AS ({corpus.CHUNKS}), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS k FROM c)
 SELECT a.doc_id, a.ordinal, p.body AS before, q.body AS after FROM n a LEFT JOIN n p ON p.doc_id = a.doc_id AND p.k = a.k - 1 LEFT JOIN n q ON q.doc_id = a.doc_id AND q.k = a.k + 1""")
def w6_sibling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    return corpus.chunks(spark, sf_dir).select("doc_id", "ordinal", F.lag("body").over(w).alias("before"), F.lead("body").over(w).alias("after"))


@query("w12_adjacent_dedup", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type")
def w12_adjacent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return corpus.table(spark, sf_dir, "events").withColumn("p", F.lag("event_type").over(w)).where(~F.equal_null("p", "event_type")).select("event_id")


@query("u6_edge_union", f"WITH c AS ({corpus.CALLS}) SELECT 'incoming' AS direction, id FROM c WHERE type = 'calls' UNION ALL SELECT 'outgoing', id FROM c WHERE type = 'calls' UNION ALL SELECT 'incoming', id FROM c WHERE type = 'references'")
def u6_edge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.calls(spark, sf_dir)
    pick = lambda t, d: c.where(F.col("type") == t).select(F.lit(d).alias("direction"), "id")
    return pick("calls", "incoming").unionByName(pick("calls", "outgoing")).unionByName(pick("references", "incoming"))
