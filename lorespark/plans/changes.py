"""Change-detection queries: two scans of the documents' files, and states made of the shop tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import corpus
from ..operators import changes as op
from ._base import query

_CTE = f"WITH o AS ({corpus.FILES}), s AS ({corpus.FILES_AFTER}), "
_DIFF = _CTE + """b AS (SELECT coalesce(s.rel_path, o.rel_path) AS rel_path, s.size, s.mtime, s.content_hash, s.kind, o.size AS old_size, o.mtime AS old_mtime, o.content_hash AS old_hash, o.kind AS old_kind FROM s FULL JOIN o ON s.rel_path = o.rel_path),
 n AS (SELECT rel_path, content_hash, kind, row_number() OVER (PARTITION BY content_hash, kind ORDER BY rel_path) AS k FROM b WHERE old_hash IS NULL),
 g AS (SELECT rel_path, old_hash AS content_hash, old_kind AS kind, count(*) OVER (PARTITION BY old_hash, old_kind) AS c FROM b WHERE content_hash IS NULL),
 m AS (SELECT n.rel_path, g.rel_path AS old_path FROM n JOIN g USING (content_hash, kind) WHERE k = 1 AND c = 1),
 d AS (SELECT rel_path, NULL::VARCHAR AS old_path, CASE WHEN size = old_size AND abs(mtime - old_mtime) < 1e-6 THEN 'unchanged' WHEN content_hash = old_hash THEN 'unchanged_restat' ELSE 'changed' END AS decision FROM b WHERE content_hash IS NOT NULL AND old_hash IS NOT NULL
  UNION ALL SELECT n.rel_path, m.old_path, CASE WHEN m.old_path IS NULL THEN 'new' ELSE 'moved' END FROM n LEFT JOIN m USING (rel_path)
  UNION ALL SELECT rel_path, NULL, 'deleted' FROM g WHERE rel_path NOT IN (SELECT old_path FROM m))"""


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.diff(corpus.files_after(spark, sf_dir), corpus.files(spark, sf_dir))


@query("c1_snapshot_diff", _DIFF + " SELECT * FROM d")
def c1_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir)


@query("c2_renames", _DIFF + " SELECT * FROM m")
def c2_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).where("decision = 'moved'").select("rel_path", "old_path")


@query("c3_racy_files", f"SELECT rel_path, abs(doc_id + 1.5 - mtime) < 2 AS racy FROM ({corpus.FILES_AFTER})")
def c3_racy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpus.files_after(spark, sf_dir)
    return f.select("rel_path", op.racy(f.mtime, f.doc_id + 1.5).alias("racy"))


@query("c4_hash_candidates", _CTE + "x AS (SELECT s.rel_path, s.size, s.mtime, o.size AS os, o.mtime AS om FROM s LEFT JOIN o USING (rel_path)) SELECT rel_path FROM x WHERE os IS NULL OR NOT (size = os AND abs(mtime - om) < 1e-6)")
def c4_hash_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = corpus.files(spark, sf_dir).select("rel_path", F.col("size").alias("os"), F.col("mtime").alias("om"))
    s = corpus.files_after(spark, sf_dir).join(o, "rel_path", "left")
    return s.where(F.col("os").isNull() | ~op.stat_unchanged(s.size, s.mtime, F.col("os"), F.col("om"))).select("rel_path")


@query("c6_incomplete_scan", _CTE + "x AS (SELECT o.rel_path FROM o LEFT JOIN s USING (rel_path) WHERE s.rel_path IS NULL) SELECT rel_path, 'unseen' AS decision FROM x")
def c6_incomplete_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.diff(corpus.files_after(spark, sf_dir), corpus.files(spark, sf_dir), complete=False).where("decision = 'unseen'").select("rel_path", "decision")


@query("a7_diff_counts", _DIFF + """ SELECT count(*) FILTER (decision = 'new') AS "new", count(*) FILTER (decision = 'changed') AS changed, count(*) FILTER (decision = 'unchanged') AS unchanged, count(*) FILTER (decision = 'unchanged_restat') AS unchanged_restat, count(*) FILTER (decision = 'moved') AS moved,
 count(*) FILTER (decision = 'unseen') AS unseen, count(*) FILTER (decision = 'deleted') AS deleted, count(*) FILTER (decision IN ('new', 'changed', 'moved')) AS to_process FROM d""")
def a7_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.counts(_decisions(spark, sf_dir))


@query("c7_to_process", _DIFF + " SELECT rel_path, decision FROM d WHERE decision IN ('new', 'changed', 'moved')")
def c7_to_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).where(F.col("decision").isin("new", "changed", "moved")).select("rel_path", "decision")


@query("c8_retry_backoff", "SELECT event_id, a AS attempts, CASE WHEN a < 5 THEN least(2 * pow(2, greatest(a, 1) - 1), 300) END::DOUBLE AS wait FROM (SELECT event_id, event_id % 9 AS a FROM events)")
def c8_retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 9).alias("attempts"))
    return e.withColumn("wait", op.backoff(F.col("attempts")))


@query("c9_rebuild_plan", """WITH t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'needs_full_rebuild' WHEN 1 THEN 'building' WHEN 2 THEN 'failed' ELSE 'published' END AS st, CASE WHEN c_custkey % 8 = 0 THEN 'asked' END AS rr, CASE WHEN c_custkey % 3 > 0 THEN 'b' || c_custkey END AS ab, c_custkey % 5 AS v FROM customer),
 r AS (SELECT c_custkey, CASE WHEN st = 'needs_full_rebuild' THEN coalesce(rr, 'needs_full_rebuild') WHEN ab IS NULL THEN 'no published build' WHEN v = 1 THEN 'versions changed: parser_version' WHEN v = 2 THEN 'versions changed: parser_version, embedding_model_id' END AS reason FROM t)
 SELECT 'src' || c_custkey AS source_id, CASE WHEN reason IS NULL THEN 'incremental' ELSE 'full' END AS mode, reason FROM r""")
def c9_rebuild_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    built = F.struct(F.when((k % 5).isin(1, 2), "p0").otherwise("p1").alias("parser_version"), F.lit("c1").alias("chunker_version"), F.lit("v1").alias("converter_version"), F.when(k % 5 == 2, F.lit(None).cast("string")).otherwise("m1").alias("embedding_model_id"), F.lit("t1").alias("embedding_text_version"))
    current = F.struct(F.lit("p1").alias("parser_version"), F.lit("c1").alias("chunker_version"), F.lit("v1").alias("converter_version"), F.lit("m1").alias("embedding_model_id"), F.lit("t1").alias("embedding_text_version"))
    state = F.when(k % 4 == 0, "needs_full_rebuild").when(k % 4 == 1, "building").when(k % 4 == 2, "failed").otherwise("published")
    s = corpus.table(spark, sf_dir, "customer").select(F.concat(F.lit("src"), k).alias("source_id"), state.alias("build_state"), F.when(k % 8 == 0, "asked").alias("rebuild_reason"), F.when(k % 3 > 0, F.concat(F.lit("b"), k)).alias("active_build_id"), built.alias("built"), current.alias("current"))
    return op.rebuild_plan(s)


_STATES = "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'failed' WHEN 2 THEN 'stale' ELSE 'ready' END AS state, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 3 END AS bb, 1 AS b, o_orderkey % 2 AS bg, 1 AS g, o_orderkey % 5 > 0 AS sd, o_orderkey % 11 > 5 AS sg FROM orders"


@query("g17_graph_plan", f"""WITH x AS (SELECT *, bb IS NOT DISTINCT FROM b AS sr, (bb IS NOT DISTINCT FROM b) AND sd AS complete, state IN ('failed', 'stale', 'building') AS retry FROM ({_STATES})), y AS (SELECT *, state = 'ready' AND bg = g AND sd AND sg AS skip FROM x)
 SELECT 'src' || k AS source_id, CASE WHEN skip THEN 'skip' WHEN complete AND sg THEN 'rebind' WHEN retry THEN 'retry' WHEN NOT complete THEN 'full' ELSE 'incremental' END AS action,
 CASE WHEN skip THEN 'current' WHEN complete AND sg THEN 'equivalent_snapshot' WHEN NOT complete THEN CASE WHEN bb IS NULL THEN 'first_build' WHEN NOT sd THEN 'derivation_changed' WHEN NOT sr THEN 'base_rebuilt' ELSE 'metadata_missing' END WHEN retry THEN 'retry_after_failure' ELSE 'files_changed' END AS reason, NOT skip AND NOT complete AS "full" FROM y""")
def g17_graph_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = corpus.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("src"), k).alias("source_id"),
        F.when(k % 4 == 1, "failed").when(k % 4 == 2, "stale").otherwise("ready").alias("state"),
        F.when(k % 7 > 0, k % 3).alias("base_build_id"), F.lit(1).alias("build_id"), (k % 2).alias("base_generation"), F.lit(1).alias("generation"),
        F.when(k % 5 > 0, "d").otherwise("e").alias("base_derivation"), F.lit("d").alias("derivation"), F.when(k % 11 > 5, "h").otherwise("i").alias("base_digest"), F.lit("h").alias("digest"), F.lit(True).alias("manifest_ok"),
    )
    return op.graph_plan(s)


@query("c11_active_builds", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 1 + l_suppkey % 3")
def c11_active_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_linenumber").cast("long").alias("build_id"), "l_orderkey", "l_linenumber")
    active = corpus.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), (1 + F.col("s_suppkey") % 3).alias("build_id"))
    return op.visible(rows, active).select("l_orderkey", "l_linenumber")


@query("c12_job_claim", "SELECT event_id AS id, user_id % 10 AS priority FROM events WHERE event_type <> 'error' AND ts <= TIMESTAMP '2030-01-01' ORDER BY user_id % 10 DESC, ts, event_id LIMIT 1")
def c12_job_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = corpus.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("priority"), F.when(F.col("event_type") == "error", "failed").otherwise("queued").alias("status"), F.col("ts").alias("created_at"), F.col("ts").alias("next_attempt_at"))
    return op.claim(j, F.lit("2030-01-01").cast("timestamp_ntz")).select("id", "priority")


@query("c13_carry_forward", f"""WITH s AS ({corpus.FILES_AFTER}), e AS (SELECT DISTINCT doc_id AS file_id, md5(doc_id || 'e') AS id FROM documents JOIN labels USING (doc_id)), l AS (SELECT d.doc_id AS entity_id, b.item_id AS document_id FROM documents d, benchmark b WHERE d.doc_id % 40 = b.item_id)
 SELECT 'edge' AS kind, id FROM e WHERE file_id IN (SELECT doc_id FROM s) UNION ALL SELECT DISTINCT 'link', entity_id || ':' || document_id FROM l WHERE entity_id IN (SELECT doc_id FROM s) AND document_id IN (SELECT doc_id FROM labels)""")
def c13_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = corpus.table(spark, sf_dir, "documents"), corpus.table(spark, sf_dir, "benchmark")
    files = corpus.files_after(spark, sf_dir).select(F.col("doc_id").alias("file_id"))
    edges = d.join(corpus.table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("file_id"), F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("e"))).alias("id"))
    links = d.select(F.col("doc_id").alias("entity_id"), (F.col("doc_id") % 40).alias("document_id")).join(b.select(F.col("item_id").alias("document_id")), "document_id")
    e, l = op.carry_forward(edges, links, files, files.select(F.col("file_id").alias("entity_id")), corpus.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id")))
    return e.select(F.lit("edge").alias("kind"), "id").unionByName(l.select(F.lit("link").alias("kind"), F.concat_ws(":", "entity_id", "document_id").alias("id")))


@query("c17_stale_vectors", "SELECT 'stale' AS kind, vec_id AS id FROM embeddings WHERE label <> 1 UNION ALL SELECT 'pending', doc_id FROM documents WHERE trim(text) <> '' AND doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 1)")
def c17_stale_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = corpus.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("fingerprint"))
    old, pending = op.stale(v, corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "1")
    return old.select(F.lit("stale").alias("kind"), "id").unionByName(pending.select(F.lit("pending").alias("kind"), "id"))


@query("c18_network_diff", _CTE + "x AS (SELECT coalesce(o.rel_path, s.rel_path) AS rel_path, o.size AS a, s.size AS b, o.mtime AS c, s.mtime AS d FROM o FULL JOIN s ON o.rel_path = s.rel_path) SELECT rel_path FROM x WHERE a IS DISTINCT FROM b OR c IS DISTINCT FROM d")
def c18_network_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.changed_paths(corpus.files(spark, sf_dir), corpus.files_after(spark, sf_dir))


@query("s11_conversion_cache", "SELECT content_hash, count(*) AS files, bool_or(hit) AS cached FROM (SELECT sha256(text) AS content_hash, doc_id IN (SELECT doc_id FROM labels) AS hit FROM documents) GROUP BY content_hash")
def s11_conversion_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import files

    d = corpus.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    known = d.join(corpus.table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("content_hash").distinct()
    cache = known.select("content_hash", F.lit("v1").alias("options"), F.lit("converted").alias("value")).unionByName(known.select("content_hash", F.lit("v0").alias("options"), F.lit("old").alias("value")))
    hits, rest = files.uncached(d, cache, "v1")
    return hits.select("content_hash", F.lit(True).alias("hit")).unionByName(rest.select("content_hash", F.lit(False).alias("hit"))).groupBy("content_hash").agg(F.count("*").alias("files"), F.bool_or("hit").alias("cached"))


@query("s15_upsert", f"SELECT rel_path, content_hash, mtime FROM ({corpus.FILES_AFTER}) UNION ALL SELECT rel_path, content_hash, mtime FROM ({corpus.FILES}) WHERE rel_path NOT IN (SELECT rel_path FROM ({corpus.FILES_AFTER}))")
def s15_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["rel_path", "content_hash", "mtime"]
    return op.upsert(corpus.files(spark, sf_dir).select(cols), corpus.files_after(spark, sf_dir).select(cols), ["rel_path"])


@query("u8_insert_or_ignore", f"SELECT rel_path, mtime FROM ({corpus.FILES}) UNION ALL SELECT rel_path, mtime FROM ({corpus.FILES_AFTER}) WHERE rel_path NOT IN (SELECT rel_path FROM ({corpus.FILES}))")
def u8_insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.keep_first(corpus.files(spark, sf_dir).select("rel_path", "mtime"), corpus.files_after(spark, sf_dir).select("rel_path", "mtime"), ["rel_path"])


@query("u5_changed_keys", _CTE + "x AS (SELECT coalesce(o.doc_id, s.doc_id) AS doc_id, o.content_hash AS a, s.content_hash AS b FROM o FULL JOIN s ON o.doc_id = s.doc_id) SELECT doc_id FROM x WHERE a IS DISTINCT FROM b")
def u5_changed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.symmetric_difference(corpus.files(spark, sf_dir), corpus.files_after(spark, sf_dir), "doc_id", "content_hash")
