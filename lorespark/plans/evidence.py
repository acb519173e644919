"""Evidence queries: questions about benchmark items, answered from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import corpus, shared
from ..functions import routing, text
from ..operators import evidence as op
from ..operators import lexical as lex
from . import lexical as lexical_plans
from . import scalars
from ._base import query

_Q = corpus.QUESTIONS_SQL


def _ci(pattern: str) -> str:
    return "regexp_matches(t, '" + pattern.replace("'", "''") + "', 'i')"


_NAMED = "regexp_extract_all(t, '" + routing.NAMED + "', 1)"
_SUFFIXES = ", ".join(f"'{x}'" for x in routing.FILE_SUFFIXES)
_ROUTE = f"""WITH q AS (SELECT question_id, trim(question) AS t FROM ({_Q})), n AS (SELECT *, {_NAMED} AS named, regexp_matches(t, '{routing.IDENTIFIER}') AS ident FROM q),
 s AS (SELECT *, len(named) >= 2 AS many, regexp_matches(t, '{routing.PATH}') AND (contains(t, '/') OR regexp_extract(t, '\\.([^.]*)$', 1) IN ({_SUFFIXES}) OR NOT ident) AS is_path, ident AND (contains(t, '.') OR contains(t, '_') OR t <> lower(t)) AS is_symbol,
  length(t) - length(replace(t, '?', '')) >= 2 OR contains(t, ';') AS parts, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) AS words FROM n),
 r AS (SELECT *, CASE WHEN is_path THEN 'path_lookup' WHEN is_symbol THEN 'exact_symbol' WHEN {_ci(routing.IMPACT)} THEN 'impact_analysis' WHEN {_ci(routing.COMPARISON)} AND many THEN 'cross_source_comparison' WHEN {_ci(routing.NAVIGATION)} THEN 'code_navigation' WHEN parts THEN 'multi_hop'
  WHEN {_ci(routing.MULTI_HOP)} AND many THEN 'multi_hop' WHEN {_ci(routing.COMPARISON)} THEN 'cross_source_comparison' WHEN {_ci(routing.DOCUMENT)} THEN 'document_fact' WHEN {_ci(routing.MULTI_HOP)} THEN 'multi_hop' WHEN {_ci(routing.QUESTION)} AND words >= 4 THEN 'conceptual' ELSE 'ambiguous' END AS intent,
  CASE WHEN is_path OR is_symbol THEN 0.95 WHEN {_ci(routing.IMPACT)} THEN 0.9 WHEN {_ci(routing.COMPARISON)} AND many THEN 0.9 WHEN {_ci(routing.NAVIGATION)} THEN 0.85 WHEN parts THEN 0.85 WHEN {_ci(routing.MULTI_HOP)} AND many THEN 0.8 WHEN {_ci(routing.COMPARISON)} THEN 0.75 WHEN {_ci(routing.DOCUMENT)} THEN 0.7
  WHEN {_ci(routing.MULTI_HOP)} THEN 0.6 WHEN {_ci(routing.QUESTION)} AND words >= 4 THEN 0.6 ELSE 0.3 END::DOUBLE AS confidence FROM s)"""


@query("v13_route", _ROUTE + " SELECT question_id, intent, confidence, intent = 'ambiguous' AS fallback FROM r")
def v13_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = corpus.questions(spark, sf_dir).select("question_id", routing.route(F.col("question"), semantic=True, decompose=True).alias("r"))
    return r.select("question_id", "r.intent", "r.confidence", "r.fallback")


# word boundaries know no accents in the oracle's regular expressions; unit tests hold the targets
@query("v13_route_targets")
def v13_route_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.questions(spark, sf_dir).select("question_id", routing.route(F.col("question"))["target"].alias("target"))


_STRATEGY = "CASE intent " + " ".join(f"WHEN '{k}' THEN '{('decompose ' if d else '') + b + (' semantic hybrid_fusion rerank' if s else '')}'" for k, (b, s, d) in routing.INTENTS.items()) + " END"


@query("v13_strategies", _ROUTE + f" SELECT question_id, {_STRATEGY} AS strategies FROM r")
def v13_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.questions(spark, sf_dir).select("question_id", routing.route(F.col("question"), semantic=True, reranker=True, decompose=True)["strategies"].alias("strategies"))


@query("v14_explore_plan", f"""WITH q AS (SELECT question_id, trim(question) AS t FROM ({_Q})) SELECT question_id, CASE WHEN regexp_matches(t, 'what breaks if|impact of|what depends on|blast radius', 'i') THEN 'impact' WHEN regexp_matches(t, 'who calls|callers of|what calls', 'i') THEN 'callers'
 WHEN regexp_matches(t, 'what does [\\w.]+ call|callees of', 'i') THEN 'callees' WHEN {_ci(routing.DOCUMENT)} THEN 'document' WHEN regexp_matches(t, '{routing.IDENTIFIER}') THEN 'identifier' ELSE 'general' END AS intent FROM q""")
def v14_explore_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.questions(spark, sf_dir).select("question_id", routing.explore_plan(F.col("question")).alias("intent"))


_XY = f"SELECT item_id, coalesce(w[1], 'nothing') AS x, coalesce(w[2], w[1], 'nothing') AS y FROM (SELECT item_id, list_filter({corpus.sql_words('text')}, lambda z: length(z) >= 5) AS w FROM benchmark)"


@query("v15_decompose", f"""WITH b AS ({_XY}), p AS (SELECT item_id * 100 + 7 AS question_id, 1 AS part, 'comparison' AS role, x || ' speed' AS text FROM b UNION ALL SELECT item_id * 100 + 7, 2, 'comparison', y || ' speed' FROM b
 UNION ALL SELECT item_id * 100 + 8, 1, 'comparison', x FROM b UNION ALL SELECT item_id * 100 + 8, 2, 'comparison', y FROM b UNION ALL SELECT item_id * 100 + 9, 1, 'comparison', x || ' limits' FROM b UNION ALL SELECT item_id * 100 + 9, 2, 'comparison', y || ' limits' FROM b
 UNION ALL SELECT item_id * 100 + 13, 1, 'part', 'what is ' || x FROM b UNION ALL SELECT item_id * 100 + 13, 2, 'part', 'and what is ' || y FROM b UNION ALL SELECT item_id * 100 + 14, 1, 'part', 'explain ' || x || ' then ' || y FROM b UNION ALL SELECT item_id * 100 + 14, 2, 'part', 'list the uses of ' || y FROM b)
,
 f AS (SELECT question_id, list_filter([{", ".join(f"regexp_replace(regexp_extract(question, '{routing.FLOW}', {i}), '[?.!]+$', '')" for i in range(1, 5))}], lambda z: z <> '') AS h FROM ({_Q}) WHERE regexp_matches(question, '{routing.FLOW}')),
 u AS (SELECT question_id, list_filter(h, lambda z, i: NOT list_contains(list_transform(h[1:i - 1], lambda v: lower(v)), lower(z))) AS h FROM f)
 SELECT question_id, part, role, text FROM p JOIN b ON b.item_id = question_id // 100 WHERE lower(x) <> lower(y) OR role = 'part'
 UNION ALL SELECT question_id, generate_subscripts(h, 1), 'hop', unnest(h) FROM u WHERE len(h) >= 2""")
def v15_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.questions(spark, sf_dir).select("question_id", F.posexplode(routing.decompose(F.col("question"))).alias("part", "p")).select("question_id", (F.col("part") + 1).alias("part"), "p.role", "p.text")


_TOP = lexical_plans._bm25_sql("SELECT doc_id, text FROM documents", "doc_id", {"text": 1}, 5)
_REFS = f"WITH r AS (SELECT query_id, 'E' || row_number() OVER (PARTITION BY query_id ORDER BY rank) AS evidence_id, rank, d.source AS source_id, d.doc_id AS record_id, d.lang, d.n_chars, source || '/' || d.doc_id || '.txt' AS path, split_part(text, chr(10), 1) AS heading, text AS body FROM ({_TOP}) JOIN documents d USING (doc_id))"


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.table(spark, sf_dir, "documents")
    h = corpus.index(spark, sf_dir).search(corpus.queries(spark, sf_dir), 5).join(d, "doc_id")
    h = h.select("query_id", "rank", F.col("source").alias("source_id"), F.when(F.col("lang") == "fr", "old").otherwise("now").alias("build_id"), F.col("doc_id").alias("record_id"), F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.split("text", "\n")[0].alias("heading"), F.col("text").alias("body"), "lang")
    return op.references(h)


@query("v18_evidence_refs", _REFS + " SELECT query_id, evidence_id, path, sha256(lower(trim(regexp_replace(body, '\\s+', ' ', 'g')))) AS fingerprint FROM r")
def v18_evidence_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refs(spark, sf_dir).select("query_id", "evidence_id", "path", "fingerprint")


_VERIFIED = _REFS + ", v AS (SELECT *, CASE WHEN source_id = 'src4' THEN 'unknown_source' WHEN lang = 'fr' THEN 'stale_build' WHEN source_id = 'src6' THEN 'filtered' WHEN record_id NOT IN (SELECT doc_id FROM labels) THEN 'missing_record' END AS reason FROM r)"


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.table(spark, sf_dir, "documents")
    builds = d.select(F.col("source").alias("source_id")).distinct().where("source_id <> 'src4'").withColumn("active_build_id", F.lit("now"))
    records = d.join(corpus.table(spark, sf_dir, "labels"), "doc_id", "left_semi").select(F.col("source").alias("source_id"), F.col("doc_id").alias("record_id"))
    return op.verify(_refs(spark, sf_dir), builds, records, F.col("source_id") != "src6")


@query("v19_verify", _VERIFIED + " SELECT query_id, evidence_id, reason IS NULL AS valid, reason FROM v")
def v19_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verified(spark, sf_dir).select("query_id", "evidence_id", "valid", "reason")


_CONTENT = scalars._CONTENT
_SUPPORT = _VERIFIED + f""", q AS (SELECT question_id // 100 AS query_id, (question_id % 100)::INT AS part, {_CONTENT.format('question')} AS terms FROM ({_Q})),
 t AS (SELECT DISTINCT query_id, part, unnest(CASE WHEN len(terms) = 0 THEN [NULL] ELSE terms END) AS term FROM q), b AS (SELECT query_id, evidence_id, lower(concat_ws(' ', body, path, heading)) AS x FROM v WHERE reason IS NULL),
 h AS (SELECT t.query_id, part, term, count(b.evidence_id) AS n FROM t LEFT JOIN b ON t.query_id = b.query_id AND contains(x, term) GROUP BY ALL),
 c AS (SELECT query_id, part, count(term) AS wanted, count(term) FILTER (n > 0) AS held FROM h GROUP BY ALL), k AS (SELECT c.*, coalesce(refs, 0) AS refs FROM c LEFT JOIN (SELECT query_id, count(*) AS refs FROM b GROUP BY 1) USING (query_id)),
 s AS (SELECT query_id, part, refs, CASE WHEN wanted = 0 THEN CASE WHEN refs = 0 THEN 0.0 ELSE 1.0 END ELSE held / wanted::DOUBLE END AS cov FROM k),
 p AS (SELECT query_id, part, CASE WHEN refs = 0 OR cov = 0 THEN 'missing' WHEN cov >= 0.5 THEN 'supported' ELSE 'partial' END AS status, round(cov, 3)::DOUBLE AS coverage FROM s)"""


def _support(spark: SparkSession, sf_dir: str, verified: DataFrame | None = None) -> DataFrame:
    q = corpus.questions(spark, sf_dir).select(F.floor(F.col("question_id") / 100).alias("query_id"), (F.col("question_id") % 100).cast("int").alias("part"), "question")
    return op.support(q, shared.written(_verified(spark, sf_dir), "verified") if verified is None else verified)


@query("v20_support", _SUPPORT + " SELECT * FROM p")
def v20_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _support(spark, sf_dir).select("query_id", "part", "status", "coverage")


@query("v21_abstain", _SUPPORT + " SELECT query_id, CASE WHEN bool_and(status = 'supported') THEN 'supported' WHEN bool_or(status = 'supported') THEN 'partial' ELSE 'insufficient_evidence' END AS verdict FROM p GROUP BY query_id")
def v21_abstain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.verdict(_support(spark, sf_dir))


@query("v22_check_answer", """WITH a AS (SELECT conv_id, turn, text || ' [E' || (turn + 1) || '] and [E9].' AS answer FROM conversations), s AS (SELECT *, list_filter(list_transform(regexp_split_to_array(answer, '[.!?\\n]'), lambda x: trim(x)), lambda x: len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')) >= 6
  AND NOT regexp_matches(x, '\\[E\\d+\\]') AND NOT regexp_matches(lower(x), 'insufficient|does not answer|not enough evidence|no evidence|cannot answer')) AS bare, list_distinct(regexp_extract_all(answer, '\\[(E\\d+)\\]', 1)) AS named FROM a)
 SELECT conv_id, turn, len(list_filter(named, lambda x: x IN ('E1', 'E2', 'E3', 'E9'))) AS cited, len(list_filter(named, lambda x: x NOT IN ('E1', 'E2', 'E3', 'E9'))) AS invalid, len(bare) AS unsupported,
 CASE WHEN len(list_filter(named, lambda x: x NOT IN ('E1', 'E2', 'E3', 'E9'))) > 0 THEN 'ungrounded' WHEN len(bare) = 0 THEN 'grounded' ELSE 'partially_grounded' END AS status FROM s""")
def v22_check_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = corpus.table(spark, sf_dir, "conversations").withColumn("answer", F.concat("text", F.lit(" [E"), F.col("turn") + 1, F.lit("] and [E9].")))
    c = a.select("conv_id", "turn", op.check_answer(F.col("answer"), F.array(*(F.lit(x) for x in ("E1", "E2", "E3", "E9")))).alias("c"))
    return c.select("conv_id", "turn", F.size("c.cited").cast("long").alias("cited"), F.size("c.invalid").cast("long").alias("invalid"), F.size("c.unsupported").cast("long").alias("unsupported"), "c.status")


_TERMS = f"SELECT item_id AS query_id, list_distinct({_CONTENT.format('text')}) AS terms FROM benchmark"


@query("v23_coverage_order", _REFS + f", x AS (SELECT r.query_id, rank, len(list_filter(terms, lambda w: contains(lower(body), w))) AS held FROM r JOIN ({_TERMS}) USING (query_id)) SELECT query_id, rank, held, row_number() OVER (PARTITION BY query_id ORDER BY held DESC, rank) AS position FROM x")
def v23_coverage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return op.by_coverage(_refs(spark, sf_dir), q).select("query_id", "rank", "held", "position")


_TOP30 = lexical_plans._bm25_sql("SELECT doc_id, text FROM documents", "doc_id", {"text": 1}, 30)


@query("v24_keep_each_side", f"""WITH h AS (SELECT query_id, doc_id, rank, lang, row_number() OVER (PARTITION BY query_id, lang ORDER BY rank) = 1 AS best FROM ({_TOP30}) JOIN documents USING (doc_id)), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, rank) AS n FROM h)
 SELECT query_id, doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM k WHERE n <= 10""")
def v24_keep_each_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.table(spark, sf_dir, "documents")
    h = corpus.index(spark, sf_dir).search(corpus.queries(spark, sf_dir), 30).join(d.select("doc_id", "lang"), "doc_id")
    return op.keep_each_side(h, "query_id", "lang", 10).select("query_id", "doc_id", "rank", "position")


@query("v17_evidence", _SUPPORT + f""", x AS (SELECT v.query_id, v.evidence_id, v.path, v.rank, len(list_filter(terms, lambda w: contains(lower(body), w))) AS held FROM v JOIN ({_TERMS}) USING (query_id) WHERE reason IS NULL), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY held DESC, rank) AS position FROM x),
 vd AS (SELECT query_id, CASE WHEN bool_and(status = 'supported') THEN 'supported' WHEN bool_or(status = 'supported') THEN 'partial' ELSE 'insufficient_evidence' END AS verdict FROM p GROUP BY query_id)
 SELECT query_id, verdict, position, evidence_id, path FROM vd LEFT JOIN o USING (query_id)""")
def v17_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieve, cite, verify, order by coverage, judge support, and abstain where there is too little."""
    q = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    # judged and shown: retrieved and verified once for both
    verified = shared.written(_verified(spark, sf_dir), "verified")
    found = op.by_coverage(verified.where("valid"), q)
    return op.verdict(_support(spark, sf_dir, verified)).join(found, "query_id", "left").select("query_id", "verdict", "position", "evidence_id", "path")


_C = corpus.CHUNKS


@query("n11_context", f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS n, len(regexp_extract_all(body, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')) AS size FROM ({_C})), h AS (SELECT doc_id AS query_id, doc_id, n AS mid, size AS own FROM c WHERE ordinal = 2),
 x AS (SELECT h.query_id, c.doc_id, c.ordinal, c.n - mid AS delta, c.size, own FROM h JOIN c ON c.doc_id = h.doc_id AND c.n BETWEEN mid - 2 AND mid + 2), r AS (SELECT *, sum(size) OVER (PARTITION BY query_id, sign(delta) ORDER BY abs(delta)) AS run FROM x)
 SELECT query_id, doc_id, ordinal FROM r WHERE delta = 0 OR 2 * run <= 300 - own""")
def n11_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.chunks(spark, sf_dir)
    return op.expand_context(c, c.where("ordinal = 2").select(F.col("doc_id").alias("query_id"), "doc_id", "ordinal"), text.token_count("body"), 300, 2)


@query("v26_search", f"""WITH h AS ({lexical_plans._bm25_sql('SELECT doc_id, text FROM documents', 'doc_id', {'text': 1}, 40)}), d AS (SELECT h.*, source, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS body FROM h JOIN documents USING (doc_id)),
 u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, body ORDER BY rank) AS n FROM d) WHERE n = 1), c AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS k FROM u)
 SELECT query_id, doc_id, score, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM c WHERE k <= 2) WHERE position <= 20""")
def v26_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over-fetch, one of equal texts, two of a source, then the page."""
    d = corpus.table(spark, sf_dir, "documents")
    h = corpus.index(spark, sf_dir).search(corpus.queries(spark, sf_dir), 40).join(d, "doc_id").withColumn("body", text.normalized("text"))
    u = h.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "body").orderBy("rank"))).where("n = 1")
    c = u.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "source").orderBy("rank"))).where("k <= 2")
    return c.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long")).where("position <= 20").select("query_id", "doc_id", "score", "position")
