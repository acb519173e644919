"""Graph queries: words as symbols of the document that first holds them, and the shop tables as a call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import corpus, shared
from ..functions import files, text
from ..operators import changes, graph, patterns
from ._base import query

_E = corpus.ENTITIES
_C = corpus.CALLS


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunks(spark, sf_dir).select(F.col("doc_id").alias("document_id"), "ordinal", "body")


_RESOLVED = f"""WITH e AS ({_E}), r AS ({corpus.REFERENCES}),
 sn AS (SELECT r.file_id, reference_text, count(*) AS n, min_by(id, qualified_name) AS target_id FROM r JOIN e ON name = reference_text AND e.file_id = r.file_id GROUP BY ALL),
 cq AS (SELECT r.file_id, reference_text, count(*) AS n, min_by(id, (e.file_id, start_line, id)) AS target_id FROM r JOIN e ON qualified_name = reference_text AND e.file_id <> r.file_id GROUP BY ALL),
 cn AS (SELECT r.file_id, reference_text, min_by(id, (qualified_name, e.file_id, id)) AS target_id FROM r JOIN e ON name = reference_text AND e.file_id <> r.file_id GROUP BY ALL),
 x AS (SELECT r.file_id, r.reference_text, coalesce(sn.target_id, cq.target_id, cn.target_id) AS target_id, CASE WHEN sn.n = 1 THEN 'same_file_name' WHEN sn.n > 1 THEN 'same_file_name_ambiguous' WHEN cq.n > 1 THEN 'cross_file_qualified_ambiguous' WHEN cq.n = 1 THEN 'cross_file_qualified' WHEN cn.target_id IS NOT NULL THEN 'name_only' ELSE 'unresolved' END AS resolver
  FROM r LEFT JOIN sn USING (file_id, reference_text) LEFT JOIN cq USING (file_id, reference_text) LEFT JOIN cn USING (file_id, reference_text))"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolve(corpus.references(spark, sf_dir), shared.written(corpus.entities(spark, sf_dir), "entities"), words=True)


# A name is one entity's here and no word is a qualified name, so one join on names says all; the other cases have tests of their own.
_ONE_JOIN = f"""WITH e AS MATERIALIZED (SELECT name, id, file_id AS owner FROM ({_E})), r AS MATERIALIZED ({corpus.REFERENCES})
 SELECT r.file_id, r.reference_text, e.id AS target_id, CASE WHEN e.id IS NULL THEN 'unresolved' WHEN e.owner = r.file_id THEN 'same_file_name' ELSE 'name_only' END AS resolver,
  CASE WHEN e.owner = r.file_id THEN 'exact' ELSE 'medium' END AS confidence FROM r LEFT JOIN e ON e.name = r.reference_text"""


@query("g3_g4_resolution", _ONE_JOIN)
def g3_g4_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("file_id", "reference_text", "target_id", "resolver", "confidence")


def _later(sql: str) -> str:
    """The same over the documents that the next scan still finds; edits there change no word."""
    return sql.replace("FROM documents", "FROM (SELECT * FROM documents WHERE NOT (lang = 'de' AND source = 'src3'))")


@query("g4_delta_resolution", f"""WITH o AS MATERIALIZED (SELECT name, id FROM ({_E})), c AS MATERIALIZED (SELECT name, id FROM ({_later(_E)})),
 k AS MATERIALIZED (SELECT coalesce(o.name, c.name) AS name FROM o FULL JOIN c USING (name) WHERE o.id IS DISTINCT FROM c.id), x AS MATERIALIZED ({_later(_ONE_JOIN)})
 SELECT *, (SELECT count(*) FROM x WHERE reference_text IN (SELECT name FROM k)) AS again FROM x""")
def g4_delta_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolution after the next scan out of the one before; ``again`` says how many references had to be resolved anew."""
    later = corpus.documents_after(spark, sf_dir)
    before, after = (shared.written(corpus.entities(spark, sf_dir, of), "entities") for of in (None, later))
    shared.release(spark)
    resolved = shared.written(graph.resolve(corpus.references(spark, sf_dir), before, words=True), "resolved")
    shared.release(spark)
    done, again = graph.resolve_changes(resolved, corpus.references(spark, sf_dir, later), before, after, words=True)
    return done.select("file_id", "reference_text", "target_id", "resolver", "confidence").withColumn("again", F.lit(again.count()).cast("long"))


@query("g2_relationships", _RESOLVED + " SELECT type, confidence, count(*) AS n, count(DISTINCT target_id) AS targets FROM (SELECT 'contains' AS type, 'exact' AS confidence, id AS target_id FROM e UNION ALL SELECT 'references', CASE WHEN resolver = 'same_file_name' THEN 'exact' WHEN resolver IN ('name_only', 'unresolved') THEN 'medium' ELSE 'high' END, target_id FROM x) GROUP BY ALL")
def g2_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.relationships(corpus.entities(spark, sf_dir), _resolved(spark, sf_dir)).groupBy("type", "confidence").agg(F.count("*").alias("n"), F.countDistinct("target_id").alias("targets"))


@query("g5_symbol_matches", f"SELECT item_id, id, qualified_name, row_number() OVER (PARTITION BY item_id ORDER BY source_id, qualified_name, id) AS position FROM (SELECT DISTINCT item_id, unnest({corpus.sql_words('lower(text)')}) AS name FROM benchmark) JOIN ({_E}) USING (name)")
def g5_symbol_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = corpus.queries(spark, sf_dir).select(F.col("query_id").alias("item_id"), F.explode("terms").alias("name"))
    w = Window.partitionBy("item_id").orderBy("source_id", "qualified_name", "id")
    return q.join(corpus.entities(spark, sf_dir), "name").withColumn("position", F.row_number().over(w).cast("long")).select("item_id", "id", "qualified_name", "position")


def _bfs_sql(start: str, depth: int, a: str = "source_id", b: str = "target_id") -> str:
    return f"""WITH RECURSIVE c AS ({_C}), h AS (SELECT DISTINCT {a} AS node, {b} AS next FROM c), w(start, node, depth) AS (SELECT start, start, 0 FROM ({start}) UNION SELECT w.start, h.next, w.depth + 1 FROM w JOIN h USING (node) WHERE w.depth < {depth}),
 m AS (SELECT start, node, min(depth) AS depth FROM w GROUP BY start, node)"""


@query("g6_bfs", _bfs_sql("SELECT 'o' || o_orderkey AS start FROM orders", 3) + " SELECT * FROM m WHERE depth > 0")
def g6_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = corpus.table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("start"))
    return graph.bfs(corpus.calls(spark, sf_dir), starts, 3)


@query("g7_callers", _bfs_sql("SELECT 'r' || r_regionkey AS start FROM region", 3, "target_id", "source_id") + " SELECT * FROM m WHERE depth > 0")
def g7_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = corpus.table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("start"))
    return graph.bfs(corpus.calls(spark, sf_dir), starts, 3, incoming=True)


@query("g9_walk_edges", _bfs_sql("SELECT 'c' || c_custkey AS start FROM customer", 1) + " SELECT m.start, c.id, min(m.depth + 1) AS depth FROM m JOIN c ON c.source_id = m.node GROUP BY ALL")
def g9_walk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = corpus.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("start"))
    return graph.walk(corpus.calls(spark, sf_dir), starts, 2)


@query("t6_capped_edges", f"SELECT id, source_id, position FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY type, target_id, id) AS position FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id) AS k FROM ({_C})) WHERE k <= 3)")
def t6_capped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.capped_edges(corpus.calls(spark, sf_dir), "source_id", 3).select("id", "source_id", "position")


@query("g8_unresolved", _RESOLVED + " SELECT reference_text, count(*) AS files FROM x WHERE target_id IS NULL GROUP BY reference_text")
def g8_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).where("target_id is null").groupBy("reference_text").agg(F.count("*").alias("files"))


@query("g10_neighbours", f"SELECT c.id, s.s_name AS neighbour FROM ({_C}) c LEFT JOIN supplier s ON c.target_id = 's' || s_suppkey")
def g10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = corpus.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("target_id"), F.col("s_name").alias("neighbour"))
    return corpus.calls(spark, sf_dir).join(s, "target_id", "left").select("id", "neighbour")


@query("g11_g12_impact", _bfs_sql("SELECT 's' || s_suppkey AS start FROM supplier", 2, "target_id", "source_id") + f""", up AS (SELECT start, count(*) AS callers, count(*) FILTER (ends_with(node, '7')) AS tests FROM m WHERE depth > 0 GROUP BY start),
 d2 AS (SELECT 's' || s_suppkey AS start, 1 + 1 AS callees FROM supplier), k AS (SELECT 's' || l_suppkey AS start, count(DISTINCT l_partkey) AS documents FROM lineitem GROUP BY 1)
 SELECT start, coalesce(callers, 0) AS callers, callees, coalesce(tests, 0) AS tests, coalesce(documents, 0) AS documents, coalesce(callers, 0) + coalesce(documents, 0) AS score, CASE WHEN coalesce(callers, 0) + coalesce(documents, 0) <= 2 THEN 'LOW' WHEN coalesce(callers, 0) + coalesce(documents, 0) <= 7 THEN 'MEDIUM' ELSE 'HIGH' END AS radius FROM d2 LEFT JOIN up USING (start) LEFT JOIN k USING (start)""")
def g11_g12_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.calls(spark, sf_dir)
    starts = corpus.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("start"))
    paths = c.select(F.col("source_id").alias("id")).distinct().withColumn("path", F.when(F.col("id").endswith("7"), F.concat(F.lit("test_"), "id", F.lit(".py"))).otherwise(F.concat("id", F.lit(".py"))))
    links = corpus.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("entity_id"), F.col("l_partkey").alias("document_id"))
    return graph.impact(c, starts, links, paths)


_L = f"""WITH e AS ({_E}), u AS (SELECT doc_id AS document_id, ordinal, body FROM ({corpus.CHUNKS})),
 t AS (SELECT DISTINCT document_id, ordinal, unnest(list_filter(regexp_split_to_array(body, '[^\\p{{L}}\\p{{N}}\\p{{M}}_.]+'), lambda x: x <> '')) AS raw FROM u),
 w AS (SELECT DISTINCT document_id, ordinal, regexp_replace(raw, '\\.+$', '') AS word FROM t),
 h AS (SELECT DISTINCT e.id AS entity_id, document_id, ordinal FROM w JOIN e ON word = name WHERE length(name) >= 3 AND name NOT IN ({", ".join(f"'{x}'" for x in text.COMMON_NAMES)}))"""


@query("g14_links_by_name", _L + " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, document_id ORDER BY ordinal) AS n FROM h) WHERE n <= 5")
def g14_links_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.entities(spark, sf_dir)
    m = graph.mentions(e.where(text.links_by_bare_name("name")), _units(spark, sf_dir), F.col("name"), "linker:exact_identifier", "high", "mentioned_in")
    return m.select("entity_id", "document_id", "ordinal", F.col("position").alias("n"))


@query("g14_linker", _L + """, p AS (SELECT page_id + 1000000000 AS document_id, url FROM pages), v AS (SELECT document_id, ordinal, body FROM u UNION ALL SELECT document_id, 0, url FROM p),
 vt AS (SELECT DISTINCT document_id, ordinal, regexp_replace(unnest(list_filter(regexp_split_to_array(body, '[^\\p{L}\\p{N}\\p{M}_.]+'), lambda x: x <> '')), '\\.+$', '') AS word FROM v),
 n AS (SELECT id, unnest([f, regexp_extract(f, '^(.+)\\.[^.]+$', 1)]) AS needle FROM (SELECT 'f' || page_id AS id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS f FROM pages WHERE page_id % 2 = 0)),
 r AS (SELECT DISTINCT 'r' || (page_id % 7) AS id, regexp_extract(url, '^[^:]+://[^/]+(/[^/?#]+)', 1) AS path FROM pages),
 a AS (SELECT id AS entity_id, document_id, ordinal, 'linker:exact_identifier' AS resolver, 'high' AS confidence, 'mentioned_in' AS type FROM e JOIN vt ON word = name WHERE length(name) >= 3 AND name NOT IN (""" + ", ".join(f"'{x}'" for x in text.COMMON_NAMES) + """)
  UNION ALL SELECT id, document_id, ordinal, 'linker:filename', 'medium', 'mentioned_in' FROM (SELECT DISTINCT id, needle FROM n WHERE needle <> '') JOIN vt ON word = needle
  UNION ALL SELECT r.id, document_id, 0, 'linker:route_heuristic', 'heuristic', 'related_to' FROM r, p WHERE r.path <> '' AND regexp_matches(url, regexp_escape(r.path) || '([^\\p{L}\\p{N}_]|$)'))
 SELECT resolver, confidence, type, count(*) AS n, count(DISTINCT entity_id) AS entities FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, document_id, resolver ORDER BY ordinal) AS k FROM (SELECT DISTINCT * FROM a)) WHERE k <= 5 GROUP BY ALL""")
def g14_linker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five resolvers over chunks and page addresses: words as symbols, every other page's file as a namespace, first path segments as routes."""
    p = corpus.table(spark, sf_dir, "pages")
    units = _units(spark, sf_dir).unionByName(p.select((F.col("page_id") + 1_000_000_000).alias("document_id"), F.lit(0).cast("long").alias("ordinal"), F.col("url").alias("body")))
    namespaces = p.where("page_id % 2 = 0").select(F.concat(F.lit("f"), "page_id").alias("id"), F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    routes = p.select(F.concat(F.lit("r"), F.col("page_id") % 7).alias("id"), F.concat(F.lit("http_endpoint:GET:"), F.regexp_extract("url", r"^[^:]+://[^/]+(/[^/?#]+)", 1)).alias("symbol"))
    links = graph.link(corpus.entities(spark, sf_dir), units, 5, namespaces, routes)
    return links.groupBy("resolver", "confidence", "type").agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("entities"))


@query("w7_links_per_document", _L + " SELECT document_id, count(*) AS links, count(DISTINCT entity_id) AS entities FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, document_id ORDER BY ordinal) AS n FROM h) WHERE n <= 5 GROUP BY document_id")
def w7_links_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.entities(spark, sf_dir)
    m = graph.mentions(e.where(text.links_by_bare_name("name")), _units(spark, sf_dir), F.col("name"), "linker:exact_identifier", "high", "mentioned_in")
    return m.groupBy("document_id").agg(F.count("*").alias("links"), F.countDistinct("entity_id").alias("entities"))


@query("g16_manual_links", f"WITH t AS (SELECT split_part(text, chr(10), 1) AS title, count(*) AS n, min(doc_id) AS document_id FROM documents GROUP BY 1), e AS ({_E}) SELECT e.id AS entity_id, t.document_id, e.name AS note FROM e JOIN documents d ON d.doc_id = e.file_id JOIN t ON t.title = split_part(d.text, chr(10), 1) WHERE t.n = 1")
def g16_manual_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = corpus.entities(spark, sf_dir), corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.split("text", "\n")[0].alias("title"))
    asked = e.join(d, e.file_id == d.document_id).select(F.col("qualified_name").alias("entity_name"), "title", F.col("name").alias("note"))
    return graph.manual(asked, e, d)


@query("g18_graph_changes", f"SELECT coalesce(a.rel_path, b.rel_path) AS rel_path, CASE WHEN a.rel_path IS NULL THEN 'added' WHEN b.rel_path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM ({corpus.FILES}) a FULL JOIN ({corpus.FILES_AFTER}) b ON a.rel_path = b.rel_path WHERE a.content_hash IS DISTINCT FROM b.content_hash")
def g18_graph_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = corpus.files(spark, sf_dir).select("rel_path", F.col("content_hash").alias("a"))
    b = corpus.files_after(spark, sf_dir).select("rel_path", F.col("content_hash").alias("b"))
    return a.join(b, "rel_path", "full").where(~F.equal_null("a", "b")).select("rel_path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("modified").alias("change"))


@query("g19_dependents", f"WITH ch AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id FROM ({corpus.FILES}) a FULL JOIN ({corpus.FILES_AFTER}) b ON a.doc_id = b.doc_id WHERE a.content_hash IS DISTINCT FROM b.content_hash), k AS (SELECT name FROM ({_E}) WHERE file_id IN (SELECT doc_id FROM ch)) SELECT DISTINCT file_id FROM ({corpus.REFERENCES}) WHERE reference_text IN (SELECT name FROM k)")
def g19_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = changes.symmetric_difference(corpus.files(spark, sf_dir), corpus.files_after(spark, sf_dir), "doc_id", "content_hash").withColumnRenamed("doc_id", "file_id")
    keys = corpus.entities(spark, sf_dir).join(changed, "file_id", "left_semi").select(F.col("name").alias("key")).distinct()
    return graph.dependents(corpus.references(spark, sf_dir).withColumnRenamed("reference_text", "key"), keys)


@query("g20_file_symbols", _RESOLVED + f""", d AS (SELECT file_id, key, count(*) AS defs, sha256(array_to_string(list_sort(list(id || '|' || kind || '|' || start_line)), chr(10))) AS fingerprint FROM (SELECT file_id, id, kind, start_line, unnest(['q:' || qualified_name, 'n:' || name]) AS key FROM e) GROUP BY file_id, key),
 r2 AS (SELECT file_id, 'n:' || reference_text AS key, count(*) AS refs FROM x GROUP BY ALL) SELECT coalesce(d.file_id, r2.file_id) AS file_id, coalesce(d.key, r2.key) AS key, coalesce(defs, 0) AS defs, coalesce(refs, 0) AS refs, fingerprint FROM d FULL JOIN r2 ON d.file_id = r2.file_id AND d.key = r2.key""")
def g20_file_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.file_symbols(corpus.entities(spark, sf_dir), _resolved(spark, sf_dir))


@query("g22_cross_source", f"""WITH e AS ({_E}), r AS (SELECT DISTINCT source_id, 'src' || ((regexp_extract(source_id, '[0-9]+')::INT + 1) % 20) || '.' || split_part(qualified_name, '.', 2) || '.' || name AS symbol FROM e),
 p AS (SELECT source_id, qualified_name, id FROM e) SELECT r.source_id, r.symbol, CASE WHEN count(p.id) = 0 THEN 'none' WHEN count(p.id) = 1 THEN 'single' ELSE 'ambiguous' END AS state, CASE WHEN count(p.id) = 1 THEN min(p.id) END AS producer_id
 FROM r LEFT JOIN p ON p.qualified_name = r.symbol AND p.source_id = 'src' || ((regexp_extract(r.source_id, '[0-9]+')::INT + 1) % 20) GROUP BY ALL""")
def g22_cross_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.entities(spark, sf_dir)
    nxt = F.concat(F.lit("src"), (F.regexp_extract("source_id", "[0-9]+", 0).cast("int") + 1) % 20)
    refs = e.select("source_id", F.concat_ws(".", nxt, F.split("qualified_name", r"\.")[1], "name").alias("symbol")).distinct()
    allowed = e.select("source_id").distinct().select("source_id", nxt.alias("producer_source"))
    return graph.bind_across(refs, e, allowed)


@query("g13_linked_documents", "SELECT l_suppkey, l_partkey, position FROM (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY first_order, l_partkey) AS position FROM (SELECT l_suppkey, l_partkey, min(l_orderkey) AS first_order FROM lineitem GROUP BY ALL))")
def g13_linked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = corpus.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_orderkey").alias("first_order"))
    return g.withColumn("position", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("first_order", "l_partkey")).cast("long")).select("l_suppkey", "l_partkey", "position")


@query("j3_four_way_self_join", f"WITH c AS ({corpus.CHUNKS}) SELECT c.doc_id, c.ordinal, d.lang, l.quality, p.doc_id AS parent_id FROM c JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id) LEFT JOIN documents p ON p.doc_id = d.doc_id - 1 AND p.lang = d.lang WHERE c.kind = 'heading'")
def j3_four_way_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.table(spark, sf_dir, "documents").select("doc_id", "lang")
    p = d.select((F.col("doc_id") + 1).alias("doc_id"), "lang", F.col("doc_id").alias("parent_id"))
    c = corpus.chunks(spark, sf_dir).where("kind = 'heading'").select("doc_id", "ordinal")
    return c.join(d, "doc_id").join(corpus.table(spark, sf_dir, "labels").select("doc_id", F.col("quality")), "doc_id", "left").join(p, ["doc_id", "lang"], "left").select("doc_id", "ordinal", "lang", "quality", "parent_id")


@query("j9_containment_join", _L + " SELECT entity_id, count(*) AS units FROM h GROUP BY entity_id")
def j9_containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.entities(spark, sf_dir)
    m = graph.mentions(e.where(text.links_by_bare_name("name")), _units(spark, sf_dir), F.col("name"), "linker:exact_identifier", "high", "mentioned_in", None)
    return m.groupBy("entity_id").agg(F.count("*").alias("units"))


@query("j10_route_mentions", "SELECT DISTINCT r.path, p.page_id FROM (SELECT DISTINCT regexp_extract(url, '^[^:]+://[^/]+(/[^/?#]+)', 1) AS path FROM pages UNION SELECT unnest(['/', 'a', 'page', '://'])) r, pages p WHERE r.path <> '' AND regexp_matches(p.url, regexp_escape(r.path) || '([^\\p{L}\\p{N}_]|$)')")
def j10_route_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = corpus.table(spark, sf_dir, "pages").select("page_id", "url")
    # the paths' first segments, the bare slash, and pieces that stand within words
    routes = p.select(F.regexp_extract("url", r"^[^:]+://[^/]+(/[^/?#]+)", 1).alias("pattern")).unionByName(spark.createDataFrame([("/",), ("a",), ("page",), ("://",)], "pattern string"))
    return patterns.found(routes, p, "url").select(F.col("pattern").alias("path"), "page_id")


_REFERENCE = "CASE doc_id % 5 WHEN 0 THEN './x.txt' WHEN 1 THEN '../src' || (doc_id % 7) || '/moved/./y.txt' WHEN 2 THEN '..\\..\\outside\\z.txt' WHEN 3 THEN 'a//b/../../../src' || (doc_id % 23) || '/c.txt' ELSE '../../../../../top.txt' END"
_ROOTS = "SELECT DISTINCT source AS source_id, 'home/' || source AS path FROM documents UNION ALL SELECT 'moved-' || source, 'home/' || source || '/moved' FROM (SELECT DISTINCT source FROM documents WHERE source IN ('src1', 'src2', 'src3'))"


@query("j14_project_references", f"""WITH f AS (SELECT source_id, substr(rel_path, length(source_id) + 2) AS rel_path, {_REFERENCE} AS reference FROM ({corpus.FILES_AFTER})), s AS ({_ROOTS}),
 t AS (SELECT f.*, list_reduce(list_prepend('', string_split(replace(concat_ws('/', path, regexp_replace(rel_path, '/?[^/]*$', ''), reference), '\\', '/'), '/')), lambda acc, x: CASE WHEN x = '..' THEN regexp_replace(acc, '/?[^/]*$', '') WHEN x IN ('', '.') THEN acc WHEN acc = '' THEN x ELSE acc || '/' || x END) AS target FROM f JOIN s USING (source_id)),
 p AS (SELECT t.source_id, t.rel_path, t.reference, max_by(s.source_id, length(s.path)) AS producer FROM t JOIN s ON starts_with(t.target || '/', s.path || '/') GROUP BY ALL)
 SELECT source_id, rel_path, reference, target, producer, CASE WHEN producer IS NULL THEN 'outside' WHEN producer = source_id THEN 'inside' ELSE 'declares' END AS status FROM t LEFT JOIN p USING (source_id, rel_path, reference)""")
def j14_project_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that name others by relative paths, against the folders of the sources, some of which lie within others."""
    f = corpus.files_after(spark, sf_dir)
    references = f.select("source_id", F.substring("rel_path", F.length("source_id") + 2, F.length("rel_path")).alias("rel_path"), F.expr(_REFERENCE.replace("\\", "\\\\")).alias("reference"))
    d = corpus.table(spark, sf_dir, "documents").select("source").distinct()
    inner = d.where("source in ('src1', 'src2', 'src3')")
    sources = d.select(F.col("source").alias("source_id"), F.concat(F.lit("home/"), "source").alias("path")).unionByName(inner.select(F.concat(F.lit("moved-"), "source").alias("source_id"), F.concat(F.lit("home/"), "source", F.lit("/moved")).alias("path")))
    return graph.project_references(references, sources)


@query("j16_null_safe", "SELECT a.doc_id, count(b.doc_id) AS n FROM (SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)) a JOIN (SELECT item_id AS doc_id, CASE WHEN item_id % 3 = 0 THEN NULL ELSE item_id % 2 END AS quality FROM benchmark) b ON a.quality IS NOT DISTINCT FROM b.quality GROUP BY a.doc_id")
def j16_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = corpus.table(spark, sf_dir, "documents").join(corpus.table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality")
    b = corpus.table(spark, sf_dir, "benchmark").select(F.when(F.col("item_id") % 3 != 0, (F.col("item_id") % 2)).cast("int").alias("q")).groupBy("q").agg(F.count("*").alias("n"))
    return a.join(b, F.equal_null("quality", "q")).groupBy("doc_id").agg(F.sum("n").alias("n"))


@query("p12_test_files", "SELECT 's' || s_suppkey AS id, s_suppkey % 10 = 7 AS test FROM supplier")
def p12_test_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = corpus.table(spark, sf_dir, "supplier")
    path = F.when(s.s_suppkey % 10 == 7, F.concat(F.lit("a/Run"), s.s_suppkey, F.lit("Tests.java"))).otherwise(F.concat(F.lit("a/Tests"), s.s_suppkey, F.lit(".java")))
    return s.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), files.is_test(path).alias("test"))
