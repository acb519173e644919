"""Full-text queries: benchmark items and questions against whole documents, lines and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import corpus
from ..functions import text
from ..operators import lexical as op
from ..operators import search
from ._base import ORACLES, query

_W = corpus.sql_words("lower(text)")


_ASKED = f"SELECT DISTINCT item_id AS query_id, unnest({_W}) AS term FROM benchmark"


def _bm25_sql(records: str, key: str, fields: dict[str, float], k: int, asked: str = _ASKED) -> str:
    parts = " UNION ALL ".join(f"SELECT {key}, unnest({corpus.sql_words(f'lower({f})')}) AS term, {float(w)}::DOUBLE AS weight FROM r" for f, w in fields.items())
    size = " + ".join(f"len({corpus.sql_words(f'lower({f})')})" for f in fields)
    return f"""WITH r AS ({records}), q AS ({asked}),
 l AS (SELECT {key}, ({size})::DOUBLE AS length FROM r), s AS (SELECT count(*)::DOUBLE AS total, avg(length) AS mean FROM l),
 h AS (SELECT {key}, term, sum(weight) AS f FROM ({parts}) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
 d AS (SELECT term, count(*)::DOUBLE AS n FROM h GROUP BY term),
 g AS (SELECT {key}, h.term, (CASE WHEN ln((total - n + 0.5) / (n + 0.5)) > 0 THEN ln((total - n + 0.5) / (n + 0.5)) ELSE 1e-6 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean)) AS gain
  FROM h JOIN d USING (term) JOIN l USING ({key}), s),
 t AS (SELECT query_id, {key}, round(sum(gain), 6) AS score FROM g JOIN q USING (term) GROUP BY ALL)
 SELECT query_id, {key}, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank FROM t) WHERE rank <= {k}"""


@query("v1_bm25", _bm25_sql("SELECT doc_id, text FROM documents", "doc_id", {"text": 1}, 10))
def v1_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.index(spark, sf_dir).search(corpus.queries(spark, sf_dir), 10)


_FIELDS = {"heading": 5, "body": 1, "words": 0.5}
_RECORDS = "SELECT doc_id, split_part(text, chr(10), 1) AS heading, text AS body, source || ' ' || lang AS words FROM documents"


@query("v1_bm25_fields", _bm25_sql(_RECORDS, "doc_id", _FIELDS, 10))
def v1_bm25_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.table(spark, sf_dir, "documents")
    records = d.select("doc_id", F.split("text", "\n")[0].alias("heading"), F.col("text").alias("body"), F.concat_ws(" ", "source", "lang").alias("words"))
    return op.Index.stored(corpus.scan(spark, sf_dir, "documents"), records, "doc_id", _FIELDS, "documents-fields").search(corpus.queries(spark, sf_dir), 10)


_AFTER = f"""WITH o AS ({corpus.FILES}), s AS ({corpus.FILES_AFTER}) SELECT d.doc_id, CASE WHEN contains(text, '###') THEN text || '!' ELSE text END AS text FROM documents d JOIN s USING (doc_id)"""


@query("s14_index_upkeep", f"SELECT *, (SELECT count(*) FROM documents WHERE contains(text, '###') AND NOT (lang = 'de' AND source = 'src3')) AS taken_apart FROM ({_bm25_sql(_AFTER, 'doc_id', {'text': 1}, 10)})")
def s14_index_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking is a full build's, though only records whose content changed were taken apart."""
    index = corpus.index_after(spark, sf_dir)
    taken = sum(s["records"] for s in index.state["segments"] if s["name"] != "first")
    return index.search(corpus.queries(spark, sf_dir), 10).withColumn("taken_apart", F.lit(taken).cast("long"))


@query("a18_corpus_statistics", f"SELECT term, count(*) AS documents, sum(n)::BIGINT AS occurrences FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_W}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def a18_corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.index(spark, sf_dir).postings.groupBy("term").agg(F.count("*").alias("documents"), F.sum("f").cast("long").alias("occurrences"))


_MATCHED = f"""WITH q AS (SELECT item_id AS query_id, list_distinct({_W}) AS terms FROM benchmark), a AS (SELECT query_id, len(terms) AS wanted, unnest(terms) AS term FROM q),
 h AS (SELECT DISTINCT doc_id, unnest({_W}) AS term FROM documents), m AS (SELECT query_id, doc_id, wanted, count(*) AS matched FROM h JOIN a USING (term) GROUP BY ALL)"""


@query("v2_all_terms", _MATCHED + " SELECT query_id, doc_id FROM m WHERE matched = wanted")
def v2_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.index(spark, sf_dir).matched(corpus.queries(spark, sf_dir)).where("matched = wanted").select("query_id", "doc_id")


@query("u10_min_should_match", _MATCHED + " SELECT query_id, doc_id, matched FROM m WHERE 2 * matched >= wanted")
def u10_min_should_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.index(spark, sf_dir).matched(corpus.queries(spark, sf_dir)).where("2 * matched >= wanted").select("query_id", "doc_id", "matched")


@query("v2_phrase", f"""WITH p AS (SELECT item_id AS query_id, ' ' || array_to_string({_W}, ' ') || ' ' AS phrase FROM benchmark), d AS (SELECT doc_id, ' ' || array_to_string({_W}, ' ') || ' ' AS t FROM documents)
 SELECT query_id, doc_id FROM p, d WHERE contains(t, phrase)""")
def v2_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text.lower_words("text").alias("words"))
    return corpus.index(spark, sf_dir).phrases(p)


@query("v2_prefix", f"""WITH q AS (SELECT item_id AS query_id, list_distinct(({_W})[1:3]) AS terms FROM benchmark), a AS (SELECT query_id, len(terms) AS wanted, unnest(terms) AS term FROM q),
 h AS (SELECT DISTINCT doc_id, unnest({_W}) AS word FROM documents),
 m AS (SELECT DISTINCT query_id, doc_id, wanted, term FROM h, a WHERE substr(word, 1, 4) = substr(term, 1, 4) AND CASE WHEN length(term) >= 4 THEN starts_with(word, term) ELSE word = term END)
 SELECT query_id, doc_id FROM m GROUP BY query_id, doc_id, wanted HAVING count(*) = wanted""")
def v2_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.slice(text.lower_words("text"), 1, 3).alias("terms"))
    return corpus.index(spark, sf_dir).prefixes(q)


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


@query("v2_query_plan", f"""WITH q AS ({corpus.QUESTIONS_SQL}), w AS (SELECT question_id AS query_id, {corpus.sql_words('question')} AS words FROM q),
 c AS (SELECT query_id, words, CASE WHEN len(list_filter(words, lambda t: lower(t) NOT IN ({_STOP}))) > 0 THEN list_filter(words, lambda t: lower(t) NOT IN ({_STOP})) ELSE words END AS content FROM w WHERE len(words) > 0),
 x AS (SELECT *, len(content) AS n, CASE WHEN (len(content) + 1) // 2 = 1 OR len(content) >= 7 THEN 1 ELSE (len(content) + 1) // 2 END AS k,
  list_filter(content, lambda t: contains(t, '_') OR regexp_matches(t, '[0-9]') OR regexp_matches(substr(t, 2), '\\p{{Lu}}')) AS names FROM c)
 SELECT query_id, 0 AS tier, 'phrase' AS name, array_to_string(words, ' ') AS terms, len(words) AS need FROM x
 UNION ALL SELECT query_id, 1, 'all', array_to_string(content, ' '), n FROM x WHERE NOT (len(words) = 1 AND words = content)
 UNION ALL SELECT query_id, 2, 'prefix', array_to_string(content, ' '), n FROM x WHERE n > 1 AND len(list_filter(content, lambda t: length(t) >= 4)) > 0
 UNION ALL SELECT query_id, 3, 'most', array_to_string(content, ' '), k FROM x WHERE n > 1
 UNION ALL SELECT query_id, 4, 'identifiers', array_to_string(names, ' '), 1 FROM x WHERE n > 1 AND len(names) > 0 AND NOT (len(names) = n AND k = 1)""")
def v2_query_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = corpus.questions(spark, sf_dir).withColumnRenamed("question_id", "query_id")
    return op.plan(q, "question").withColumn("terms", F.array_join("terms", " ")).withColumn("need", F.col("need").cast("long"))


@query("t14_tiers_until_enough", _MATCHED + f""", x AS (SELECT query_id, doc_id AS id, CASE WHEN matched = wanted THEN 0 WHEN 4 * matched >= 3 * wanted THEN 1 WHEN 2 * matched >= wanted THEN 2 ELSE 3 END AS tier FROM m WHERE 4 * matched >= wanted),
 c AS (SELECT query_id, tier, count(*) AS n FROM x GROUP BY ALL), b AS (SELECT query_id, tier, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
 SELECT query_id, tier, id FROM x JOIN b USING (query_id, tier) WHERE before < 20""")
def t14_tiers_until_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = corpus.index(spark, sf_dir).matched(corpus.queries(spark, sf_dir)).where("4 * matched >= wanted")
    tier = F.when(F.expr("matched = wanted"), 0).when(F.expr("4 * matched >= 3 * wanted"), 1).when(F.expr("2 * matched >= wanted"), 2).otherwise(3)
    return op.until_enough(m.select("query_id", F.col("doc_id").alias("id"), tier.alias("tier")), 20)


@query("p1_hard_filters", f"SELECT rel_path, source_id FROM ({corpus.FILES}) WHERE source_id IN ('src0', 'src5', 'src12') AND (starts_with(rel_path, 'src0/') OR starts_with(rel_path, 'src12/')) AND kind = 'document'")
def p1_hard_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpus.files(spark, sf_dir)
    return f.where(op.allowed(f.rel_path, f.source_id, f.kind, sources=["src0", "src5", "src12"], prefixes=["./src0/", "src12/"], kinds=["document"])).select("rel_path", "source_id")


@query("p2_filter_before_rank", _bm25_sql("SELECT doc_id, text FROM documents WHERE source IN ('src1', 'src2')", "doc_id", {"text": 1}, 5))
def p2_filter_before_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.scan(spark, sf_dir, "documents").where(F.col("source").isin("src1", "src2"))
    return corpus.index(spark, sf_dir).search(corpus.queries(spark, sf_dir), 5, d.select("doc_id"))


@query("p4_p5_symbol_lookup", f"""WITH e AS ({corpus.ENTITIES}), q AS (SELECT question_id, lower(question) AS question FROM ({corpus.QUESTIONS_SQL}) UNION ALL SELECT file_id * 1000 + 999, split_part(qualified_name, '.', 2) || '.' || translate(name, 'aet', 'AET') FROM e),
 h AS (SELECT question_id, id, 0 AS tier FROM q JOIN e ON question = name UNION ALL SELECT question_id, id, 1 FROM q JOIN e ON question = qualified_name
  UNION ALL SELECT question_id, id, 2 FROM q JOIN e ON lower(question) = lower(split_part(qualified_name, '.', 2) || '.' || split_part(qualified_name, '.', 3)) AND len(string_split(question, '.')) = 2)
 SELECT question_id, id, min(tier) AS tier FROM h GROUP BY ALL""")
def p4_p5_symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.entities(spark, sf_dir)
    q = corpus.questions(spark, sf_dir).withColumn("question", F.lower("question")).unionByName(e.select((F.col("file_id") * 1000 + 999).alias("question_id"), F.concat(F.split("qualified_name", r"\.")[1], F.lit("."), F.translate("name", "aet", "AET")).alias("question")))
    return op.symbol_hits(e, q)


@query("p6_title_lookup", "SELECT a.doc_id, b.doc_id AS other_id FROM (SELECT doc_id, lower(split_part(text, chr(10), 1)) AS t FROM documents) a JOIN (SELECT doc_id, lower(split_part(text, chr(10), 1)) AS t FROM documents) b USING (t) WHERE a.doc_id < b.doc_id")
def p6_title_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = corpus.table(spark, sf_dir, "documents").select("doc_id", F.lower(F.split("text", "\n")[0]).alias("t"))
    return op.equal_pairs(t, "t", "doc_id", "other_id")


@query("p7_path_substring", f"SELECT rel_path FROM ({corpus.FILES}) WHERE contains(rel_path, 'c1/1') OR contains(rel_path, '%') OR contains(rel_path, '_7')")
def p7_path_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpus.files(spark, sf_dir)
    return f.where(f.rel_path.contains("c1/1") | f.rel_path.contains("%") | f.rel_path.contains("_7")).select("rel_path")


@query("p8_exact_path", f"SELECT rel_path, asked FROM ({corpus.FILES_AFTER}), (VALUES ('12.TXT'), ('./moved/20.txt'), ('SRC1\\1.txt'), ('2.txt'), ('')) AS v(asked) WHERE lower(trim(asked)) <> '' AND (lower(rel_path) = regexp_replace(lower(replace(trim(asked), chr(92), '/')), '^(\\./)+', '') OR ends_with(lower(rel_path), '/' || regexp_replace(lower(replace(trim(asked), chr(92), '/')), '^(\\./)+', '')))")
def p8_exact_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpus.files_after(spark, sf_dir).select("rel_path", F.explode(F.array(*(F.lit(x) for x in ("12.TXT", "./moved/20.txt", "SRC1\\1.txt", "2.txt", "")))).alias("asked"))
    return f.where(op.is_exact_path(f.rel_path, f.asked))


@query("p9_heading_match", f"""WITH h AS (SELECT doc_id, ' ' || array_to_string({corpus.sql_words("lower(split_part(text, chr(10), 1))")}, ' ') || ' ' AS t FROM documents), q AS (SELECT item_id, ({corpus.sql_words("lower(text)")})[1:2] AS w FROM benchmark)
 SELECT item_id, doc_id FROM q, h WHERE len(w) > 0 AND contains(t, ' ' || array_to_string(w, ' ') || ' ')""")
def p9_heading_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.slice(text.lower_words("text"), 1, 2).alias("words"))
    h = corpus.table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n")[0].alias("heading"))
    return op.phrase_hits(h, "doc_id", "heading", q).withColumnRenamed("query_id", "item_id")


@query("w3_fts_ordinal", f"SELECT query_id, doc_id, rank - 1 AS ordinal FROM ({_bm25_sql('SELECT doc_id, text FROM documents', 'doc_id', {'text': 1}, 20)})")
def w3_fts_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = corpus.index(spark, sf_dir).search(corpus.queries(spark, sf_dir), 20)
    return r.select("query_id", "doc_id", (F.col("rank") - 1).alias("ordinal"))


@query("u9_postings_intersection", f"""WITH n AS (SELECT item_id, unnest(list_distinct(({_W})[1:3])) AS term, len(list_distinct(({_W})[1:3])) AS wanted FROM benchmark), c AS ({corpus.CHUNKS}),
 h AS (SELECT DISTINCT doc_id, ordinal, unnest({corpus.sql_words("lower(body)")}) AS term FROM c) SELECT item_id, doc_id, ordinal FROM n JOIN h USING (term) GROUP BY item_id, doc_id, ordinal, wanted HAVING count(*) = wanted""")
def u9_postings_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array_distinct(F.slice(text.lower_words("text"), 1, 3))
    n = corpus.table(spark, sf_dir, "benchmark").select("item_id", F.explode(terms).alias("term"), F.size(terms).alias("wanted"))
    h = corpus.chunks(spark, sf_dir).select("doc_id", "ordinal", F.explode(F.array_distinct(text.lower_words("body"))).alias("term"))
    return n.join(h, "term").groupBy("item_id", "doc_id", "ordinal", "wanted").count().where("count = wanted").select("item_id", "doc_id", "ordinal")


@query("f33_snippets", f"""WITH r AS ({_bm25_sql('SELECT doc_id, text FROM documents', 'doc_id', {'text': 1}, 3)}), w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
 t AS (SELECT item_id AS query_id, list_distinct({_W}) AS terms FROM benchmark),
 p AS (SELECT query_id, doc_id, text, w, list_min(list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_contains(terms, lower(regexp_replace(w[i], '[^\\p{{L}}\\p{{N}}_]', '', 'g'))) THEN i - 1 END), lambda i: i IS NOT NULL)) AS hit FROM r JOIN w USING (doc_id) JOIN t USING (query_id)),
 s AS (SELECT *, greatest(0, least(hit - 16, len(w) - 32)) AS start FROM p)
 SELECT query_id, doc_id, CASE WHEN hit IS NULL THEN substr(text, 1, 280) ELSE CASE WHEN start > 0 THEN '...' ELSE '' END || array_to_string(w[start + 1:start + 32], ' ') || CASE WHEN start + 32 < len(w) THEN '...' ELSE '' END END AS snippet FROM s""")
def f33_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = corpus.table(spark, sf_dir, "documents"), corpus.queries(spark, sf_dir)
    r = corpus.index(spark, sf_dir).search(q, 3)
    return r.join(d, "doc_id").join(q, "query_id").select("query_id", "doc_id", text.snippet("text", F.col("terms")).alias("snippet"))


@query("v9_lexical_search", f"""WITH e AS ({corpus.ENTITIES}), f AS ({_bm25_sql('SELECT doc_id, text FROM documents', 'doc_id', {'text': 1}, 20)}),
 x AS (SELECT item_id AS query_id, unnest(list_distinct({_W})) AS term FROM benchmark), s AS (SELECT DISTINCT query_id, 'entity' AS kind, id, 0 AS tier, 0.0::DOUBLE AS score FROM x JOIN e ON term = name),
 h AS (SELECT query_id, 'document' AS kind, doc_id::VARCHAR AS id, CASE WHEN contains(' ' || array_to_string({corpus.sql_words("lower(split_part(text, chr(10), 1))")}, ' ') || ' ', ' ' || w || ' ') THEN 3 ELSE 5 END AS tier, score
  FROM f JOIN documents USING (doc_id) JOIN (SELECT item_id AS query_id, array_to_string(({_W})[1:2], ' ') AS w FROM benchmark) USING (query_id)),
 a AS (SELECT * FROM s UNION ALL SELECT * FROM h) SELECT query_id, kind, id, tier, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, kind, id) AS rank FROM a) WHERE rank <= 20""")
def v9_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = corpus.table(spark, sf_dir, "documents"), corpus.queries(spark, sf_dir)
    first = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(text.lower_words("text"), 1, 2), " ").alias("w"))
    named = q.select("query_id", F.explode("terms").alias("name")).join(corpus.entities(spark, sf_dir), "name").select("query_id", F.lit("entity").alias("kind"), "id", F.lit(0).alias("tier"), F.lit(0.0).alias("score")).distinct()
    heading = F.concat(F.lit(" "), F.array_join(text.lower_words(F.split("text", "\n")[0]), " "), F.lit(" "))
    found = corpus.index(spark, sf_dir).search(q, 20).join(d.select("doc_id", "text"), "doc_id").join(first, "query_id")
    found = found.select("query_id", F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"), F.when(F.contains(heading, F.concat(F.lit(" "), "w", F.lit(" "))), 3).otherwise(5).alias("tier"), "score")
    ranked = named.unionByName(found).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("tier", F.desc("score"), "kind", "id")).cast("long"))
    return ranked.where("rank <= 20")


_BY_QUESTION = _bm25_sql("SELECT doc_id, text FROM documents", "doc_id", {"text": 1}, 10**9, f"SELECT DISTINCT question_id AS query_id, unnest({corpus.sql_words('lower(question)')}) AS term FROM ({corpus.QUESTIONS_SQL})")
TIERED_SQL = f"""WITH a AS MATERIALIZED (SELECT query_id, tier, name, list_distinct(string_split(lower(terms), ' ')) AS terms, lower(terms) AS phrase, need FROM ({ORACLES["v2_query_plan"]})),
 d AS MATERIALIZED (SELECT doc_id, ' ' || array_to_string({_W}, ' ') || ' ' AS t FROM documents), h AS MATERIALIZED (SELECT DISTINCT doc_id, unnest({_W}) AS term FROM documents),
 u AS MATERIALIZED (SELECT query_id, tier, name, need, len(terms) AS n, unnest(terms) AS word FROM a WHERE name <> 'phrase'),
 m AS (SELECT query_id, tier, need, n, doc_id, count(DISTINCT word) AS matched FROM (SELECT u.*, doc_id FROM u JOIN h ON term = word WHERE name <> 'prefix'
  UNION ALL SELECT u.*, doc_id FROM u JOIN h ON substr(term, 1, 4) = substr(word, 1, 4) AND CASE WHEN length(word) >= 4 THEN starts_with(term, word) ELSE term = word END WHERE name = 'prefix') GROUP BY ALL),
 x AS (SELECT query_id, tier, doc_id FROM a JOIN d ON contains(t, ' ' || phrase || ' ') WHERE name = 'phrase' UNION SELECT query_id, tier, doc_id FROM m WHERE matched >= least(need, n)),
 f AS (SELECT query_id, doc_id, min(tier) AS tier FROM x GROUP BY ALL), c AS (SELECT query_id, tier, count(*) AS new FROM f GROUP BY ALL),
 b AS (SELECT query_id, tier, coalesce(sum(new) OVER (PARTITION BY query_id ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
 v AS (SELECT query_id, doc_id, tier, coalesce(score, 0.0::DOUBLE) AS score FROM f JOIN b USING (query_id, tier) LEFT JOIN ({_BY_QUESTION}) s USING (query_id, doc_id) WHERE before < 20),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, doc_id) AS rank FROM v)
 SELECT query_id, doc_id, tier, score, rank FROM r WHERE rank <= 20"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.questions(spark, sf_dir).withColumnRenamed("question_id", "query_id")


@query("v9_tiered_search", TIERED_SQL)
def v9_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form of question through the tiers of the stored index, until there are 20 records."""
    return search.tiered(corpus.index(spark, sf_dir), _asked(spark, sf_dir), 20)
