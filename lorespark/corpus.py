"""The driver tables as the engine's own views: files, chunks, questions, entities, references, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .functions import ids, text
from .operators import lexical


#: Tables whose texts are taken apart.
TEXTS = ("documents", "pages", "conversations")


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shared.spread(scan(spark, sf_dir, name)) if name in TEXTS else scan(spark, sf_dir, name)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a document: its source is the document's, its time the document's number."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("source_id"),
        F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("rel_path"),
        F.col("n_chars").alias("size"),
        F.col("doc_id").cast("double").alias("mtime"),
        F.sha2("text", 256).alias("content_hash"),
        F.lit("document").alias("kind"),
        "doc_id",
        "lang",
    )


def files_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next scan of the same folders: Spanish files were moved, those with ``###`` edited, German ones of src3 deleted, French ones only touched."""
    d = table(spark, sf_dir, "documents").where("not (lang = 'de' and source = 'src3')")
    edited = F.col("text").contains("###")
    return d.select(
        F.col("source").alias("source_id"),
        F.concat("source", F.when(F.col("lang") == "es", "/moved/").otherwise("/"), "doc_id", F.lit(".txt")).alias("rel_path"),
        (F.col("n_chars") + F.when(edited, 1).otherwise(0)).alias("size"),
        (F.col("doc_id") + F.when(edited | (F.col("lang") == "fr"), 0.5).otherwise(0.0)).alias("mtime"),
        F.sha2(F.when(edited, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"),
        F.lit("document").alias("kind"),
        "doc_id",
        "lang",
    )


FILES = "SELECT source AS source_id, source || '/' || doc_id || '.txt' AS rel_path, n_chars AS size, doc_id::DOUBLE AS mtime, sha256(text) AS content_hash, 'document' AS kind, doc_id, lang FROM documents"
FILES_AFTER = """SELECT source AS source_id, source || CASE WHEN lang = 'es' THEN '/moved/' ELSE '/' END || doc_id || '.txt' AS rel_path,
 n_chars + CASE WHEN contains(text, '###') THEN 1 ELSE 0 END AS size, doc_id + CASE WHEN contains(text, '###') OR lang = 'fr' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS mtime,
 sha256(CASE WHEN contains(text, '###') THEN text || '!' ELSE text END) AS content_hash, 'document' AS kind, doc_id, lang
 FROM documents WHERE NOT (lang = 'de' AND source = 'src3')"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's lines that aren't blank; the first is its heading, very long lines are tables."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("ordinal", "body"))
    kind = F.when(F.col("ordinal") == 0, "heading").when(F.col("body").contains("|"), "table").otherwise("paragraph")
    return d.where(F.trim("body") != "").select("doc_id", "source", "lang", F.col("ordinal").cast("long").alias("ordinal"), "body", kind.alias("kind"))


CHUNKS = """SELECT doc_id, source, lang, ordinal, body, CASE WHEN ordinal = 0 THEN 'heading' WHEN contains(body, '|') THEN 'table' ELSE 'paragraph' END AS kind
 FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS body, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::BIGINT AS ordinal FROM documents) WHERE trim(body) <> ''"""

# How the questions of the tests are put; X and Y stand for words of a benchmark item.
QUESTIONS = [
    "X",
    "X.Y",
    "Get_X",
    "src/X.py",
    "X Y",
    "who calls X",
    "what breaks if X changes",
    "compare X and Y on speed",
    "difference between X and Y",
    "X vs Y limits",
    "from X through Y to X_end",
    "what does the X policy say about Y",
    "how does X handle the Y of an order",
    "what is X? and what is Y?",
    "explain X then Y; list the uses of Y",
]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, question): every form of question over the first two words of five letters and more of each benchmark item."""
    w = F.filter(text.words("text"), lambda x: F.length(x) >= 5)
    b = table(spark, sf_dir, "benchmark").select("item_id", F.coalesce(F.try_element_at(w, F.lit(1)), F.lit("nothing")).alias("x"), F.try_element_at(w, F.lit(2)).alias("y"))
    forms = b.select("item_id", "x", F.coalesce("y", "x").alias("y"), F.posexplode(F.array(*(F.lit(q) for q in QUESTIONS))).alias("form", "q"))
    filled = F.replace(F.replace(F.replace("q", F.lit("X"), F.lit("\u0001")), F.lit("Y"), F.col("y")), F.lit("\u0001"), F.col("x"))
    return forms.select((F.col("item_id") * 100 + F.col("form")).alias("question_id"), filled.alias("question"))


_SQL_WORDS = r"list_filter(regexp_split_to_array({0}, '[^\p{{L}}\p{{N}}_\p{{M}}]+'), lambda x: x <> '')"


def sql_words(expression: str) -> str:
    return _SQL_WORDS.format(expression)


QUESTIONS_SQL = (
    "SELECT item_id * 100 + form AS question_id, replace(replace(replace(q, 'X', chr(1)), 'Y', coalesce(w[2], w[1], 'nothing')), chr(1), coalesce(w[1], 'nothing')) AS question FROM (SELECT item_id, list_filter("
    + sql_words("text")
    + ", lambda x: length(x) >= 5) AS w FROM benchmark), (VALUES "
    + ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUESTIONS))
    + ") AS f(form, q)"
)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, terms): the distinct lower-cased words of each benchmark item."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(text.lower_words("text")).alias("terms"))


def held(documents: DataFrame) -> DataFrame:
    """(doc_id, name): the distinct words of each of documents(doc_id, text), lower-cased; from the texts, as no index is needed for them."""
    return documents.select("doc_id", F.explode(F.array_distinct(text.lower_words("text"))).alias("name"))


def entities(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Words of three letters and more that two documents hold at least, as symbols their first document defines; (name, qualified_name, kind, file, source, start_line, id); of other documents if given."""
    stored = None if of is not None else lexical.Index.found(scan(spark, sf_dir, "documents"), *INDEX)
    if stored:
        # by the index's own blocks: how many documents hold a word, and the first of them, without opening any
        n = stored.terms()
    else:
        # summed up in the tasks, so that a word leaves each but once; an index is not built for it
        words = held(table(spark, sf_dir, "documents") if of is None else of)
        n = words.groupBy(F.col("name").alias("term")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    e = n.where("n >= 2 and length(term) >= 3").select(F.col("term").alias("name"), F.col("first").alias("doc_id"))
    e = e.join(scan(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").withColumn("first", F.struct("doc_id", "source"))
    q = F.concat_ws(".", F.col("first.source"), F.concat(F.lit("d"), F.col("first.doc_id")), F.col("name"))
    return e.select(
        ids.entity_id(F.col("first.doc_id"), F.lit("function"), q, F.lit(0)).alias("id"),
        "name",
        q.alias("qualified_name"),
        F.when(F.length("name") % 3 == 0, "class").when(F.length("name") % 3 == 1, "function").otherwise("method").alias("kind"),
        F.col("first.doc_id").alias("file_id"),
        F.col("first.source").alias("source_id"),
        F.length("name").cast("long").alias("start_line"),
    )


#: Key, fields and name of the documents' index.
INDEX = ("doc_id", {"text": 1}, "documents-text")


def index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    """The stored full-text index of the documents' texts."""
    return lexical.Index.stored(scan(spark, sf_dir, "documents"), table(spark, sf_dir, "documents"), *INDEX)


def index_after(spark: SparkSession, sf_dir: str) -> lexical.Index:
    """The stored index brought up to the next scan: only records whose content changed are taken apart."""
    old, new = files(spark, sf_dir).select("doc_id", "content_hash"), files_after(spark, sf_dir).select("doc_id", F.col("content_hash").alias("now"))
    both = shared.written(old.join(new, "doc_id", "full").where(~F.col("content_hash").eqNullSafe(F.col("now"))), "changed")
    edited = both.where("now is not null").select("doc_id")
    records = table(spark, sf_dir, "documents").join(edited, "doc_id", "left_semi").select("doc_id", F.concat("text", F.lit("!")).alias("text"))
    return index(spark, sf_dir).copy(shared.folder(spark, "upkeep")).update(both.where("now is null").select("doc_id"), records)


def sql_id(domain: str, *parts: str) -> str:
    return f"substr(sha256(concat_ws(chr(31), '{domain}', {', '.join(parts)})), 1, 32)"


ENTITIES = f"""SELECT {sql_id("entity", "doc_id", "'function'", "source || '.d' || doc_id || '.' || name", "0")} AS id, name, source || '.d' || doc_id || '.' || name AS qualified_name,
 CASE length(name) % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'method' END AS kind, doc_id AS file_id, source AS source_id, length(name)::BIGINT AS start_line
 FROM (SELECT name, count(*) AS held, min(doc_id) AS doc_id, min_by(source, doc_id) AS source FROM (SELECT DISTINCT doc_id, source, unnest({sql_words("lower(text)")}) AS name FROM documents) GROUP BY name)
 WHERE held >= 2 AND length(name) >= 3"""


def documents_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) as the next scan finds them."""
    d = table(spark, sf_dir, "documents").where("not (lang = 'de' and source = 'src3')")
    return d.select("doc_id", F.when(F.col("text").contains("###"), F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))


def references(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """(file_id, reference_text): the words of each document, once each, as references to symbols; no word holds a dot; of other documents if given."""
    return held(table(spark, sf_dir, "documents") if of is None else of).select(F.col("doc_id").alias("file_id"), F.col("name").alias("reference_text"))


REFERENCES = f"SELECT DISTINCT doc_id AS file_id, source AS source_id, unnest({sql_words('lower(text)')}) AS reference_text FROM documents"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source_id, target_id, type): the shop tables as a graph, from orders to customers, parts and suppliers, and on to nations and regions."""

    def edge(name: str, a: Column, b: Column, kind: str) -> DataFrame:
        return table(spark, sf_dir, name).select(a.alias("s"), b.alias("t"), F.lit(kind).alias("type")).distinct()

    def node(prefix: str, column: str) -> Column:
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    all_edges = (
        edge("orders", node("o", "o_orderkey"), node("c", "o_custkey"), "references")
        .unionByName(edge("customer", node("c", "c_custkey"), node("n", "c_nationkey"), "calls"))
        .unionByName(edge("supplier", node("s", "s_suppkey"), node("n", "s_nationkey"), "calls"))
        .unionByName(edge("nation", node("n", "n_nationkey"), node("r", "n_regionkey"), "calls"))
        .unionByName(edge("lineitem", node("o", "l_orderkey"), node("s", "l_suppkey"), "imports"))
    )
    return all_edges.select(ids.relationship_id(F.col("s"), F.col("type"), F.col("t"), F.lit(0)).alias("id"), F.col("s").alias("source_id"), F.col("t").alias("target_id"), "type")


CALLS = f"""SELECT {sql_id("relationship", "s", "type", "t", "0")} AS id, s AS source_id, t AS target_id, type FROM (
 SELECT DISTINCT 'o' || o_orderkey AS s, 'c' || o_custkey AS t, 'references' AS type FROM orders UNION ALL SELECT DISTINCT 'c' || c_custkey, 'n' || c_nationkey, 'calls' FROM customer
 UNION ALL SELECT DISTINCT 's' || s_suppkey, 'n' || s_nationkey, 'calls' FROM supplier UNION ALL SELECT DISTINCT 'n' || n_nationkey, 'r' || n_regionkey, 'calls' FROM nation
 UNION ALL SELECT DISTINCT 'o' || l_orderkey, 's' || l_suppkey, 'imports' FROM lineitem)"""
