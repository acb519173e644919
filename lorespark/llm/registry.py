"""Queries of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitpack, decontaminate, dimension_history, language_id, metric_topk, ngram_join, piece_codec, quality_rules, spelling_groups, suffix_dedup, token_counts, toxicity, warc_zip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def contamination(docs: DataFrame, benchmark: DataFrame, *more: str) -> DataFrame:
    """The measures of each document, and columns more of ``phrase_matches``."""
    found = decontaminate.phrase_matches(decontaminate.build_index(docs.select("doc_id", "text")), benchmark)
    hits = F.size("places").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        ((hits > 0) & (20 * hits >= F.col("n_words"))).alias("contaminated"),
        *more,
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def remainder(n: int, column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    net = language_id.learn(docs.select("doc_id", "text", "lang"), remainder(4) != 2)
    return language_id.predict(docs.select("doc_id", "text"), net).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"), remainder(5) != 0)
    return toxicity.score(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


END_OF_DOCUMENT = 49407  # <|endoftext|> of word_bpe_49k.json


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_counts.write_flat(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"), END_OF_DOCUMENT)
    return token_counts.document_counts(files, END_OF_DOCUMENT)


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc_zip.read(warc_zip.write(_table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(_table(spark, sf_dir, "documents"))


def piece_digests(docs: DataFrame) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    done = piece_codec.encode(docs.select("doc_id", "text"), model, decoded=True)
    return done.select("doc_id", *piece_columns())


def piece_columns() -> list[Column]:
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    ]


def op10_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = bitpack.write(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return bitpack.read(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


SLIP = 199  # of so many runs of a document one loses a letter


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling_groups.runs(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "run").cast("binary"))
    run = F.col("run")
    slipped = F.when(h % SLIP == 0, spelling_groups.without(run, (h % F.char_length(run)).cast("int"))).otherwise(run)
    return spelling_groups.variants(spelling_groups.count_words(runs.select(slipped.alias("word"))))


def dimension_changes(docs: DataFrame) -> DataFrame:
    """Changes j=0 and j=1 of every document, as ``dimension_history.versions`` takes them."""
    each = docs.select("doc_id", "source", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    digest = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("j").cast("string")), 256)
    h = each.select("doc_id", "source", "j", F.conv(F.substring(digest, 1, 12), 16, 10).cast("long").alias("h")).where("doc_id is not null")
    sort = F.floor(F.col("h") / 1000) % 10
    kind = F.when(sort <= 1, "delete").when(sort <= 4, "correction").otherwise("update")
    start = F.col("h") % 60
    return h.select((F.col("doc_id") - F.col("doc_id") % 10).alias("key"), kind.alias("kind"), start.alias("start"), (start + 10).alias("stop"), F.array("h", F.col("doc_id").cast("long"), F.col("j").cast("long")).alias("arrival"), F.col("source").alias("value"))


def op12_dimension_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dimension_history.versions(dimension_changes(_table(spark, sf_dir, "documents")))
    return found.withColumnRenamed("key", "doc_id")


def op13_metric_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = metric_topk.build(_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x")))
    return metric_topk.top_k(index, 10, metric_topk.divisible(100)).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_quality_rules": op2_quality_rules,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_decontaminate": op4_decontaminate,
        "op5_language_id": op5_language_id,
        "op6_toxicity": op6_toxicity,
        "op7_token_counts": op7_token_counts,
        "op8_warc_zip": op8_warc_zip,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_bitpack": op10_bitpack,
        "op11_spelling_groups": op11_spelling_groups,
        "op12_dimension_history": op12_dimension_history,
        "op13_metric_topk": op13_metric_topk,
    }


#: crc32 goes over the bytes' hexadecimal digits, the low one of a byte first.
SPELLING_SQL = """
WITH RECURSIVE digits AS (SELECT list(list_reduce([r::BIGINT, 1, 2, 3, 4], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY r) AS t FROM range(16) AS x(r)),
runs AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS run FROM documents),
counted AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS said, run, count(*) AS n FROM runs GROUP BY ALL),
hexes AS (SELECT run, n, hex(encode(said)) AS h FROM counted),
crcs AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h)), lambda i: strpos('0123456789ABCDEF', h[i + CASE WHEN i % 2 = 0 THEN 2 ELSE 0 END]) - 1)), lambda c, d: xor(c >> 4, t[(xor(c, d) & 15) + 1]))) AS c FROM hexes, digits),
slipped AS (SELECT CASE WHEN c % 199 = 0 THEN substr(run, 1, (c % length(run))::INT) || substr(run, (c % length(run))::INT + 2) ELSE run END AS word, n FROM crcs),
words AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
holes AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
less AS (SELECT word, n, i, substr(word, 1, (i - 1)::INT) || substr(word, (i + 1)::INT) AS rest FROM holes),
pairs AS (
  SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-m, near)) AS near, max(m) AS m FROM pairs GROUP BY word),
told AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 5 * w.n THEN b.near END AS form, CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n FROM words w LEFT JOIN best b USING (word)),
chain AS (SELECT word, word AS root, form AS next FROM told UNION ALL SELECT c.word, t.word, t.form FROM chain c JOIN told t ON t.word = c.next)
SELECT t.word, t.form, c.root, t.n, t.n_near, t.form_n FROM told t JOIN chain c ON c.word = t.word AND c.next IS NULL
"""

HISTORY_SQL = """
WITH changes AS (
  SELECT DISTINCT doc_id - doc_id % 10 AS k, h, doc_id, j, h % 60 AS s, (h // 1000) % 10 AS o, source FROM (
    SELECT doc_id, source, j, ('0x' || substr(sha256(doc_id || ':' || j), 1, 12))::BIGINT AS h FROM documents, range(2) AS r(j) WHERE doc_id IS NOT NULL)),
days AS (SELECT k, d FROM (SELECT DISTINCT k FROM changes), range(71) AS r(d)),
fixes AS (SELECT k, d, arg_max({'v': source}, (h, doc_id, j, source IS NOT NULL, source)) AS v FROM days JOIN changes USING (k) WHERE o BETWEEN 2 AND 4 AND d >= s AND d < s + 10 GROUP BY ALL),
bases AS (SELECT k, d, arg_max({'v': source, 'gone': o <= 1}, (s, h, doc_id, j, source IS NOT NULL, source)) AS b FROM days JOIN changes USING (k) WHERE o NOT BETWEEN 2 AND 4 AND d >= s GROUP BY ALL),
present AS (SELECT k, d, CASE WHEN f.v IS NOT NULL THEN f.v.v ELSE b.b.v END AS value FROM days LEFT JOIN fixes f USING (k, d) LEFT JOIN bases b USING (k, d) WHERE f.v IS NOT NULL OR NOT b.b.gone),
marked AS (SELECT k, d, value, CASE WHEN lag(d) OVER w = d - 1 AND lag(value) OVER w IS NOT DISTINCT FROM value THEN 0 ELSE 1 END AS new FROM present WINDOW w AS (PARTITION BY k ORDER BY d)),
runs AS (SELECT k, d, value, sum(new) OVER (PARTITION BY k ORDER BY d) AS version FROM marked)
SELECT k AS doc_id, version::INT AS version, min(d)::BIGINT AS valid_from, CASE WHEN max(d) < 70 THEN max(d) + 1 END::BIGINT AS valid_to, any_value(value) AS value FROM runs GROUP BY k, version
"""

TOP_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_spelling_groups": SPELLING_SQL, "op12_dimension_history": HISTORY_SQL, "op13_metric_topk": TOP_SQL}
