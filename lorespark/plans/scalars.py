"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import corpus
from ..functions import files, ids, text
from ..functions import vectors as v
from ._base import query

_W = corpus.sql_words("text")
_LW = corpus.sql_words("lower(text)")


@query("f1_word_tokens", f"SELECT doc_id, len({_W})::BIGINT AS n_words, len(list_distinct({_W}))::BIGINT AS n_distinct, sha256(array_to_string({_W}, ' ')) AS words_sha256 FROM documents")
def f1_word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = text.words("text")
    return corpus.table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), F.sha2(F.array_join(w, " "), 256).alias("words_sha256"))


# identifiers put together from a document's words
_IDENT = "concat(w[1], upper(substr(w[2], 1, 1)), substr(w[2], 2), '2Api HTTP', upper(substr(w[1], 1, 1)), substr(w[1], 2), ' snake_', w[2], ' v', len(w))"


def _split_sql(e: str) -> str:
    e = f"regexp_replace({e}, '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g')"
    e = f"regexp_replace({e}, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g')"
    e = f"regexp_replace({e}, '(\\p{{L}})([0-9])', '\\1 \\2', 'g')"
    e = f"regexp_replace({e}, '([0-9])(\\p{{L}})', '\\1 \\2', 'g')"
    return f"list_filter(string_split_regex(lower({e}), '[ _]+'), lambda x: x <> '')"


def _with_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = text.lower_words("text")
    d = corpus.table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).where("size(w) > 1")
    a, b = F.col("w")[0], F.col("w")[1]
    return d.select("doc_id", F.concat(a, text.capitalized(b), F.lit("2Api HTTP"), text.capitalized(a), F.lit(" snake_"), b, F.lit(" v"), F.size("w")).alias("ident"))


@query("f2_identifier_words", f"""WITH i AS (SELECT doc_id, {_IDENT} AS ident FROM (SELECT doc_id, {_LW} AS w FROM documents) WHERE len(w) > 1),
 p AS (SELECT doc_id, flatten(list_transform({corpus.sql_words('ident')}, lambda x: list_filter(string_split(x, '_'), lambda y: y <> ''))) AS pieces FROM i)
 SELECT doc_id, array_to_string(flatten(list_filter(list_transform(pieces, lambda x: {_split_sql('x')}), lambda x: len(x) > 1)), ' ') AS words FROM p""")
def f2_identifier_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_identifiers(spark, sf_dir).select("doc_id", text.identifier_words("ident").alias("words"))


@query("f4_f8_names_and_paths", f"""SELECT rel_path, regexp_extract(qn, '[^.]*$') AS bare, CASE WHEN len(string_split(qn, '.')) >= 3 THEN array_to_string(string_split(qn, '.')[-2:], '.') END AS alias,
 regexp_extract(rel_path, '[^/]*$') AS file_name, lower(regexp_extract(rel_path, '[^/](\\.[^./]+)$', 1)) AS suffix, regexp_replace(regexp_extract(rel_path, '[^/]*$'), '\\.[^.]+$', '') AS stem, replace(regexp_replace(rel_path, '\\.[^./]+$', ''), '/', '.') AS namespace
 FROM (SELECT rel_path, source_id || '.' || lang || CASE WHEN lang = 'en' THEN '.x' || doc_id ELSE '' END AS qn FROM ({corpus.FILES_AFTER}))""")
def f4_f8_names_and_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpus.files_after(spark, sf_dir).withColumn("qn", F.concat("source_id", F.lit("."), "lang", F.when(F.col("lang") == "en", F.concat(F.lit(".x"), "doc_id")).otherwise("")))
    return f.select("rel_path", text.bare_name("qn").alias("bare"), text.alias_name("qn").alias("alias"), text.file_name("rel_path").alias("file_name"), text.suffix("rel_path").alias("suffix"), text.stem("rel_path").alias("stem"), text.namespace("rel_path").alias("namespace"))


@query("f9_first_line", "SELECT doc_id, substr(split_part(text, chr(10), 1), 1, 80) AS signature FROM documents")
def f9_first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "documents").select("doc_id", text.first_line("text", 80).alias("signature"))


_ROUTES = ["@app.get('/X')", '@app.route("/X", methods=["post"])', "@bp.route('/X')", "@login_required", "@x.delete( '/X' )", "@app.route('/bad\")"]
_ATTRS = ['HttpGet("/X")', "Route('X')", "HttpPost", "Authorize", 'HttpDelete( "X/{id}" )']


def _forms(spark: SparkSession, sf_dir: str, forms: list[str]) -> DataFrame:
    w = text.lower_words("text")[0]
    b = corpus.table(spark, sf_dir, "benchmark").select("item_id", w.alias("x"), F.posexplode(F.array(*(F.lit(f) for f in forms))).alias("form", "f"))
    return b.select("item_id", F.col("form").cast("long").alias("form"), F.replace("f", F.lit("X"), F.col("x")).alias("t"))


def _forms_sql(forms: list[str]) -> str:
    rows = ", ".join("({}, '{}')".format(i, f.replace("'", "''")) for i, f in enumerate(forms))
    return f"SELECT item_id, form::BIGINT AS form, replace(f, 'X', x) AS t FROM (SELECT item_id, ({_LW})[1] AS x FROM benchmark), (VALUES {rows}) AS v(form, f)"


_PY = """(?s)^@\\s*[\\w.]*\\.(route|get|post|put|patch|delete|head|options)\\s*\\(\\s*(?:''([^''"]+)''|"([^''"]+)")(.*)"""
_CS = """^(Http(Get|Post|Put|Patch|Delete)|Route)\\s*(?:\\(\\s*(?:''([^''"]*)''|"([^''"]*)")\\s*\\))?"""


@query("f11_f12_routes", f"""WITH p AS ({_forms_sql(_ROUTES)}), c AS ({_forms_sql(_ATTRS)}),
 r AS (SELECT item_id, 'python' AS language, form, trim(split_part(regexp_replace(t, '^@', ''), '(', 1)) AS head, CASE WHEN regexp_extract(t, '{_PY}', 1) <> '' THEN 'http_endpoint:' ||
   CASE WHEN regexp_extract(t, '{_PY}', 1) <> 'route' THEN upper(regexp_extract(t, '{_PY}', 1)) WHEN regexp_extract(regexp_extract(t, '{_PY}', 4), 'methods\\s*=\\s*\\[\\s*[''"](\\w+)[''"]', 1) <> '' THEN upper(regexp_extract(regexp_extract(t, '{_PY}', 4), 'methods\\s*=\\s*\\[\\s*[''"](\\w+)[''"]', 1)) ELSE 'GET' END
   || ':' || regexp_extract(t, '{_PY}', 2) || regexp_extract(t, '{_PY}', 3) END AS target FROM p
  UNION ALL SELECT item_id, 'csharp', form, trim(split_part(t, '(', 1)), CASE WHEN regexp_extract(t, '{_CS}', 1) <> '' THEN 'http_endpoint:' || CASE WHEN regexp_extract(t, '{_CS}', 2) <> '' THEN upper(regexp_extract(t, '{_CS}', 2)) ELSE 'ANY' END || ':' || regexp_extract(t, '{_CS}', 3) || regexp_extract(t, '{_CS}', 4) END FROM c)
 SELECT *, CASE WHEN regexp_extract(target, '^http_endpoint:[^:]*:(.*)$', 1) <> '' THEN regexp_extract(target, '^http_endpoint:([^:]*):', 1) END AS method FROM r""")
def f11_f12_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _forms(spark, sf_dir, _ROUTES).select("item_id", F.lit("python").alias("language"), "form", text.decorator_head("t").alias("head"), text.python_route("t").alias("target"))
    c = _forms(spark, sf_dir, _ATTRS).select("item_id", F.lit("csharp").alias("language"), "form", text.decorator_head("t").alias("head"), text.csharp_route("t").alias("target"))
    return p.unionByName(c).withColumn("method", text.route_parts("target")["method"])


@query("f13_sentences", "SELECT doc_id, pos::BIGINT AS pos, sentence FROM (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda x: x <> '') AS s FROM documents))")
def f13_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.sentences("text")).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@query("f14_token_count", "SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]'))::BIGINT AS n FROM documents")
def f14_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "documents").select("doc_id", text.token_count("text").cast("long").alias("n"))


@query("f16_f17_rendering", "SELECT r_name, 'Regions' || chr(10) || chr(10) || string_agg(n_nationkey || ' | ' || n_name, chr(10) ORDER BY n_nationkey) AS table_text, 'Document: ' || r_name || chr(10) || 'Section: ' || string_agg(n_name, ' > ' ORDER BY n_nationkey) AS header FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def f16_f17_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = corpus.table(spark, sf_dir, "nation").join(corpus.table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    g = n.groupBy("r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    rows = F.transform("r", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))
    return g.select("r_name", text.render_table(rows, F.lit("Regions")).alias("table_text"), text.section_header(F.col("r_name"), F.transform("r", lambda x: x["n_name"])).alias("header"))


@query("f18_normalized", "SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS fingerprint FROM documents")
def f18_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "documents").select("doc_id", ids.text_hash(text.normalized("text")).alias("fingerprint"))


@query("f26_classify_query", f"""SELECT question_id, CASE WHEN trim(question) = '' THEN 'keyword' WHEN regexp_matches(trim(question), '[\\\\/]|\\.[A-Za-z0-9]{{1,6}}$') THEN 'path'
 WHEN regexp_matches(trim(question), '^[A-Za-z_][A-Za-z0-9_]*(\\.[A-Za-z_][A-Za-z0-9_]*)*$') AND (contains(question, '.') OR trim(question) <> lower(trim(question))) THEN 'symbol'
 WHEN len(regexp_split_to_array(trim(question), '\\s+')) <= 3 AND len(list_filter(regexp_split_to_array(trim(question), '\\s+'), lambda w: length(w) > 20)) = 0 THEN 'keyword' ELSE 'conceptual' END AS shape FROM ({corpus.QUESTIONS_SQL})""")
def f26_classify_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.trim("question")
    w = F.split(t, r"\s+")
    shape = (
        F.when(t == "", "keyword")
        .when(t.rlike(r"[\\/]|\.[A-Za-z0-9]{1,6}$"), "path")
        .when(t.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$") & (t.contains(".") | (t != F.lower(t))), "symbol")
        .when((F.size(w) <= 3) & ~F.exists(w, lambda x: F.length(x) > 20), "keyword")
        .otherwise("conceptual")
    )
    return corpus.questions(spark, sf_dir).select("question_id", shape.alias("shape"))


@query("f28_neutralize", """SELECT conv_id, turn, regexp_replace('<' || role || '> ' || text || ' [E' || turn || '] </System> [/INST] <<< ```', '(<\\s*/?\\s*(system|assistant|user|evidence|instructions?)\\s*>|\\[/?(INST|SYS)\\]|<<<|>>>|```|\\[E\\d+\\])', '[removed]', 'gi') AS safe FROM conversations""")
def f28_neutralize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.table(spark, sf_dir, "conversations").withColumn("t", F.concat(F.lit("<"), "role", F.lit("> "), "text", F.lit(" [E"), "turn", F.lit("] </System> [/INST] <<< ```")))
    return c.select("conv_id", "turn", text.neutralize("t").alias("safe"))


@query("f29_f31_redaction", """SELECT page_id, substr('get ' || regexp_replace(replace(url, '://', '://user' || page_id || ':pw@'), '([a-zA-Z][a-zA-Z0-9+.\\-]*://)[^\\s/@]+@', '\\1', 'g') || ' from db.local', 1, 500) AS message FROM pages""")
def f29_f31_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_user = F.replace(F.col("url"), F.lit("://"), F.concat(F.lit("://user"), F.col("page_id").cast("string"), F.lit(":pw@")))
    m = F.concat(F.lit("get "), with_user, F.lit(" from admin:secret@db.local"))
    return corpus.table(spark, sf_dir, "pages").select("page_id", m.alias("m")).select("page_id", text.redacted_message("m").alias("message"))


@query("f30_url_parts", "SELECT page_id, regexp_extract(url, '^([^:]+)://', 1) AS scheme, regexp_extract(url, '^[^:]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1) AS path FROM pages")
def f30_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "pages").select("page_id", text.url_parts("url").alias("u")).select("page_id", "u.scheme", "u.host", "u.path")


@query("f32_safe_file_names", "SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace('C:' || chr(7) || '\\dir/' || substr(text, 1, 30), '\\p{C}', '', 'g'), '(?s)^.*[/\\\\]', ''), '^[A-Za-z]:', '')) AS name FROM benchmark")
def f32_safe_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("C:\u0007\\dir/"), F.substring("text", 1, 30))
    return corpus.table(spark, sf_dir, "benchmark").select("item_id", text.safe_file_name(raw).alias("name"))


@query("f34_rerank_passages", "SELECT doc_id, split_part(text, chr(10), 1) || ' — ' || source || ' > ' || lang || '. ' || array_to_string((list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))[1:256], ' ') AS passage FROM documents")
def f34_rerank_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.table(spark, sf_dir, "documents")
    return d.select("doc_id", text.rerank_passage(F.split("text", "\n")[0], F.array("source", "lang"), F.col("text")).alias("passage"))


@query("f37_table_grid", "SELECT o_orderkey, array_to_string(list_transform(range(1, rows + 1), lambda r: coalesce(m[r]::VARCHAR, '') || ' | ' || CASE WHEN m[r] IS NULL THEN '' ELSE 'q' END), chr(10)) AS grid FROM (SELECT l_orderkey AS o_orderkey, max(l_linenumber) AS rows, map_from_entries(list((l_linenumber, p))) AS m FROM (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, max(l_partkey) AS p FROM lineitem GROUP BY ALL) GROUP BY ALL)")
def f37_table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid an order, with as many rows as its largest line number."""
    one = corpus.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").cast("string").alias("p"))
    cells = one.select("l_orderkey", F.explode(F.array(F.struct((F.col("l_linenumber") - 1).cast("int").alias("row"), F.lit(0).alias("col"), F.col("p").alias("text")), F.struct((F.col("l_linenumber") - 1).cast("int").alias("row"), F.lit(1).alias("col"), F.lit("q").alias("text")))).alias("c"))
    g = cells.groupBy("l_orderkey").agg(F.collect_list("c").alias("cells"), (F.max("c.row") + 1).alias("rows"))
    return g.select(F.col("l_orderkey").alias("o_orderkey"), text.render_table(text.table_grid(F.col("cells"), F.col("rows"), F.lit(2))).alias("grid"))


@query("f38_f40_times", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, round(greatest(0, epoch(TIMESTAMP '2030-01-01' - ts)), 1)::DOUBLE AS age, CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' || (s // 3600 % 24) || 'h ' || (s // 60 % 60) || 'm' WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS uptime
 FROM (SELECT event_id, ts, (event_id * 37)::BIGINT AS s FROM events)""")
def f38_f40_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    age = F.unix_micros(F.lit("2030-01-01 00:00:00").cast("timestamp")) - F.unix_micros("ts")
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.round(F.greatest(F.lit(0.0), age / 1e6), 1).alias("age"), text.uptime(F.col("event_id") * 37).alias("uptime"))


@query("f39_percentage", "SELECT o_orderkey, CASE WHEN p = 0 THEN 100.0 ELSE round(greatest(0.0, least(100.0, d * 100.0 / p)), 1) END::DOUBLE AS pct FROM (SELECT o_orderkey, count(l_orderkey)::DOUBLE AS d, (max(o_orderkey) % 5)::DOUBLE AS p FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)")
def f39_percentage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = corpus.table(spark, sf_dir, "orders").join(corpus.table(spark, sf_dir, "lineitem"), F.expr("o_orderkey = l_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_orderkey").cast("double").alias("d"))
    return o.select("o_orderkey", text.percentage(F.col("d"), (F.col("o_orderkey") % 5).cast("double")).alias("pct"))


@query("f42_f43_project_files", "SELECT r_name, array_to_string(list(n_name ORDER BY n_nationkey), ',') AS includes, lower(r_name) AS consumer, 'core' AS producer FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def f42_f43_project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = corpus.table(spark, sf_dir, "nation").join(corpus.table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    g = n.groupBy("r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    xml = F.concat(F.lit("<Project>"), F.array_join(F.transform("r", lambda x: F.concat(F.lit('<PackageReference Version="1" Include="'), x["n_name"], F.lit('"/>'))), "\n"), F.lit("</Project>"))
    d = text.dependency(F.concat(F.lower("r_name"), F.lit(" -> core")))
    return g.select("r_name", F.array_join(text.project_references(xml), ",").alias("includes"), d["consumer"].alias("consumer"), d["producer"].alias("producer"))


_ID = corpus.sql_id


@query("f45_ids", f"""SELECT rel_path, 'src_' || substr(sha256(source_id), 1, 10) AS source_key, {_ID('file', 'source_id', 'rel_path')} AS file_key, {_ID('document', _ID('file', 'source_id', 'rel_path'))} AS document_key, {_ID('chunk', _ID('document', _ID('file', 'source_id', 'rel_path')), "'0'")} AS chunk_key,
 'q:' || source_id || '.' || doc_id AS symbol_key, kind || ':indexed:' || content_hash AS semantic_key, CASE WHEN lang IN ('de', 'fr') THEN 'network' ELSE 'local' END AS source_type FROM ({corpus.FILES})""")
def f45_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpus.files(spark, sf_dir)
    file = ids.file_id(f.source_id, f.rel_path)
    raw = F.when(f.lang == "de", F.concat(F.lit("smb://h/"), f.rel_path)).when(f.lang == "fr", F.concat(F.lit("//h/"), f.rel_path)).when(f.lang == "es", F.concat(F.lit("///"), f.rel_path)).otherwise(f.rel_path)
    return f.select(
        "rel_path",
        ids.source_id(f.source_id).alias("source_key"),
        file.alias("file_key"),
        ids.document_id(file).alias("document_key"),
        ids.chunk_id(ids.document_id(file), F.lit(0)).alias("chunk_key"),
        ids.symbol_keys(F.concat_ws(".", "source_id", "doc_id"), f.lang)[0].alias("symbol_key"),
        ids.semantic_file_key(f.kind, F.lit("indexed"), f.content_hash).alias("semantic_key"),
        ids.source_type(raw).alias("source_type"),
    )


_NAMES = ["app/main.py", "a/B.PY", "x.Eml", ".env", "archive.tar.gz", "web/node_modules/x.js", "src/index.test.ts", "pkg/run_test.go", "OrderTests.cs", "test_.py", "keys/server.pem", "docs/private/a.md", "logs/a.log", "logs/keep.log", "deep/secrets.txt", "site/page.html", "r/sheet.xlsx", "noext", "dot.", "ui/App.tsx"]
_FOLDER = "CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'p' || page_id || '/' ELSE coalesce(regexp_extract(url, '^[^:]+://([^/]+)', 1), '') || '/' END"


def _cases(table: dict[str, str]) -> str:
    return "CASE suffix " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


@query("s4_s8_path_rules", f"""WITH n AS (SELECT page_id, {_FOLDER} || ([{_quoted(_NAMES)}])[page_id % {len(_NAMES)} + 1] AS path FROM pages UNION ALL SELECT doc_id, rel_path FROM ({corpus.FILES})),
 p AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, string_split(path, '/') AS parts FROM n), x AS (SELECT *, lower(regexp_extract(name, '\\.[^.]*$')) AS suffix, regexp_matches(name, '^(\\.env|\\.env\\..*|.*\\.pem|.*\\.key|id_rsa|id_ed25519|credentials.*|secrets.*)$') AS secret FROM p)
 SELECT page_id AS id, path, CASE WHEN suffix IN ({_quoted(files.CODE)}) THEN 'code' WHEN suffix IN ({_quoted(files.DOCUMENT)}) THEN 'document' ELSE 'unknown' END AS kind, {_cases(files.LANGUAGE)} AS language, {_cases(files.FORMAT)} AS format, secret,
  secret OR list_has_any(parts[:len(parts) - 1], [{_quoted(files.SKIPPED_FOLDERS)}]) OR (name <> 'keep.log' AND (regexp_matches(name, '\\.log$') OR starts_with(path, 'docs/private/'))) AS ignored,
  regexp_matches(name, '^test_.+\\.py$|^.+_test\\.(py|go)$|^.+Tests?\\.(cs|java)$|^.+\\.(test|spec)\\.(js|jsx|ts|tsx)$') AS test FROM x""")
def s4_s8_path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of all kinds under the pages' hosts and numbers, and the documents' paths."""
    folder = F.expr(_FOLDER)
    name = F.element_at(F.array(*(F.lit(x) for x in _NAMES)), (F.col("page_id") % len(_NAMES) + 1).cast("int"))
    p = corpus.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.concat(folder, name).alias("path")).unionByName(corpus.files(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("rel_path").alias("path")))
    c = F.col("path")
    return p.select("id", "path", files.kind(c).alias("kind"), files.language(c).alias("language"), files.document_format(c).alias("format"), files.is_secret(c).alias("secret"), files.is_ignored(c, ["*.log", "logs/", "/docs/private/*"], ["keep.log"]).alias("ignored"), files.is_test(c).alias("test"))


@query("s4_ignored_files", f"SELECT rel_path, contains(rel_path, '/moved/') OR regexp_matches(rel_path, '/1[^/]*\\.txt$') AS ignored, 'document' AS kind, 'txt' AS format FROM ({corpus.FILES_AFTER})")
def s4_ignored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpus.files_after(spark, sf_dir)
    return f.select("rel_path", files.is_ignored(f.rel_path, ["*/moved/*", "1*.txt"]).alias("ignored"), files.kind(f.rel_path).alias("kind"), files.document_format(f.rel_path).alias("format"))


_QW = ", ".join(f"'{w}'" for w in text.QUESTION_WORDS)
_CONTENT = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 3 AND w NOT IN (" + _QW + "))"


@query("p13_p14_content_terms", f"SELECT question_id, term FROM (SELECT DISTINCT question_id, unnest({_CONTENT.format('question')}) AS term FROM ({corpus.QUESTIONS_SQL}))")
def p13_p14_content_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.questions(spark, sf_dir).select("question_id", F.explode(text.content_terms("question")).alias("term"))


_COMMON = ", ".join(f"'{w}'" for w in text.COMMON_NAMES)


@query("p15_common_names", f"SELECT name, length(name) >= 3 AND name NOT IN ({_COMMON}) AS links FROM (SELECT DISTINCT unnest({_LW}) AS name FROM documents UNION SELECT unnest(['get', 'value', 'to_string', 'ab', 'settle']))")
def p15_common_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = corpus.table(spark, sf_dir, "documents").select(F.explode(text.lower_words("text")).alias("name"))
    extra = spark.createDataFrame([(x,) for x in ("get", "value", "to_string", "ab", "settle")], "name string")
    return n.unionByName(extra).distinct().select("name", text.links_by_bare_name("name").alias("links"))


@query("f20_f23_vector_math", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS norm2, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS unit_sum, 0.5::DOUBLE AS cosine FROM embeddings")
def f20_f23_vector_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(v.dot(e.embedding, e.embedding), 6).alias("norm2"), F.round(F.aggregate(v.normalized(e.embedding), F.lit(0.0), lambda a, x: a + x), 6).alias("unit_sum"), v.cosine_of_score(F.lit(0.75)).alias("cosine"))
