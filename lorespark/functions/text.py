"""Text, identifier and path functions as Spark column expressions: all JVM-side, none a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that don't narrow an English query.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "did", "do", "does", "for", "from", "how", "i", "if", "in", "is", "it", "of", "on", "or",
    "should", "that", "the", "this", "to", "was", "what", "when", "where", "which", "who", "why", "with",
]

# Words that don't count as content of a question (English, then Greek).
QUESTION_WORDS = [
    "the", "and", "for", "are", "was", "were", "with", "that", "this", "what", "when", "where", "which", "who", "how", "why", "does", "did", "has",
    "have", "had", "about", "from", "into", "say", "says", "its", "their", "there", "can", "will", "should", "would", "could", "our", "your", "you",
    "all", "any", "between", "compare", "difference", "differences", "versus", "according", "tell", "me", "explain", "describe", "break", "breaks",
    "change", "changes", "changed", "affect", "affects", "affected", "impact", "happens", "του", "της", "και", "για", "των", "τις", "τον", "την",
    "στο", "στη", "στην", "από", "που", "είναι", "πώς", "ποιος", "ποια",
]

# Names too generic to link by themselves.
COMMON_NAMES = [
    "add", "apply", "build", "call", "check", "clear", "clone", "close", "compare", "config", "copy", "count", "create", "data", "debug", "default",
    "delete", "dispose", "equals", "error", "execute", "find", "format", "get", "handle", "hash", "id", "index", "info", "init", "item", "items",
    "key", "keys", "len", "length", "list", "load", "log", "main", "map", "name", "new", "next", "open", "options", "parse", "process", "read",
    "remove", "reset", "result", "run", "save", "send", "set", "size", "start", "stop", "test", "to_string", "tostring", "type", "update", "validate",
    "value", "warn", "write",
]

# Route decorators and attributes, include attributes of project files, markers that pass for instructions, user information in URLs and addresses.
PYTHON_ROUTE = r"""(?s)^@\s*[\w.]*\.(route|get|post|put|patch|delete|head|options)\s*\(\s*(?:'([^'"]+)'|"([^'"]+)")(.*)"""
PYTHON_METHOD = r"""methods\s*=\s*\[\s*['"](\w+)['"]"""
CSHARP_ROUTE = r"""^(Http(Get|Post|Put|Patch|Delete)|Route)\s*(?:\(\s*(?:'([^'"]*)'|"([^'"]*)")\s*\))?"""
PROJECT_INCLUDE = r"""<(?:ProjectReference|PackageReference)\b[^>]*\bInclude\s*=\s*"([^"]*)\""""
INSTRUCTION_MARKS = r"(?i)(<\s*/?\s*(system|assistant|user|evidence|instructions?)\s*>|\[/?(INST|SYS)\]|<<<|>>>|```|\[E\d+\])"
URL_USER = r"([a-zA-Z][a-zA-Z0-9+.\-]*://)[^\s/@]+@"
BARE_USER = r"(?<![\p{L}\p{N}_/@])[^\s/@:]+:[^\s/@]+@(?=[\p{L}\p{N}_.\-\[])"

WORD_GAP = r"[^\p{L}\p{N}_\p{M}]+"
SEP = "\u001f"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Maximal runs of letters, digits, ``_`` and combining marks."""
    return F.filter(F.split(_col(text), WORD_GAP), lambda x: x != "")


def lower_words(text: Column | str) -> Column:
    return words(F.lower(_col(text)))


# Letters that upper() makes several of, and the one letter that is their capital: ``ß`` and those whose title case is one letter.
_SINGLE = {"ß": "ẞ"} | {c: c.title() for c in map(chr, range(0x10000)) if len(c.upper()) > 1 and len(c.title()) == 1}


def capitalized(word: Column | str) -> Column:
    """A word with its first letter as a capital, one letter for one."""
    c = _col(word)
    first = F.substring(c, 1, 1)
    up = F.upper(first)
    return F.concat(F.when(F.length(up) == 1, up).otherwise(F.translate(first, "".join(_SINGLE), "".join(_SINGLE.values()))), F.substr(c, F.lit(2)))


def split_identifier(name: Column | str) -> Column:
    """Lower-cased parts of one identifier, cut at case changes, letter-digit boundaries and ``_``."""
    c = _col(name)
    c = F.regexp_replace(c, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    c = F.regexp_replace(c, r"(\p{Ll})(\p{Lu})", "$1 $2")
    c = F.regexp_replace(c, r"(\p{L})([0-9])", "$1 $2")
    c = F.regexp_replace(c, r"([0-9])(\p{L})", "$1 $2")
    return F.filter(F.split(F.lower(c), "[ _]+"), lambda x: x != "")


def identifier_words(text: Column | str) -> Column:
    """The words inside a text's identifiers that word splitting alone doesn't separate."""
    pieces = F.flatten(F.transform(words(text), lambda w: F.filter(F.split(w, "_"), lambda p: p != "")))
    parts = F.transform(pieces, split_identifier)
    return F.array_join(F.flatten(F.filter(parts, lambda p: F.size(p) > 1)), " ")


def bare_name(qualified: Column | str) -> Column:
    return F.substring_index(_col(qualified), ".", -1)


def alias_name(qualified: Column | str) -> Column:
    """The last two of at least three dotted segments, else null."""
    parts = F.split(_col(qualified), r"\.")
    return F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, -2, 2), "."))


def file_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def file_candidates(path: Column | str) -> Column:
    """A path's file name and, if it has a suffix, its stem."""
    name = F.regexp_extract(_col(path), r"([^/\\\\]*)$", 1)
    stem = F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)
    return F.filter(F.array(name, stem), lambda x: x != "")


def suffix(path: Column | str) -> Column:
    """Lower-cased from the last dot of the file name; empty if that dot leads or ends the name."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column | str) -> Column:
    name = file_name(path)
    s = F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)
    return F.when(s != "", s).otherwise(name)


def namespace(path: Column | str) -> Column:
    """a/b/c.py as a.b.c."""
    return F.regexp_replace(F.regexp_replace(_col(path), r"\.[^./]+$", ""), "/", ".")


def first_line(text: Column | str, cap: int) -> Column:
    return F.substring(F.split(_col(text), "[\n\u000b\u000c\r\u001c\u001d\u001e\u0085  ]").getItem(0), 1, cap)


def sentences(text: Column | str) -> Column:
    """Cut after ``.``, ``!`` or ``?`` followed by white space."""
    marked = F.regexp_replace(F.trim(_col(text)), r"([.!?])\s+", "$1" + SEP)
    return F.filter(F.split(marked, SEP), lambda x: x != "")


def token_count(text: Column | str) -> Column:
    """Words and single marks; a stand-in unit, as the exact vocabulary isn't published with the engine."""
    return F.size(F.regexp_extract_all(_col(text), F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"), 1))


def normalized(text: Column | str) -> Column:
    """Lower case, white space as single blanks."""
    return F.lower(F.trim(F.regexp_replace(_col(text), r"\s+", " ")))


def content_terms(text: Column | str) -> Column:
    """Distinct lower-cased words of three letters and more that aren't question words, in order."""
    parts = F.split(F.lower(_col(text)), r"[^\p{L}\p{N}_]+")
    return F.array_distinct(F.filter(parts, lambda w: (F.length(w) >= 3) & ~w.isin(QUESTION_WORDS)))


def without_stopwords(tokens: Column) -> Column:
    """tokens without stop words, or all of them if nothing else is left."""
    kept = F.filter(tokens, lambda w: ~w.isin(STOPWORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(tokens)


def looks_like_identifier(token: Column) -> Column:
    return token.contains("_") | token.rlike("[0-9]") | F.substring(token, 2, 1_000_000).rlike(r"\p{Lu}")


def links_by_bare_name(name: Column | str) -> Column:
    c = _col(name)
    return (F.length(c) >= 3) & ~F.lower(c).isin(COMMON_NAMES)


def contains_identifier(text: Column | str, needle: Column | str) -> Column:
    """needle occurs with no word character or dot before it, nor a word character or a dot and a word character after it."""
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}\p{M}_.])\Q"), _col(needle), F.lit(r"\E(?![\p{L}\p{N}\p{M}_]|\.[\p{L}\p{N}\p{M}_])"))
    return F.regexp_like(_col(text), quoted)


def identifiers(text: Column | str) -> Column:
    """Maximal dotted identifiers: a text contains an identifier, as ``contains_identifier`` has it, exactly if this array does."""
    return F.filter(F.split(_col(text), r"[^\p{L}\p{N}\p{M}_.]+|\.(?![\p{L}\p{N}\p{M}_])"), lambda x: (x != "") & ~F.startswith(x, F.lit(".")))


def mentions_route(text: Column | str, path: Column | str) -> Column:
    """path occurs without a word character after it."""
    return F.regexp_like(_col(text), F.concat(F.lit(r"\Q"), _col(path), F.lit(r"\E(?![\p{L}\p{N}_])")))


def route_parts(symbol: Column | str) -> Column:
    """(method, path) of ``http_endpoint:METHOD:path``; null for another symbol or an empty path."""
    c = _col(symbol)
    path = F.regexp_extract(c, "^http_endpoint:[^:]*:(.*)$", 1)
    return F.when(path != "", F.struct(F.regexp_extract(c, "^http_endpoint:([^:]*):", 1).alias("method"), path.alias("path")))


def python_route(decorator: Column | str) -> Column:
    """``http_endpoint:METHOD:path`` of a Python route decorator, or null."""
    c = _col(decorator)
    verb, path = F.regexp_extract(c, PYTHON_ROUTE, 1), F.concat(F.regexp_extract(c, PYTHON_ROUTE, 2), F.regexp_extract(c, PYTHON_ROUTE, 3))
    named = F.regexp_extract(F.regexp_extract(c, PYTHON_ROUTE, 4), PYTHON_METHOD, 1)
    method = F.when(verb != "route", F.upper(verb)).when(named != "", F.upper(named)).otherwise("GET")
    return F.when(verb != "", F.concat(F.lit("http_endpoint:"), method, F.lit(":"), path))


def csharp_route(attribute: Column | str) -> Column:
    """``http_endpoint:METHOD:path`` of a C# route attribute, or null."""
    c = _col(attribute)
    verb = F.regexp_extract(c, CSHARP_ROUTE, 2)
    path = F.concat(F.regexp_extract(c, CSHARP_ROUTE, 3), F.regexp_extract(c, CSHARP_ROUTE, 4))
    return F.when(F.regexp_extract(c, CSHARP_ROUTE, 1) != "", F.concat(F.lit("http_endpoint:"), F.when(verb != "", F.upper(verb)).otherwise("ANY"), F.lit(":"), path))


def decorator_head(text: Column | str) -> Column:
    return F.trim(F.substring_index(F.regexp_replace(_col(text), "^@", ""), "(", 1))


def neutralize(text: Column | str) -> Column:
    """Role and citation markers of retrieved text replaced, so it can't pass for instructions."""
    return F.regexp_replace(_col(text), INSTRUCTION_MARKS, "[removed]")


def redact(text: Column | str) -> Column:
    """URLs without user information, and no bare user:password@host."""
    return F.regexp_replace(F.regexp_replace(_col(text), URL_USER, "$1"), BARE_USER, "")


def redacted_message(text: Column | str, cap: int = 500) -> Column:
    return F.substring(redact(text), 1, cap)


def url_parts(url: Column | str) -> Column:
    c = _col(url)
    return F.struct(*(F.coalesce(F.try_parse_url(c, F.lit(k)), F.lit("")).alias(n) for k, n in (("PROTOCOL", "scheme"), ("AUTHORITY", "authority"), ("HOST", "host"), ("PATH", "path"), ("QUERY", "query"), ("REF", "fragment"))))


def safe_file_name(name: Column | str) -> Column:
    """No control or format characters, no folders, no drive."""
    c = F.regexp_replace(_col(name), r"[\p{C}]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^.*[/\\]", ""), r"^[A-Za-z]:", ""))


def rerank_passage(title: Column, headings: Column, text: Column, cap: int = 256) -> Column:
    head = F.concat_ws(" — ", title, F.when(F.size(headings) > 0, F.array_join(headings, " > ")))
    return F.concat_ws(". ", head, F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, cap), " "))


def snippet(text: Column | str, terms: Column, size: int = 32) -> Column:
    """``size`` words around the first of the terms, with ``...`` where words were left out; the first 280 characters if none occurs."""
    w = F.filter(F.split(_col(text), r"\s+"), lambda x: x != "")
    clean = F.transform(w, lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}_]", "")))
    hits = F.filter(F.transform(clean, lambda x, i: F.when(F.array_contains(terms, x), i)), lambda i: i.isNotNull())
    start = F.greatest(F.lit(0), F.least(hits[0] - size // 2, F.size(w) - size))
    body = F.array_join(F.slice(w, start + 1, size), " ")
    return F.when(F.size(hits) > 0, F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(start + size < F.size(w), "...").otherwise(""))).otherwise(F.substring(_col(text), 1, 280))


def render_table(rows: Column, caption: Column | None = None) -> Column:
    """Cells joined by `` | ``, rows by line feeds, after the caption and a blank line."""
    body = F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")
    return body if caption is None else F.concat_ws("\n\n", F.nullif(caption, F.lit("")), body)


def table_grid(cells: Column, n_rows: Column, n_cols: Column) -> Column:
    """Cells (row, col, text) as dense rows; missing ones are empty."""
    at = F.map_from_entries(F.transform(cells, lambda c: F.struct(F.concat_ws(",", c["row"], c["col"]), c["text"])))
    return F.transform(F.sequence(F.lit(0), n_rows - 1), lambda r: F.transform(F.sequence(F.lit(0), n_cols - 1), lambda c: F.coalesce(F.try_element_at(at, F.concat_ws(",", r, c)), F.lit(""))))


def section_header(title: Column, headings: Column) -> Column:
    return F.concat(F.lit("Document: "), title, F.when(F.size(headings) > 0, F.concat(F.lit("\nSection: "), F.array_join(headings, " > "))).otherwise(""))


def project_references(xml: Column | str) -> Column:
    """Include attributes of ProjectReference and PackageReference elements."""
    return F.regexp_extract_all(_col(xml), F.lit(PROJECT_INCLUDE), 1)


def dependency(text: Column | str) -> Column:
    """(consumer, producer) of ``consumer -> producer``."""
    parts = F.split(_col(text), "->")
    return F.when(F.size(parts) == 2, F.struct(F.trim(parts[0]).alias("consumer"), F.trim(parts[1]).alias("producer")))


def uptime(seconds: Column) -> Column:
    s = seconds.cast("long")
    d, h, m = F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60
    return F.when(s >= 86400, F.format_string("%dd %dh %dm", d, h, m)).when(s >= 3600, F.format_string("%dh %dm", h, m)).when(s >= 60, F.format_string("%dm %ds", m, s % 60)).otherwise(F.format_string("%ds", s))


def percentage(done: Column, planned: Column) -> Column:
    """One decimal, within 0 and 100; null without a plan, 100 if nothing is planned."""
    return F.when(planned == 0, F.lit(100.0)).when(planned.isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(done, F.lit(0)) * 100.0 / planned)), 1))


def parse_time(value: Column | str) -> Column:
    """UTC time of epoch milliseconds, RFC 3339 or plain ISO text; null for anything else."""
    c = F.trim(_col(value))
    return F.when(c.rlike("^[0-9]+$"), F.timestamp_millis(F.regexp_extract(c, "^([0-9]+)$", 1).try_cast("long"))).otherwise(c.try_cast("timestamp"))
