"""Document conversion and chunking."""

from __future__ import annotations

import csv
import email
import email.policy
import html.parser
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import pdf, wordpiece

UNITS = "kind string, level int, body string"


class _Html(html.parser.HTMLParser):
    BLOCKS = {"p", "li", "td", "th", "div", "section", "article", "blockquote", "pre", "dd", "dt", "figcaption"}
    SKIPPED = {"script", "style", "nav", "noscript", "template", "head"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.units, self.text, self.kind, self.level, self.skipped, self.title, self.in_title = [], [], "paragraph", 0, 0, "", False
        self.rows: list[list[str]] | None = None

    def flush(self) -> None:
        body = " ".join("".join(self.text).split())
        self.text = []
        if not body:
            return
        if self.rows is not None:
            self.rows[-1].append(body)
        else:
            self.units.append((self.kind, self.level, body))

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        if tag in self.SKIPPED:
            self.skipped += 1
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.kind, self.level = "heading", int(tag[1])
        elif tag == "table":
            self.flush()
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in self.BLOCKS or tag == "br":
            self.flush()

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in self.SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.kind, self.level = "paragraph", 0
        elif tag == "table" and self.rows is not None:
            rows, self.rows = [r for r in self.rows if r], None
            if rows:
                self.units.append(("table", 0, "\n".join(" | ".join(r) for r in rows)))
        elif tag in self.BLOCKS:
            self.flush()

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skipped and (self.rows is None or self.rows):
            self.text.append(data)


def html_units(body: str) -> tuple[str, list[tuple]]:
    p = _Html()
    p.feed(body)
    p.close()
    p.flush()
    return " ".join(p.title.split()), p.units


def markdown_units(body: str) -> tuple[str, list[tuple]]:
    units, run, table = [], [], []

    def flush() -> None:
        if table:
            rows = [[c.strip() for c in r.strip().strip("|").split("|")] for r in table if not re.fullmatch(r"\s*\|?[\s:|-]+\|?\s*", r)]
            units.append(("table", 0, "\n".join(" | ".join(r) for r in rows)))
        elif run:
            units.append(("paragraph", 0, " ".join(" ".join(run).split())))
        run.clear()
        table.clear()

    for line in body.splitlines():
        m = re.match(r"(#{1,6})\s+(.*?)\s*#*$", line)
        if m:
            flush()
            units.append(("heading", len(m[1]), m[2]))
        elif line.lstrip().startswith("|"):
            if run:
                flush()
            table.append(line)
        elif line.strip():
            if table:
                flush()
            run.append(line.strip())
        else:
            flush()
    flush()
    return next((u[2] for u in units if u[0] == "heading"), ""), units


def text_units(body: str) -> tuple[str, list[tuple]]:
    return "", [("paragraph", 0, " ".join(p.split())) for p in re.split(r"\n\s*\n", body) if p.strip()]


def csv_units(body: str) -> tuple[str, list[tuple]]:
    rows = [r for r in csv.reader(io.StringIO(body)) if r]
    return "", [("table", 0, "\n".join(" | ".join(c.strip() for c in r) for r in rows))] if rows else []


def email_parts(raw: bytes) -> tuple[str, list[tuple], list[tuple]]:
    """(subject, units of the body, attachments as (ordinal, name, type, size, content))."""
    m = email.message_from_bytes(raw, policy=email.policy.default)
    body = m.get_body(("plain", "html"))
    units = []
    if body is not None:
        units = (html_units if body.get_content_type() == "text/html" else text_units)(body.get_content())[1]
    found = []
    for i, part in enumerate(m.iter_attachments()):
        data = part.get_payload(decode=True) or b""
        found.append((i, part.get_filename() or f"attachment-{i}", part.get_content_type(), len(data), data))
    return str(m.get("subject", "")), units, found


def office_units(raw: bytes, kind: str) -> tuple[str, list[tuple]]:
    """Paragraphs and rows of zipped XML documents (docx, pptx, xlsx, odt, ods, odp, epub); text only."""
    units = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = sorted(z.namelist(), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])
        if kind == "epub":
            for n in names:
                if n.endswith((".xhtml", ".html", ".htm")):
                    units += html_units(z.read(n).decode("utf-8", "replace"))[1]
            return "", units
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.itertext()) for t in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        wanted = {"docx": r"word/document\.xml", "pptx": r"ppt/slides/slide\d+\.xml", "xlsx": r"xl/worksheets/sheet\d+\.xml"}.get(kind, r"content\.xml")
        for n in names:
            if not re.fullmatch(wanted, n):
                continue
            for e in ElementTree.fromstring(z.read(n)).iter():
                tag = e.tag.rsplit("}", 1)[-1]
                if kind == "xlsx" and tag == "row":
                    cells = [shared[int(v)] if c.get("t") == "s" else v for c in e if (v := "".join(c.itertext()))]
                    units.append(("table", 0, " | ".join(cells)))
                elif kind != "xlsx" and tag in ("p", "h") and (body := " ".join("".join(e.itertext()).split())):
                    style = next((x.get(k) for x in e.iter() for k in x.attrib if k.endswith("}val") and str(x.get(k)).startswith("Heading")), None)
                    units.append(("heading", int(re.sub(r"\D", "", style) or 1), body) if style else ("heading" if tag == "h" else "paragraph", 1 if tag == "h" else 0, body))
    return "", units


def convert(raw: bytes, kind: str) -> tuple[str, list[tuple]]:
    """(title, units) of a file; kinds without a converter at hand (images) have none.  Each page of a PDF file begins with a unit of kind ``page``, also one without text, so that their number stays known."""
    if kind == "pdf":
        return "", [("page" if j == 0 else "paragraph", 0, body) for i, t in enumerate(pdf.read(raw)) for j, body in enumerate([f"Page {i + 1}", *t.split("\n")]) if body]
    if kind in ("docx", "pptx", "xlsx", "odt", "ods", "odp", "epub"):
        return office_units(raw, kind)
    if kind == "eml":
        return email_parts(raw)[:2]
    by = {"html": html_units, "markdown": markdown_units, "txt": text_units, "csv": csv_units}.get(kind)
    return by(raw.decode("utf-8", "replace")) if by else ("", [])


#: Bytes of a batch that are taken into Python at a time.
PIECE = 1 << 20


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of batches, about PIECE bytes at a time: what is made of them is handed on before more is read."""
    for b in batches:
        step = max(1, b.num_rows * PIECE // max(b.nbytes, PIECE))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step).to_pylist()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def units(files: DataFrame, key: str, content: str, kind: str) -> DataFrame:
    """(key, title, ordinal, kind, level, body, headings): converted files, a row a unit, with the headings it stands under; files that can't be read give one unit of kind ``error``."""
    key_type = files.schema[key].dataType.simpleString()

    schema = f"`{key}` {key_type}, title string, ordinal int, kind string, level int, body string, headings array<string>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            rows = []
            for k, raw, t in ((r[key], r[content], r[kind]) for r in piece):
                raw = raw.encode() if isinstance(raw, str) else bytes(raw or b"")
                try:
                    title, found = convert(raw, t)
                except Exception as e:  # one broken file must not end the run; it becomes a row that says so
                    title, found = "", [("error", 0, f"{type(e).__name__}: {e}"[:500])]
                stack: list[tuple[int, str]] = []
                for i, (kind_of, level, body) in enumerate(found):
                    if kind_of == "heading":
                        stack = [x for x in stack if x[0] < level]
                    rows.append((k, title, i, kind_of, level, body, [x[1] for x in stack]))
                    if kind_of == "heading":
                        stack.append((level, body))
            yield _batch(rows, arrow)

    return files.select(key, content, kind).mapInArrow(run, schema)


def scanned(units_of: DataFrame, key: str, pages: Column) -> DataFrame:
    """(key, scanned): fewer than 50 characters a page, or fewer than half the pages with text."""
    g = units_of.groupBy(key).agg(F.sum(F.length("body")).alias("chars"), F.max(pages).alias("pages"), F.count_distinct(F.when(F.length("body") > 0, pages)).alias("full"))
    return g.select(key, ((F.col("chars") / F.col("pages") < 50) | (2 * F.col("full") < F.col("pages"))).alias("scanned"))


def page_policy(pages: Column, scanned: Column, mode: str = "auto", max_pages: int | None = None) -> Column:
    """What is done with a paged document: ``skipped`` beyond the limit, else ``ocr`` or ``text``, by the mode (off, auto: scanned ones, always)."""
    if mode not in ("off", "auto", "always"):
        raise ValueError(f"no mode: {mode}")
    read = {"off": F.lit("text"), "always": F.lit("ocr"), "auto": F.when(scanned, "ocr").otherwise("text")}[mode]
    return read if max_pages is None else F.when(pages > max_pages, "skipped").otherwise(read)


#: Counts a text's tokens.
Size = Callable[[str], int]


def words_and_signs(body: str) -> int:
    return len(_tokens(body))


def pieces_of(vocabulary: str) -> Size:
    """The word pieces of a text; those of a text asked for again are remembered."""
    model = wordpiece.WordPiece.load(vocabulary)
    return lru_cache(1 << 16)(lambda body: int(model.count([body])[0]))


#: Between a row's cells.
CELL = " | "


def _tokens(body: str) -> list[str]:
    return re.findall(r"\w+|[^\w\s]", body)


def _sentences(body: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+", body.strip()) if s]


def split_by_budget(body: str, most: int, size: Size = words_and_signs) -> list[str]:
    """Pieces of at most ``most`` tokens: by sentences, then words, then within a word; neighbours are packed together again."""
    pieces: list[str] = []
    for s in _sentences(body):
        if size(s) <= most:
            pieces.append(s)
            continue
        for w in s.split():
            pieces += [w] if size(w) <= most else within_word(w, most, size)
    out: list[str] = []
    used = 0
    for p in pieces:
        n = size(p)
        if out and used + n <= most:
            out[-1] += " " + p
            used += n
        else:
            out.append(p)
            used = n
    return out


def within_word(word: str, most: int, size: Size) -> list[str]:
    """A word that is too long by itself, cut so that each part is the longest that fits, one character at least."""
    out = []
    while word:
        k = 1
        # parts of a word hold at least a character a token or are one unknown token
        while k < len(word) and size(word[: k + 1]) <= most:
            k += 1
        out.append(word[:k])
        word = word[k:]
    return out


def pack(pieces: list[str], most: int, overlap: int, least: int, size: Size = words_and_signs) -> list[str]:
    """Pieces packed greedily, each chunk begun with the last pieces of the one before up to ``overlap`` tokens; then, from the first on, a chunk and its successor of which one is under ``least`` are evened out where both still fit."""
    sized = [(p, size(p)) for p in pieces]
    tokens = lambda chunk: sum(n for _, n in chunk)
    chunks: list[list[tuple[str, int]]] = []
    run: list[tuple[str, int]] = []
    for p, n in sized:
        if run and tokens(run) + n > most:
            chunks.append(run)
            seed: list[tuple[str, int]] = []
            for q in reversed(run):
                if tokens(seed) + q[1] > overlap or tokens(seed) + q[1] + n > most:
                    break
                seed = [q, *seed]
            run = seed
        run = [*run, (p, n)]
    if run:
        chunks.append(run)
    for i in range(len(chunks) - 1):
        if min(tokens(chunks[i]), tokens(chunks[i + 1])) < least:
            left, right = halves(chunks[i] + chunks[i + 1])
            if left and right and max(tokens(left), tokens(right)) <= most:
                chunks[i : i + 2] = [left, right]
    return [" ".join(p for p, _ in c) for c in chunks]


def halves(sized: list[tuple[str, int]]) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """(piece, tokens) cut in two: the first half takes pieces, one at least, up to half of all tokens, rounded up."""
    target = (sum(n for _, n in sized) + 1) // 2
    upto, k = 0, 0
    while k < len(sized) and (k == 0 or upto + sized[k][1] <= target):
        upto += sized[k][1]
        k += 1
    return sized[:k], sized[k:]


def split_table(body: str, most: int, size: Size = words_and_signs) -> list[str]:
    """Row groups that fit, each under the first row; a row too long by itself is cut between its cells, and a cell too long by itself within it."""
    head, *rows = body.split("\n")
    h = size(head)
    out, run, used = [], [], h
    for r in rows:
        for p in [r] if h + size(r) <= most else split_row(r, max(1, most - h), size):
            m = size(p)
            if run and used + m > most:
                out.append("\n".join([head, *run]))
                run, used = [], h
            run, used = [*run, p], used + m
    if run or not rows:
        out.append("\n".join([head, *run]))
    return out


def split_row(row: str, most: int, size: Size = words_and_signs) -> list[str]:
    """Pieces of at most ``most`` tokens; put together with ``CELL`` between them, they are the row unless a cell was too long by itself."""
    out: list[str] = []
    used, between = 0, size(CELL)
    for cell in row.split(CELL):
        for p in [cell] if size(cell) <= most else split_by_budget(cell, most, size):
            n = size(p)
            if out and used + between + n <= most:
                out[-1] += CELL + p
                used += between + n
            else:
                out.append(p)
                used = n
    return out


def fit_header(title: str, headings: list[str], most: int, size: Size = words_and_signs) -> str:
    """Title and headings within ``most`` tokens: outer headings go first, then the title, then the end of what is left."""
    kept = list(headings)
    make = lambda t, hs: "\n".join(x for x in ((f"Document: {t}" if t else ""), ("Section: " + " > ".join(hs) if hs else "")) if x)
    while len(kept) > 1 and size(make(title, kept)) > most:
        kept.pop(0)
    text = make(title, kept)
    if size(text) > most:
        text = make("", kept)
    return text if size(text) <= most else (split_by_budget(text, most, size) or [""])[0]


def chunk_document(title: str, rows: list[tuple], most: int = 256, least: int = 60, overlap: int = 40, safety: int = 4, size: Size = words_and_signs) -> list[tuple]:
    """(kind, headings, body, contextual text, tokens): headings and tables by themselves, runs of paragraphs packed; no chunk with its header has over ``most - safety`` tokens."""
    out = []
    run: list[str] = []
    under: list[str] = []

    def emit(kind: str, headings: list[str], body: str, header: str) -> None:
        whole = (header + "\n\n" if header else "") + body
        out.append((kind, headings, body, whole, size(whole)))

    def flush() -> None:
        if run:
            header = fit_header(title, under, (most - safety) // 2, size)
            room = most - safety - size(header)
            pieces = [p for body in run for p in split_by_budget(body, room, size)]
            for c in pack(pieces, room, overlap, least, size):
                emit("paragraph", under, c, header)
        run.clear()

    for kind, headings, body in rows:
        if kind in ("heading", "table") or headings != under:
            flush()
        under = list(headings)
        header = fit_header(title, under, (most - safety) // 2, size)
        room = most - safety - size(header)
        if kind == "heading":
            for c in split_by_budget(body, room, size):
                emit(kind, under, c, header)
        elif kind == "table":
            for c in split_table(body, room, size):
                for d in [c] if size(c) <= room else split_by_budget(c, room, size):
                    emit(kind, under, d, header)
        else:
            run.append(body)
    flush()
    return out


def chunk(units_of: DataFrame, key: str, most: int = 256, least: int = 60, overlap: int = 40, safety: int = 4, vocabulary: str | None = None) -> DataFrame:
    """(key, ordinal, kind, headings, body, contextual, tokens): each document's units(key, title, ordinal, kind, body, headings) as chunks; a document is one row's array, so no group is gathered twice.

    Tokens are words and signs, or, with the path of a ``vocabulary`` that every worker can open, its word pieces.
    """
    key_type = units_of.schema[key].dataType.simpleString()
    docs = units_of.groupBy(key).agg(F.first("title").alias("title"), F.sort_array(F.collect_list(F.struct("ordinal", "kind", "body", "headings"))).alias("rows"))

    schema = f"`{key}` {key_type}, ordinal int, kind string, headings array<string>, body string, contextual string, tokens int"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = words_and_signs if vocabulary is None else pieces_of(vocabulary)
        for piece in _pieces(batches):
            out = []
            for k, title, rows in ((r[key], r["title"], r["rows"]) for r in piece):
                made = chunk_document(title or "", [(r["kind"], list(r["headings"]), r["body"]) for r in rows], most, least, overlap, safety, size)
                out += [(k, i, *c) for i, c in enumerate(made)]
            yield _batch(out, arrow)

    return docs.mapInArrow(run, schema)


def attachments(items: Column, most: int, one: int, total: int) -> Column:
    """Attachments (ordinal, size) in order as (ordinal, size, reason): too_large, too_many or total_exceeded; those left out use up nothing."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"), F.transform(F.slice(items, 1, 0), lambda x: F.struct(x["ordinal"].alias("ordinal"), x["size"].alias("size"), F.lit(None).cast("string").alias("reason"))).alias("out"))

    def step(s: Column, x: Column) -> Column:
        reason = F.when(x["size"] > one, "too_large").when(s["n"] >= most, "too_many").when(s["used"] + x["size"] > total, "total_exceeded")
        ok = reason.isNull()
        row = F.struct(x["ordinal"].alias("ordinal"), x["size"].alias("size"), reason.alias("reason"))
        return F.struct((s["n"] + F.when(ok, 1).otherwise(0)).alias("n"), (s["used"] + F.when(ok, x["size"]).otherwise(0)).cast("long").alias("used"), F.concat(s["out"], F.array(row)).alias("out"))

    return F.aggregate(items, start, step, lambda s: s["out"])
