"""Text layers of hand-made PDF files: cross-reference tables and streams, packed content, maps to Unicode, damage."""

from __future__ import annotations

import re
import zlib

import pytest

from lorespark.operators import documents, pdf

CMAP = b"/CIDInit /ProcSet findresource begin\n1 begincodespacerange <0000> <FFFF> endcodespacerange\n2 beginbfchar <0001> <00DF> <0002> <D83DDE00> endbfchar\n2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<0066006C> <006F>] endbfrange\nend"


def stream(body: bytes, extra: bytes = b"", packed: bool = True) -> bytes:
    body = zlib.compress(body) if packed else body
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode" if packed else b"", extra, body)


def objects() -> dict[int, bytes]:
    one = b"BT /F1 12 Tf 72 700 Td (Hello \\(nested (parens)\\) W\\366rld) Tj 0 -14 Td [(spl) -10 (it) -300 (words)] TJ T* (third) ' ET q BI /W 1 ID \x00(no)Tj EI Q /X1 Do"
    two = b"BT /F2 9 Tf 1 0 0 1 10 20 Tm <0001000200100011> Tj 1 0 0 1 60 20 Tm <00120020002100FF> Tj ET"
    return {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R 10 0 R] /Count 3 /Resources << /Font << /F1 6 0 R /F2 7 0 R >> /XObject << /X1 9 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R] >>",
        4: stream(one),
        5: stream(two, packed=False),
        6: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
        7: b"<< /Type /Font /Subtype /Type0 /ToUnicode 8 0 R >>",
        8: stream(CMAP),
        9: stream(b"BT /F1 8 Tf (in a form) Tj ET", b"/Type /XObject /Subtype /Form"),
        10: b"<< /Type /Pages /Parent 2 0 R /Kids [11 0 R 12 0 R] /Count 2 >>",
        11: b"<< /Type /Page /Parent 10 0 R /Contents 5 0 R >>",
        12: b"<< /Type /Page /Parent 10 0 R >>",
    }


WANT = ["Hello (nested (parens)) Wörld\nsplit words\nthird\nin a form", "ß\U0001f600AB Cflo", ""]


def with_table(objs: dict[int, bytes]) -> bytes:
    out, at = b"%PDF-1.4\n%\xe2\xe3\n", {}
    for n, body in objs.items():
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (max(objs) + 1) + b"".join(b"%010d 00000 n \n" % at[n] for n in range(1, max(objs) + 1))
    return out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (max(objs) + 1, start)


def with_streams(objs: dict[int, bytes], predictor: bool) -> bytes:
    """Dictionaries in an object stream, places in a cross-reference stream."""
    inner = {n: b for n, b in objs.items() if b"stream" not in b}
    heads, body = b"", b""
    for n, b in inner.items():
        heads += b"%d %d " % (n, len(body))
        body += b + b"\n"
    outer = {n: b for n, b in objs.items() if n not in inner} | {20: stream(heads + body, b"/Type /ObjStm /N %d /First %d" % (len(inner), len(heads)))}
    out, at = b"%PDF-1.7\n", {}
    for n, b in outer.items():
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, b)
    at[21] = len(out)
    rows = []
    for n in range(22):
        kind, a, b = (1, at[n], 0) if n in at else (2, 20, list(inner).index(n)) if n in inner else (0, 0, 0)
        rows.append(bytes([kind]) + a.to_bytes(3, "big") + bytes([b]))
    table = b"".join(rows)
    extra = b"/Type /XRef /W [1 3 1] /Size 22 /Root 1 0 R"
    if predictor:  # each row but the first as differences from the one above
        table = b"".join(bytes([2]) + bytes((x - y) & 255 for x, y in zip(r, rows[i - 1] if i else bytes(5), strict=True)) for i, r in enumerate(rows))
        extra += b" /DecodeParms << /Predictor 12 /Columns 5 >>"
    return out + b"21 0 obj\n" + stream(table, extra) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % at[21]


@pytest.mark.parametrize("raw", [with_table(objects()), with_streams(objects(), False), with_streams(objects(), True)], ids=["table", "streams", "predicted"])
def test_pages_and_text(raw):
    assert pdf.read(raw) == WANT
    # damaged places: objects are looked for
    broken = re.sub(rb"startxref\s+\d+", b"startxref 7", raw)
    assert pdf.read(broken) == WANT


def test_updated_files_hold_the_newest_objects():
    raw = with_table(objects())
    old = int(re.findall(rb"startxref\s+(\d+)", raw)[-1])
    at = len(raw)
    raw += b"4 0 obj\n%s\nendobj\n" % stream(b"BT /F1 1 Tf (new) Tj ET")
    start = len(raw)
    raw += b"xref\n4 1\n%010d 00000 n \ntrailer\n<< /Size 13 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at, old, start)
    assert pdf.read(raw)[0] == "new"


def test_what_is_not_read(spark):
    for bad in (b"", b"hello", b"%PDF-1.4\n1 0 obj << /Type /Catalog >> endobj", with_table(objects())[:200]):
        try:
            assert pdf.read(bad) == []
        except ValueError:
            pass
    with pytest.raises(ValueError, match="encrypted"):
        pdf.read(with_table(objects()).replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 6 0 R"))
    # pages that stand under themselves
    loop = objects() | {2: b"<< /Type /Pages /Kids [2 0 R 3 0 R] >>"}
    assert len(pdf.read(with_table(loop))) == 1


def test_scanned_pages_go_to_the_given_function():
    assert pdf.read(with_table(objects()), lambda raw, page: f"page {page} by eye") == [*WANT[:2], "page 2 by eye"]


def test_units_of_pdf_files(spark):
    f = spark.createDataFrame([(1, bytearray(with_table(objects())), "pdf"), (2, bytearray(b"junk"), "pdf")], "k int, body binary, kind string")
    got = documents.units(f, "k", "body", "kind").orderBy("k", "ordinal").collect()
    assert [(r["kind"], r["body"]) for r in got if r["k"] == 1] == [("page", "Page 1"), *(("paragraph", x) for x in WANT[0].split("\n")), ("page", "Page 2"), ("paragraph", WANT[1]), ("page", "Page 3")]
    assert [r["kind"] for r in got if r["k"] == 2] == ["error"]
