"""The text layer of PDF files: pages, their content and their fonts' maps to Unicode, with the standard library alone.

Objects are found by the cross-reference tables and streams a file ends with, or, where these are damaged, by looking through it.  What has no text layer is left to a
function that is given the page (``ocr``), as none is at hand.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|[\[\]{}]|/[^\x00\t\n\f\r ()<>\[\]{}/%]*|\((?:\\[\s\S]|[^\\()])*\)|\(|<[0-9A-Fa-f\s]*>|[+-]?(?:\d+\.?\d*|\.\d+)|[^\x00\t\n\f\r ()<>\[\]{}/%]+")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\r\n": b"", b"\n": b"", b"\r": b""}
#: Levels of lists, dictionaries and forms, and bytes that a stream may unpack to.
DEEPEST, LARGEST = 40, 256 << 20


class Name(str):
    pass


class Ref(tuple):
    """(number, generation) of another object."""


class Word(bytes):
    """An operator or keyword."""


class Tokens:
    def __init__(self, raw: bytes, at: int = 0):
        self.raw, self.at = raw, at

    def next(self) -> bytes | None:
        while m := _TOKEN.search(self.raw, self.at):
            self.at = m.end()
            if m[0] == b"(":  # parentheses within
                depth, i = 1, m.end()
                while depth and i < len(self.raw):
                    c = self.raw[i : i + 1]
                    i += 2 if c == b"\\" else 1
                    depth += (c == b"(") - (c == b")")
                self.at = i
                return self.raw[m.start() : i]
            if not m[0].startswith(b"%"):
                return m[0]
        return None

    def value(self, depth: int = 0) -> object:
        """The next object; None at the end, and Word for anything that isn't one."""
        t = self.next()
        if t is None or depth > DEEPEST:
            return None
        if t == b"<<":
            out = {}
            while (k := self.value(depth + 1)) is not None and k != b">>":
                v = self.value(depth + 1)
                if v == b">>" or v is None:
                    break
                if isinstance(k, Name):
                    out[k] = v
            return out
        if t == b"[":
            out = []
            while (v := self.value(depth + 1)) is not None and v != b"]":
                out.append(v)
            return out
        if t[:1] == b"/":
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), t[1:]).decode("latin-1"))
        if t[:1] == b"(":
            return _unescaped(t[1:-1])
        if t[:1] == b"<" and t != b"<<":
            body = re.sub(rb"\s", b"", t[1:-1])
            return bytes.fromhex((body + b"0" * (len(body) % 2)).decode())
        if re.fullmatch(rb"[+-]?\d+", t):
            here = self.at
            if t.isdigit() and (m := re.compile(rb"\s+(\d+)\s+R(?![A-Za-z])").match(self.raw, here)):
                self.at = m.end()
                return Ref((int(t), int(m[1])))
            return int(t)
        if re.fullmatch(rb"[+-]?(?:\d+\.\d*|\.\d+)", t):
            return float(t)
        return {b"true": True, b"false": False}.get(t, Word(t))


def _unescaped(body: bytes) -> bytes:
    return re.sub(rb"\\(\r\n|[0-7]{1,3}|[\s\S])", lambda m: _ESCAPES.get(m[1]) if m[1] in _ESCAPES else bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][:1] < b"8" else m[1], body)


class Pdf:
    def __init__(self, raw: bytes):
        self.raw = raw
        self.places: dict[int, tuple] = {}
        self.trailer: dict = {}
        self.known: dict[int, object] = {}
        try:
            self._cross_references()
            if not isinstance(self.get(self.get(self.trailer.get("Root"), {}).get("Pages")), dict):
                raise ValueError("no pages")
        except (ValueError, KeyError, TypeError, IndexError, AttributeError, zlib.error, RecursionError):
            self.known.clear()
            self._look_through()
        if "Encrypt" in self.trailer:
            raise ValueError("the file is encrypted")

    # ---- objects ----

    def _cross_references(self) -> None:
        at = int(re.findall(rb"startxref\s+(\d+)", self.raw)[-1])
        seen = set()
        while at is not None and at not in seen:
            seen.add(at)
            if m := re.compile(rb"\s*xref\s+").match(self.raw, at):
                at = m.end()
                while m := re.compile(rb"\s*(\d+)\s+(\d+)\s*\r?\n?").match(self.raw, at):
                    first, n, at = int(m[1]), int(m[2]), m.end()
                    for i in range(n):
                        e = re.compile(rb"\s*(\d{10})\s(\d{5})\s([nf])").match(self.raw, at)
                        at = e.end()
                        if e[3] == b"n":
                            self.places.setdefault(first + i, ("at", int(e[1])))
                here = Tokens(self.raw, re.compile(rb"\s*trailer").match(self.raw, at).end()).value()
            else:
                here, body = self._stream_at(at)
                w = [int(x) for x in here["W"]]
                index = here.get("Index") or [0, here["Size"]]
                rows = iter(range(0, len(body) - sum(w) + 1, sum(w)))
                for first, n in zip(index[::2], index[1::2], strict=True):
                    for i in range(n):
                        k = next(rows)
                        kind, a, b = (int.from_bytes(body[k + sum(w[:j]) : k + sum(w[: j + 1])], "big") if w[j] else (j == 0) for j in range(3))
                        if kind in (1, 2):
                            self.places.setdefault(first + i, ("at", a) if kind == 1 else ("in", a, b))
            self.trailer = here | self.trailer
            if isinstance(also := here.get("XRefStm"), int):
                self.trailer["Prev"] = here.get("Prev")
                at = also
                continue
            at = here.get("Prev")

    def _look_through(self) -> None:
        self.places = {int(m[1]): ("at", m.start()) for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", self.raw)}
        for m in re.finditer(rb"trailer", self.raw):
            t = Tokens(self.raw, m.end()).value()
            self.trailer |= t if isinstance(t, dict) else {}
        for number in list(self.places):
            try:
                d, body = self._stream_at(self.places[number][1])
            except (ValueError, zlib.error, TypeError):
                continue
            if d.get("Type") == "ObjStm":
                heads = Tokens(body)
                for i in range(int(self.get(d.get("N"), 0))):
                    inner = heads.value()
                    heads.value()
                    if isinstance(inner, int):
                        self.places.setdefault(inner, ("in", number, i))
            elif d.get("Type") == "XRef":
                self.trailer |= {k: v for k, v in d.items() if k in ("Root", "Encrypt", "Info")}
        if "Root" not in self.trailer:
            root = next((n for n in self.places if isinstance(o := self.get(Ref((n, 0))), dict) and o.get("Type") == "Catalog"), None)
            if root is None:
                raise ValueError("this is no PDF file")
            self.trailer["Root"] = Ref((root, 0))

    def _stream_at(self, at: int) -> tuple[dict, bytes]:
        """(dictionary, unpacked body) of the stream at a place."""
        m = re.compile(rb"\s*(\d+)\s+\d+\s+obj").match(self.raw, at)
        if not m:
            raise ValueError(f"no object at {at}")
        t = Tokens(self.raw, m.end())
        d = t.value()
        s = re.compile(rb"\s*stream(?:\r\n|\n|\r)?").match(self.raw, t.at)
        if not isinstance(d, dict) or not s:
            raise ValueError(f"no stream at {at}")
        length = self.get(d.get("Length"))
        end = s.end() + length if isinstance(length, int) else -1
        if end < 0 or not re.compile(rb"\s*endstream").match(self.raw, end):
            end = self.raw.find(b"endstream", s.end())
            end = len(self.raw) if end < 0 else end
        return d, self._unpacked(d, self.raw[s.end() : end])

    def _unpacked(self, d: dict, body: bytes) -> bytes:
        filters, parms = self.get(d.get("Filter"), []), self.get(d.get("DecodeParms"), {})
        filters = filters if isinstance(filters, list) else [filters]
        parms = parms if isinstance(parms, list) else [parms] * len(filters)
        for f, p in zip(filters, [*parms, *[{}] * len(filters)]):
            f, p = self.get(f), self.get(p) or {}
            if f in ("FlateDecode", "Fl"):
                body = zlib.decompressobj().decompress(body, LARGEST)
                if (p.get("Predictor") or 1) >= 10:
                    body = _unpredicted(body, (p.get("Columns") or 1) * (p.get("Colors") or 1) * (p.get("BitsPerComponent") or 8) + 7 >> 3)
            elif f in ("ASCIIHexDecode", "AHx"):
                body = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", body.split(b">")[0]).decode().ljust(2, "0"))
            else:
                raise ValueError(f"streams packed by {f} are not read")
        return body

    def get(self, x: object, default: object = None) -> object:
        """What a reference stands for; anything else as it is, and ``default`` for nothing."""
        for _ in range(DEEPEST):
            if not isinstance(x, Ref):
                break
            if x[0] not in self.known:
                self.known[x[0]] = None  # for an object that stands for itself
                self.known[x[0]] = self._object(x[0])
            x = self.known[x[0]]
        return default if x is None else x

    def _object(self, number: int) -> object:
        place = self.places.get(number)
        if place is None:
            return None
        if place[0] == "at":
            m = re.compile(rb"\s*\d+\s+\d+\s+obj").match(self.raw, place[1])
            return Tokens(self.raw, m.end()).value() if m else None
        d, body = self._stream_at(self.places[place[1]][1])
        heads = Tokens(body)
        offsets = [(heads.value(), heads.value()) for _ in range(int(self.get(d["N"])))]
        at = next((o for n, o in offsets if n == number), None)
        return None if at is None else Tokens(body, self.get(d["First"]) + at).value()

    def stream(self, ref: object) -> bytes:
        if not isinstance(ref, Ref) or ref[0] not in self.places or self.places[ref[0]][0] != "at":
            return b""
        return self._stream_at(self.places[ref[0]][1])[1]

    # ---- pages ----

    def pages(self) -> list[dict]:
        out: list[dict] = []
        seen: set = set()

        def walk(ref: object, inherited: dict, depth: int) -> None:
            node = self.get(ref)
            if not isinstance(node, dict) or depth > DEEPEST or (isinstance(ref, Ref) and ref in seen):
                return
            seen.add(ref if isinstance(ref, Ref) else id(node))
            have = inherited | {k: v for k, v in node.items() if k == "Resources"}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                for kid in kids:
                    walk(kid, have, depth + 1)
            else:
                out.append(have | node)

        walk(self.get(self.trailer.get("Root"), {}).get("Pages"), {}, 0)
        return out

    def text(self, page: dict) -> str:
        """A page's lines, in the order in which they are drawn."""
        contents = self.get(page.get("Contents"))
        refs = contents if isinstance(contents, list) else [page.get("Contents")]
        drawn = Drawn(self)
        drawn.run(b"\n".join(self.stream(r) for r in refs), self.get(page.get("Resources"), {}), 0)
        lines = (" ".join(x.split()) for x in "".join(drawn.out).split("\n"))
        return "\n".join(x for x in lines if x)


def _unpredicted(body: bytes, width: int) -> bytes:
    """Rows without their PNG filters."""
    out, before = bytearray(), bytearray(width)
    for i in range(0, len(body) - width, width + 1):
        kind, row = body[i], bytearray(body[i + 1 : i + 1 + width])
        for j in range(width) if kind else ():
            left, up, corner = row[j - 1] if j else 0, before[j], before[j - 1] if j else 0
            near = left + up - corner
            paeth = min((abs(near - left), 0, left), (abs(near - up), 1, up), (abs(near - corner), 2, corner))[2]
            row[j] = row[j] + (left, up, (left + up) // 2, paeth)[kind - 1] & 255
        out += row
        before = row
    return bytes(out)


class Font:
    """Codes of one or two bytes to text, by the font's own map or else as Windows' Latin letters."""

    def __init__(self, pdf: Pdf, font: dict):
        self.map: dict[bytes, str] = {}
        self.wide = font.get("Subtype") == "Type0"
        if isinstance(font.get("ToUnicode"), Ref):
            self._read(pdf.stream(font["ToUnicode"]))
        encoding = pdf.get(font.get("Encoding"), {})
        code = 0
        for x in pdf.get(encoding.get("Differences"), []) if isinstance(encoding, dict) else []:
            if isinstance(x, int):
                code = x
            else:
                if (c := _glyph(str(x))) is not None:
                    self.map.setdefault(bytes([code & 255]), c)
                code += 1

    def _read(self, body: bytes) -> None:
        t, stack = Tokens(body), []
        spell = lambda b: b.decode("utf-16-be", "replace")
        while (v := t.value()) is not None:
            if v == b"endcodespacerange" and stack:
                self.wide = any(isinstance(x, bytes) and not isinstance(x, Word) and len(x) == 2 for x in stack)
            elif v == b"endbfchar":
                for a, b in zip(stack[::2], stack[1::2]):
                    self.map[a] = spell(b)
            elif v == b"endbfrange":
                for a, b, c in zip(stack[::3], stack[1::3], stack[2::3]):
                    low, high = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                    for i in range(min(high - low + 1, 1 << 16)):
                        to = c[i] if isinstance(c, list) and i < len(c) else b"" if isinstance(c, list) else (int.from_bytes(c, "big") + i).to_bytes(len(c), "big")
                        self.map[(low + i).to_bytes(len(a), "big")] = spell(to)
            if isinstance(v, Word):
                stack = []
            else:
                stack.append(v)

    def text(self, codes: bytes) -> str:
        n = 2 if self.wide else 1
        parts = [codes[i : i + n] for i in range(0, len(codes), n)]
        return "".join(self.map[p] if p in self.map else "" if self.wide else p.decode("cp1252", "replace") for p in parts)


def _glyph(name: str) -> str | None:
    if m := re.fullmatch(r"uni([0-9A-Fa-f]{4})|u([0-9A-Fa-f]{4,6})", name):
        return chr(int(m[1] or m[2], 16))
    return name if len(name) == 1 else {"space": " ", "fi": "fi", "fl": "fl", "hyphen": "-", "period": ".", "comma": ","}.get(name)


class Drawn:
    """What a content stream writes, line by line: a new line where the pen moves up or down, a blank where it skips."""

    def __init__(self, pdf: Pdf):
        self.pdf, self.out = pdf, []
        self.fonts: dict[int, Font] = {}
        self.font: Font | None = None
        self.height = None

    def show(self, x: object) -> None:
        if isinstance(x, bytes) and self.font:
            self.out.append(self.font.text(x))

    def run(self, body: bytes, resources: dict, depth: int) -> None:
        if depth > 8:
            return
        t, stack = Tokens(body), []
        fonts, forms = (self.pdf.get(resources.get(k), {}) for k in ("Font", "XObject"))
        while (v := t.value()) is not None:
            if not isinstance(v, Word):
                stack.append(v)
                continue
            if v == b"Tf" and len(stack) > 1:
                font = self.pdf.get(fonts.get(stack[-2]))
                if isinstance(font, dict):
                    self.font = self.fonts.setdefault(id(font), Font(self.pdf, font)) if id(font) not in self.fonts else self.fonts[id(font)]
            elif v in (b"Td", b"TD") and len(stack) > 1:
                self.out.append("\n" if stack[-1] else " ")
            elif v == b"Tm" and len(stack) > 5:
                self.out.append(" " if stack[-1] == self.height else "\n")
                self.height = stack[-1]
            elif v in (b"T*", b"ET"):
                self.out.append("\n")
            elif v == b"Tj" and stack:
                self.show(stack[-1])
            elif v in (b"'", b'"') and stack:
                self.out.append("\n")
                self.show(stack[-1])
            elif v == b"TJ" and stack and isinstance(stack[-1], list):
                for x in stack[-1]:
                    if isinstance(x, int | float) and x < -200:
                        self.out.append(" ")
                    self.show(x)
            elif v == b"Do" and stack and isinstance(stack[-1], Name):
                ref = forms.get(stack[-1])
                form = self.pdf.get(ref)
                if isinstance(form, dict) and form.get("Subtype") == "Form":
                    self.run(self.pdf.stream(ref), self.pdf.get(form.get("Resources"), resources), depth + 1)
            elif v == b"ID":  # an image within the content
                end = body.find(b"EI", t.at)
                t.at = len(body) if end < 0 else end + 2
            stack = []


def read(raw: bytes, ocr: Callable[[bytes, int], str] | None = None) -> list[str]:
    """The text of each page; of a page without any, what ``ocr`` makes of (file, page number)."""
    pdf = Pdf(raw)
    texts = [pdf.text(p) for p in pdf.pages()]
    return [t or (ocr(raw, i) if ocr else "") for i, t in enumerate(texts)]
